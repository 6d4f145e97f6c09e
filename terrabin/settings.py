"""Query settings, checked on the driver before any plan is built."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

DISTANCES = (100, 250, 500)
MODELS = ("distance", "elevation", "cover")
DEFAULT_THRESHOLDS = (200, 800)
STEP, LIMIT = 100, 3000


def thresholds(low, mountain) -> tuple[int, int]:
    """Altitude thresholds in metres; anything that is no ordered pair of whole hundreds in range gives the default."""
    try:
        low, mountain = float(low), float(mountain)
    except (TypeError, ValueError):
        return DEFAULT_THRESHOLDS
    whole = all(x == x and x not in (float("inf"), float("-inf")) and x == int(x) and x % STEP == 0 for x in (low, mountain))
    if whole and STEP <= low < LIMIT and low < mountain <= LIMIT:
        return int(low), int(mountain)
    return DEFAULT_THRESHOLDS


def excluded_classes(value) -> tuple[int, ...]:
    """Sorted distinct cover classes 1..15 of a list or of text like 8.6; anything else in it is ignored."""
    parts = str(value or "").split(".") if not isinstance(value, (list, tuple, set)) else map(str, value)
    return tuple(sorted({int(p) for p in parts if re.fullmatch(r"[1-9]|1[0-5]", p)}))


@dataclass(frozen=True)
class QuerySettings:
    region: str = "all"
    pref: int | None = None
    scope: str = "recorded"
    model: str = "distance"
    distance: int = 500
    excluded: tuple[int, ...] = ()
    #: species_id to its selected rules; a missing species selects all, an empty list none
    habitats: dict = field(default_factory=dict)
    low: int = DEFAULT_THRESHOLDS[0]
    mountain: int = DEFAULT_THRESHOLDS[1]
    #: strata carry 100 m altitude bins
    fine: bool = False

    def __post_init__(self) -> None:
        if self.model not in MODELS:
            raise ValueError(f"unknown model {self.model}")
        if self.model != "cover" and self.distance not in DISTANCES:
            raise ValueError(f"distance must be one of {DISTANCES}")
        if self.scope not in ("recorded", "environment"):
            raise ValueError(f"unknown scope {self.scope}")
        object.__setattr__(self, "excluded", excluded_classes(self.excluded))
        low, mountain = thresholds(self.low, self.mountain)
        object.__setattr__(self, "low", low)
        object.__setattr__(self, "mountain", mountain)

    @property
    def limit(self) -> int:
        """The largest distance bin that counts as near."""
        return DISTANCES.index(self.distance)


PUBLIC, PUBLIC_ELEVATION, PREVIEW = "public", "public-elevation", "local-preview"


def publication_profile(edition: str, dem: bool, local_only: bool, approved: bool = False, allow_preview: bool = False) -> dict:
    """Which layers an edition may publish; inconsistent descriptions are errors."""
    if edition == PUBLIC and not dem and not local_only:
        return {"elevation": False, "preview": False}
    if edition == PREVIEW and allow_preview and dem and local_only:
        return {"elevation": True, "preview": True}
    if edition == PUBLIC_ELEVATION and dem and not local_only and approved:
        return {"elevation": True, "preview": False}
    raise ValueError("the edition's layers, place and approval do not agree")


def approval(record: dict) -> dict:
    """Checks an approval's fields and returns the known ones."""
    wanted = {"status": r"approved", "number": r"[^<>\r\n]{1,100}", "issued_on": r"\d{4}-\d{2}-\d{2}", "receipt_sha256": r"[a-f0-9]{64}"}
    if any(not re.fullmatch(p, str(record.get(k, ""))) for k, p in wanted.items()) or not str(record.get("number", "")).strip():
        raise ValueError("approval is incomplete")
    if record["number"] not in str(record.get("attribution", "")):
        raise ValueError("attribution must hold the approval's number")
    return {k: record[k] for k in (*wanted, "attribution")}
