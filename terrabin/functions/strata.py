"""The packed stratum key and its relatives as bit expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dimension: (bit, width); veg has radix 6, and alt follows as a multiple of ALT_STRIDE.
BITS = {"bb": (0, 2), "wb": (2, 2), "h": (4, 2), "cover": (6, 4), "cb": (10, 2), "eb": (12, 2), "rb": (14, 2), "vb": (16, 2), "veg": (18, 3)}
ALT_STRIDE = 1572864
COAST_RIVER, HEIGHT = 3072 | 196608, 48
BASES, QUERY_STRIDE = 24576, 512
#: Key bits kept by a compact base, with their place there.
COMPACT = ((0, 4, 0), (6, 4, 4), (12, 2, 8), (14, 2, 10), (18, 3, 12))


def pack(**dims: Column) -> Column:
    out = F.lit(0).cast("bigint")
    for name, (bit, _) in BITS.items():
        if name in dims:
            out = out + F.shiftleft(dims[name].cast("bigint"), bit)
    return out + dims["alt"].cast("bigint") * ALT_STRIDE if "alt" in dims else out


def unpack(k: Column) -> dict[str, Column]:
    low = k % ALT_STRIDE
    out = {name: F.shiftright(low, bit).bitwiseAND(F.lit((1 << width) - 1)) for name, (bit, width) in BITS.items()}
    return out | {"alt": F.floor(k / ALT_STRIDE).cast("bigint")}


def public_stratum(k: Column, elevation: bool = False) -> Column:
    return k.bitwiseAND(F.lit(~(COAST_RIVER | (0 if elevation else HEIGHT))).cast("bigint"))


def _moved(k: Column, parts) -> Column:
    out = F.lit(0).cast("bigint")
    for source, width, target in parts:
        out = out.bitwiseOR(F.shiftleft(F.shiftright(k, source).bitwiseAND(F.lit((1 << width) - 1)), target))
    return out


def compact_base(k: Column) -> Column:
    """Built, water, cover, edge, rice and vegetation in 15 bits."""
    return _moved(k.cast("bigint"), COMPACT)


def source_key(b: Column) -> Column:
    return _moved(b.cast("bigint"), [(target, width, source) for source, width, target in COMPACT])


def query_key(signature: Column, elevation_bin: Column, cover: Column) -> Column:
    return F.when(signature == 0, 0).otherwise(signature * QUERY_STRIDE + elevation_bin * 16 + cover).cast("bigint")
