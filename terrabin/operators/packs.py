"""The shape of delivery manifests and packs, checked in JSON text: where each fault is, and why.

A schema is a small tree.  A manifest is parsed to the type that the schema names, every field as text, so that a number in
place of a text, or a missing object, is told by its value; each leaf gives a (path, reason) or null, and maps are walked
by their entries.  Packs hold many rows of numbers and are unfolded to rows first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NONE = "cast(array() as array<struct<path: string, reason: string>>)"


def _fault(path: Column, reason: str, wrong: Column) -> Column:
    return F.when(wrong, F.array(F.struct(path.alias("path"), F.lit(reason).alias("reason")))).otherwise(F.expr(_NONE))


@dataclass
class Text:
    """A text that a pattern accepts; {prefix} in it is the place's own, so braces are doubled."""

    pattern: str

    def kind(self) -> str:
        return "string"

    def faults(self, value: Column, path: Column, prefix: Column) -> Column:
        before, _, after = self.pattern.partition("{prefix}")
        parts = [F.lit(before.format())] + ([prefix, F.lit(after.format())] if after else [])
        fits = F.call_function("regexp_like", value, F.concat(*parts))
        return F.concat(_fault(path, "missing", value.isNull()), _fault(path, "pattern", value.isNotNull() & ~fits))


@dataclass
class Whole:
    """A whole number between bounds."""

    low: int
    high: int

    def kind(self) -> str:
        return "string"

    def faults(self, value: Column, path: Column, prefix: Column) -> Column:
        whole = F.call_function("regexp_like", value, F.lit("^(0|-?[1-9][0-9]{0,17})$"))
        inside = F.when(whole, value).cast("bigint").between(self.low, self.high)
        return F.concat(_fault(path, "missing", value.isNull()), _fault(path, "not whole", value.isNotNull() & ~whole), _fault(path, "range", whole & ~inside))


class Fields:
    """An object of named fields."""

    def __init__(self, **fields):
        self.fields = fields

    def kind(self) -> str:
        return "struct<" + ", ".join(f"{k}: {v.kind()}" for k, v in self.fields.items()) + ">"

    def faults(self, value: Column, path: Column, prefix: Column) -> Column:
        at = lambda k: F.when(path == "", F.lit(k)).otherwise(F.concat(path, F.lit("." + k)))
        inner = F.concat(*(v.faults(value[k], at(k), prefix) for k, v in self.fields.items()))
        return F.when(value.isNull(), F.array(F.struct(path.alias("path"), F.lit("missing").alias("reason")))).otherwise(inner)


class Info(Fields):
    """A file's entry: its name bears the prefix ({key}: the entry's key) and the digest's first characters."""

    def __init__(self, prefix: str, **more):
        super().__init__(file=Text(r"^{prefix}-[a-f0-9]{{12}}\.json\.gz$"), sha256=Text("^[a-f0-9]{{64}}$"), bytes=Whole(1, 26214400), decodedBytes=Whole(1, 64000000), **more)
        self.prefix = prefix

    def faults(self, value: Column, path: Column, prefix: Column) -> Column:
        before, _, after = self.prefix.partition("{key}")
        own = F.concat(F.lit(before), prefix, F.lit(after)) if "{key}" in self.prefix else F.lit(self.prefix)
        named = F.substring(value["sha256"], 1, 12) != F.call_function("regexp_extract", value["file"], F.lit(r"([a-f0-9]{12})\.json\.gz$"), F.lit(1))
        sound = F.size(Fields(**{k: self.fields[k] for k in ("file", "sha256")}).faults(value, path, own)) == 0
        return F.concat(super().faults(value, path, own), _fault(F.concat(path, F.lit(".file")), "digest", F.coalesce(sound & named, F.lit(False))))


@dataclass
class Each:
    """An object whose keys a pattern accepts and whose values share a schema."""

    value: Fields
    keys: str

    def kind(self) -> str:
        return f"map<string, {self.value.kind()}>"

    def faults(self, value: Column, path: Column, prefix: Column) -> Column:
        def entry(e: Column) -> Column:
            at = F.concat(path, F.lit("."), e["key"])
            return F.concat(_fault(at, "key", ~F.call_function("regexp_like", e["key"], F.lit(self.keys))), self.value.faults(e["value"], at, e["key"]))

        return F.when(value.isNull(), F.array(F.struct(path.alias("path"), F.lit("missing").alias("reason")))).otherwise(F.flatten(F.transform(F.map_entries(value), entry)))


def faults(rows: DataFrame, column: str, schema: Fields, *keys: str) -> DataFrame:
    """(keys, path, reason) of every fault in a column of JSON texts; a text that is no object is missing as a whole."""
    found = schema.faults(F.col("_value"), F.lit(""), F.lit(""))
    parsed = rows.select(*keys, F.from_json(column, schema.kind()).alias("_value"))
    return parsed.select(*keys, F.explode(found).alias("fault")).select(*keys, "fault.path", "fault.reason")


@dataclass
class Rows:
    """Bounds of a pack's cells [gx, gy, pref, [key, count, ...]]; keys rise."""

    gx: tuple[int, int]
    gy: tuple[int, int]
    pref: tuple[int, int]
    key: tuple[int, int]
    count: tuple[int, int]


def pack_faults(rows: DataFrame, column: str, bounds: Rows, *keys: str) -> DataFrame:
    """(keys, cell, field, value) of each number of a pack that is out of bounds, keys that do not rise (order), and cells of
    another form (cell)."""
    parsed = rows.select(*keys, F.posexplode(F.from_json(column, "struct<cells: array<array<string>>>")["cells"]).alias("cell", "v"))
    flat = F.from_json(F.get("v", F.lit(3)), "array<bigint>")
    parsed = parsed.withColumn("flat", flat)
    number = lambda i: F.get("v", F.lit(i)).try_cast("bigint")
    fault = lambda field, value: F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"))
    out = lambda v, b: ~F.coalesce(v.between(*b), F.lit(False))
    head = [F.when(out(number(i), getattr(bounds, f)), fault(f, F.get("v", F.lit(i)))) for i, f in enumerate(("gx", "gy", "pref"))]
    form = F.when((F.size("v") != 4) | F.col("flat").isNull() | (F.size("flat") % 2 != 0), fault("cell", F.col("cell")))

    def pair(i: Column) -> Column:
        k, n = F.get("flat", i * 2), F.get("flat", i * 2 + 1)
        rises = F.when(i > 0, k > F.get("flat", i * 2 - 2)).otherwise(True)
        return F.array_compact(F.array(F.when(out(k, bounds.key), fault("key", k)), F.when(out(n, bounds.count), fault("count", n)), F.when(~rises, fault("order", k))))

    pairs = F.when(F.size("flat") > 1, F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size("flat") / 2).cast("int") - 1), pair)))
    all_ = F.concat(F.array_compact(F.array(form, *head)), F.coalesce(pairs, F.expr("cast(array() as array<struct<field: string, value: string>>)")))
    return parsed.select(*keys, "cell", F.explode(all_).alias("f")).select(*keys, "cell", "f.field", "f.value")
