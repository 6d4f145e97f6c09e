"""Tiled TIFF rasters: a writer by pixels, and a data source whose rows are windows of aligned layers.

A layer is a folder of square files of one size, each a TIFF of deflated square blocks with its place in it; files are
written by tasks of their own, under a name that appears when the file is whole.  The source's partitions are windows:
a task opens the files that a window and its halo meet, reads the blocks in reach alone, and gives places without a file
the layer's fill value.  Folders must be mounted on every machine (file: paths), as Spark's own readers take files whole.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terrabin.shipping import ship

#: TIFF tags and field types; fixed values.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, TILE_WIDTH, TILE_LENGTH, OFFSETS, COUNTS, FORMAT, SCALE, TIEPOINT = 256, 257, 258, 259, 262, 277, 322, 323, 324, 325, 339, 33550, 33922
_FIELD = {3: "H", 4: "I", 12: "d", 16: "Q"}
_FORMAT = {"u": 1, "i": 2, "f": 3}
DEFLATE = 8


def local(path: str) -> str:
    """The mounted folder of a path."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme != "file":
        raise ValueError(f"rasters need a mounted folder, not {path}")
    return "/" + rest.lstrip("/") if colon else path


def write_tiff(path: str, values: np.ndarray, block: int, x0: int, y0: int) -> None:
    """values (rows from y0 on, columns from x0 on) in square blocks; pixels are of side 1."""
    high, wide = values.shape
    blocks = [np.ascontiguousarray(np.pad(values[r : r + block, c : c + block], [(0, max(0, r + block - high)), (0, max(0, c + block - wide))])) for r in range(0, high, block) for c in range(0, wide, block)]
    data = [zlib.compress(b.astype(values.dtype.newbyteorder("<")).tobytes(), 6) for b in blocks]
    starts = np.cumsum([8, *map(len, data)])
    fields = [
        (WIDTH, 4, [wide]), (LENGTH, 4, [high]), (BITS, 3, [values.dtype.itemsize * 8]), (COMPRESSION, 3, [DEFLATE]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]),
        (TILE_WIDTH, 4, [block]), (TILE_LENGTH, 4, [block]), (OFFSETS, 4, starts[:-1].tolist()), (COUNTS, 4, list(map(len, data))), (FORMAT, 3, [_FORMAT[values.dtype.kind]]),
        (SCALE, 12, [1.0, 1.0, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, float(x0), float(y0), 0.0]),
    ]
    at = int(starts[-1]) + int(starts[-1]) % 2
    extra_at, directory, extra = at + 2 + 12 * len(fields) + 4, b"", b""
    for tag, kind, v in fields:
        packed = struct.pack(f"<{len(v)}{_FIELD[kind]}", *v)
        if len(packed) > 4:
            packed, extra = struct.pack("<I", extra_at + len(extra)), extra + packed
        directory += struct.pack("<HHI", tag, kind, len(v)) + packed.ljust(4, b"\0")
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(struct.pack("<2sHI", b"II", 42, at) + b"".join(data))
        f.seek(at)
        f.write(struct.pack("<H", len(fields)) + directory + struct.pack("<I", 0) + extra)
    os.replace(part, path)


class Tiff:
    """The directory of a tiled TIFF, and windows of it; opened counts the blocks that were read."""

    def __init__(self, path: str):
        self.path, self.opened = path, 0
        with open(path, "rb") as f:
            order, magic, at = struct.unpack("<2sHI", f.read(8))
            if order != b"II" or magic != 42:
                raise ValueError(f"not a little-endian TIFF: {path}")
            f.seek(at)
            (n,) = struct.unpack("<H", f.read(2))
            entries = [struct.unpack("<HHI4s", f.read(12)) for _ in range(n)]
            tags = {}
            for tag, kind, count, raw in entries:
                if kind not in _FIELD:
                    continue
                form = f"<{count}{_FIELD[kind]}"
                if struct.calcsize(form) > 4:
                    f.seek(struct.unpack("<I", raw)[0])
                    raw = f.read(struct.calcsize(form))
                tags[tag] = struct.unpack_from(form, raw)
        if tags.get(COMPRESSION) != (DEFLATE,) or TILE_WIDTH not in tags or tags.get(SAMPLES, (1,)) != (1,):
            raise ValueError(f"not one layer of deflated blocks: {path}")
        self.width, self.height, self.block = tags[WIDTH][0], tags[LENGTH][0], tags[TILE_WIDTH][0]
        self.dtype = np.dtype(f"<{ {v: k for k, v in _FORMAT.items()}[tags[FORMAT][0]] }{tags[BITS][0] // 8}")
        self.x0, self.y0 = int(tags[TIEPOINT][3]), int(tags[TIEPOINT][4])
        self.grid = (self.width, self.height, self.block, tags[TIEPOINT], tags[SCALE])
        self._offsets, self._counts = tags[OFFSETS], tags[COUNTS]

    def read_into(self, out: np.ndarray, west: int, south: int) -> None:
        """Fills out, a window that begins at (west, south), where this file has pixels."""
        across = -(-self.width // self.block)
        c0, c1 = max(west - self.x0, 0), min(west - self.x0 + out.shape[1], self.width)
        r0, r1 = max(south - self.y0, 0), min(south - self.y0 + out.shape[0], self.height)
        if c0 >= c1 or r0 >= r1:
            return
        with open(self.path, "rb") as f:
            for br in range(r0 // self.block, (r1 - 1) // self.block + 1):
                for bc in range(c0 // self.block, (c1 - 1) // self.block + 1):
                    k = br * across + bc
                    f.seek(self._offsets[k])
                    values = np.frombuffer(zlib.decompress(f.read(self._counts[k])), self.dtype).reshape(self.block, self.block)
                    self.opened += 1
                    a, b = max(br * self.block, r0), min((br + 1) * self.block, r1)
                    c, d = max(bc * self.block, c0), min((bc + 1) * self.block, c1)
                    oy, ox = self.y0 - south, self.x0 - west
                    out[a + oy : b + oy, c + ox : d + ox] = values[a - br * self.block : b - br * self.block, c - bc * self.block : d - bc * self.block]


def _name(fx: int, fy: int) -> str:
    return f"{fx}_{fy}.tif"


def write_layer(pixels: DataFrame, column: str, path: str, fill: float, kind: str, side: int = 4096, block: int = 256) -> int:
    """pixels (x, y, column) as a layer of files of side pixels, one task a file; other places, and nulls, get fill.  Returns
    the number of files; a file of a repeated task replaces its equal."""
    folder = local(path)

    def run(t: pa.Table) -> pa.Table:
        x, y = (t[c].to_numpy() for c in "xy")
        fx, fy = int(x[0]) // side, int(y[0]) // side
        values = np.full((side, side), fill, kind)
        values[y - fy * side, x - fx * side] = t["value"].fill_null(fill).to_numpy().astype(kind)
        os.makedirs(folder, exist_ok=True)
        write_tiff(f"{folder}/{_name(fx, fy)}", values, block, fx * side, fy * side)
        return pa.table({"fx": [fx], "fy": [fy]})

    ship(pixels.sparkSession)
    rows = pixels.select(F.col("x").cast("long"), F.col("y").cast("long"), F.col(column).cast("double").alias("value"))
    return rows.groupBy(F.floor(F.col("x") / side), F.floor(F.col("y") / side)).applyInArrow(run, "fx long, fy long").count()


#: Windows that a task reads one after the other.
WINDOWS_A_TASK = 16


@dataclass
class Window:
    tx: int
    ty: int
    files: tuple[str, ...]


@dataclass
class Neighbours(InputPartition):
    windows: list[Window]


class Windows(DataSourceReader):
    def __init__(self, options: dict):
        self.layers = dict(p.split("=", 1) for p in options["layers"].split(";"))
        self.fill = {k: float(v) for k, v in (p.split("=") for p in options["fill"].split(";"))}
        self.tile, self.halo = int(options["tile"]), int(options.get("halo", 0))

    def partitions(self) -> list[Neighbours]:
        """Windows, some neighbours a task, for every tile that a file of the first layer meets; layers of other grids are errors."""
        first, *rest = self.layers.values()
        names = sorted(p.name for p in Path(first).glob("*.tif"))
        heads = {n: Tiff(f"{first}/{n}") for n in names}
        for other in rest:
            for n, head in heads.items():
                if not os.path.exists(f"{other}/{n}") or Tiff(f"{other}/{n}").grid != head.grid:
                    raise ValueError(f"layers are not aligned at {n}")
        reach: dict[tuple[int, int], list[str]] = {}
        own = set()
        for n, h in heads.items():
            for pad, seen in ((0, own), (self.halo, None)):
                for ty in range((h.y0 - pad) // self.tile, (h.y0 + h.height - 1 + pad) // self.tile + 1):
                    for tx in range((h.x0 - pad) // self.tile, (h.x0 + h.width - 1 + pad) // self.tile + 1):
                        if seen is not None:
                            seen.add((tx, ty))
                        else:
                            reach.setdefault((tx, ty), []).append(n)
        windows = [Window(tx, ty, tuple(reach[tx, ty])) for tx, ty in sorted(own)]
        return [Neighbours(windows[k : k + WINDOWS_A_TASK]) for k in range(0, len(windows), WINDOWS_A_TASK)]

    def read(self, partition: Neighbours) -> Iterator[pa.RecordBatch]:
        return map(self.window, partition.windows)

    def window(self, partition: Window) -> pa.RecordBatch:
        side = self.tile + 2 * self.halo
        west, south = partition.tx * self.tile - self.halo, partition.ty * self.tile - self.halo
        columns, opened = [], 0
        for name, folder in self.layers.items():
            out = np.full((side, side), self.fill[name])
            for n in partition.files:
                tiff = Tiff(f"{folder}/{n}")
                tiff.read_into(out, west, south)
                opened += tiff.opened
            columns.append(pa.array([out.reshape(-1)], pa.list_(pa.float64())))
        head = [pa.array([v], pa.int64()) for v in (partition.tx, partition.ty, west, south, side, opened)]
        return pa.RecordBatch.from_arrays([*head, *columns], ["tx", "ty", "west", "south", "side", "blocks", *self.layers])


class RasterWindows(DataSource):
    """Options: layers (name=folder;...), fill (name=value;...), tile, halo."""

    @classmethod
    def name(cls) -> str:
        return "raster_windows"

    def schema(self) -> str:
        names = [p.split("=", 1)[0] for p in self.options["layers"].split(";")]
        return "tx long, ty long, west long, south long, side long, blocks long, " + ", ".join(f"{n} array<double>" for n in names)

    def reader(self, schema) -> DataSourceReader:
        return Windows(dict(self.options))


def read_windows(spark: SparkSession, layers: dict[str, str], fill: dict[str, float], tile: int, halo: int) -> DataFrame:
    """(tx, ty, west, south, side, blocks, layers as arrays by rows): windows of tile pixels with a halo."""
    ship(spark).dataSource.register(RasterWindows)
    joined = lambda m: ";".join(f"{k}={v}" for k, v in m.items())
    return spark.read.format("raster_windows").options(layers=joined({k: local(v) for k, v in layers.items()}), fill=joined(fill), tile=str(tile), halo=str(halo)).load()


def pixels_of(windows: DataFrame, *layers: str) -> DataFrame:
    """(tx, ty, x, y, layers) of windows."""
    at = windows.select("tx", "ty", "west", "south", "side", F.posexplode(F.arrays_zip(*layers)).alias("k", "v"))
    return at.select("tx", "ty", (F.col("west") + F.col("k") % F.col("side")).alias("x"), (F.col("south") + F.floor(F.col("k") / F.col("side"))).alias("y"), *(F.col(f"v.{c}").alias(c) for c in layers))
