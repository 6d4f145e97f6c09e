"""Grid codes, ellipsoid areas and bins as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: GRS80-like ellipsoid of the grid; fixed values.
AXIS, E2 = 6378137.0, 6.6943799901413165e-3


def mesh_xy(code: Column) -> Column:
    """(x, y) of an 8-digit third-order mesh code; malformed codes are errors."""
    part = lambda start, size: F.substring(code, start, size).cast("bigint")
    xy = F.struct((part(3, 2) * 80 + part(6, 1) * 10 + part(8, 1)).alias("x"), (part(1, 2) * 80 + part(5, 1) * 10 + part(7, 1)).alias("y"))
    return F.when(code.rlike(r"^\d{4}[0-7]{2}\d{2}$"), xy).otherwise(F.raise_error(F.concat(F.lit("invalid mesh code: "), code)))


def zone(phi: Column) -> Column:
    """Area from the equator to a latitude in radians, by radian of longitude, in units of AXIS ** 2 * (1 - E2)."""
    e, u = math.sqrt(E2), F.sin(phi)
    return u / (2 * (1 - E2 * u * u)) + F.atanh(e * u) / (2 * e)


def pixel_area_km2(lat: Column) -> Column:
    """Area of a pixel of 1/12000 degree centred at a latitude, on the ellipsoid."""
    half, phi = math.radians(1 / 24000), F.radians(lat)
    return (zone(phi + half) - zone(phi - half)) * (AXIS * AXIS * (1 - E2) * math.radians(1 / 12000) / 1e6)


def metres(lat: Column) -> Column:
    """(dy, dx) of a pixel in metres."""
    phi = F.radians(lat)
    q = 1 - E2 * F.pow(F.sin(phi), 2)
    step = math.pi / 180 / 12000
    return F.struct((AXIS * (1 - E2) / F.pow(q, 1.5) * step).alias("dy"), (AXIS / F.sqrt(q) * F.cos(phi) * step).alias("dx"))


def known_height(height: Column, no_data: float = -9999.0) -> Column:
    return height.isNotNull() & ~F.isnan(height.cast("double")) & (height != no_data) & height.between(-500, 9000)


def height_band(height: Column, low: int = 200, mountain: int = 800) -> Column:
    """0 below low, 1 below mountain, 2 above, 3 missing."""
    band = F.when(height < low, 0).when(height < mountain, 1).otherwise(2)
    return F.when(known_height(height), band).otherwise(3).cast("bigint")


def altitude_bin(height: Column) -> Column:
    """100 m bins 0..29, 30 from 3000 m on, 31 missing."""
    return F.when(known_height(height), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(3000.0), height.cast("double"))) / 100)).otherwise(31).cast("bigint")


def band_of_bin(alt: Column, low: int | Column = 200, mountain: int | Column = 800) -> Column:
    return F.when(alt == 31, 3).when(alt * 100 < low, 0).when(alt * 100 < mountain, 1).otherwise(2).cast("bigint")


def valid_thresholds(low: Column, mountain: Column) -> Column:
    """(low, mountain) in metres of texts, whole hundreds with 100 <= low < mountain <= 3000; else the usual pair."""
    a, b = (c.cast("string").try_cast("bigint") for c in (low, mountain))
    sound = (a % 100 == 0) & (b % 100 == 0) & (a >= 100) & (a < b) & (b <= 3000)
    pair = lambda x, y: F.struct(x.cast("bigint").alias("low"), y.cast("bigint").alias("mountain"))
    return F.when(F.coalesce(sound, F.lit(False)), pair(a, b)).otherwise(pair(F.lit(200), F.lit(800)))


def distance_bin(d: Column) -> Column:
    """0..3 for up to 100, 250, 500 m (inclusive) and beyond; a null distance is beyond."""
    return F.when(d <= 100, 0).when(d <= 250, 1).when(d <= 500, 2).otherwise(3).cast("bigint")


def cell_box(gx: Column, gy: Column) -> dict[str, Column]:
    """Degrees of a quarter mesh cell."""
    return {"west": 100 + gx / 320.0, "south": gy / 480.0, "east": 100 + (gx + 1) / 320.0, "north": (gy + 1) / 480.0}
