import numpy as np
import pytest

from terrabin.shipping import shared_dir
from terrabin.sources import raster


@pytest.mark.parametrize("kind", ["u1", "i4", "f4", "f8"])
def test_windows_of_a_file(tmp_path, kind):
    values = (np.random.default_rng(1).random((50, 37)) * 200).astype(kind)
    path = str(tmp_path / "a.tif")
    raster.write_tiff(path, values, 16, 100, -20)
    padded = np.full((150, 200), 7.0)
    padded[50:100, 50:87] = values
    for west, south, wide, high in ((100, -20, 37, 50), (90, -30, 30, 70), (110, 0, 5, 5), (130, 20, 40, 40), (200, 0, 5, 5)):
        t, out = raster.Tiff(path), np.full((high, wide), 7.0)
        t.read_into(out, west, south)
        assert (out == padded[south + 70 :, west - 50 :][:high, :wide]).all()
    t = raster.Tiff(path)
    t.read_into(np.zeros((4, 4)), 117, -3)
    assert t.opened == 1  # of twelve blocks


def test_layers(spark):
    r = np.random.default_rng(2)
    rows = [(int(x), int(y), int(r.integers(1, 15)), float(r.random())) for x in range(-5, 40) for y in range(3, 30) if r.random() < 0.8]
    px = spark.createDataFrame([(*p[:3], None if p[2] == 3 else p[3]) for p in rows], "x long, y long, cover long, height double").repartition(3)
    path = shared_dir(spark)
    assert raster.write_layer(px, "cover", f"{path}/c", 0, "u1", 16, 8) == 8
    raster.write_layer(px, "height", f"{path}/h", -9999, "f8", 16, 8)
    w = raster.read_windows(spark, {"cover": f"{path}/c", "height": f"{path}/h"}, {"cover": 0, "height": -9999}, 10, 2)
    got = {(p.tx, p.ty, p.x, p.y): (p.cover, p.height) for p in raster.pixels_of(w, "cover", "height").collect()}
    at = {(x, y): (c, -9999 if c == 3 else h) for x, y, c, h in rows}
    tiles = {(x // 10, y // 10) for x in range(-16, 48) for y in range(0, 32)}
    assert got == {(tx, ty, x, y): at.get((x, y), (0, -9999)) for tx, ty in tiles for x in range(tx * 10 - 2, tx * 10 + 12) for y in range(ty * 10 - 2, ty * 10 + 12)}
    raster.write_layer(px.selectExpr("x", "y + 16 as y", "cover"), "cover", f"{path}/moved", 0, "u1", 16, 8)
    with pytest.raises(Exception, match="not aligned"):
        raster.read_windows(spark, {"cover": f"{path}/c", "height": f"{path}/moved"}, {"cover": 0, "height": 0}, 10, 2).collect()


def test_folders_must_be_mounted():
    assert raster.local("file:///a/b") == raster.local("file:/a/b") == raster.local("/a/b") == "/a/b"
    with pytest.raises(ValueError, match="mounted"):
        raster.local("hdfs://x/y")
