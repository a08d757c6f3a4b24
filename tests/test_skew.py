"""Skew: the search for its angle against all votes, and pages levelled where they are drawn."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from __spark_entry__ import queries
from leafwright.extractors import raster
from leafwright.sources import rasters

SF = "/root/testdata/sf0.001"
ANGLES = np.arange(-15, 15.1, 0.25)


def _pages():
    rng = np.random.default_rng(7)
    for k in range(0, 287, 7):
        yield rasters.slanted(k)
    for i in range(40):
        h, w = (int(v) for v in rng.integers(30, 300, 2))
        g = np.full((h, w), 255, np.uint8)
        fall = np.tan(np.radians(rng.uniform(-16, 16)))
        for y in rng.uniform(0, h, 6):
            rasters.line(g, 0, y, w - 1, y + (w - 1) * fall, 1 + i % 3)
        g[rng.random(g.shape) < (0, 0.03, 0.3, 0.9)[i % 4]] = 0
        yield g


def _upper(g):
    mask = raster.inked(g)
    y, x = np.nonzero(mask & ~np.vstack([np.zeros((1, g.shape[1]), bool), mask[:-1]]))
    low = int(np.ceil(g.shape[1] * np.sin(np.radians(15))))
    return np.array([y + low, x - g.shape[1] / 2]), g.shape[0] + 2 * low


def test_strongest_angle_is_that_of_all_votes():
    for g in _pages():
        at, size = _upper(g)
        all_votes = np.array([np.bincount(np.rint(at[0] * np.cos(a) - at[1] * np.sin(a)).astype(int), minlength=size) for a in np.radians(ANGLES)])
        assert (raster._votes(at, ANGLES, size) == all_votes).all()
        assert raster._strongest(at, ANGLES, size) == all_votes.max(1).argmax()


def test_most_angles_are_not_voted_for(monkeypatch):
    made, votes = [], raster._votes
    monkeypatch.setattr(raster, "_votes", lambda at, angles, *a: (made.append(at.shape[1] * len(angles)), votes(at, angles, *a))[1])
    pixels = 0
    for k in range(41):
        raster.skew(g := rasters.slanted(k))
        pixels += _upper(g)[0].shape[1]
    # 121 coarse angles and 41 fine ones before
    assert sum(made) < 90 * pixels


def test_turned_is_every_pixel_interpolated():
    for i, g in enumerate(_pages()):
        h, w = g.shape
        a = np.radians(angle := (-15, -4.75, 0.3, 2.2, 14.9)[i % 5])
        dy, dx = np.mgrid[:h, :w] - np.array([h / 2, w / 2])[:, None, None]
        edge = np.pad(g, 1, constant_values=255).astype(np.float32)
        sx = np.clip(w / 2 + dx * np.cos(a) - dy * np.sin(a) + 1, 0, w + 0.999)
        sy = np.clip(h / 2 + dx * np.sin(a) + dy * np.cos(a) + 1, 0, h + 0.999)
        x, y = sx.astype(int), sy.astype(int)
        fx, fy = (sx - x).astype(np.float32), (sy - y).astype(np.float32)
        upper, lower = (edge[v, x] * (1 - fx) + edge[v, x + 1] * fx for v in (y, y + 1))
        assert (raster.turned(g, angle) == np.rint(upper * (1 - fy) + lower * fy)).all()


def test_places_of_all_shapes():
    rng = np.random.default_rng(2)
    for shape in [(8, 8), (3, 5), (16, 3), (1, 1), (0, 4), (4, 0), (40, 64)]:
        for share in (0, 0.02, 0.5, 1):
            mask = rng.random(shape) < share
            for m in (mask, mask[:, ::2], mask[1:], mask.T):
                assert all((a == b).all() for a, b in zip(raster.places(m), np.nonzero(m), strict=True))


def test_pages_are_levelled_where_they_are_drawn(spark):
    query = queries()["raster_skew"](spark, SF)
    plan = query._jdf.queryExecution().executedPlan().toString()
    # rasters go to no second step in Python
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    drawn = rasters.pages(spark, SF, rasters.slanted).withColumn("was", F.col("image.data"))
    level = raster.levelled(drawn).select("page", "skew", (F.col("image.data") != F.col("was")).alias("turned"))
    same = rasters.pages(spark, SF, rasters.slanted, raster.levelling, "page long, skew double, turned boolean")
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, level.collect()))


def test_null_images_and_slices_are_levelled():
    drawn = [None, rasters.slanted(3), rasters.slanted(20), None]
    rows = [None if g is None else {"width": g.shape[1], "height": g.shape[0], "data": g.tobytes()} for g in drawn]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(rows, raster._IMAGE)], ["page", "image"])
    got = raster.levelling(batch).to_pylist()
    assert [r["turned"] for r in got] == [None, True, False, None] and [r["skew"] for r in got][::3] == [0.0, 0.0]
    whole = raster.level(batch.column("image"))
    assert whole[0]["image"].as_py() is None and whole[2]["image"].as_py() == rows[2]
    assert raster.level(batch.column("image")[1:]).to_pylist() == whole[1:].to_pylist()
