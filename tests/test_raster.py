"""Scanned pages: components, evidence and skew against direct counts."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwright.extractors import raster
from leafwright.sources import rasters


def _flooded(mask):
    """Component of each pixel, by filling."""
    of, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if of[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        of[y, x] = n
        while todo:
            a, b = todo.pop()
            for c in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                for d in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                    if mask[c, d] and not of[c, d]:
                        of[c, d] = n
                        todo.append((c, d))
    return of


@pytest.mark.parametrize("share", [0.1, 0.35, 0.5, 0.9])
def test_components_are_those_of_filling(share):
    rng = np.random.default_rng(int(share * 100))
    for shape in [(1, 30), (30, 1), (40, 50), (7, 3)]:
        mask = rng.random(shape) < share
        row, start, end = raster.runs(mask)
        assert sum(end - start) == mask.sum()
        label, of = raster.components(row, start, end, mask.shape[1]), _flooded(mask)
        pairs = {(int(label[i]), int(of[row[i], start[i]])) for i in range(len(row))}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == of.max()


def test_controls_and_no_letters():
    for k in range(200):
        g = rasters.form(k)
        assert sorted(raster.boxes(raster.inked(g))) == [("checkbox", 10 + k % 30, 12 + k % 11, 30 + k % 21, 30 + k % 21), ("radio", 120 + k % 17, 40 - k % 13, 34 + k % 17, 34 + k % 17)]
    assert raster.boxes(np.zeros((5, 5), bool)) == [] and raster.boxes(np.ones((300, 300), bool)) == []


def test_evidence_is_that_of_direct_sums():
    rng = np.random.default_rng(3)
    for k in range(12):
        g = rasters.form(k)
        g = np.where(rng.random(g.shape) < 0.03, 0, g).astype(np.uint8)
        mask = raster.inked(g)
        mean = np.array([[g[max(0, y - 17) : y + 18, max(0, x - 17) : x + 18].mean() for x in range(0, 220, 9)] for y in range(0, 120, 9)])
        assert (mask[::9, ::9] == ((g[::9, ::9] < mean - 10) | (g[::9, ::9] < 100))).all()
        s = raster.summed(mask)
        side = 30 + k
        e = raster.evidence(g, s, "checkbox", 10 + k, 12 + k % 11, side, side)
        b = max(2, int(side * 0.18))
        inside = (slice(12 + k % 11 + b, 12 + k % 11 + side - b), slice(10 + k + b, 10 + k + side - b))
        assert e["fill"] == pytest.approx(mask[inside].mean())
        v = np.pad(g[inside].astype(int), 1, mode="edge")
        edge = np.array([[abs(v[y + 1, x + 2] - v[y + 1, x]) + abs(v[y + 2, x + 1] - v[y, x + 1]) > 120 for x in range(v.shape[1] - 2)] for y in range(v.shape[0] - 2)])
        assert e["edges"] == pytest.approx(edge.mean())
        best = 0.0
        base = max(10, min(28, int(min(edge.shape) / 0.64 * 0.6)))
        for scale in (0.8, 1.0, 1.2):
            t = raster.tick(max(8, int(base * scale))).astype(float)
            for y in range(edge.shape[0] - t.shape[0] + 1):
                for x in range(edge.shape[1] - t.shape[1] + 1):
                    w = edge[y : y + t.shape[0], x : x + t.shape[1]].astype(float)
                    if w.std():
                        best = max(best, ((w - w.mean()) * (t - t.mean())).sum() / np.sqrt(((w - w.mean()) ** 2).sum() * ((t - t.mean()) ** 2).sum()))
        assert e["tick"] == pytest.approx(best)
        x, y, side = 120 + k % 17, 40 - k % 13, 34 + k % 17
        e = raster.evidence(g, s, "radio", x, y, side, side)
        cx, cy, r = x + side // 2, y + side // 2, int(side * 0.3)
        yy, xx = np.ogrid[: g.shape[0], : g.shape[1]]
        spans = lambda radius: (np.abs(yy - cy) <= int(radius)) & (np.abs(xx - cx) <= np.sqrt(np.maximum(radius**2 - (yy - cy) ** 2, 0)).astype(int))
        near, far = spans(max(1, int(side * 0.18))), spans(min(r, int(side * 0.45)))
        assert e["inner"] == pytest.approx(mask[cy - r : cy + r, cx - r : cx + r].mean())
        assert e["centre"] == pytest.approx(mask[near].mean()) and e["ring"] == pytest.approx(mask[far & ~near].mean() if (far & ~near).any() else 0)


def test_crosses_have_two_directions():
    g = rasters.form(2)
    b = next(b for b in raster.boxes(raster.inked(g)) if b[0] == "checkbox")
    a = raster.evidence(g, raster.summed(raster.inked(g)), *b)["angles"]
    assert any(30 <= x <= 70 for x in a)
    g = np.full((40, 40), 255, np.uint8)
    rasters.line(g, 4, 4, 34, 34)
    rasters.line(g, 34, 4, 4, 34)
    a = raster.line_angles(g, 20)
    assert 45.0 in a and 135.0 in a and 0.0 not in a


@pytest.mark.parametrize("angle", [-9.7, -2.0, -0.6, 0.0, 0.2, 1.3, 12.0])
def test_planted_skew_is_found_and_turned(angle):
    g = np.full((500, 700), 255, np.uint8)
    for i in range(8):
        dx, y = 300 - 20 * (i % 3), 90 + 40 * i
        rasters.line(g, 350 - dx, y - dx * np.tan(np.radians(angle)), 350 + dx, y + dx * np.tan(np.radians(angle)), 2)
    found = raster.skew(g)
    assert abs(found - angle) <= 0.2
    if abs(angle) >= 0.5:
        assert abs(raster.skew(raster.turned(g, found))) < 0.2
    assert (raster.turned(g, 0.0) == g).all()


def test_blank_and_null_pages(spark):
    white = bytes([255]) * 6000
    d = spark.createDataFrame([(1, (100, 60, white)), (2, None), (3, (1, 1, b"\x00"))], f"page int, image {raster.IMAGE}")
    got = raster.controls(d).select("page", F.size("controls").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(1, 0), (2, 0), (3, 0)]
    level = {r["page"]: r for r in raster.levelled(d).collect()}
    assert level[2]["image"] is None and bytes(level[1]["image"]["data"]) == white and {r["skew"] for r in level.values()} == {0.0}
    assert raster.controls(d.limit(0)).collect() == []


def test_a_whole_page_takes_seconds():
    rng = np.random.default_rng(1)
    g = np.full((3300, 2550), 255, np.uint8)
    for y in range(200, 3100, 50):
        for x in range(200, 2300, 24):
            if rng.random() < 0.8:
                rasters.line(g, x, y, x + rng.integers(0, 12), y + rng.integers(8, 20))
    g[980:1090, 960:1080] = 255
    rasters.box(g, 1000, 1017, 50)
    began = time.time()
    mask = raster.inked(g)
    assert ("checkbox", 1000, 1017, 50, 50) in raster.boxes(mask)
    raster.skew(g)
    assert time.time() - began < 60
