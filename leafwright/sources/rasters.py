"""Scanned pages, one for each part, drawn from its number.

The drawing is plain numpy in one Arrow step; where what stands is a formula of
the number that the queries' SQL states again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from leafwright.sources import shared

IMAGE = "struct<width:int,height:int,data:binary>"


def pages(
    spark: SparkSession, sf_dir: str, draw: Callable[[int], np.ndarray], then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = f"page long, image {IMAGE}"
) -> DataFrame:
    """(page, image) of each part, or of these what ``then`` makes, as ``schema`` says: rasters that only it needs do not leave their task's Python."""
    kind = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # some rasters at a time
                keys = batch.column(0).slice(at, 64)
                images = [draw(k) for k in keys.to_pylist()]
                rows = [{"width": g.shape[1], "height": g.shape[0], "data": g.tobytes()} for g in images]
                drawn = pa.RecordBatch.from_arrays([keys, pa.array(rows, kind)], ["page", "image"])
                yield drawn if then is None else then(drawn)

    parts = shared.dealt(spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("cast(p_partkey as long) page"), 10_000)
    return parts.mapInArrow(run, schema)


def line(g: np.ndarray, x0: float, y0: float, x1: float, y1: float, thick: int = 3) -> None:
    lines(g, [(x0, y0, x1, y1)], thick)


def lines(g: np.ndarray, ends: list[tuple[float, float, float, float]], thick: int = 3) -> None:
    x0, y0, x1, y1 = np.array(ends, float).T
    n = (2 * np.maximum(np.abs(x1 - x0), np.abs(y1 - y0))).astype(int) + 1
    stop, more = np.cumsum(n), n > 1
    at = np.arange(stop[-1]) - np.repeat(stop - n, n)
    parts = np.maximum(n - 1, 1)
    x, y = at * np.repeat((x1 - x0) / parts, n) + np.repeat(x0, n), at * np.repeat((y1 - y0) / parts, n) + np.repeat(y0, n)
    x[stop[more] - 1], y[stop[more] - 1] = x1[more], y1[more]
    x, y = np.rint(x).astype(int), np.rint(y).astype(int)
    new = np.ones(len(x), bool)
    np.logical_or(x[1:] != x[:-1], y[1:] != y[:-1], out=new[1:])
    x, y = x[new], y[new]
    columns = [np.clip(x + e, 0, g.shape[1] - 1) for e in range(thick)]
    for d in range(thick):
        row = np.clip(y + d, 0, g.shape[0] - 1) * g.shape[1]
        for column in columns:
            g.ravel()[row + column] = 0


def box(g: np.ndarray, x: int, y: int, side: int, thick: int = 3) -> None:
    g[y : y + side, x : x + side] = 0
    g[y + thick : y + side - thick, x + thick : x + side - thick] = 255


def disc(g: np.ndarray, x: int, y: int, side: int, value: int = 0) -> None:
    r = side / 2
    at = np.arange(side) + 0.5 - r
    g[y : y + side, x : x + side][at[:, None] ** 2 + at**2 <= r * r] = value


def form(k: int) -> np.ndarray:
    """A box and a ring, each with a mark or none, a line of strokes, and a frame."""
    g = _strokes().copy()
    x, y, side = 10 + k % 30, 12 + k % 11, 30 + k % 21
    box(g, x, y, side)
    a, b = (side * 3) // 10, side - (side * 3) // 10 - 3
    if k % 4 == 1:
        g[y + a : y + side - a, x + a : x + side - a] = 0
    elif k % 4 == 2:
        lines(g, [(x + 7, y + 7, x + side - 10, y + side - 10), (x + side - 10, y + 7, x + 7, y + side - 10)])
    elif k % 4 == 3:
        lines(g, [(x + a, y + side // 2, x + side // 2 - 2, y + b), (x + side // 2 - 2, y + b, x + b, y + a)])
    x, y, side = 120 + k % 17, 40 - k % 13, 34 + k % 17
    disc(g, x, y, side)
    disc(g, x + 3, y + 3, side - 6, 255)
    if k % 3 == 1:
        disc(g, x + side // 4, y + side // 4, side - 2 * (side // 4))
    return g


@lru_cache(1)
def _strokes() -> np.ndarray:
    """What is no control, and stands where no control reaches."""
    g = np.full((120, 220), 255, np.uint8)
    lines(g, [*((20 + 16 * i, 100, 26 + 16 * i, 112 - i % 3) for i in range(6)), (2, 2, 2, 116)], 2)
    return g


def filled(k: int) -> np.ndarray:
    """A box with a square of its own around its middle."""
    g = np.full((80, 80), 255, np.uint8)
    side, inner = 40 + k % 5 * 2, k % 12 * 2
    box(g, 10, 12, side)
    at = side // 2 - inner // 2
    g[12 + at : 12 + at + inner, 10 + at : 10 + at + inner] = 0
    return g


def slanted(k: int) -> np.ndarray:
    """Ruled lines and words that fall by ``(k % 41 - 20) / 4`` degrees."""
    g, a = np.full((220, 320), 255, np.uint8), np.radians((k % 41 - 20) / 4)
    ends, fall = [], float(np.tan(a))
    for i in range(5):
        y = 40 + 32 * i + k % 7
        dx = 130 - 10 * (i % 3)
        ends.append((160 - dx, y - dx * fall, 160 + dx, y + dx * fall))
    for i in range(20):
        x = 40 + 12 * i
        y = 100 + (x - 160) * fall
        ends.append((x, y, x + 5, y + 9 + i % 3))
    lines(g, ends, 2)
    return g
