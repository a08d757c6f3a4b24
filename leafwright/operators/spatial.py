"""Nearest-neighbour and containment joins of things on one page.

Every join has the page as its equi key, so it is a hash or sort-merge join
with the ranges as a residual condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_controls(controls: DataFrame, lines: DataFrame, band: float = 12, reach: float = 80) -> DataFrame:
    """Each control (page, ctrl, x, y), x and y its centre, with its label:
    among lines (page, line, lx, lcx, ly, text) of its band, the nearest one
    that begins within ``reach`` right of its centre, else the one with the
    nearest centre."""
    gap = F.col("lx") - F.col("x")
    ahead = gap.between(0, reach)
    rank = F.struct(F.when(ahead, 0).otherwise(1), F.when(ahead, gap).otherwise(F.abs(F.col("lcx") - F.col("x"))), F.col("line"))
    near = controls.join(lines, "page").where(F.abs(F.col("ly") - F.col("y")) <= band)
    best = near.groupBy("page", "ctrl").agg(F.min_by("text", rank).alias("label"))
    return controls.join(best, ["page", "ctrl"], "left")


def text_right(lines: DataFrame, anchor: Column, most_dx: float, most_dy: float = 4) -> DataFrame:
    """(page, anchor, value): the nearest text in the band right of each anchor;
    a text with a colon is a label, unless the anchor has one as well."""
    a = lines.where(anchor).select("page", F.col("line").alias("anchor"), F.col("right").alias("ax"), F.col("ly").alias("ay"), F.contains("text", F.lit(":")).alias("labelled"))
    dx = F.col("lx") - F.col("ax")
    near = a.join(lines, "page").where(dx.between(0, most_dx) & (F.abs(F.col("ly") - F.col("ay")) <= most_dy) & (F.col("line") != F.col("anchor")) & (F.col("labelled") | ~F.contains("text", F.lit(":"))))
    return near.groupBy("page", "anchor").agg(F.min_by("text", F.struct(dx, F.col("line"))).alias("value"))


def closest(points: DataFrame, marks: DataFrame, most: float) -> DataFrame:
    """(page, point, mark): each point's nearest mark nearer than ``most``."""
    square = F.pow(F.col("mx") - F.col("px"), 2) + F.pow(F.col("my") - F.col("py"), 2)
    near = points.join(marks, "page").where(square < most * most)
    return near.groupBy("page", "point").agg(F.min_by("mark", F.struct(square, F.col("mark"))).alias("mark"))


def overlaps(boxes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of boxes (page, box, x, y, w, h) of one page by intersection over
    union above ``threshold``."""
    a = boxes.select("page", *(F.col(c).alias(f"a_{c}") for c in ("box", "x", "y", "w", "h")))
    b = boxes.select("page", *(F.col(c).alias(f"b_{c}") for c in ("box", "x", "y", "w", "h")))

    def shared(at: str, size: str) -> Column:
        return F.greatest(F.least(F.col(f"a_{at}") + F.col(f"a_{size}"), F.col(f"b_{at}") + F.col(f"b_{size}")) - F.greatest(f"a_{at}", f"b_{at}"), F.lit(0))

    p = a.join(b, "page").where("a_box < b_box").withColumn("inner", shared("x", "w") * shared("y", "h")).where("inner > 0")
    outer = F.col("a_w") * F.col("a_h") + F.col("b_w") * F.col("b_h") - F.col("inner")
    return p.where(F.col("inner") > threshold * outer).select("page", "a_box", "b_box", F.round(F.col("inner") / outer, 4).alias("iou"))
