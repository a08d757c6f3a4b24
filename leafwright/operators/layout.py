"""Rows, columns, boxes and marks of a page.

Joins have the page as their equi key and the ranges as residual conditions.
Folds go over the things of one page, held in one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def height_rows(items: DataFrame, tolerance: float, item: str = "item", x: str = "x", y: str = "y") -> DataFrame:
    """(page, row, item): items grouped into rows from top to bottom.

    Taken by (y, x, item), an item joins the first row whose height is within
    ``tolerance``, else it begins one.  A row of n items then has the height
    (height * (n + 1) + y) / (n + 2).
    """
    each = F.array_sort(F.collect_list(F.struct(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"), F.col(item).alias("item"))))
    start = F.struct(F.array().cast("array<struct<h:double,n:int>>").alias("rows"), F.array().cast("array<int>").alias("at"))

    def step(state: Column, one: Column) -> Column:
        n = F.size(state["rows"])
        fits = F.transform(state["rows"], lambda r: F.abs(r["h"] - one["y"]) <= tolerance)
        hit = F.coalesce(F.array_position(fits, F.lit(True)), F.lit(0)).cast("int") - 1
        at = F.when(hit < 0, n).otherwise(hit)
        fresh = F.struct(one["y"].alias("h"), F.lit(1).alias("n"))
        moved = F.transform(
            state["rows"],
            lambda r, i: F.when(i == at, F.struct(((r["h"] * (r["n"] + 1) + one["y"]) / (r["n"] + 2)).alias("h"), (r["n"] + 1).alias("n"))).otherwise(r),
        )
        return F.struct(F.when(hit < 0, F.concat(state["rows"], F.array(fresh))).otherwise(moved).alias("rows"), F.concat(state["at"], F.array(at)).alias("at"))

    folded = items.groupBy("page").agg(each.alias("each")).withColumn("at", F.aggregate("each", start, step)["at"])
    return folded.select("page", F.explode(F.arrays_zip("each", "at")).alias("z")).select("page", F.col("z.at").alias("row"), F.col("z.each.item").alias("item"))


def column_of(x: Column, columns: dict[str, float], most: float = 40) -> Column:
    """The name of the nearest header column within ``most``, else null."""
    near = [F.when(F.abs(x - at) <= most, F.struct(F.abs(x - at).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name"))) for i, (name, at) in enumerate(columns.items())]
    return F.array_min(F.array_compact(F.array(*near)))["name"]


def in_region(lines: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Lines whose centre lies in the rectangle, edges included."""
    return lines.where(F.col("lcx").between(x0, x1) & F.col("ly").between(y0, y1))


def box_left_of_label(lines: DataFrame, controls: DataFrame, reach: float, band: float, nearest: bool = True) -> DataFrame:
    """(page, line, ctrl): the box that ends at most ``reach`` left of each
    line in its band; the nearest one, or else the first by number."""
    gap = F.col("lx") - F.col("edge")
    rank = F.struct(gap, F.col("ctrl")) if nearest else F.struct(F.col("ctrl"))
    near = lines.join(controls, "page").where(gap.between(0, reach) & (F.abs(F.col("ly") - F.col("y")) <= band))
    return near.groupBy("page", "line").agg(F.min_by("ctrl", rank).alias("ctrl"))


def text_below(lines: DataFrame, anchor: Column, drop: float = 12, left: float = 5, right: float = 200) -> DataFrame:
    """(page, anchor, value): the first line that begins just under each anchor."""
    a = lines.where(anchor).select("page", F.col("line").alias("anchor"), F.col("lx").alias("ax"), F.col("ly").alias("ay"))
    near = a.join(lines, "page").where((F.col("ly") > F.col("ay")) & (F.col("ly") <= F.col("ay") + drop) & F.col("lx").between(F.col("ax") - left, F.col("ax") + right))
    return near.groupBy("page", "anchor").agg(F.min_by("text", "line").alias("value"))


def overlaid(anchors: DataFrame, spans: DataFrame, below: bool, most_dx: float, most_dy: float) -> DataFrame:
    """(page, anchor, span): the coloured span of lowest score below or right
    of each anchor (page, anchor, ax, ay) among spans (page, span, sx, sy)."""
    dx, dy = F.col("sx") - F.col("ax"), F.col("sy") - F.col("ay")
    if below:
        inside, score = dy.between(0, most_dy) & (F.abs(dx) <= most_dx), dy + F.abs(dx) * 0.1
    else:
        inside, score = dx.between(0, most_dx) & (F.abs(dy) <= most_dy), F.abs(dx) + F.abs(dy) * 0.5
    return anchors.join(spans, "page").where(inside).groupBy("page", "anchor").agg(F.min_by("span", F.struct(score, F.col("span"))).alias("span"))


def _as(boxes: DataFrame, prefix: str) -> DataFrame:
    return boxes.select("page", *(F.col(c).alias(f"{prefix}_{c}") for c in boxes.columns if c != "page"))


def marked(boxes: DataFrame, marks: DataFrame, margin: float = 0) -> DataFrame:
    """The boxes (page, box, x, y, w, h) that any mark overlaps."""
    m = _as(marks, "m")
    meets = (
        (F.col("m_x") <= F.col("x") + F.col("w") + margin) & (F.col("m_x") + F.col("m_w") >= F.col("x") - margin)
        & (F.col("m_y") <= F.col("y") + F.col("h") + margin) & (F.col("m_y") + F.col("m_h") >= F.col("y") - margin)
    )
    return boxes.join(m, (boxes["page"] == m["page"]) & meets, "left_semi")


def drawing_shape(ops: Column) -> Column:
    """The shape that drawing operations (re, l, c) make, or null."""
    n = lambda op: F.size(F.filter(ops, lambda o: o == op))
    rest = F.when((n("l") >= 3) & ((n("c") == 0) | (n("c") >= 3)), "rect")
    return F.when(F.array_contains(ops, "re"), "rect").when((n("c") > 0) & (n("l") == 0), "circle").otherwise(rest)


def control_states(outlines: DataFrame, fills: DataFrame, margin: float = 1) -> DataFrame:
    """Each square outline (page, box, x, y, w, h) with ``selected``: a filled
    shape lies inside, or two line segments do (fills have kind)."""
    f = _as(fills, "f")
    inside = (
        (F.col("f_x") >= F.col("x") - margin) & (F.col("f_x") + F.col("f_w") <= F.col("x") + F.col("w") + margin)
        & (F.col("f_y") >= F.col("y") - margin) & (F.col("f_y") + F.col("f_h") <= F.col("y") + F.col("h") + margin)
    )
    square = F.col("w").between(5, 22) & F.col("h").between(5, 22) & (F.abs(F.col("w") - F.col("h")) <= 3)
    o = outlines.where(square)
    hits = o.join(f.withColumnRenamed("page", "f_page"), (F.col("page") == F.col("f_page")) & inside).groupBy("page", "box")
    hits = hits.agg(F.count_if(F.col("f_kind") == "fill").alias("n_fill"), F.count_if(F.col("f_kind") == "line").alias("n_line"))
    chosen = F.coalesce((F.col("n_fill") >= 1) | (F.col("n_line") >= 2), F.lit(False))
    return o.join(hits, ["page", "box"], "left").select("page", "box", chosen.alias("selected"))


def suppress(boxes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Greedy suppression: per page, by area (largest first, the later of
    equals first), a box stays unless it overlaps one that stayed by more than
    ``threshold`` of their union.  Returns (page, box)."""
    each = F.sort_array(F.collect_list(F.struct((F.col("w") * F.col("h")).cast("double").alias("area"), F.col("box").cast("long").alias("box"), *(F.col(c).cast("double").alias(c) for c in "xywh"))), asc=False)
    none = F.array().cast("array<struct<area:double,box:bigint,x:double,y:double,w:double,h:double>>")

    def shared(a: Column, b: Column, at: str, size: str) -> Column:
        return F.greatest(F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]), F.lit(0.0))

    def step(kept: Column, one: Column) -> Column:
        def hits(k: Column) -> Column:
            inner = shared(k, one, "x", "w") * shared(k, one, "y", "h")
            return inner > threshold * (k["area"] + one["area"] - inner)

        return F.when(F.exists(kept, hits), kept).otherwise(F.concat(kept, F.array(one)))

    kept = boxes.groupBy("page").agg(F.aggregate(each, none, step).alias("kept"))
    return kept.select("page", F.explode("kept.box").alias("box"))
