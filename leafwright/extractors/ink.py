"""Answers of scanned forms by the ink where a mark would stand.

A page's raster is ``image`` (width, height, data: grey bytes at ``DPI``).  The
measure is the one step in Python; what to measure and what it says are
expressions.  A page without an image has no ink.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from leafwright.extractors import page as P

DPI = 300
#: The grey up to which a pixel is ink, and shares of ink that count as a mark.
INK, MARKED, CHOSEN, AHEAD = 200, 0.22, 0.20, 1.15


def density(image: np.ndarray, x: float, y: float, size: float, dpi: int = DPI) -> float:
    """The share of ink inside a box around a place in points: its crop is
    smoothed, and a fifth of it on each side, its outline, is left out."""
    scale = dpi / 72
    half, cx, cy = int(size * scale / 2), int(x * scale), int(y * scale)
    x0, y0, x1, y1 = max(0, cx - half), max(0, cy - half), min(image.shape[1], cx + half), min(image.shape[0], cy + half)
    if x1 - x0 < 4 or y1 - y0 < 4:
        return 0.0
    edged = np.pad(image[y0:y1, x0:x1].astype(np.int32), 1, mode="reflect")
    across = edged[:, :-2] + 2 * edged[:, 1:-1] + edged[:, 2:]
    smooth = (across[:-2] + 2 * across[1:-1] + across[2:] + 8) >> 4
    margin = max(2, int(min(smooth.shape) * 0.2))
    inner = smooth[margin : smooth.shape[0] - margin, margin : smooth.shape[1] - margin]
    return float((inner <= INK).mean()) if inner.size else 0.0


@F.arrow_udf(ArrayType(DoubleType()))
def densities(images: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The ink at each place (x, y, size) of a page's image; 0 for a null place or image."""
    for image, places in images:
        out = []
        for i, at in zip(image, places.to_pylist(), strict=True):
            grey = np.frombuffer(i["data"].as_buffer(), np.uint8).reshape(i["height"].as_py(), i["width"].as_py()) if i.is_valid else None
            out.append(None if at is None else [0.0 if p is None or grey is None else density(grey, p["x"], p["y"], p["size"]) for p in at])
        yield pa.array(out, pa.list_(pa.float64()))


def spot(x: str, y: str, size: float) -> str:
    """A place to measure, in points."""
    return f"named_struct('x', cast({x} as double), 'y', cast({y} as double), 'size', cast({size} as double))"


def measured(pages: DataFrame, name: str, places: str) -> DataFrame:
    return P.staged(pages, {"_places": places}).withColumn(name, densities("image", "_places")).drop("_places")


def best_option(pages: DataFrame, name: str, options: list[str]) -> DataFrame:
    """``pages`` with the option that has most ink left of, below or above its
    text: a fifth at least, and 1.15 times the next."""
    first = "split(lower(o), ' ')[0]"
    line = f"get(filter(lines, l -> contains(l.norm, lower(o)) or array_contains(split(l.norm, ' '), {first})), 0)"
    spots = f"case when l is null then array(null, null, null) else array({spot('l.x0 - 6', 'l.cy', 8)}, {spot('l.cx', 'l.y1 + (l.y1 - l.y0) * 0.8D', 8)}, {spot('l.cx', 'l.y0 - (l.y1 - l.y0) * 0.8D', 8)}) end"
    p = measured(pages, "_ink", f"flatten(transform(transform({P.array(options)}, o -> {line}), l -> {spots}))")
    ranked = f"array_sort(transform({P.array(options)}, (o, i) -> named_struct('less', -array_max(slice(_ink, 3 * i + 1, 3)), 'i', i, 'o', o)))"
    p = P.staged(p, {"_ranked": ranked}, {name: f"case when -_ranked[0].less >= {CHOSEN} and not coalesce(get(_ranked, 1).less < 0 and _ranked[0].less > get(_ranked, 1).less * {AHEAD}, false) then _ranked[0].o end"})
    return p.drop("_ink", "_ranked")


def marked_options(pages: DataFrame, name: str, options: list[str], section: str | None = None, either: bool = True) -> DataFrame:
    """``pages`` with the options whose text, in a section, has a mark to its
    left; with ``either``, a text that an option holds is its text as well."""
    top = f"coalesce(get(filter(lines, l -> contains(lower(l.text), {P.quoted(section.lower())})), 0).y0, 0)" if section else "0"
    test = "contains(lower(l.said), lower(o))" + (" or contains(lower(o), lower(l.said))" if either else "")
    line = f"get(filter(lines, l -> l.cy >= {top} and ({test})), 0)"
    p = measured(pages, "_ink", f"transform(transform({P.array(options)}, o -> {line}), l -> case when l is not null then {spot('l.x0 - 8', 'l.cy', 9)} end)")
    return P.staged(p, {name: f"filter({P.array(options)}, (o, i) -> _ink[i] >= {MARKED})"}).drop("_ink")


def yes_or_no(pages: DataFrame, name: str, anchor: str, band: float = 20, left: float = 10, size: float = 9) -> DataFrame:
    """``pages`` with the answer whose text near an anchor has more ink to its left, 1.15 times that of the other."""
    from leafwright.extractors.intake import cleaned

    row = f"filter(lines, l -> abs(l.cy - get(filter(lines, m -> contains(lower(m.text), {P.quoted(anchor.lower())})), 0).cy) <= {band})"
    said = f"lower({cleaned('l.said')})"
    places = ", ".join(f"get(transform(filter({row}, l -> {said} in ('{a}', '{a[0]}')), l -> {spot(f'l.cx - {left}', 'l.cy', size)}), 0)" for a in ("yes", "no"))
    p = measured(pages, "_ink", f"array({places})")
    return P.staged(p, {name: f"case when _ink[0] = 0 and _ink[1] = 0 then null when greatest(_ink[0], _ink[1]) < {CHOSEN} then null when _ink[0] > _ink[1] * {AHEAD} then true when _ink[1] > _ink[0] * {AHEAD} then false end"}).drop("_ink")


def row_picks(pages: DataFrame, name: str, rows: str) -> DataFrame:
    """``pages`` with, for each row of four controls, the place of the box with most ink, a fifth at least, else null."""
    p = measured(pages, "_ink", f"flatten(transform({rows}, r -> transform(slice(array_sort(r.of), 1, 4), c -> {spot('c.cx', 'c.cy', 0).replace('cast(0 as double)', 'c.w')})))")
    part = "slice(_ink, 4 * i + 1, 4)"
    return P.staged(p, {name: f"transform({rows}, (r, i) -> case when array_max({part}) >= {CHOSEN} then cast(array_position({part}, array_max({part})) as int) - 1 end)"}).drop("_ink")


def scanned(pages: DataFrame) -> bool:
    """Whether pages have images and say how their text was read."""
    return "image" in pages.columns and "text_source" in pages.columns


def only_scanned(pages: DataFrame) -> DataFrame:
    """``pages`` with the images of those alone whose text was read optically: others are not measured."""
    return pages.withColumn("image", F.when(F.col("text_source") == "ocr", F.col("image")))


def filled_in(pages: DataFrame, *fields: str) -> DataFrame:
    """``pages`` with each field as it is, or, where boxes gave nothing, as the
    ink ``_by_<field>`` says; nothing is null or an empty list."""
    for f in fields:
        empty = F.col(f).isNull() | ((F.size(f) == 0) if pages.schema[f].dataType.typeName() == "array" else F.lit(False))
        pages = pages.withColumn(f, F.when(empty & F.col("image").isNotNull(), F.coalesce(F.col(f"_by_{f}"), F.col(f))).otherwise(F.col(f)))
    return pages.drop(*(f"_by_{f}" for f in fields))


def crossed(angles: str) -> str:
    """Whether line angles (degrees) hold two that cross like an X."""
    slanted = lambda a: f"({a} between 30 and 70 or {a} between 110 and 150)"
    return f"(size({angles}) >= 2 and exists({angles}, one -> {slanted('one')} and exists({angles}, other -> {slanted('other')} and abs(one - other) between 70 and 110)))"


def box_state(fill: str, angles: str, edges: str, template: str) -> str:
    """(selected, conf) of a box by its fill, line angles, share of edges and likeness to a tick."""
    return f"named_struct('selected', {fill} > 0.22D or {crossed(angles)} or {edges} > 0.02D or {template} > 0.35D, 'conf', least(0.95D, greatest({fill}, {edges} * 3, {template})))"


def radio_state(inner: str, centre: str, ring: str) -> str:
    """(selected, conf) of a radio by the fill of its inside, its centre and the ring around that."""
    return f"named_struct('selected', {inner} > 0.25D or ({centre} > 0.35D and {centre} > {ring} * 1.5D), 'conf', greatest({inner}, {centre}))"


# The fields that a reviewing model may correct.
CORRECTABLE = ("sex", "smoker", "diabetic", "allergies", "symptoms", "claim_type")


def corrected(record: str, suggestion: str, flags: str) -> tuple[str, str]:
    """A map of fields with the allowed ones of a suggestion (null or empty:
    none), and the flags, which then say so.  Where suggestions come from is
    the caller's: any column, a UDF's among them."""
    allowed = f"map_filter({suggestion}, (k, v) -> k in ({', '.join(map(P.quoted, CORRECTABLE))}))"
    some = f"coalesce(size({suggestion}), 0) > 0"
    return (
        f"case when {some} then map_concat(map_filter({record}, (k, v) -> not map_contains_key({allowed}, k)), {allowed}) else {record} end",
        f"case when {some} then concat_ws(';', nullif({flags}, ''), 'llm_adjusted') else {flags} end",
    )
