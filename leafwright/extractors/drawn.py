"""Controls from a page's vector drawings (x0, y0, x1, y1, type, ops, segs)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from leafwright.extractors import page as P


def square(d: str) -> str:
    """Whether a box is about a square of 5 to 22 points."""
    w, h = f"({d}.x1 - {d}.x0)", f"({d}.y1 - {d}.y0)"
    return f"({w} between 5 and 22 and {h} between 5 and 22 and abs({w} - {h}) <= 3)"


def inside(outer: str, inner: str) -> str:
    return f"({inner}.x0 >= {outer}.x0 - 1 and {inner}.x1 <= {outer}.x1 + 1 and {inner}.y0 >= {outer}.y0 - 1 and {inner}.y1 <= {outer}.y1 + 1)"


def holds_point(outer: str, x: str, y: str) -> str:
    return f"({x} between {outer}.x0 - 1 and {outer}.x1 + 1 and {y} between {outer}.y0 - 1 and {outer}.y1 + 1)"


def shape(ops: str) -> str:
    """The shape that operations (re, l, c) make: rect, circle or null."""
    n = lambda op: f"size(filter({ops}, o -> o = '{op}'))"
    return f"case when array_contains({ops}, 're') then 'rect' when {n('c')} > 0 and {n('l')} = 0 then 'circle' when {n('l')} >= 3 and ({n('c')} = 0 or {n('c')} >= 3) then 'rect' end"


def useful(drawings: str = "drawings") -> str:
    """Whether a page draws three boxes or more, so that its controls can be read from them."""
    return f"size(filter({drawings}, d -> {square('d')})) >= 3"


def controls(pages: DataFrame, scale: float = P.SCALE) -> DataFrame:
    """``pages`` with ``controls`` (kind, x, y, w, h in pixels, selected, label,
    conf) from its drawings: stroked squares are boxes, chosen if a filled shape
    or two lines lie inside; stroked circles are radios, chosen if a smaller
    filled circle is near the centre or a filled rectangle lies inside."""
    kind = lambda t, s: f"transform(filter(shaped, d -> d.type = '{t}' and d.square and d.shape = '{s}'), d -> d)"
    small = "not d.square and d.x1 - d.x0 between 1 and 20 and d.y1 - d.y0 between 1 and 20"
    keyed = lambda items: f"transform(array_distinct(transform({items}, d -> struct(cast(d.x0 * 10 as int), cast(d.y0 * 10 as int)))), q -> get(filter({items}, d -> struct(cast(d.x0 * 10 as int), cast(d.y0 * 10 as int)) = q), 0))"
    dist = "sqrt(pow((f.x0 + f.x1) / 2 - (b.x0 + b.x1) / 2, 2) + pow((f.y0 + f.y1) / 2 - (b.y0 + b.y1) / 2, 2))"
    lines = f"size(filter(segs, s -> {holds_point('b', 's.x1', 's.y1')} and {holds_point('b', 's.x2', 's.y2')}))"
    dot = f"exists(filled_circles, f -> {dist} <= (b.x1 - b.x0) / 2 * 0.5D and (f.x1 - f.x0) / 2 < (b.x1 - b.x0) / 2 * 0.9D)"
    filled = f"exists(filled_rects, f -> {inside('b', 'f')})"

    def found(items: str, name: str, chosen: str) -> str:
        px = lambda v: f"cast(cast({v} * {scale}D as int) as double)"
        one = f"named_struct('kind', '{name}', 'x', {px('b.x0')}, 'y', {px('b.y0')}, 'w', {px('(b.x1 - b.x0)')}, 'h', {px('(b.y1 - b.y0)')}, 'selected', {chosen}, 'label', '', 'conf', if({chosen}, 0.98D, 0.95D))"
        return f"transform({items}, b -> {one})"

    p = P.staged(
        pages, {"shaped": f"transform(coalesce(drawings, array()), d -> named_struct('x0', d.x0, 'y0', d.y0, 'x1', d.x1, 'y1', d.y1, 'type', d.type, 'square', {square('d')}, 'shape', {shape('d.ops')}))",
                "segs": "flatten(transform(filter(coalesce(drawings, array()), d -> d.type = 's' and size(d.ops) <= 2), d -> d.segs))"},
        {"boxes": keyed(kind("s", "rect")), "radios": keyed(kind("s", "circle")), "filled_circles": f"filter(shaped, d -> d.type = 'f' and d.shape = 'circle' and (d.square or {small}))",
         "filled_rects": f"filter(shaped, d -> d.type = 'f' and (d.square and d.shape = 'rect' or {small} and coalesce(d.shape, '') <> 'circle'))"},
        {"controls": f"concat({found('boxes', 'checkbox', f'({filled} or {lines} >= 2)')}, {found('radios', 'radio', f'({dot} or {filled})')})"},
    )
    return p.drop("shaped", "segs", "boxes", "radios", "filled_circles", "filled_rects")
