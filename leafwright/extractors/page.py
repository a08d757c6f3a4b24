"""A page as one row, its lines and controls in arrays, and expressions on them.

An extractor is a projection of pages: nothing is shuffled, and a page is
bounded, so its arrays are too.  Expressions are SQL text, composed in stages
of named columns so that what several fields use is computed once.  Lengths
are points; controls are given in pixels and scaled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.operators import fuzzy

#: Pixels a point of the images on which controls are found.
SCALE = 300 / 72
SPACES = " \t\n\x0b\f\r"
LINE = "struct<i:int,text:string,x0:double,y0:double,x1:double,y1:double,cx:double,cy:double,said:string,norm:string,tight:string>"
CONTROL = "struct<x:double,i:int,kind:string,selected:boolean,label:string,conf:double,cx:double,cy:double,right:double,w:double>"


def prepare(pages: DataFrame, scale: float = SCALE) -> DataFrame:
    """Pages with ``lines`` (text, x0, y0, x1, y1) and ``controls`` (kind, x, y,
    w, h, selected, label, conf) numbered, centred, scaled and normalised.
    Null arrays are empty, a null text is empty, a null selection is none."""
    # white space is what a pattern's \\s is, put as replacements since a page has many lines
    low = "lower(coalesce(l.text, ''))"
    for sign in SPACES[1:]:
        low = f"replace({low}, '{sign}', ' ')"
    line = f"""transform(transform(coalesce(lines, array()), l -> named_struct('l', l, 'low', {low})), (z, i) -> cast(named_struct('i', i, 'text', coalesce(z.l.text, ''), 'x0', z.l.x0, 'y0', z.l.y0, 'x1', z.l.x1, 'y1', z.l.y1,
        'cx', (z.l.x0 + z.l.x1) / 2, 'cy', (z.l.y0 + z.l.y1) / 2, 'said', trim(both '{SPACES}' from coalesce(z.l.text, '')), 'norm', trim(if(contains(z.low, '  '), regexp_replace(z.low, ' +', ' '), z.low)),
        'tight', replace(z.low, ' ', '')) as {LINE}))"""
    control = f"""transform(coalesce(controls, array()), (c, i) -> cast(named_struct('x', c.x / {scale}D, 'i', i, 'kind', c.kind, 'selected', coalesce(c.selected, false), 'label', regexp_replace(coalesce(c.label, ''), '^\\\\s+|\\\\s+$', ''),
        'conf', c.conf, 'cx', (c.x + c.w / 2D) / {scale}D, 'cy', (c.y + c.h / 2D) / {scale}D, 'right', (c.x + c.w) / {scale}D, 'w', c.w / {scale}D) as {CONTROL}))"""
    return staged(pages, {"lines": line, "controls": control})


def staged(pages: DataFrame, *stages: dict[str, str]) -> DataFrame:
    """``pages`` with named expressions, each stage over the ones before.

    The optimizer would copy an expression that is named once into the lambda
    that names it, to be evaluated for every element.  It never copies one that
    depends on the partition, as each of these does in form.
    """
    for stage in stages:
        pages = pages.withColumns({name: F.expr(f"if(spark_partition_id() >= 0, {e}, null)") for name, e in stage.items()})
    return pages


def quoted(value: str | None) -> str:
    return "null" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array(values: list[str]) -> str:
    return f"array({', '.join(map(quoted, values))})"


def anchored(pages: DataFrame, anchors: dict[str, tuple[str, ...]], prefix: tuple[str, ...] = (), threshold: float | None = 0.78) -> DataFrame:
    """``pages`` with a line (or null) for each name: the first that holds its
    text (begins with it, for names in ``prefix``), letter case and white space
    aside; else the first that nearly does.  Of several texts the first that
    any line has, exactly or nearly, counts.

    Of the pages on which an anchor was not found, the distinct texts are
    compared with it; pages themselves stay where they are.
    """
    flat = [(name, k, text) for name, texts in anchors.items() for k, text in enumerate(texts)]
    hit = {}
    for name, k, text in flat:
        test = "startswith" if name in prefix else "contains"
        # what holds a text with its spaces holds it without them too
        hit[f"_{name}{k}"] = f"get(filter(lines, l -> {test}(l.tight, {quoted(''.join(text.lower().split()))})), 0)"
    pages = staged(pages, hit)
    if threshold is not None:
        texts = pages.where(" or ".join(f"{c} is null" for c in hit)).select(F.explode("lines.text").alias("text"))
        pages = fuzzy.Pairs(fuzzy.nearly(texts, [text for *_, text in flat], threshold)).told(pages, "lines.text", "_near")
        pages = staged(pages, {c: f"coalesce({c}, get(lines, cast(array_position(transform(_near, ks -> array_contains(ks, {j})), true) as int) - 1))" for j, c in enumerate(hit)})
    chosen = {name: f"coalesce({', '.join(f'_{name}{k}' for k in range(len(texts)))})" for name, texts in anchors.items()}
    return staged(pages, chosen).drop(*hit, "_near")


def variant(texts: tuple[str, ...]) -> tuple[str, ...]:
    """The longest text first."""
    return tuple(sorted(texts, key=len, reverse=True))


def row(band: str, dy: float, x0: str, x1: str, where: str = "true") -> str:
    """The controls of a band, from left to right."""
    return f"array_sort(filter(controls, c -> abs(c.cy - ({band})) <= {dy}D and c.cx between {x0} and {x1} and {where}))"


def region(x0: str, y0: str, x1: str, y1: str) -> str:
    """The lines with their centre in a rectangle, in line order."""
    return f"filter(lines, l -> l.cx between {x0} and {x1} and l.cy between {y0} and {y1})"


def option(row: str, names: list[str]) -> str:
    """The name of the place of the first selected of a row's first controls."""
    return f"get({array(names)}, cast(array_position(transform(slice({row}, 1, {len(names)}), c -> c.selected), true) as int) - 1)"


def yes_no(row: str, yes: str = "upper(c.label) = 'YES'", no: str = "upper(c.label) = 'NO'") -> str:
    """True or false if one of a row's two answers is selected; without labels
    of both, its first two controls are the answers."""
    labelled = f"(exists({row}, c -> {yes}) and exists({row}, c -> {no})) or size({row}) < 2"
    said = [f"case when {labelled} then exists({row}, c -> c.selected and {test}) else get({row}, {k}).selected end" for k, test in enumerate((yes, no))]
    return f"case when {said[0]} and not {said[1]} then true when {said[1]} and not {said[0]} then false end"


def text_right(a: str, max_dx: float, max_dy: float = 4, label: bool = False) -> str:
    """The nearest text in an anchor's row at most ``max_dx`` to its right; a
    text with a colon is another label, unless the anchor has one."""
    other = "" if label else "and not contains(l.text, ':')"
    near = f"filter(lines, l -> l.i <> {a}.i and abs(l.cy - {a}.cy) <= {max_dy}D and l.x0 - {a}.x1 between 0 and {max_dx}D {other})"
    return f"array_min(transform({near}, l -> named_struct('dx', l.x0 - {a}.x1, 'i', l.i, 'said', l.said))).said"


def text_below(a: str, needle: str, max_dy: float = 12, max_dx: float = 200) -> str:
    """The first text just below an anchor that isn't the anchor's own."""
    return (
        f"get(filter(lines, l -> l.cy > {a}.y1 and l.cy <= {a}.y1 + {max_dy}D and l.x0 between {a}.x0 - 5 and {a}.x0 + {max_dx}D"
        f" and l.said <> '' and not contains(lower(l.text), {quoted(needle.lower())})), 0).said"
    )


def box_left(line: str, reach: float, band: float, nearest: bool = True, where: str = "c.kind = 'checkbox'", among: str = "controls") -> str:
    """The control that ends at most ``reach`` left of a line in its band: the
    nearest, or the first."""
    near = f"filter({among}, c -> {where} and abs(c.cy - {line}.cy) <= {band}D and {line}.x0 - c.right between 0 and {reach}D)"
    if nearest:
        return f"array_min(transform({near}, c -> named_struct('dx', {line}.x0 - c.right, 'i', c.i, 'selected', c.selected)))"
    return f"get({near}, 0)"


def clustered(items: str, tolerance: float, value: str = "l", kind: str = LINE) -> str:
    """Rows (h, of) of lines or controls with a height ``cy``, taken in their
    order: one joins the first row within the tolerance of its height."""
    none = f"cast(array() as array<struct<h:double,of:array<{kind}>>>)"
    at = f"array_position(transform(rows, r -> abs(r.h - {value}.cy) <= {tolerance}D), true)"
    fresh = f"named_struct('h', {value}.cy, 'of', array({value}))"
    joined = f"named_struct('h', (r.h * (size(r.of) + 1) + {value}.cy) / (size(r.of) + 2), 'of', concat(r.of, array({value})))"
    return f"aggregate({items}, {none}, (rows, {value}) -> case when {at} > 0 then transform(rows, (r, k) -> if(k + 1 = {at}, {joined}, r)) else concat(rows, array({fresh})) end)"


def by(items: str, *keys: str, value: str = "l") -> str:
    """Items sorted by keys, the first of equals first."""
    first = ", ".join(f"'k{i}', {k}" for i, k in enumerate(keys))
    return f"transform(array_sort(transform({items}, ({value}, at) -> named_struct({first}, 'at', at, 'of', {value}))), s -> s.of)"
