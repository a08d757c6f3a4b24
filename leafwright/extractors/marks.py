"""Marks and overlaid text that a user has put on a printed page."""

from __future__ import annotations

from pyspark.sql import DataFrame

from leafwright.extractors import page as P


def _colour(colour: str, exclude: list[tuple[float, float, float]]) -> str:
    """A colour rounded, or null if it is black or one of the form's own."""
    own = ", ".join(f"array({', '.join(f'{c}D' for c in x)})" for x in exclude)
    rounded = f"transform(slice({colour}, 1, 3), v -> round(v, 3))"
    keep = f"exists(slice({colour}, 1, 3), v -> v > 0.05D)" + (f" and not array_contains(array({own}), {rounded})" if own else "")
    return f"case when {keep} then {rounded} end"


def found(drawings: str = "drawings", most: float = 40, least: float = 2, exclude: list[tuple[float, float, float]] | None = None) -> str:
    """The marks (cy, cx, x0, y0, x1, y1, kind, size, color) among drawings (x0,
    y0, x1, y1, color, fill): coloured, by stroke or else by fill, and neither
    small nor large; from top to bottom."""
    stroke, fill = (_colour(c, exclude or []) for c in ("d.color", "d.fill"))
    size = "greatest(d.x1 - d.x0, d.y1 - d.y0)"
    one = f"named_struct('cy', (d.y0 + d.y1) / 2, 'cx', (d.x0 + d.x1) / 2, 'i', i, 'x0', d.x0, 'y0', d.y0, 'x1', d.x1, 'y1', d.y1, 'kind', if({stroke} is not null, 'stroke', 'fill'), 'size', {size}, 'color', coalesce({stroke}, {fill}))"
    return f"array_sort(filter(transform({drawings}, (d, i) -> {one}), m -> m.color is not null and m.size between {least} and {most}))"


def overlaid(spans: str = "spans") -> str:
    """The spans (text, color, x0, y0, x1, y1) that are not black, with (r, g, b)."""
    said = "regexp_replace(s.text, '^\\\\s+|\\\\s+$', '')"
    one = f"named_struct('said', {said}, 'x0', s.x0, 'y0', s.y0, 'x1', s.x1, 'y1', s.y1, 'cy', (s.y0 + s.y1) / 2, 'rgb', array(shiftright(s.color, 16) & 255, shiftright(s.color, 8) & 255, s.color & 255))"
    return f"transform(filter({spans}, s -> coalesce(s.color, 0) <> 0 and {said} <> ''), s -> {one})"


def nearest(a: str, direction: str, max_dy: float, max_dx: float, overlays: str = "overlays") -> str:
    """The text of the overlay of least score below or right of a box."""
    if direction == "below":
        near = f"o.cy - {a}.y1 between -2 and {max_dy} and o.x0 between {a}.x0 - 20 and {a}.x1 + {max_dx}"
        score = f"o.cy - {a}.y1 + abs(o.x0 - {a}.x0) * 0.1D"
    else:
        near = f"o.x0 - {a}.x1 between -30 and {max_dx} and abs(o.cy - ({a}.y0 + {a}.y1) / 2) <= {max_dy}"
        score = f"abs(o.x0 - {a}.x1) + abs(o.cy - ({a}.y0 + {a}.y1) / 2) * 0.5D"
    return f"array_min(transform(filter({overlays}, o -> {near}), (o, i) -> named_struct('score', {score}, 'i', i, 'said', o.said))).said"


def phrase(text: str) -> str:
    """The box of a phrase's first place in a line: its share of the line's width."""
    t = P.quoted(text)
    at, n = f"(locate({t}, lower(l.text)) - 1)", f"greatest(length(l.text), 1)"
    box = f"named_struct('x0', l.x0 + (l.x1 - l.x0) * {at} / {n}, 'y0', l.y0, 'x1', l.x0 + (l.x1 - l.x0) * ({at} + {len(text)}) / {n}, 'y1', l.y1)"
    return f"get(transform(filter(lines, l -> contains(lower(l.text), {t})), l -> {box}), 0)"


def on_mark(line: str, marks: str = "marks") -> str:
    """Whether any mark touches a text's box, grown by 6 and 4 points and the margin of 2."""
    return f"exists({marks}, m -> m.x1 >= {line}.x0 - 8 and m.x0 <= {line}.x1 + 8 and m.y1 >= {line}.y0 - 6 and m.y0 <= {line}.y1 + 6)"


def letter(a: str, candidates: list[str], max_dy: float = 25, max_dx: float = 150) -> str:
    """The first candidate whose first text near an anchor is marked."""
    place = f"get(filter(lines, l -> l.said = c and abs(l.cy - {a}.cy) <= {max_dy} and l.cx >= {a}.x0 - 20 and l.cx <= {a}.x1 + {max_dx}), 0)"
    return f"get(filter(transform({P.array(candidates)}, c -> named_struct('c', c, 'l', {place})), q -> q.l is not null and {on_mark('q.l')}), 0).c"


def likert(marks: str = "marks") -> str:
    """Scores of the rows that print 0, 1, 2 and 3, from top to bottom: the
    first digit with a mark, or null."""
    digits = P.by("filter(lines, l -> l.said in ('0', '1', '2', '3'))", "l.cy")
    whole = f"filter({P.clustered(digits, 4)}, r -> size(array_distinct(transform(r.of, l -> l.said))) = 4)"
    score = "cast(get(filter(" + P.by("r.of", "l.said") + f", l -> {on_mark('l', marks)}), 0).said as int)"
    return f"transform(array_sort(transform({whole}, (r, i) -> named_struct('h', r.h, 'i', i, 'score', {score}))), s -> s.score)"


#: Overlays of a printed report of injury: anchor, direction, reach.
OVERLAYS = {
    "employee_name": ("name (first", "below", 20, 250), "accident_date": ("date of accident", "below", 20, 250), "employee_dob": ("date of birth", "below", 20, 250), "occupation": ("occupation", "below", 20, 250),
    "company_name": ("company name", "right", 8, 300), "body_part": ("part of body affected", "below", 20, 200), "injury_description": ("injury/illness that occurred", "below", 20, 250), "place_of_accident": ("place of accident", "below", 20, 400),
}


def marked_report(pages: DataFrame, threshold: float | None = 0.78) -> DataFrame:
    """Fields of prepared pages with ``drawings`` and ``spans``, read from
    overlaid text and circled letters; null where nothing is put."""
    p = P.anchored(pages, {"at_sex": ("sex",), "at_time": ("time of accident",)}, (), threshold)
    p = P.staged(p, {"marks": found(), "overlays": overlaid(), **{f"a_{k}": phrase(v[0]) for k, v in OVERLAYS.items()}})
    fields = {k: nearest(f"a_{k}", *v[1:]) for k, v in OVERLAYS.items()}
    for k in ("accident_date", "employee_dob"):
        fields[k] = f"case when {fields[k]} rlike '^\\\\d{{2}}/\\\\d{{2}}/\\\\d{{4}}' then {fields[k]} end"
    p = P.staged(p, fields | {"employee_sex": letter("at_sex", ["M", "F"], 25, 120), "am_pm": letter("at_time", ["AM", "PM"], 25, 400), "marks_detected": "size(marks)", "overlays_detected": "size(overlays)"})
    return p.select("page", *fields, "employee_sex", "am_pm", "marks_detected", "overlays_detected")
