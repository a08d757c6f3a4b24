"""Pages of forms, one per part, as views in Spark and in SQL.

A template's cells are expressions that both dialects read: a text (null: no
such line) and its place, which vary with the part ``k`` so that anchors
compete, rows overlap, ties occur and boxes are missing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.sources import shared


@dataclass
class Template:
    """Lines (text, x0, y0, width), ten points high, and controls (x, y, w,
    selected, label, kind) in pixels, square."""

    lines: list[tuple[str, str, str, str]]
    controls: list[tuple[str, str, str, str, str, str]] = field(default_factory=list)
    #: (x0, y0, width, height, stroke, fill): the red of a colour, or null.
    drawings: list[tuple[str, str, str, str, str, str]] = field(default_factory=list)
    #: (text, x0, y0, width, colour).
    spans: list[tuple[str, str, str, str, str]] = field(default_factory=list)

    def pages(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        line = ", ".join(f"named_struct('text', {t}, 'x0', cast({x} as double), 'y0', cast({y} as double), 'x1', cast({x} + {w} as double), 'y1', cast({y} + 10 as double))" for t, x, y, w in self.lines)
        ctrl = ", ".join(
            f"named_struct('kind', {kind}, 'x', cast({x} as double), 'y', cast({y} as double), 'w', cast({w} as double), 'h', cast({w} as double), 'selected', {sel}, 'label', {label}, 'conf', cast(0.9 as double))"
            for x, y, w, sel, label, kind in self.controls
        )
        kinds = "array<struct<kind:string,x:double,y:double,w:double,h:double,selected:boolean,label:string,conf:double>>"
        # a number becomes a page of some hundred times its size
        p = shared.dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k")), 20_000)
        rect = lambda x, y, w, h: f"'x0', cast({x} as double), 'y0', cast({y} as double), 'x1', cast({x} + {w} as double), 'y1', cast({y} + {h} as double)"
        red = lambda c: f"case when {c} is not null then array(cast({c} as double), 0D, 0D) end"
        drawn = ", ".join(f"named_struct({rect(x, y, w, h)}, 'color', {red(s)}, 'fill', {red(f)})" for x, y, w, h, s, f in self.drawings)
        spans = ", ".join(f"named_struct('text', {t}, {rect(x, y, w, '10')}, 'color', cast({c} as int))" for t, x, y, w, c in self.spans)
        more = [F.expr(f"array({e})").alias(n) for n, e in (("drawings", drawn), ("spans", spans)) if e]
        return p.select(
            *more,
            F.col("k").alias("page"), F.expr(f"filter(array({line}), l -> l.text is not null)").alias("lines"),
            F.expr(f"filter(cast(array({ctrl}) as {kinds}), c -> c.x is not null)").alias("controls"),
        )

    def sql(self) -> str:
        """ln (page, i, text, said, norm, x0, y0, x1, y1, cx, cy) and ct (page, i,
        kind, x, right_, w, cx, cy, selected, label) as common table expressions."""
        line = ", ".join(f"{{i: {i}, text: {t}, x0: ({x})::double, y0: ({y})::double, x1: ({x} + {w})::double, y1: ({y} + 10)::double}}" for i, (t, x, y, w) in enumerate(self.lines))
        ctrl = ", ".join(f"{{i: {i}, kind: {kind}, x: ({x})::double, y: ({y})::double, w: ({w})::double, selected: {sel}, label: ({label})::varchar}}" for i, (x, y, w, sel, label, kind) in enumerate(self.controls))
        out = f"""kk as (select p_partkey k, p_partkey page from part), l0 as (select k page, unnest([{line}]) l from kk),
ln as (select page, l.i, l.text, trim(l.text) said, trim(lower(l.text)) norm, l.x0, l.y0, l.x1, l.y1, (l.x0 + l.x1) / 2 cx, (l.y0 + l.y1) / 2 cy from l0 where l.text is not null)"""
        if ctrl:
            out += f""", c0 as (select k page, unnest([{ctrl}]) c from kk),
ct as (select page, c.i, c.kind, c.selected, c.label, c.x / (300::double / 72) x, (c.x + c.w) / (300::double / 72) right_, c.w / (300::double / 72) w, (c.x + c.w / 2) / (300::double / 72) cx, (c.y + c.w / 2) / (300::double / 72) cy from c0 where c.x is not null)"""
        if self.drawings:
            drawn = ", ".join(f"{{i: {i}, x0: ({x})::double, y0: ({y})::double, x1: ({x} + {w})::double, y1: ({y} + {h})::double, s: ({s})::double, f: ({f})::double}}" for i, (x, y, w, h, s, f) in enumerate(self.drawings))
            out += f", d0 as (select k page, unnest([{drawn}]) d from kk), dr as (select page, d.*, (d.x0 + d.x1) / 2 cx, (d.y0 + d.y1) / 2 cy from d0)"
        if self.spans:
            spans = ", ".join(f"{{i: {i}, text: {t}, x0: ({x})::double, y0: ({y})::double, x1: ({x} + {w})::double, color: ({c})::int}}" for i, (t, x, y, w, c) in enumerate(self.spans))
            out += f", s0 as (select k page, unnest([{spans}]) s from kk), sp as (select page, s.*, s.y0 + 5 cy from s0)"
        return out

    def anchors(self, anchors: dict[str, tuple[str, ...]], prefix: tuple[str, ...] = ()) -> str:
        """The further expression an (page, name, i, x0, y0, x1, y1, cx, cy)."""
        rows = ", ".join("('{}', {}, '{}', {})".format(n, k, t.replace("'", "''"), str(n in prefix).lower()) for n, ts in anchors.items() for k, t in enumerate(ts))
        return f"""{self.sql()}, nm(name, k, needle, pre) as (values {rows}),
aw as (select page, i, name, k, pre, needle, norm, replace(norm, ' ', '') tight, replace(needle, ' ', '') needle_tight, regexp_replace(norm, '[^a-z0-9]', '', 'g') bare, regexp_replace(needle, '[^a-z0-9]', '', 'g') needle_bare,
list_distinct(regexp_extract_all(norm, '\\w+')) w, list_distinct(regexp_extract_all(needle, '\\w+')) nw from ln, nm),
at_ as (select page, i, name, k, case when pre and (starts_with(norm, needle) or starts_with(tight, needle_tight)) or not pre and (contains(norm, needle) or contains(tight, needle_tight)) then 0
when contains(norm, needle) or contains(bare, needle_bare) or contains(needle, ' ') and len(list_intersect(w, nw)) >= 0.5::double * len(list_distinct(list_concat(w, nw))) then 1 end tier from aw),
ah as (select page, name, k, min((tier, i)) t from at_ where tier is not null group by all),
an as (select h.name, ln.* from (select page, name, arg_min(t[2], k) i from ah group by all) h join ln using (page, i))"""


def clusters(items: str, tolerance: float, name: str = "cl") -> str:
    """Recursive expressions for rows of ``items`` (page, n, i, cy), n the order
    from 1: ``name`` (page, i, row_)."""
    return f"""{name}_f(page, n, hs, row_at) as (select page, 0::bigint, []::struct(h double, c int)[], 0::bigint from {items} group by page
union all select f.page, f.n + 1, case when j.p is null then list_append(f.hs, {{h: t.cy, c: 1}}) else list_transform(f.hs, lambda r, q: case when q = j.p then {{h: (r.h * (r.c + 1) + t.cy) / (r.c + 2), c: r.c + 1}} else r end) end, coalesce(j.p, len(f.hs) + 1)
from {name}_f f join {items} t on t.page = f.page and t.n = f.n + 1, lateral (select nullif(list_position(list_transform(f.hs, lambda r: abs(r.h - t.cy) <= {tolerance}), true), 0)::bigint p) j),
{name} as (select f.page, t.i, f.row_at row_, f.n from {name}_f f join {items} t on t.page = f.page and t.n = f.n where f.n > 0)"""


def texts(*choices: str | None) -> str:
    """One of the texts, by part."""
    when = " ".join(f"when {i} then " + ("null" if c is None else "'" + c.replace("'", "''") + "'") for i, c in enumerate(choices))
    return f"case cast(k % {len(choices)} as int) {when} end"
