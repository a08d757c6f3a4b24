"""Fields of explanations of benefits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.extractors import page as P
from leafwright.extractors.claim import _price

# Patterns, the money columns, the labels of the summary box.
DATE = r"\b(\d{2}/\d{2}/\d{4})\b"
REASON = r"\b([A-Z]{2}-\d{1,4})\b"
MONEY = ("billed", "allowed", "deductible", "copay", "coinsurance", "plan_paid", "patient_resp")
SUMMARY_LABELS = {"deductible": "deductible", "copay": "copay", "coinsurance": "coinsurance", "total patient owes": "patient_resp", "total patient": "patient_resp", "plan paid": "plan_paid"}
ANCHORS = {"at_title": ("explanation of benefits",), "at_billed": ("billed",), "at_claim": ("claim number",), "at_check": ("check number",), "at_member": ("member name",)}
#: How a header line t names a column, in the order in which columns are told.
COLUMNS = {
    "date_of_service": "contains({t}, 'date')", "cpt": "endswith({t}, 'cpt') or contains(right({t}, 4), 'cpt')", "billed": "startswith({t}, 'billed')", "allowed": "startswith({t}, 'allowed')",
    "deductible": "contains({t}, 'deductible')", "copay": "{t} = 'copay'", "coinsurance": "contains({t}, 'coins')", "plan_paid": "contains({t}, 'plan')",
    "patient_resp": "contains({t}, 'pt resp') or contains({t}, 'patient')", "reason": "{t} = 'rsn' or contains({t}, 'reason')",
}


def _last(items: str) -> str:
    return f"try_element_at({items}, -1)"


def _found(items: str) -> str:
    return f"filter({items}, v -> v is not null)"


def _columns() -> str:
    """The columns that a header row states: (x, k, name)."""
    out = []
    for k, (name, test) in enumerate(COLUMNS.items()):
        at = _last(f"filter(transform(headers, (h, j) -> named_struct('j', j, 'x', h.x0, 't', lower(h.said))), h -> {test.format(t='h.t')})")
        x = f"{at}.x"
        if name == "cpt":
            # told in one cell with the date, it stands further to the right
            date = _last(f"filter(slice(headers, 1, {at}.j + 1), h -> contains(lower(h.said), 'date'))") + ".x0"
            x = f"case when {at} is not null then {x} + case when coalesce(abs({x} - {date}) < 5, false) then 55 else 0 end end"
        out.append(f"named_struct('x', {x}, 'k', {k}, 'name', '{name}')")
    return f"filter(array({', '.join(out)}), c -> c.x is not null)"


def _row(cells: str) -> str:
    """The values of a row's cells (col, said), the last valid of a column."""
    valid = lambda name, value: _last(_found(f"transform(filter({cells}, c -> c.col = '{name}'), c -> {value})"))
    codes = f"regexp_extract_all(c.said, {P.quoted(REASON)}, 1)"
    return "named_struct(" + ", ".join([
        "'date_of_service', " + valid("date_of_service", f"nullif(regexp_extract(c.said, {P.quoted(DATE)}, 1), '')"), "'cpt', " + valid("cpt", "case when c.said rlike '^\\\\d{5}$' then c.said end"),
        *(f"'{m}', " + valid(m, _price("c.said")) for m in MONEY), "'reason', " + valid("reason", f"case when size({codes}) > 0 then {codes} end"),
    ]) + ")"


def _summary(field: str) -> str:
    """What the summary box says of a field: the last line with its value."""
    labels = list(SUMMARY_LABELS)
    own = [n for n, f in SUMMARY_LABELS.items() if f == field]
    low = "lower(l.text)"
    first = "case " + " ".join(f"when contains({low}, '{n}') then '{SUMMARY_LABELS[n]}'" for n in labels) + " end"
    beside = f"get({_found('transform(filter(lines, m -> m.i <> l.i and abs(m.cy - l.cy) <= 4), m -> ' + _price('m.text') + ')')}, 0)"
    has = " or ".join(f"contains({low}, '{n}')" for n in own)
    value = f"case when {_price('l.text')} is not null then case when {first} = '{field}' then {_price('l.text')} end when {has} then {beside} end"
    return _last(_found(f"transform(summary, l -> {value})"))


def benefits(pages: DataFrame, threshold: float | None = 0.78) -> DataFrame:
    """(page, payer_name, claim_number, check_number, member_name, service_lines,
    service_line_count, service_line_cpts, totals, summary_*, total_*,
    reason_codes_used) of prepared pages."""
    p = P.anchored(pages, ANCHORS, (), threshold)
    payer = "filter(lines, l -> not contains(lower(l.text), 'not a bill') and not contains(lower(l.text), 'explanation of benefits') and l.cy > at_title.y1 and l.cy <= at_title.y1 + 30 and l.x0 < 300)"
    near = "array_min(transform(filter(columns, c -> abs(l.x0 - c.x) <= 40), c -> named_struct('d', abs(l.x0 - c.x), 'x', c.x, 'k', c.k, 'name', c.name))).name"
    cells = f"transform(filter(r, l -> upper(l.said) <> 'TOTALS'), l -> named_struct('col', {near}, 'said', l.said))"
    heads = {
        "payer_name": f"array_min(transform({payer}, l -> named_struct('y', l.cy, 'x', l.x0, 'i', l.i, 'said', l.said))).said",
        "claim_number": P.text_right("at_claim", 250), "check_number": P.text_right("at_check", 250), "member_name": P.text_right("at_member", 300),
        "head": "coalesce(get(filter(lines, l -> contains(lower(l.text), 'billed') and contains(lower(l.text), 'allowed')), 0), at_billed)",
        "summary": "filter(lines, l -> l.i >= get(filter(lines, m -> contains(lower(m.text), 'patient responsibility') or contains(lower(m.text), 'patient owes')), 0).i)",
    }
    p = P.staged(
        p, heads, {"headers": P.by("filter(lines, l -> abs(l.cy - head.cy) <= 3)", "l.x0")}, {"columns": _columns(), "rows": P.clustered(P.by("lines", "l.cy"), 3)},
        {"rows": f"transform(filter(rows, r -> size(columns) > 0 and r.h > head.cy + 8), q -> {P.by('q.of', 'l.x0')})"},
        {"cells": f"transform(rows, r -> named_struct('ends', exists(r, l -> upper(l.said) = 'TOTALS'), 'cells', {cells}))"},
        {"parsed": f"transform(cells, r -> named_struct('ends', r.ends, 'v', {_row('r.cells')}))"},
        {"end": "cast(nullif(array_position(transform(parsed, r -> r.ends), true), 0) as int) - 1"},
        {"service_lines": "filter(transform(slice(parsed, 1, coalesce(end, size(parsed))), r -> r.v), v -> v.cpt is not null or v.date_of_service is not null)", "totals": "get(parsed, end).v",
         **{f"summary_{f}": _summary(f) for f in dict.fromkeys(SUMMARY_LABELS.values())}},
        {
            "service_line_count": "size(service_lines)", "service_line_cpts": _found("transform(service_lines, v -> v.cpt)"), "total_billed": "totals.billed", "total_allowed": "totals.allowed",
            # the summary box is asked only if the table states no patient's total
            "total_plan_paid": "coalesce(totals.plan_paid, case when totals.patient_resp is null then summary_plan_paid end)", "total_patient_resp": "coalesce(totals.patient_resp, summary_patient_resp)",
            "reason_codes_used": "array_sort(array_distinct(flatten(" + _found("transform(service_lines, v -> v.reason)") + ")))",
        },
        {"reason_codes_used": f"case when size(reason_codes_used) > 0 then reason_codes_used else array_sort(array_distinct(regexp_extract_all(array_join(transform(lines, l -> l.text), ' '), {P.quoted(REASON)}, 1))) end"},
    )
    if "text_again" in pages.columns:
        # codes of a second, closer reading, where the table gave none
        again = procedure_codes(F.col("text_again"))
        none = (F.size("service_line_cpts") == 0) & (F.size(again) > 0)
        p = p.withColumn("service_line_count", F.when(none, F.size(again)).otherwise(F.col("service_line_count"))).withColumn("service_line_cpts", F.when(none, again).otherwise(F.col("service_line_cpts")))
    return p.select(
        "page", "payer_name", "claim_number", "check_number", "member_name", "service_lines", "service_line_count", "service_line_cpts", "totals",
        *(f"summary_{f}" for f in dict.fromkeys(SUMMARY_LABELS.values())), "total_billed", "total_allowed", "total_plan_paid", "total_patient_resp", "reason_codes_used",
    )


def procedure_codes(text: Column, digits: str = "5") -> Column:
    """The distinct procedure codes of a text, sorted: numbers of so many digits (``5,``: or more)."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(rf"\b(\d{{{digits}}})\b"), F.lit(1)), lambda c: c >= "10000")))


def table_values(tables: Column, digits: str = "5") -> Column:
    """Codes and totals of detected tables (rows of cells), header rows apart:
    codes (of so many ``digits``) in the first three columns, totals by their column."""
    rows = F.flatten(F.transform(tables, lambda t: F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))))
    is_total = lambda r: F.exists(F.slice(r, 1, 2), lambda c: F.contains(F.lower(c), F.lit("total")))
    codes = F.flatten(F.transform(F.filter(rows, lambda r: ~is_total(r)), lambda r: F.flatten(F.transform(F.slice(r, 1, 3), lambda c: procedure_codes(c, digits)))))
    every = F.flatten(F.transform(rows, lambda r: F.flatten(F.transform(r, lambda c: F.regexp_extract_all(c, F.lit(REASON), F.lit(1))))))

    def total(at: int) -> Column:
        shown = F.flatten(F.transform(F.filter(rows, is_total), lambda r: F.coalesce(F.regexp_extract_all(F.get(r, F.lit(at)), F.lit(r"\$?([\d,]+\.\d{2})"), F.lit(1)), F.array().cast("array<string>"))))
        value = F.try_element_at(F.filter(F.transform(shown, lambda s: F.replace(s, F.lit(","), F.lit("")).try_cast("double")), lambda v: v.isNotNull()), F.lit(-1))
        return F.when(value > 0, value)

    cpts = F.array_sort(F.array_distinct(codes))
    return F.struct(
        F.when(F.size(cpts) > 0, cpts).alias("service_line_cpts"), F.when(F.size(cpts) > 0, F.size(cpts)).alias("service_line_count"),
        total(2).alias("total_billed"), total(3).alias("total_allowed"), total(7).alias("total_plan_paid"), F.array_sort(F.array_distinct(every)).alias("reason_codes"),
    )
