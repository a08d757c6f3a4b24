"""What any page states: pairs, dates, entities, tables, headings, controls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.extractors import page as P
from leafwright.functions import text as T

# Patterns and keys of promoted fields.
DATE = r"\b(\d{1,2}/\d{1,2}/\d{4})\b"
NAME_KEYS = ("patient name", "patient's name", "name", "member name", "employee name")
BIRTH_KEYS = ("date of birth", "dob", "birth date")
NAME_LABEL = r"(?i)^Patient(?:'s Name)?:?\s*$"
NAME_INLINE = r"(?i)Patient(?:'s)?\s*(?:Name)?[:\s]+([A-Z][a-z]+(?:\s+[A-Z]\.?\s*)*[A-Z][a-z]+)"
BIRTH_LABEL = r"(?i)^(?:Date of Birth|DOB):?\s*$"
BIRTH_INLINE = (r"DOB[:\s]+(\d{1,2}/\d{1,2}/\d{4})", r"(?i)Date of Birth[:\s]+(\d{1,2}/\d{1,2}/\d{4})")
PROVIDER_LABEL = r"(?i)^(?:Provider|Records? From|Attending)[:\s]*$"
NOT_PROVIDERS = ("PAGE", "DATE", "CONFID", "MEDICAL RECORD")


def pairs() -> str:
    """(label, value) of "Label: value" lines, and of labels with the line after them."""
    kv = P.quoted(T.KEY_VALUE)
    strip = lambda e: f"regexp_replace({e}, '^\\\\s+|\\\\s+$', '')"
    said, after = "l.said", "get(lines, i + 1).said"
    label = strip(f"left({said}, length({said}) - 1)")
    value = strip(f"regexp_extract({said}, {kv}, 2)")
    inline = f"case when {value} <> '' and not startswith({value}, '_') then named_struct('label', {strip(f'regexp_extract({said}, {kv}, 1)')}, 'value', {value}) end"
    below = f"case when endswith({said}, ':') and length({label}) >= 2 and length({after}) >= 1 and not endswith({after}, ':') and not startswith({after}, '_') then named_struct('label', {label}, 'value', {after}) end"
    return f"filter(transform(lines, (l, i) -> case when {said} rlike {kv} then {inline} else {below} end), p -> p is not null)"


def dates() -> str:
    """(date, context) of each distinct date: the text up to 40 characters before its first place."""
    found, pieces = f"regexp_extract_all(l.text, {P.quoted(DATE)}, 1)", f"split(l.text, {P.quoted(DATE)})"
    start = f"length(array_join(slice({pieces}, 1, j + 1), '')) + length(array_join(slice({found}, 1, j), ''))"
    context = f"regexp_replace(substring(l.text, greatest({start} - 40, 0) + 1, least({start}, 40)), '^\\\\s+|[_\\\\s]+$', '')"
    context = f"nullif(regexp_replace(regexp_replace({context}, ':$', ''), '^\\\\s+|\\\\s+$', ''), '')"
    every = f"flatten(transform(lines, l -> transform({found}, (d, j) -> named_struct('date', d, 'context', {context}))))"
    return f"transform(array_distinct(transform({every}, e -> e.date)), d -> get(filter({every}, e -> e.date = d), 0))"


def tables() -> str:
    """(row_count, col_count, header, rows) of runs of two or more ``rows``
    (by height) with three or more cells."""
    numbered = "transform(rows, (r, k) -> named_struct('run', size(filter(slice(rows, 1, k), q -> size(q.of) < 3)), 'cells', transform(" + P.by("r.of", "l.x0") + ", l -> l.said)))"
    full = f"filter({numbered}, r -> size(r.cells) >= 3)"
    runs = f"filter(transform(array_distinct(transform({full}, r -> r.run)), n -> transform(filter({full}, r -> r.run = n), r -> r.cells)), t -> size(t) >= 2)"
    return f"transform({runs}, t -> named_struct('row_count', size(t), 'col_count', array_max(transform(t, c -> size(c))), 'header', t[0], 'rows', slice(t, 2, size(t) - 1)))"


def headings(spans: str = "spans") -> str:
    """The texts of spans (text, size, font) larger than the most common size or bold, at most 20."""
    said = "regexp_replace(s.text, '^\\\\s+|\\\\s+$', '')"
    own = f"filter(transform({spans}, s -> named_struct('size', s.size, 'font', s.font, 'said', {said})), s -> length(s.said) > 2)"
    sizes = f"transform({own}, s -> round(s.size, 1))"
    body = f"array_max(transform(array_distinct({sizes}), (z, i) -> named_struct('n', size(filter({sizes}, y -> y = z)), 'first', -i, 'size', z))).size"
    return f"slice(transform(filter({own}, s -> (s.size > {body} + 1.5 or contains(lower(s.font), 'bold') or contains(s.font, 'Black')) and length(s.said) between 4 and 79 and not s.said rlike '^[\\\\d/.$,\\\\s]+$'), s -> s.said), 1, 20)"


def form_fields(widgets: str = "widgets") -> str:
    """(field_name, field_value, field_type) of form widgets that state something; boxes without a value say so."""
    box = "w.type in ('CheckBox', 'RadioButton')"
    named = f"filter({widgets}, w -> coalesce(w.name, '') <> '' and (coalesce(w.value, '') <> '' or {box}))"
    return f"transform({named}, w -> named_struct('field_name', w.name, 'field_value', if(coalesce(w.value, '') <> '', w.value, 'unchecked'), 'field_type', w.type))"


def entities(text: str) -> dict[str, str]:
    """Expressions of the entities of a text, capped as lists of each kind are."""
    found = lambda pattern, n, group=0: f"slice(array_distinct(regexp_extract_all({text}, {P.quoted(pattern)}, {group})), 1, {n})"
    every = lambda pattern: f"array_distinct(regexp_extract_all({text}, {P.quoted(pattern)}, 0))"
    worth = "try_cast(replace(replace(m, '$', ''), ',', '') as double)"
    return {
        "phone_numbers": found(T.PHONE, 5), "emails": found(T.EMAIL, 5), "mrn": found(T.MRN, 3, 1), "npi": found(T.NPI, 3, 1), "ssn_detected": f"transform({found(T.SSN, 3)}, s -> concat('***-**-', right(s, 4)))",
        "currency_values": f"slice(transform(array_sort(transform({every(T.CURRENCY)}, (m, i) -> named_struct('v', -{worth}, 'i', i, 'm', m))), s -> s.m), 1, 10)",
        "icd10_codes": f"slice(array_sort({every(T.ICD10)}), 1, 15)",
    }


def _after(label: str, value: str) -> str:
    """The first value, an expression of ``n``, of a line that follows a label."""
    return f"get(filter(transform(lines, (l, i) -> case when l.said rlike {P.quoted(label)} then transform(array(get(lines, i + 1).said), n -> {value})[0] end), v -> v is not null), 0)"


def generic(pages: DataFrame) -> DataFrame:
    """(page, key_value_pairs, selected_controls, dates, entities, tables,
    section_headers, acroform_fields, patient_name, patient_dob, provider_name,
    mrn, diagnoses, stats) of prepared pages, which may have ``spans`` and
    ``widgets``; what is not found is null or an empty list."""
    for name, kind in (("spans", "array<struct<text:string,size:double,font:string>>"), ("widgets", "array<struct<name:string,value:string,type:string>>")):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.array().cast(kind))
    group = lambda text, pattern: f"nullif(regexp_extract({text}, {P.quoted(pattern)}, 1), '')"
    keyed = lambda keys: ", ".join(f"try_element_at(filter(key_value_pairs, p -> lower(p.label) = {P.quoted(k)}), -1).value" for k in keys)
    filled = "filter(acroform_fields, f -> f.field_value not in ('checked', 'unchecked'))"
    p = P.staged(
        pages,
        {"key_value_pairs": pairs(), "dates": dates(), "rows": P.clustered(P.by("lines", "l.cy"), 3), "section_headers": headings(), "acroform_fields": form_fields(), "full_text": "array_join(transform(lines, l -> l.text), ' ')",
         "selected_controls": "transform(filter(controls, c -> c.selected), c -> named_struct('kind', c.kind, 'label', c.label, 'confidence', round(coalesce(c.conf, 0), 3)))"},
        {"tables": tables(), "more_text": "concat_ws(' ', full_text, nullif(array_join(transform(acroform_fields, f -> f.field_value), ' '), ''))"},
        {f"e_{k}": e for k, e in entities("full_text").items()} | {f"m_{k}": e for k, e in entities("more_text").items()},
    )
    # widgets add kinds of entities that the page's own text lacks
    p = P.staged(
        p, {"entities": "named_struct(" + ", ".join(f"'{k}', if(size(e_{k}) > 0, e_{k}, m_{k})" for k in entities("")) + ")"},
        {
            "patient_name": f"coalesce({keyed(NAME_KEYS)}, {_after(NAME_LABEL, 'case when length(n) > 2 and not startswith(n, ' + P.quoted('Date') + ') then n end')}, {group('full_text', NAME_INLINE)})",
            "patient_dob": f"coalesce({keyed(BIRTH_KEYS)}, {_after(BIRTH_LABEL, group('n', DATE))}, {', '.join(group('full_text', x) for x in BIRTH_INLINE)})",
            "provider_name": f"coalesce({_after(PROVIDER_LABEL, 'case when length(n) > 2 then n end')}, get(filter(slice(lines, 1, 5), l -> length(l.said) > 5 and not ({' or '.join(f'startswith(upper(l.said), {P.quoted(w)})' for w in NOT_PROVIDERS)})), 0).said)",
            "mrn": "get(entities.mrn, 0)", "diagnoses": "entities.icd10_codes",
            "stats": f"named_struct('text_lines', size(lines), 'controls_total', size(controls), 'controls_selected', size(selected_controls), 'key_value_pairs', size(key_value_pairs) + size({filled}), 'dates_found', size(dates), 'tables_found', size(tables), 'acroform_fields', size(acroform_fields))",
        },
    )
    return p.select("page", "key_value_pairs", "selected_controls", "dates", "entities", "tables", "section_headers", "acroform_fields", "patient_name", "patient_dob", "provider_name", "mrn", "diagnoses", "stats")
