"""Queries of what any page states, with their SQL over flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.extractors import generic
from leafwright.extractors import page as P
from leafwright.plans.claim_queries import box
from leafwright.plans.queries import query
from leafwright.sources import shared
from leafwright.sources.form_pages import Template, clusters, texts

_NOTE = Template(
    [
        (texts("PAGE 1 of 3", "Valley Clinic", "short", "Medical record of care", "Confidential: x"), "20", "20", "100"), ("concat('Clinic No ', k)", "20", "34", "100"),
        (texts("Patient Name: Person A", "Patient Name:", "Patient:", "Name: Zed  ", "Patient's Name", "Member Name: M"), "20", "48", "100"), (texts("Person B", "Date of Birth:", "X", "_____", "Anna B. Cole"), "20", "62", "100"),
        (texts("DOB: 1/2/1960", "Date of Birth", "DOB:", "Birth Date: 3/4/1970", "born 05/06/1980"), "20", "76", "100"), (texts("07/08/1990 or so", "unknown", "seen 9/9/1999"), "20", "90", "100"),
        ("concat('Visit on ', 1 + k % 12, '/', 10 + k % 18, '/2024 and follow-up __ : 0', 1 + k % 9, '/11/2024, again ', 1 + k % 12, '/', 10 + k % 18, '/2024')", "20", "104", "300"),
        (texts("Provider:", "Records From", "Attending :", "Provider: Dr. Q", "none"), "20", "118", "60"), (texts("Dr. Who", "XY", "Valley Care"), "20", "132", "60"),
        ("concat('Call (555) 010-', 1000 + k, ' or 555.010.', 1000 + k % 7, '; mail p', k, '@site.org')", "20", "146", "200"), ("concat('MRN: A', 1000 + k, case when k % 2 = 0 then ' MR# ZZ-9 and Medical Record 12345' else '' end)", "20", "160", "200"),
        ("concat('NPI: ', 1000000000 + k, case when k % 3 = 0 then ' npi# 2000000000 NPI 3000000000 NPI 4000000000' else '' end)", "20", "174", "200"), ("concat('SSN 123-45-', 1000 + k % 9000)", "20", "188", "90"),
        ("concat('Cost $', k % 90, ' and $1,', 100 + k % 900, '.50 and $', k % 90)", "20", "202", "90"), ("concat('Dx M', 10 + k % 80, '.2, S13.4, A', 10 + k % 7)", "20", "216", "90"),
        *[(f"case when (k + {r}) % 4 > 0 or {c} < 2 then concat('c{r}{c} ', k % 5) end", f"{20 + 60 * c} + (k * {c}) % 7", f"{240 + 12 * r} + (k + {c}) % 3", "40") for r in range(6) for c in (2, 0, 1)],
        (texts("A-Label: ", "Notes: ____", "Lab/Test (x): value: more", "9Key: no"), "20", "330", "60"), (texts("next value", "Other:", "_x"), "20", "344", "60"),
    ],
    [box(f"20 + {30 * i}", "400", f"(k + {i}) % 3 = 0", f"'L{i} '", kind="'radio'" if i % 2 else "'checkbox'") for i in range(4)],
)
_N = _NOTE.sql()
_D = "\\b(\\d{1,2}/\\d{1,2}/\\d{4})\\b"
_KV = "^([A-Z][A-Za-z\\s/&''.()-]{2,40}):\\s+(.{1,200})$"
_PAIRS = f"""nx as (select *, lead(said) over (partition by page order by i) after, said || '' as s from ln),
kv as (select page, i, case when regexp_matches(said, '{_KV}') then trim(regexp_extract(said, '{_KV}', 1)) else trim(left(said, len(said) - 1)) end label, case when regexp_matches(said, '{_KV}') then trim(regexp_extract(said, '{_KV}', 2)) else after end as value
from nx where case when regexp_matches(said, '{_KV}') then not starts_with(trim(regexp_extract(said, '{_KV}', 2)), '_') else ends_with(said, ':') and len(trim(left(said, len(said) - 1))) >= 2 and len(after) >= 1 and not ends_with(after, ':') and not starts_with(after, '_') end)"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generic.generic(P.prepare(_NOTE.pages(spark, sf_dir)))


@query(f"with {_N}, {_PAIRS} select page, row_number() over (partition by page order by i) n, label, value from kv")
def page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("page", F.posexplode("key_value_pairs").alias("n", "p")).select("page", (F.col("n") + 1).cast("long").alias("n"), "p.label", "p.value")


@query(f"""with {_N}, m as (select page, i, text, unnest(regexp_extract_all(text, '{_D}', 1)) d, generate_subscripts(regexp_extract_all(text, '{_D}', 1), 1) j, regexp_split_to_array(text, '{_D.replace("(", "").replace(")", "")}') pc, regexp_extract_all(text, '{_D}', 1) al from ln),
s as (select *, len(array_to_string(pc[1:j], '')) + len(array_to_string(al[1:j - 1], '')) st from m), c as (select page, i, j, d, trim(regexp_replace(trim(text[greatest(st - 40, 0) + 1:st]), '[_ ]+$', '')) x from s),
f as (select *, row_number() over (partition by page, d order by i, j) r from c) select page, d as date_, nullif(trim(case when ends_with(x, ':') then left(x, len(x) - 1) else x end), '') context from f where r = 1""")
def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("page", F.explode("dates").alias("d")).select("page", F.col("d.date").alias("date_"), "d.context")


def _caps(kind: str, pattern: str, most: int, group: int = 0, order: str = "min(j)", shown: str = "s") -> str:
    return f"""{kind}_ as (select page, array_to_string(list({shown} order by o)[1:{most}], ',') {kind} from (select page, s, {order} o from (select page, unnest(regexp_extract_all(t, '{pattern}', {group})) s, generate_subscripts(regexp_extract_all(t, '{pattern}', {group}), 1) j from ft) group by 1, 2) group by 1)"""


_ENT = ", ".join([
    _caps("phones", "\\(?\\d{3}\\)?[\\s.-]?\\d{3}[\\s.-]?\\d{4}", 5), _caps("emails", "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b", 5), _caps("mrns", "(?i)\\b(?:MRN|MR#|Medical Record)\\s*[:#]?\\s*([A-Z0-9-]{4,15})\\b", 3, 1),
    _caps("npis", "(?i)\\bNPI[:\\s#]*(\\d{10})\\b", 3, 1), _caps("ssns", "\\b\\d{3}-\\d{2}-\\d{4}\\b", 3, shown="'***-**-' || right(s, 4)"),
    _caps("amounts", "\\$\\d+(?:,\\d{3})*(?:\\.\\d{2})?", 10, order="(-replace(replace(s, '$', ''), ',', '')::double, min(j))"), _caps("codes", "\\b[A-TV-Z]\\d{2}(?:\\.[A-Z0-9]{1,5})?\\b", 15, order="s"),
])


@query(f"with {_N}, ft as (select page, string_agg(text, ' ' order by i) t from ln group by page), {_ENT} select page, " + ", ".join(f"coalesce({k}, '') {k}" for k in ("phones", "emails", "mrns", "npis", "ssns", "amounts", "codes")) + " from kk " + " ".join(f"left join {k}_ using (page)" for k in ("phones", "emails", "mrns", "npis", "ssns", "amounts", "codes")))
def page_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"phone_numbers": "phones", "emails": "emails", "mrn": "mrns", "npi": "npis", "ssn_detected": "ssns", "currency_values": "amounts", "icd10_codes": "codes"}
    return notes(spark, sf_dir).select("page", *(F.array_join(f"entities.{k}", ",").alias(v) for k, v in names.items()))


_TABS = f"""it as (select *, row_number() over (partition by page order by cy, i) n from ln), {clusters("it", 3)}, rc as (select page, row_, count(*) c from cl group by 1, 2),
ri as (select *, sum((c < 3)::int) over (partition by page order by row_) run from rc), rt as (select page, run, count(*)::int row_count, max(c)::int col_count, min(row_) f from ri where c >= 3 group by 1, 2 having count(*) >= 2),
ce as (select page, row_, string_agg(said, '|' order by x0, n) cells from cl join ln using (page, i) group by 1, 2)"""


@query(f"with recursive {_N}, {_TABS} select rt.page, row_count, col_count, h.cells as header, (select string_agg(ce.cells, ';' order by ce.row_) from ri join ce using (page, row_) where ri.page = rt.page and ri.run = rt.run and ri.c >= 3 and ri.row_ > rt.f) as rows_ from rt join ce h on h.page = rt.page and h.row_ = rt.f")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = notes(spark, sf_dir).select("page", F.explode("tables").alias("t")).select("page", "t.*")
    return t.select("page", "row_count", "col_count", F.array_join("header", "|").alias("header"), F.expr("array_join(transform(rows, r -> array_join(r, '|')), ';')").alias("rows_"))


def _keyed(keys: tuple[str, ...]) -> str:
    return ", ".join("arg_max(value, i) filter (lower(label) = '{}')".format(k.replace("'", "''")) for k in keys)


def _label(pattern: str, value: str, where: str) -> str:
    return f"(select page, arg_min({value}, i) v from nx where regexp_matches(said, '{pattern}') and {where} group by page)"


_DX = "regexp_extract(after, '" + _D + "', 1)"


@query(f"""with recursive {_N}, {_PAIRS}, {_TABS}, ft as (select page, string_agg(text, ' ' order by i) t from ln group by page), {_ENT}, pk as (select page, coalesce({_keyed(generic.NAME_KEYS)}) nm, coalesce({_keyed(generic.BIRTH_KEYS)}) bd, count(*)::int n from kv group by page),
pf as (select page, arg_min(said, i) v from (select *, row_number() over (partition by page order by i) r from ln) where r <= 5 and len(said) > 5 and not regexp_matches(upper(said), '^(PAGE|DATE|CONFID|MEDICAL RECORD)') group by page),
dn as (select page, count(distinct d)::int n from (select page, unnest(regexp_extract_all(text, '{_D}', 1)) d from ln) group by page), tn as (select page, count(*)::int n from rt group by page), cn as (select page, count(*)::int c, count(*) filter (selected)::int s, string_agg(kind || ' ' || trim(label), ',' order by i) filter (selected) sel from ct group by page), lc as (select page, count(*)::int n from ln group by page)
select page, coalesce(pk.nm, a.v, nullif(regexp_extract(t, '(?i)Patient(?:''s)?\\s*(?:Name)?[:\\s]+([A-Z][a-z]+(?:\\s+[A-Z]\\.?\\s*)*[A-Z][a-z]+)', 1), '')) patient_name,
coalesce(pk.bd, b.v, nullif(regexp_extract(t, 'DOB[:\\s]+(\\d{{1,2}}/\\d{{1,2}}/\\d{{4}})', 1), ''), nullif(regexp_extract(t, '(?i)Date of Birth[:\\s]+(\\d{{1,2}}/\\d{{1,2}}/\\d{{4}})', 1), '')) patient_dob, coalesce(c.v, pf.v) provider_name, string_split(mrns, ',')[1] mrn, codes diagnoses,
lc.n text_lines, cn.c controls_total, cn.s controls_selected, coalesce(pk.n, 0) n_pairs, dn.n dates_found, coalesce(tn.n, 0) tables_found, coalesce(cn.sel, '') selected
from kk left join pk using (page) left join {_label("(?i)^Patient(?:''s Name)?:?\\s*$", "after", "len(after) > 2 and not starts_with(after, 'Date')")} a using (page) left join {_label("(?i)^(?:Date of Birth|DOB):?\\s*$", _DX, _DX + " <> ''")} b using (page)
left join {_label("(?i)^(?:Provider|Records? From|Attending)[:\\s]*$", "after", "len(after) > 2")} c using (page) left join pf using (page) left join ft using (page) left join mrns_ using (page) left join codes_ using (page) left join lc using (page) left join cn using (page) left join dn using (page) left join tn using (page)""")
def page_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select(
        "page", "patient_name", "patient_dob", "provider_name", "mrn", F.array_join("diagnoses", ",").alias("diagnoses"), "stats.text_lines", "stats.controls_total", "stats.controls_selected",
        F.col("stats.key_value_pairs").alias("n_pairs"), "stats.dates_found", "stats.tables_found", F.expr("array_join(transform(selected_controls, c -> concat(c.kind, ' ', c.label)), ',')").alias("selected"),
    )


_SP = "select p_partkey page, [{i: 0, t: p_name, z: 9 + p_partkey % 3 * 0.5::double, f: 'Helv'}, {i: 1, t: 'Findings ' || p_partkey % 9, z: 9 + p_partkey % 4::double, f: 'Helv'}, {i: 2, t: ' 12/34 ', z: 20.0::double, f: 'Helv'}, {i: 3, t: 'Plan', z: 9.04::double, f: case p_partkey % 3 when 0 then 'Helv-Bold' when 1 then 'Arial Black' else 'Helv' end}, {i: 4, t: 'ab', z: 30.0::double, f: 'Bold'}] s from part"


@query(f"""with a as (select page, unnest(s) s from ({_SP})), b as (select page, s.i, trim(s.t) t, s.z, s.f from a where len(trim(s.t)) > 2), c as (select page, round(z, 1) r, count(*) n, min(i) f from b group by 1, 2), d as (select page, arg_max(r, (n, -f)) body from c group by 1)
select page, coalesce(string_agg(t, '|' order by i) filter ((z > body + 1.5 or contains(lower(f), 'bold') or contains(f, 'Black')) and len(t) between 4 and 79 and not regexp_matches(t, '^[\\d/.$,\\s]+$')), '') headings, 'name=' || (page % 5) || ';agree=' || case when page % 2 = 0 then 'Yes' else 'unchecked' end fields from b join d using (page) group by page""")
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "p_partkey"
    rows = [("p_name", f"9 + {k} % 3 * 0.5", "'Helv'"), (f"concat('Findings ', {k} % 9)", f"9 + {k} % 4", "'Helv'"), ("' 12/34 '", "20", "'Helv'"), ("'Plan'", "9.04", f"case {k} % 3 when 0 then 'Helv-Bold' when 1 then 'Arial Black' else 'Helv' end"), ("'ab'", "30", "'Bold'")]
    spans = "array(" + ", ".join(f"named_struct('text', {t}, 'size', cast({z} as double), 'font', {f})" for t, z, f in rows) + ")"
    widgets = f"array(named_struct('name', 'name', 'value', cast({k} % 5 as string), 'type', 'Text'), named_struct('name', 'agree', 'value', case when {k} % 2 = 0 then 'Yes' end, 'type', 'CheckBox'), named_struct('name', 'x', 'value', '', 'type', 'Text'), named_struct('name', '', 'value', 'v', 'type', 'Text'))"
    # a number becomes a page of some hundred times its size
    p = shared.dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select(k, "p_name"), 20_000).select(F.col(k).alias("page"), F.expr(spans).alias("spans"), F.expr(widgets).alias("widgets"))
    p = P.staged(p, {"h": generic.headings(), "w": generic.form_fields()})
    return p.select("page", F.array_join("h", "|").alias("headings"), F.expr("array_join(transform(w, f -> concat(f.field_name, '=', f.field_value)), ';')").alias("fields"))
