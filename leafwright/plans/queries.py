"""One query per operator family over the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.functions import text as T
from leafwright.operators import classify, indexing, metrics, relational, segments, spatial
from leafwright.sources import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


# Views in SQL, as in the sources.
_DOCS = "docs as (select o_orderkey id, 'doc_' || o_orderkey || '.pdf' file_name, 'form' || (o_orderkey % 8) form_type, (o_orderkey % 40 + 60) / 100.0::double confidence, strftime(o_orderdate, '%Y-%m-%d') extracted_at, (o_orderkey % 1000 + 0.25)::double processing_time_ms from orders)"
_DX = "dx as (select l_orderkey document_id, l_linenumber as position, substr('ABCDEFGHIJKLMNOPQRSTVWXYZ', (l_partkey % 25 + 1)::int, 1) || (l_partkey % 90 + 10) icd10_code from lineitem)"
_LINES = r"forms as (select o_orderkey id, concat_ws(chr(10), 'Patient Name: Person ' || o_orderkey, 'Date of Service: ' || strftime(o_orderdate, '%m/%d/%Y'), 'NPI: ' || lpad(o_orderkey::varchar, 10, '0'), 'Total: $' || (o_orderkey % 900 + 100) || '.50 of $20.00', 'SSN 123-45-' || lpad((o_orderkey % 10000)::varchar, 4, '0'), 'Dx M' || (o_orderkey % 90 + 10) || '.2 and S13.4', (['progress note', 'MRI of knee', 'plain', 'surgery'])[(o_orderkey % 4 + 1)::int]) as text from orders)"
_BUNDLES = """pages_ as (select user_id bundle, event_id page, case event_type when 'click' then 'A' when 'purchase' then 'B' when 'signup' then 'C' when 'error' then case when event_id % 3 = 0 then 'B' end end provider, case when event_id % 3 <> 0 then strftime(ts, '%m/%d/%Y') end dos,
case when event_type <> 'view' then event_type end as type, case when event_type <> 'error' then (['Clinical Note', 'Lab Result', 'Clinical Note', 'Imaging Report', 'Clinical Note', 'Clinical Note', 'ER Report'])[(event_id % 7 + 1)::int] end doc_type, event_type = 'error' as is_separator, event_type = 'error' and event_id % 2 = 0 as is_cover,
['w' || event_id % 3, 'x' || event_id % 2, 'y' || event_id % 5, 'z' || event_id % 7] tokens from events)"""
_PHONES = r"regexp_extract_all(text, '\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}')"
_CTRL = "ctrl as (select p_partkey // 20 page, p_partkey ctrl, p_partkey * 7 % 300 x, p_partkey * 7 % 300 + 10 as rgt, p_partkey * 13 % 200 y from part)"
_TXT = "txt as (select p_partkey // 20 page, p_partkey line, p_partkey * 11 % 320 lx, p_partkey * 11 % 320 + 25 lcx, p_partkey * 11 % 320 + 50 as rgt, p_partkey * 17 % 200 ly, p_name as text from part)"
_RESULTS = "results as (select 'f' || (d.doc_id // 50) as file, d.source as field, case when d.doc_id % 7 = 0 then null else (n_chars > 400)::int::varchar end predicted, quality::varchar truth from labels join documents d using (doc_id))"
_SEGMENTS = f"""{_BUNDLES}, a as (select *, row_number() over o = 1 as fst, is_separator and row_number() over o > 1 as sep from pages_ window o as (partition by bundle order by page)),
b as (select *, coalesce(last_value(provider ignore nulls) over (partition by bundle order by page rows unbounded preceding), 'Unknown') prov from a),
b2 as (select *, fst or not sep and prov is distinct from lag(prov) over o as fresh, coalesce(lag(sep) over o, false) after_ from b window o as (partition by bundle order by page)), c as (select *, fresh or sep or after_ as turn from b2),
d as (select *, sum(turn::int) over (partition by bundle order by page rows unbounded preceding) run from c),
e as (select *, coalesce(last_value(case when (provider is not null or turn) and not sep then dos end ignore nulls) over w, first_value(case when provider is null and not turn and not sep then dos end ignore nulls) over w) cur_dos from d window w as (partition by bundle, run order by page rows unbounded preceding)),
f as (select *, not sep and provider is not null and dos is not null and dos is distinct from lag(cur_dos) over (partition by bundle, run order by page) as other from e), f2 as (select *, turn or other as starts from f),
g as (select *, sum(starts::int) over (partition by bundle order by page rows unbounded preceding)::bigint as segment from f2),
sg as (select bundle, segment, min(page) start_page, max(page) end_page, count(*) page_count, arg_max(prov, page) provider, case when not bool_or(sep) then last(cur_dos order by page) end dos, bool_or(sep) is_separator, bool_or(sep and is_cover) cover, arg_max(doc_type, page) filter (doc_type <> 'Clinical Note' and not (starts and (fresh or other))) told,
max(doc_type) filter (starts and (fresh or other)) head from g group by 1, 2),
segs as (select * exclude (cover, told, head), case when is_separator then case when cover then 'Cover Sheet' else 'Separator' end else coalesce(told, head, 'Unknown') end doc_type from sg)"""


def _classify_sql() -> str:
    kinds = []
    for kind, (priority, phrases) in classify.SIGNATURES.items():
        hits = " + ".join("contains(lower(text), '{}')::int".format(p.replace("'", "''")) for p in phrases)
        kinds.append(f"select id, '{kind}' kind, {priority} priority, {hits} hits, {len(phrases)} n from p")
    texts = ", ".join("'{}'".format(p.replace("'", "''")) for p in V.PAGES)
    return f"""with p as (select o_orderkey id, ([{texts}])[(o_orderkey % {len(V.PAGES)} + 1)::int] as text from orders), k as ({" union all ".join(kinds)}),
    best as (select *, row_number() over (partition by id order by hits::double / n desc, priority desc) r from k where hits > 0)
    select p.id, coalesce(kind, 'unknown') form_type, coalesce(round_even(0.7::double + 0.3::double * hits / n, 3), 0.0::double) confidence from p left join best on p.id = best.id and r = 1"""


@query(_classify_sql())
def classify_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(V.pages(spark, sf_dir)).select("id", "form_type", "confidence")


@query(f"with {_DOCS} select form_type, count(*) documents, round(avg(confidence::decimal(18,4)) * 100, 2)::double confidence_pct, round(avg(processing_time_ms::decimal(18,4)))::double mean_ms from docs group by 1")
def form_type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.breakdown(V.documents(spark, sf_dir))


@query(f"with {_DOCS}, {_DX} select id, file_name, form_type, position from dx join docs on document_id = id where icd10_code = 'B11'")
def search_by_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.search_child(V.documents(spark, sf_dir), V.diagnoses(spark, sf_dir), "icd10_code", "B11").select("id", "file_name", "form_type", "position")


@query(f"with {_DOCS} select id, file_name, l_extendedprice charge, strftime(l_shipdate, '%m/%d/%Y') date_of_service from lineitem join docs on l_orderkey = id where l_partkey = 42")
def search_by_cpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.search_child(V.documents(spark, sf_dir), V.service_lines(spark, sf_dir), "cpt_code", "10042").select("id", "file_name", "charge", "date_of_service")


@query(f"with {_DOCS} select id, file_name, c_name field_value from orders join customer on o_custkey = c_custkey join docs on o_orderkey = id where c_name ilike '%CUSTOMER#%'")
def search_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, f = V.documents(spark, sf_dir), V.fields(spark, sf_dir)
    return relational.search_field(d, f, "patient_name", "customer#").select("id", "file_name", "field_value")


@query(f"""with {_DOCS}, {_DX}, g as (select form_type, count(*) n from docs group by 1) select (select sum(n)::bigint from g) documents, (select count(*) from g) form_types, (select string_agg(form_type || '=' || n, ',' order by n desc, form_type) from g) by_type, (select count(*) from lineitem) service_lines, (select count(*) from events) index_entries, (select count(distinct icd10_code) from dx) codes""")
def db_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = relational.stats(V.documents(spark, sf_dir), V.service_lines(spark, sf_dir), V.diagnoses(spark, sf_dir), V.table(spark, sf_dir, "events"))
    return s.withColumn("by_type", F.expr("array_join(transform(by_type, x -> concat(x.form_type, '=', x.n)), ',')"))


@query(f"""with {_DOCS} select id document_id, 'file_name' field_name, case when id % 5 > 0 then file_name end field_value, 'text' field_type from docs union all select id, 'confidence', case when id % 3 > 0 then (id % 40)::varchar end, case when id % 3 > 0 then 'numeric' else 'text' end from docs
union all select id, 'flag', case when id % 2 = 0 then 'True' else 'False' end, 'boolean' from docs union all select id, 'codes', case when id % 7 > 0 then '["A' || id || '","B"]' end, case when id % 7 > 0 then 'json' else 'text' end from docs union all select id, 'seen', extracted_at, 'text' from docs""")
def shred_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = V.documents(spark, sf_dir), F.col("id")
    return relational.shred(d.select(
        "id", F.when(k % 5 > 0, F.col("file_name")).alias("file_name"), F.when(k % 3 > 0, k % 40).alias("confidence"), (k % 2 == 0).alias("flag"), F.when(k % 7 > 0, F.array(F.concat(F.lit("A"), k.cast("string")), F.lit("B"))).alias("codes"),
        F.to_date("extracted_at").alias("seen"), F.lit("x").alias("form_type"), F.array(F.lit(1)).alias("diagnoses"),
    ))


@query(f"with {_DOCS} select id, file_name, extracted_at from docs where form_type = 'form3'")
def documents_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.listed(V.documents(spark, sf_dir), "form3").select("id", "file_name", "extracted_at")


@query("with t as (select o_orderkey id, case o_orderkey % 6 when 0 then ' 12.5 USD' when 1 then 'n/a' when 2 then '-3e2x' when 3 then null when 4 then '.5.1' else o_orderkey || 'a' end v from orders) select id, case when v is not null then coalesce(try_cast(regexp_extract(v, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1) as double), 0.0::double) end amount from t")
def lenient_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.expr("case cast(o_orderkey % 6 as int) when 0 then ' 12.5 USD' when 1 then 'n/a' when 2 then '-3e2x' when 3 then null when 4 then '.5.1' else concat(o_orderkey, 'a') end")
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), relational.lenient_number(v).alias("amount"))


@query(f"with {_LINES}, l as (select id, unnest(string_split(text, chr(10))) line from forms) select id, regexp_extract(trim(line), '^([A-Z][A-Za-z ]+):', 1) as key, regexp_extract(trim(line), ': (.*)$', 1) as value from l where line like '%: %'")
def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.trim("line")
    each = V.form_lines(spark, sf_dir).select("id", F.explode(F.split("text", "\n")).alias("line")).where(line.rlike(T.KEY_VALUE))
    return each.select("id", F.regexp_extract(line, T.KEY_VALUE, 1).alias("key"), F.regexp_extract(line, T.KEY_VALUE, 2).alias("value"))


@query(rf"""with {_LINES} select id, 'M' || (id % 90 + 10) || '.2,S13.4' icd10, case when id % 900 + 100 > 20 then '$' || (id % 900 + 100) || '.50,$20.00' end amounts, '***-**-' || lpad((id % 10000)::varchar, 4, '0') ssn,
array_to_string(regexp_extract_all(text || case when id % 2 = 0 then ' npi 1234567890 NPI: 2234567890 NPI#3234567890' else '' end, '(?i)\bNPI[:\s#]*(\d{{10}})\b', 1)[1:3], ',') npi from forms""")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, join = F.col("text"), lambda c: F.array_join(c, ",")
    more = F.concat(text, F.when(F.col("id") % 2 == 0, " npi 1234567890 NPI: 2234567890 NPI#3234567890").otherwise(""))
    return V.form_lines(spark, sf_dir).select("id", join(T.icd10(text)).alias("icd10"), join(T.amounts(text)).alias("amounts"), join(T.masked_ssns(text)).alias("ssn"), join(T.npis(more)).alias("npi"))


@query(f"with p as (select doc_id, {_PHONES} a from documents), u as (select doc_id, unnest(a) s, generate_subscripts(a, 1) i from p), f as (select doc_id, s, min(i) i from u group by 1, 2), r as (select *, row_number() over (partition by doc_id order by i) n from f) select doc_id, string_agg(s, ',' order by n) phones from r where n <= 5 group by 1")
def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.phones(F.col("text")), ",").alias("phones"))
    return d.where("phones <> ''")


@query(f"with {_LINES} select id, case id % 4 when 0 then 'Office Visit' when 1 then 'Imaging Report' when 2 then 'Clinical Note' else 'Operative Report' end doc_type from forms")
def doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.form_lines(spark, sf_dir).select("id", T.doc_type(F.col("text")).alias("doc_type"))


@query(f"with {_SEGMENTS} select * from segs")
def index_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.index_segments(V.bundles(spark, sf_dir))


@query(f"""with {_SEGMENTS} select bundle, provider, count(*) encounters, sum(page_count)::bigint pages, coalesce(array_to_string(list_sort(list(distinct dos) filter (dos is not null)), ','), '') dates,
string_agg(concat_ws(' ', dos, doc_type, start_page || '-' || end_page, page_count), ';' order by coalesce(dos, ''), start_page) visits from segs where not is_separator group by 1, 2""")
def provider_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments.provider_summary(segments.index_segments(V.bundles(spark, sf_dir)))
    return s.withColumn("visits", F.expr("array_join(transform(visits, v -> concat_ws(' ', v.dos, v.doc_type, v.pages, v.page_count)), ';')"))


@query(f"with {_SEGMENTS} select bundle, sum(page_count)::bigint total_pages, count(*) total_segments, count(distinct provider) filter (not is_separator) provider_count, count(*) filter (not is_separator) encounter_count from segs group by 1")
def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.index_totals(segments.index_segments(V.bundles(spark, sf_dir)))


_SPLIT = f"""{_BUNDLES}, a0 as (select *, row_number() over o = 1 as fst, lag(tokens) over o prev from pages_ window o as (partition by bundle order by page)),
a as (select *, is_separator and not fst as sep, coalesce(not fst and len(list_intersect(tokens, prev))::double / len(list_distinct(list_concat(tokens, prev))) < 0.2::double, false) unlike from a0)"""


@query(f"""with {_SPLIT}, b as (select *, last_value(case when sep then '-' when type is not null then type when unlike then '-' end ignore nulls) over (partition by bundle order by page rows unbounded preceding) cur from a),
c as (select *, fst or sep or coalesce(lag(sep) over o, false) or (type is not null and type is distinct from lag(cur) over o) or unlike as starts from b window o as (partition by bundle order by page)),
d as (select *, sum(starts::int) over (partition by bundle order by page rows unbounded preceding)::bigint part from c)
select bundle, part, min(page) start_page, max(page) end_page, case when bool_or(sep) then 'separator' else nullif(last(cur order by page), '-') end as type from d group by 1, 2""")
def split_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.split_segments(V.bundles(spark, sf_dir))


@query(f"""with recursive {_SPLIT}, n as (select *, row_number() over (partition by bundle order by page) i from a), r(bundle, i, page, kind, run, back, sep_) as (select bundle, i, page, type, 0::bigint, case when fst then 0::bigint end, false from n where i = 1
union all select r.bundle, n.i, n.page, case when n.sep then null when n.type is not null and n.type is distinct from r.kind then n.type when n.unlike and r.run = 1 then n.type else r.kind end,
case when n.sep or n.type is not null and n.type is distinct from r.kind then 0 when n.unlike then case when r.run = 1 then 0 else r.run + 1 end else 0 end,
case when n.sep or r.sep_ or n.type is not null and n.type is distinct from r.kind then 0 when n.unlike and r.run = 1 then 1 end, n.sep from r join n on n.bundle = r.bundle and n.i = r.i + 1),
s as (select bundle, i - back si from r where back is not null), u as (select distinct bundle, si from s), v as (select r.*, (select max(si) from u where u.bundle = r.bundle and u.si <= r.i) si from r),
w as (select bundle, si, min(page) start_page, max(page) end_page, bool_or(sep_) sp, arg_max({{k: kind}}, i) lk, max(i) li from v group by 1, 2)
select w.bundle, row_number() over (partition by w.bundle order by w.si) part, start_page, end_page, case when sp then 'separator' else q.kind end as type from w left join (select bundle, i, kind from r) q on q.bundle = w.bundle and q.i = w.li""")
def split_with_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.split_segments(V.bundles(spark, sf_dir), hysteresis=2)


_PAGE_TEXT = """case (o_orderkey % 8)::int when 0 then 'Records from Valley Clinic ==' || chr(10) || 'x' when 1 then 'Cover sheet' || chr(10) || 'Provider: Dr. ' || o_orderkey when 2 then 'Office visit on 0' || (1 + o_orderkey % 9) || '/02/2024 date of birth: 01/01/1960' when 3 then 'separator'
when 4 then 'DOB: 03/03/1970 MRI of knee, exam date 0' || (1 + o_orderkey % 9) || '/04/2024 and again 05/05/2023' when 5 then 'printed: 06/06/2024' when 6 then 'Confidential under HIPAA. records from X' else repeat('long ', 120) || '07/07/2021 surgery ' || repeat('y', 60) || ' visit date 08/08/2021' end"""


@query(rf"""with t as (select o_orderkey k, {_PAGE_TEXT} t, [{{s: 18 + o_orderkey % 3, y: 30, t: 'Medical Records Transmittal'}}, {{s: 16, y: 40 + o_orderkey % 5, t: ' Clinic ' || o_orderkey % 11}}, {{s: 16, y: 42, t: 'Clinic Twin'}}, {{s: 30, y: 121, t: 'Below'}}, {{s: 40, y: 10, t: 'ab'}}] sp from orders),
f as (select *, regexp_matches(t, '(?i)={{5,}}|separator|records?\s+from') is_separator, regexp_matches(t, '(?i)medical records?\s+transmittal|records?\s+retrieval|cover\s+(sheet|page)|confidential.*hipaa') is_cover from t), u as (select k, unnest(sp) s from f),
h as (select k, arg_min(trim(s.t), (-s.s, s.y)) p from u where s.y <= 120 and len(trim(s.t)) > 2 and not regexp_matches(lower(s.t), 'medical records|transmittal|confidential|cover|separator|===') group by 1),
x as (select *, trim(rtrim(trim(regexp_extract(t, '(?i)records?\s+from\s+(.+?)(?:\n|$)', 1)), '=')) n1, trim(rtrim(trim(regexp_extract(t, '(?i)provider[:\s]+(.+?)(?:\n|$)', 1)), '=')) n2 from f),
d as (select k, unnest(regexp_extract_all(t, '\b(\d{{2}}/\d{{2}}/\d{{4}})\b', 1)) d, generate_subscripts(regexp_extract_all(t, '\b(\d{{2}}/\d{{2}}/\d{{4}})\b', 1), 1) j, lower(t) t from f), e as (select k, d, j, instr(t, d) - 1 p, t from d), e2 as (select *, t[greatest(p - 35, 0) + 1:p + len(d) + 10] w from e),
e3 as (select *, case when {{SERVICE}} then 10 else 0 end - case when {{OTHER}} then 20 else 0 end + case when p < 500 then 3 else 0 end sc from e2), e4 as (select k, arg_max(d, (sc, -j)) d, max(sc) m from e3 group by 1)
select k page, case when is_separator or is_cover then case when len(n1) > 2 then n1 when len(n2) > 2 then n2 end else h.p end provider, case when not (is_separator or is_cover) and m >= 0 then d end dos,
case when is_separator or is_cover then null when regexp_matches(t, '(?i)office\s+visit|progress\s+note') then 'Office Visit' when regexp_matches(t, '(?i)operative\s+report|surgery') then 'Operative Report' when regexp_matches(t, '(?i)mri') then 'Imaging Report' else 'Clinical Note' end doc_type, is_separator, is_cover from x left join h using (k) left join e4 using (k)"""
       .replace("{SERVICE}", " or ".join(f"contains(w, '{x}')" for x in T.SERVICE_WORDS)).replace("{OTHER}", " or ".join(f"contains(w, '{x}')" for x in T.OTHER_WORDS)))
def page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = V.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = F.expr(_PAGE_TEXT.replace("::int", "").replace("o_orderkey % 8)", "cast(o_orderkey % 8 as int))").replace("chr(10)", "'\\n'"))
    span = lambda size, y, t: F.struct(F.lit(size).cast("double").alias("size") if isinstance(size, int) else size.cast("double").alias("size"), y.cast("double").alias("y0"), t.alias("text"))
    spans = F.array(
        span(18 + k % 3, F.lit(30), F.lit("Medical Records Transmittal")), span(16, 40 + k % 5, F.concat(F.lit(" Clinic "), (k % 11).cast("string"))), span(16, F.lit(42), F.lit("Clinic Twin")), span(30, F.lit(121), F.lit("Below")), span(40, F.lit(10), F.lit("ab")),
    )
    return indexing.page_info(o.select(F.lit(0).alias("bundle"), k.alias("page"), text.alias("text"), spans.alias("spans"))).drop("bundle")


@query("select o_orderkey id, case (o_orderkey % 6)::int when 0 then 'medical_intake' when 1 then 'insurance_claim' when 2 then 'authorization' when 3 then 'cover' when 4 then 'separator' end header_type, case when o_orderkey % 6 = 5 then 'a b|plain' end tokens from orders")
def header_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    heads = ["Patient-Intake FORM", "An Insurance Claim, release", "HIPAA: separator", "FAX cover sheet", "== SEPARATOR ==", "a-b plain!"]
    words = F.split(F.element_at(F.array(*map(F.lit, heads)), (k % 6 + 1).cast("int")), " ")
    placed = F.concat(F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(50.0).alias("y0"))), F.array(F.struct(F.lit("low").alias("word"), F.lit(109.0).alias("y0"))))
    d = V.table(spark, sf_dir, "orders").select(k.alias("id"), T.top_tokens(placed).alias("t"))
    return d.select("id", indexing.header_type(F.col("t")).alias("header_type"), F.when(F.col("id") % 6 == 5, F.array_join("t", "|")).alias("tokens"))


@query(r"""with t as (select source bundle, doc_id page, list_distinct(list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: trim(lower(regexp_replace(w, '[^A-Za-z0-9]+', ' ', 'g')))), lambda w: w <> '')[1:20]) tokens from documents),
p as (select *, lag(tokens) over (partition by bundle order by page) prev from t)
select bundle, page, round(case when len(tokens) + len(prev) = 0 then 1.0::double else len(list_intersect(tokens, prev))::double / len(list_distinct(list_concat(tokens, prev))) end, 6) similarity from p where prev is not null""")
def header_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select(F.col("source").alias("bundle"), F.col("doc_id").alias("page"), T.header_tokens(F.col("text"), 20).alias("tokens"))
    return segments.header_similarity(d).where("similarity is not null").select("bundle", "page", F.round("similarity", 6).alias("similarity"))


@query("with r as (select user_id doc, event_id row_, event_id * 7 % 5 + 1 cells from events), b as (select *, sum((cells < 3)::int) over (partition by doc order by row_ rows unbounded preceding) k from r) select doc, min(row_) first_row, count(*) row_count, max(cells) col_count from b where cells >= 3 group by doc, k having count(*) >= 2")
def table_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("row_"), (F.col("event_id") * 7 % 5 + 1).alias("cells"))
    return segments.islands(e, "doc", "row_", "cells")


@query(f"with {_CTRL}, {_TXT}, n as (select c.page, ctrl, text, row_number() over (partition by c.page, ctrl order by case when lx - x between 0 and 80 then 0 else 1 end, case when lx - x between 0 and 80 then lx - x else abs(lcx - x) end, line) r from ctrl c join txt t on c.page = t.page and abs(ly - y) <= 12) select c.page, c.ctrl, text as label from ctrl c left join n on c.page = n.page and c.ctrl = n.ctrl and r = 1")
def label_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.label_controls(V.controls(spark, sf_dir), V.lines(spark, sf_dir)).select("page", "ctrl", "label")


@query(f"with {_TXT}, tx as (select * replace (case when line % 4 = 0 then text || ':' else text end as text) from txt), n as (select a.page, a.line anchor, b.text, row_number() over (partition by a.page, a.line order by b.lx - a.rgt, b.line) r from tx a join tx b on a.page = b.page and a.line <> b.line and b.lx - a.rgt between 0 and 200 and abs(b.ly - a.ly) <= 15 and (not contains(b.text, ':') or contains(a.text, ':'))) select page, anchor, text as value from n where r = 1")
def nearest_text_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = F.when(F.col("line") % 4 == 0, F.concat("text", F.lit(":"))).otherwise(F.col("text"))
    return spatial.text_right(V.lines(spark, sf_dir).withColumn("text", labelled), F.lit(True), 200, 15)


@query(f"with {_CTRL}, {_TXT}, n as (select c.page, ctrl point, line mark, row_number() over (partition by c.page, ctrl order by (lx - x) ** 2 + (ly - y) ** 2, line) r from ctrl c join txt t on c.page = t.page and (lx - x) ** 2 + (ly - y) ** 2 < 1600) select page, point, mark from n where r = 1")
def closest_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = V.controls(spark, sf_dir).select("page", F.col("ctrl").alias("point"), F.col("x").alias("px"), F.col("y").alias("py"))
    return spatial.closest(points, V.lines(spark, sf_dir).select("page", F.col("line").alias("mark"), F.col("lx").alias("mx"), F.col("ly").alias("my")), 40)


@query("with b as (select p_partkey // 20 page, p_partkey box, p_partkey * 7 % 60 x, p_partkey * 13 % 60 y, p_partkey % 9 + 20 w, p_partkey % 7 + 20 h from part), p as (select a.page, a.box a_box, b.box b_box, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) i, a.w * a.h + b.w * b.h s from b a join b on a.page = b.page and a.box < b.box) select page, a_box, b_box, round(i::double / (s - i), 4) iou from p where i > 0 and i > 0.3 * (s - i)")
def overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.overlaps(V.boxes(spark, sf_dir), 0.3)


@query("with s as (select o_orderkey id, list_sum(list_transform(range(1, 10), lambda k: o_orderkey * k % 4))::bigint total from orders) select id, total, case when total <= 4 then 'minimal' when total <= 9 then 'mild' when total <= 14 then 'moderate' when total <= 19 then 'moderately severe' else 'severe' end severity from s")
def likert_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.array(*(F.col("o_orderkey") * k % 4 for k in range(1, 10)))
    d = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.aggregate(scores, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    return d.withColumn("severity", metrics.severity(F.col("total")))


@query("with s as (select l_orderkey id, list(distinct l_returnflag) p, list(distinct case when l_partkey % 2 = 0 then 'A' else l_linestatus end) t from lineitem group by 1), n as (select id, len(p) np, len(t) nt, len(list_intersect(p, t)) b from s) select id, round(b::double / np, 6) as precision_, round(b::double / nt, 6) recall, round(2.0::double * b / (np + nt), 6) f1 from n")
def set_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_returnflag").alias("p"), F.collect_set(F.when(F.col("l_partkey") % 2 == 0, "A").otherwise(F.col("l_linestatus"))).alias("t"))
    return g.select("id", *(F.round(c, 6).alias(n) for c, n in zip(metrics.set_scores(F.col("p"), F.col("t")), ("precision_", "recall", "f1"), strict=True)))


@query(f"with {_RESULTS}, g as (select field, count(*) total, count(*) filter (lower(predicted) is not distinct from lower(truth)) correct, count(*) filter (predicted is null and truth is not null) missing from results group by 1) select *, total - correct - missing wrong, round(correct::double / total, 4) accuracy from g")
def field_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.field_metrics(V.results(spark, sf_dir))


@query(f"with {_RESULTS} select file, count(*) fields, count(*) filter (predicted is not distinct from truth) correct, round(count(*) filter (predicted is not distinct from truth)::double / count(*), 4) accuracy from results group by 1 order by 4, 1 limit 10")
def worst_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.worst_files(V.results(spark, sf_dir))
