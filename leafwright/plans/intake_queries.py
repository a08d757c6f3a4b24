"""Queries of authorizations, injury reports, questionnaires and intake forms,
with their SQL over flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.extractors import authorization, injury, intake, marks, questionnaire
from leafwright.extractors import page as P
from leafwright.plans.claim_queries import _answer, box, right_sql
from leafwright.plans.queries import query
from leafwright.sources.form_pages import Template, clusters, texts

_AUTH = Template(
    [
        (texts("Patient Name:", "PATIENT  NAME", "Patient's Name", "Person"), "20", "30", "70"), ("concat('Person ', k)", "100 + k % 400", "30 + k % 7", "80"), ("case when k % 3 = 0 then 'Sex: F' end", "95", "31", "30"),
        (texts("Date of Birth:", "Birth"), "300", "30", "60"), ("concat('on 0', 1 + k % 9, '/02/1970')", "370 + k % 9", "33", "60"),
        (texts("Date of Service From:", "Date of Service", "Dates"), "20", "60", "90"), ("concat('0', 1 + k % 9, '/10/2023 to 0', 1 + k % 8, '/11/2023')", "230 - k % 120", "62 + k % 6", "90"), ("case when k % 2 = 0 then '05/05/2023' end", "180", "58", "50"),
        ("'Records to be released'", "20", "80", "120"), *[(texts(t, t.upper(), "no " + t.lower() + " here"), "40", f"{95 + 12 * i}", "70") for i, t in enumerate(authorization.RECORD_TYPES)],
        *[(texts("Do NOT release " + c, "do not release any " + c, "Release " + c), "300", f"{95 + 14 * i}", "120") for i, c in enumerate(authorization.SENSITIVE)],
        ("'Legal Proceedings'", "40", "180", "60"), (texts("PURPOSE OF DISCLOSURE", "Purpose of  disclosure:", "Aim"), "20", "200", "120"), *[(f"'for {c}'", "40", f"{214 + 12 * i} + k % 5", "70") for i, c in enumerate(authorization.PURPOSES)],
        (texts("One year from date of signature", "One Year From Date", "one year"), "40", "300", "120"), (texts("Specific date: ____", "specific  date"), "240", "300", "70"),
    ],
    [box("case when (k + %d) %% 9 > 0 then 22 + k %% 9 end" % i, f"{94 + 12 * i}", f"(k + {i}) % 3 = 0", "''", kind="'radio'" if i == 4 else "'checkbox'") for i in range(6)]
    + [box("26 + k % 5", "95", "k % 2 = 0", "''")] + [box(f"{278 + i}", f"{95 + 14 * i}", f"(k + {i}) % 4 < 2", "''") for i in range(4)] + [box("284", "108", "k % 5 = 0", "''")]
    + [box("24", f"{214 + 12 * i} + k % 3", f"(k + {i}) % 3 = 1", "''") for i in range(5)] + [box("26", "300", "k % 3 = 0", "''"), box("224", "303 + k % 9", "k % 4 < 2", "''")],
)
_AU = _AUTH.anchors(authorization.ANCHORS)


def authorizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authorization.authorization(P.prepare(_AUTH.pages(spark, sf_dir)))


def _options(options: list[str]) -> str:
    return "(values " + ", ".join("('{}', {})".format(o.replace("'", "''"), q) for q, o in enumerate(options)) + ") op(o, q)"


def _picked(lined: str, reach: float, band: float, nearest: bool, out: str, order: str = "o", most: str = "") -> str:
    """The options of lined (page, o, q, x0, cy) with a selected box to their left."""
    rank = "(x0 - right_, c.i)" if nearest else "c.i"
    return f"(select page, string_agg(o, ',' order by {order}) {out} from (select b.page, o, q, arg_min(selected, {rank}) s from ({lined}) b join ct c on c.page = b.page and c.kind = 'checkbox' and abs(c.cy - b.cy) <= {band} and x0 - right_ between 0 and {reach} group by all) where s {most} group by page)"


def _first(options: list[str], where: str, join: str = "") -> str:
    return f"select l.page, o, q, arg_min(l.x0, l.i) x0, arg_min(l.cy, l.i) cy from ln l {join} join {_options(options)} on {where} group by 1, 2, 3"


_HOLDS = "contains(lower(l.text), lower(o))"
_DAY = "'\\b(\\d{2}/\\d{2}/\\d{4})\\b'"


@query(f"""with {_AU}, dr as (select page, list(d order by x0, i, j) ds from (select l.page, l.x0, l.i, unnest(regexp_extract_all(l.text, {_DAY}, 1)) d, generate_subscripts(regexp_extract_all(l.text, {_DAY}, 1), 1) j from an a join ln l on a.page = l.page and a.name = 'at_from' and abs(l.cy - a.cy) <= 5) group by page)
select page, coalesce(n1, n2) patient_name, nullif(regexp_extract(db, {_DAY}, 1), '') patient_dob, ds[1] date_range_from, ds[2] date_range_to from kk left join {right_sql("at_name", "n1", 350, 5)} using (page) left join {right_sql("at_name_of", "n2", 350, 5)} using (page) left join {right_sql("at_birth", "db", 250, 5)} using (page) left join dr using (page)""")
def authorization_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authorizations(spark, sf_dir).select("page", "patient_name", "patient_dob", "date_range_from", "date_range_to")


_REFUSED = _first(authorization.SENSITIVE, "{}")
_EX = f"""select page, o, q, arg_min(x0, (t, i)) x0, arg_min(cy, (t, i)) cy from (select l.*, o, q, case when contains(lower(l.text), 'do not release ' || lower(o)) then 0 else 1 end t from ln l join {_options(authorization.SENSITIVE)} on {_HOLDS} and contains(lower(l.text), 'do not release')) group by 1, 2, 3"""


@query(f"""with {_AU}, ey as (select a.page, a.name, arg_min(selected, c.i) s from an a join ct c on c.page = a.page and a.name in ('at_year', 'at_date') and c.kind = 'checkbox' and abs(c.cy - a.cy) <= 8 and a.x0 - right_ between 0 and 20 group by 1, 2),
ex as (select page, coalesce(bool_or(s) filter (name = 'at_year'), false) y, coalesce(bool_or(s) filter (name = 'at_date'), false) d from ey group by 1)
select page, coalesce(record_types, '') record_types, coalesce(excluded, '') excluded, coalesce(purposes, '') purposes, case when y and not d then 'one_year' when d and not y then 'specific_date' end expiration_type from kk
left join {_picked(_first(authorization.RECORD_TYPES, _HOLDS), 15, 8, True, "record_types")} using (page) left join {_picked(_EX, 20, 8, False, "excluded")} using (page)
left join {_picked(_first(authorization.PURPOSES, _HOLDS + " and l.cy between a.y1 and a.y1 + 60", "join an a on a.page = l.page and a.name = 'at_purpose'"), 20, 8, False, "purposes")} using (page) left join ex using (page)""")
def authorization_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = lambda c: F.array_join(c, ",")
    return authorizations(spark, sf_dir).select("page", join("record_types").alias("record_types"), join("excluded_categories").alias("excluded"), join("purposes").alias("purposes"), "expiration_type")


_ORDER = "case when k % 4 = 0 then {} else {} end"  # the second and third section change places
_FROI = Template(
    [
        (texts("Employee Name:", "EMPLOYEE NAME", "Name"), "20", "20", "70"), ("concat('Worker ', k, '::')", "100 + k % 9", "20 + k % 7", "80"), ("'Employer Name:'", "300", "20", "70"), ("concat('Firm ', k)", "380", "21", "60"),
        (texts("Date of Injury", "DATE OF  INJURY:", "When"), "20", "40", "60"), ("concat('at 0', 1 + k % 9, '/03/2024')", "150 - k % 90", "42 + k % 5", "60"), ("'04/04/2024'", "100", "40", "50"),
        (texts("On employer premises?", "on employer's premises", "Where"), "300", "40", "90"),
        (texts("BODY PARTS INJURED", "Body parts injured (mark)", "Parts"), "20", "70", "100"),
        *[(texts(b, b, b, b.upper()) if i % 3 == 0 else f"'{b}'", f"{20 + 190 * (i % 3)}", f"{85 + 12 * (i // 3)} + k % 3", "50") for i, b in enumerate(injury.BODY_PARTS)],
        (texts("NATURE OF INJURY", "Nature of  injury", "Kind"), "20", _ORDER.format("300", "200"), "90"), ("'CAUSE OF INJURY'", "20", _ORDER.format("200", "300"), "90"), (texts("TREATMENT RECEIVED", "Treatment received", "Care"), "20", "400", "90"),
        *[(f"'{n}'", f"{40 + 150 * (i % 3)}", _ORDER.format(310 + 15 * (i // 3), 212 + 15 * (i // 3)), "60") for i, n in enumerate(injury.NATURES)],
        *[(texts(n, "or " + n.lower(), "pre" + n), f"{40 + 150 * (i % 3)}", _ORDER.format(212 + 15 * (i // 3), 312 + 15 * (i // 3)), "60") for i, n in enumerate(injury.CAUSES)],
        *[(f"'{n}'", f"{40 + 100 * i}", "415 + k % 90", "60") for i, n in enumerate(injury.TREATMENTS)],
    ],
    [box("400", "41", "k % 3 = 0", texts("Yes, it was", "", "yes")), box("430 + k % 100", "42", "k % 2 = 0", texts("No", "not", "X")), box("405", "39", "k % 5 = 0", "'Yes'", kind="'radio'")]
    + [box(f"case when (k + {i}) % 7 > {j} then {74 + 190 * (i % 3) + 22 * j} end", f"{86 + 12 * (i // 3)} + k % 4", f"(k * 3 + {i} + {j}) % 5 = 0", "''") for i in range(25) for j in range(2)]
    + [box(f"{22 + 150 * (i % 3)} + k % 4", _ORDER.format(310 + 15 * (i // 3), 212 + 15 * (i // 3)), f"(k + {i}) % 8 = 0", "''") for i in range(9)]
    + [box(f"{24 + 150 * (i % 3)}", _ORDER.format(212 + 15 * (i // 3), 312 + 15 * (i // 3)), f"(k + {i}) % 4 = 0", "''") for i in range(10)]
    + [box(f"{22 + 100 * i}", "415 + k % 90 + k % 9", f"(k + {i}) % 3 = 0", "''") for i in range(5)],
)
_FR = _FROI.anchors(injury.ANCHORS)


def injuries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return injury.injury(P.prepare(_FROI.pages(spark, sf_dir)))


@query(f"""with {_FR}, dt as (select l.page, arg_min(regexp_extract(l.text, {_DAY}, 1), l.i) injury_date from an a join ln l on a.page = l.page and a.name = 'at_injury' and abs(l.cy - a.cy) <= 4 and l.x0 >= a.x1 and regexp_matches(l.text, {_DAY}) group by 1),
st as (select c.page, row_number() over (partition by c.page order by c.x, c.i) n, selected, case when starts_with(lower(label), 'yes') then 'YES' when starts_with(lower(label), 'no') then 'NO' end label from an a join ct c on c.page = a.page and a.name = 'at_site' and c.kind = 'checkbox' and abs(c.cy - a.cy) <= 7 and c.cx between a.x1 - 5 and a.x1 + 200)
select page, regexp_replace(nm, ':+$', '') employee_name, firm employer_name, injury_date, on_premises from kk left join {right_sql("at_name", "nm", 300, 5)} using (page) left join {right_sql("at_firm", "firm", 300, 5)} using (page) left join dt using (page) left join {_answer("select * from st", "on_premises")} using (page)""".replace("not contains(l.text, ':')", "(not contains(l.text, ':'))"))
def injury_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return injuries(spark, sf_dir).select("page", "employee_name", "employer_name", "injury_date", "on_premises")


def _section(start: str, following: tuple[str, ...]) -> str:
    nexts = f"(select n.page, n.y0 from an n where n.name in {following})" if len(following) > 1 else f"(select n.page, n.y0 from an n where n.name = '{following[0]}')"
    return f"(select s.page, s.y1 b, coalesce(min(n.y0) filter (n.y0 > s.y1 and n.y0 < 99999), 99999) e from an s left join {nexts} n on n.page = s.page where s.name = '{start}' group by 1, 2)"


_LABELLED = "(lower(l.said) = lower(o) or contains(' ' || lower(l.text) || ' ', ' ' || lower(o))) and l.cy between s.b and s.e"
_PARTS = f"""bl as (select l.page, o, q, arg_min(l.x1, l.i) x1, arg_min(l.cy, l.i) cy from ln l join {_section("at_body", ("at_nature", "at_cause", "at_treat"))} s on s.page = l.page join {_options(injury.BODY_PARTS)} on l.said = o and l.cy between s.b and s.e group by 1, 2, 3),
bb as (select b.page, o, selected, row_number() over (partition by b.page, o order by c.cx, c.i) n, count(*) over (partition by b.page, o) m from bl b join ct c on c.page = b.page and c.kind = 'checkbox' and abs(c.cy - b.cy) <= 6 and c.cx between b.x1 and b.x1 + 120),
bp as (select page, case when o in {tuple(injury.TWO_SIDED)} then o || case n when 1 then '-L' else '-R' end else o end part from bb where selected and (o in {tuple(injury.TWO_SIDED)} and m >= 2 and n <= 2 or o not in {tuple(injury.TWO_SIDED)} and n = 1))"""


@query(f"""with {_FR}, {_PARTS}, pt as (select page, string_agg(part, ',' order by part) parts from bp group by page)
select page, coalesce(parts, '') parts, string_split(natures, ',')[1] nature_of_injury, coalesce(causes, '') causes, coalesce(treatments, '') treatments from kk left join pt using (page)
left join {_picked(_first(injury.NATURES, _LABELLED, "join " + _section("at_nature", ("at_cause", "at_treat")) + " s on s.page = l.page"), 20, 7, True, "natures", "q")} using (page)
left join {_picked(_first(injury.CAUSES, _LABELLED, "join " + _section("at_cause", ("at_treat",)) + " s on s.page = l.page"), 20, 7, True, "causes")} using (page)
left join {_picked(_first(injury.TREATMENTS, _LABELLED, "join (select page, y1 b, y1 + 100 e from an where name = 'at_treat') s on s.page = l.page"), 20, 7, True, "treatments")} using (page)""")
def injury_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = lambda c: F.array_join(c, ",")
    return injuries(spark, sf_dir).select("page", join("injured_body_parts").alias("parts"), "nature_of_injury", join("causes").alias("causes"), join("treatments").alias("treatments"))


_DWC = Template(
    [
        (texts("Name (First, Last) ____", "EMPLOYEE NAME (FIRST"), "20", "20", "160"), (texts("Sex", "SEX:", "S"), "20", "60", "30"), ("'M'", "60 + k % 9", "62", "8"), ("'F'", "90", "61", "8"), ("'M'", "60", "140", "8"),
        (texts("Time of accident", "TIME OF ACCIDENT ?"), "20", "90", "80"), ("'AM'", "120", "92", "14"), ("'PM'", "150", "90 + k % 40", "14"), ("'Date of Accident: ____'", "220", "20", "120"), ("'DATE OF BIRTH'", "400", "20", "70"),
        ("'Occupation'", "20", "120", "60"), (texts("COMPANY NAME:", "The company name is"), "220", "120", "90"), ("'Part of body affected'", "20", "160", "100"), ("'Describe injury/illness that occurred'", "220", "160", "160"), ("'Place of accident'", "20", "200", "90"),
    ],
    drawings=[
        ("58 + k % 60", "58 + k % 9", "14", "14", "0.9", "null"), ("117", "86", "20", "20", texts("0.8", "0.0", "0.04").replace("'", ""), "case when k % 2 = 0 then 0.7 end"), ("150", "90 + k % 30", "12", "10", "null", "0.6"), ("0", "0", "600", "800", "1.0", "null"),
        ("90", "61", "1", "1", "1.0", "null"), ("88", "57 + k % 20", "10", "10", "0.05", "null"),
    ],
    spans=[
        ("concat('Ann ', k)", "24 + k % 300", "30 + k % 20", "60", "255"), ("'printed'", "20", "31", "40", "0"), ("'Bob'", "30", "36", "30", "case when k % 3 = 0 then 128 else 0 end"), ("concat('0', 1 + k % 9, '/05/2024')", "225", "32 + k % 3", "60", "16711680"),
        ("case when k % 2 = 0 then '02/02/1960' else 'unknown' end", "400", "33", "60", "255"), ("' Welder '", "22", "128 + k % 25", "40", "65280"), ("concat('Acme ', k % 7)", "290 + k % 60", "118 + k % 14", "60", "255"),
        ("'arm'", "25", "171", "20", "255"), ("'fell'", "225", "175", "30", "4660"), ("'   '", "20", "172", "30", "255"), ("'yard'", "100 + k % 500", "212", "40", "255"),
    ],
)
_DW = _DWC.anchors({"at_sex": ("sex",), "at_time": ("time of accident",)})
_MK = """mk as (select *, case when s > 0.05 then 'stroke' else 'fill' end kind from dr where (s > 0.05 or f > 0.05) and greatest(x1 - x0, y1 - y0) between 2 and 40)"""
_OV = "ov as (select page, i, trim(text) said, x0, x1, y0, cy, [color >> 16 & 255, color >> 8 & 255, color & 255] rgb from sp where color <> 0 and trim(text) <> '')"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.marked_report(P.prepare(_DWC.pages(spark, sf_dir)))


@query(f"with {_DW}, {_MK}, {_OV} select page, m.cy, m.cx, kind, rank_, n_overlaid, reds from (select *, row_number() over (partition by page order by cy, cx, i) rank_ from mk) m join (select page, count(*) n_overlaid, sum(rgb[1])::bigint reds from ov group by 1) using (page)")
def page_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.staged(_DWC.pages(spark, sf_dir), {"m": marks.found(), "o": marks.overlaid()})
    p = p.select("page", F.size("o").cast("long").alias("n_overlaid"), F.expr("aggregate(o, 0L, (a, x) -> a + x.rgb[0])").alias("reds"), F.posexplode("m").alias("n", "m"))
    return p.select("page", "m.cy", "m.cx", "m.kind", (F.col("n") + 1).cast("long").alias("rank_"), "n_overlaid", "reds")


def _overlay(name: str, text: str, direction: str, dy: float, dx: float) -> str:
    place = f"(instr(lower(text), '{text}') - 1)"
    box = f"select page, arg_min({{x0: x0 + (x1 - x0) * {place} / len(text), x1: x0 + (x1 - x0) * ({place} + {len(text)}) / len(text), y0: y0, y1: y1}}, i) b from ln where contains(lower(text), '{text}') group by 1"
    if direction == "below":
        where, score = f"o.cy - b.y1 between -2 and {dy} and o.x0 between b.x0 - 20 and b.x1 + {dx}", "o.cy - b.y1 + abs(o.x0 - b.x0) * 0.1::double"
    else:
        where, score = f"o.x0 - b.x1 between -30 and {dx} and abs(o.cy - (b.y0 + b.y1) / 2) <= {dy}", "abs(o.x0 - b.x1) + abs(o.cy - (b.y0 + b.y1) / 2) * 0.5::double"
    return f"(select page, arg_min(said, ({score}, o.i)) {name} from ({box}) bx join ov o using (page) where {where} group by page)"


def _letter(name: str, a: str, letters: list[str], dx: float) -> str:
    return f"""(select page, arg_min(o, q) {name} from (select l.page, o, q, arg_min({{x0: l.x0, y0: l.y0, x1: l.x1, y1: l.y1}}, l.i) b from an a join ln l on l.page = a.page and a.name = '{a}' join {_options(letters)} on l.said = o
where abs(l.cy - a.cy) <= 25 and l.cx between a.x0 - 20 and a.x1 + {dx} group by 1, 2, 3) where exists (select 1 from mk m where m.page = page and m.x1 >= b.x0 - 8 and m.x0 <= b.x1 + 8 and m.y1 >= b.y0 - 6 and m.y0 <= b.y1 + 6) group by page)""".replace("m.page = page", "m.page = t.page").replace("group by 1, 2, 3) where", "group by 1, 2, 3) t where")


@query(f"with {_DW}, {_MK}, {_OV} select page, employee_name, case when regexp_matches(accident_date, '^\\d{{2}}/\\d{{2}}/\\d{{4}}') then accident_date end accident_date, case when regexp_matches(employee_dob, '^\\d{{2}}/\\d{{2}}/\\d{{4}}') then employee_dob end employee_dob, occupation, company_name, body_part, injury_description, place_of_accident, employee_sex, am_pm from kk "
       + " ".join(f"left join {_overlay(n, *v)} using (page)" for n, v in marks.OVERLAYS.items()) + f" left join {_letter('employee_sex', 'at_sex', ['M', 'F'], 120)} using (page) left join {_letter('am_pm', 'at_time', ['AM', 'PM'], 400)} using (page)")
def marked_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).drop("marks_detected", "overlays_detected")


_PHQ = Template(
    [(texts("Total Score: 14", "TOTAL SCORE 35", "Total", "total  score:7"), "20", "400", "80"), (texts("Total score 3", None, None), "20", "420", "80")],
    [box(f"case when (k % 11 > 0 or {r} <> 3 or {c} < 3) and (k % 7 > 2 or {r} < 8 + k % 3) then {300 + 30 * c} end", f"{100 + 14 * r + (c % 2)} + case when {r} >= 9 then 6 * (k % 4) else 0 end", f"(k * 5 + {r}) % 13 % 5 = {c}", "''") for r in range(11) for c in range(4)],
)


@query(f"""with {_PHQ.sql()}, rw as (select page, i // 4 r, count(*) n, min(cy) c0, count(*) filter (selected) s, max(i % 4) filter (selected) score from ct group by 1, 2), r4 as (select page, r, case when s = 1 then score end score, row_number() over (partition by page order by r) n,
c0 as h0 from rw where n = 4), hh as (select page, r, list(cy order by cy, i) ys from ct group by 1, 2), hx as (select c.page, c.i // 4 r, c.cy, row_number() over (partition by c.page, c.i // 4 order by c.cy, c.i) m from ct c), h1 as (select page, r, max(cy) filter (m = 1) a, max(cy) filter (m = 2) b, max(cy) filter (m = 3) c, max(cy) filter (m = 4) d from hx group by 1, 2),
h2 as (select page, r, (((a * 2 + b) / 3 * 3 + c) / 4 * 4 + d) / 5 h from h1), r5 as (select r4.*, h from r4 join h2 using (page, r)), gp as (select page, n - 1 as at_, h - lag(h) over (partition by page order by n) g from r5), gs as (select page, count(g) + 1 nr, list_sort(list(g) filter (g is not null)) gl, arg_max(at_, (g, -at_)) filter (g is not null) w, max(g) mg from gp group by 1),
sp_ as (select page, nr, case when nr >= 10 and mg > gl[(nr - 1) // 2 + 1] * 1.5 and w >= 9 then w end w from gs),
ev as (select page, list(score order by n) filter (w is null or n <= w) a, list(score order by n) filter (w is not null and n > w and score is not null) b, any_value(w) w from r5 join sp_ using (page) group by 1), al as (select page, case when w is null then a else list_concat(a, coalesce(b, [])[1:1]) end e from ev),
pt as (select page, arg_min(v, i) total_printed from (select page, i, try_cast(nullif(regexp_extract(text, '(?i)total\\s*score\\s*:?\\s*(\\d{{1,2}})', 1), '') as int) v from ln) where v between 0 and 27 group by 1),
sc as (select page, e, case when len(e) >= 9 then e[1:9] end s from al), tc as (select page, e, s, case when len(list_filter(s, lambda x: x is null)) = 0 then list_sum(s)::int end total_computed from sc)
select page, array_to_string(list_transform(s, lambda x: coalesce(x::varchar, '-')), ',') scores, total_computed, total_printed, coalesce(total_printed, total_computed) total, case when len(e) > 9 then e[10]::int when coalesce(total_printed, total_computed) <= 4 then 0 when coalesce(total_printed, total_computed) <= 9 then 1 when coalesce(total_printed, total_computed) <= 14 then 2 when coalesce(total_printed, total_computed) > 14 then 3 end difficulty
from kk left join tc using (page) left join pt using (page)""")
def questionnaires(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questionnaire.questionnaire(P.prepare(_PHQ.pages(spark, sf_dir)))
    return q.select("page", F.expr("array_join(transform(scores, s -> coalesce(cast(s as string), '-')), ',')").alias("scores"), "total_computed", "total_printed", "total", "difficulty")


_DIG = Template(
    [(f"case when (k + {r}) % 6 > 0 or {d} > 0 then '{d}' else 'o' end", f"{100 + 30 * d}", f"{50 + 15 * r} + (k + {d}) % 3", "6") for r in range(10) for d in (2, 0, 3, 1)],
    drawings=[(f"{100 + 30 * c} + (k * {r + 1}) % 4 * 30 - 3", f"{48 + 15 * r}", "12", "12", "0.5", "null") for r in range(10) for c in (0,)] + [("190", "50", "9", "9", "0.9", "null")],
)


@query(f"""with recursive {_DIG.sql()}, {_MK}, it as (select *, row_number() over (partition by page order by cy, i) n from ln where said in ('0', '1', '2', '3')), {{CL}}, ls as (select page, arg_max(hs, n) hs from cl_f group by page), rr as (select page, row_, ls.hs[row_].h h from cl join ls using (page) join ln using (page, i) group by all having count(distinct said) = 4),
dg as (select page, row_, min(said::int) score from cl join ln l using (page, i) where exists (select 1 from mk m where m.page = l.page and m.x1 >= l.x0 - 8 and m.x0 <= l.x1 + 8 and m.y1 >= l.y0 - 6 and m.y0 <= l.y1 + 6) group by 1, 2)
select page, row_number() over (partition by page order by h, row_) n, score from rr left join dg using (page, row_)""".replace("{CL}", clusters("it", 4)))
def likert_from_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.staged(P.prepare(_DIG.pages(spark, sf_dir)), {"marks": marks.found()}, {"s": marks.likert()})
    return p.select("page", F.posexplode("s").alias("n", "score")).select("page", (F.col("n") + 1).cast("long").alias("n"), "score")


def _pair(y: str, i: int, labels: tuple[str, str] = ("Yes", "No")) -> list[tuple[str, str, str, str, str, str]]:
    """Two answer boxes beside a label, sometimes with labels, sometimes one only."""
    return [
        box(f"120 + k % {5 + i}", y, f"(k + {i}) % 3 = 0", texts(labels[0], "", labels[0], "Fever")), box(f"case when (k + {i}) % 6 > 0 then 160 + k % 4 end", f"{y} + k % 3", f"(k * 2 + {i}) % 5 < 2", texts(labels[1], "", labels[1]), kind="'radio'"),
    ]


_INTAKE = Template(
    [
        (texts("Sex:", "Gender", "Sex", "X"), "20 + k % 3 * 300", "40", "40"), *[(f"'{s}'", f"{140 + 60 * i} + k % 3 * 300 - k % 2 * 20", f"{38 + 3 * i} + k % 7", "30") for i, s in enumerate(intake.SEXES)],
        (texts("Smoker", "smoker?", "Tobacco"), "20", "80", "40"), ("'Diabetic'", "20", "100", "40"), (texts("Is this work-related?", "Work related", "Work"), "20", "120", "80"), (texts("Auto accident?", "MVA", "Motor vehicle crash"), "20", "140", "80"),
        (texts("Allergies", "Known allergies (check all that apply)", "Allergy list", "None"), "20", "170", "80"), *[(texts(a, a.upper(), a), f"{40 + 110 * (i % 2)}", f"{186 + 14 * (i // 2)} + k % 3", "60") for i, a in enumerate(intake.ALLERGIES)],
        (texts("Current symptoms", "Symptoms", "Presenting symptoms:"), "330 - k % 2 * 10", "170", "90"), *[(f"case when (k + {i}) % 5 > 0 then '{s}' end", "360 - k % 11", f"{186 + 13 * i}", "70") for i, s in enumerate(intake.SYMPTOMS)], ("'cough'", "360", "330 + k % 9", "40"),
        (texts("Claim type:", "claim types", "Type"), "20", "360", "60"),
    ],
    [
        *[box(f"{125 + 60 * i} + k % 3 * 300 - k % 2 * 20", f"40 + (k + {i}) % 4 * 5", f"(k + {i}) % 4 = 0", texts(s, "", "x", s.lower(), ""), kind="'radio'") for i, s in enumerate(intake.SEXES)],
        *[c for i, y in enumerate(("80", "100", "120", "140")) for c in _pair(y, i)],
        *[box(f"{22 + 110 * (i % 2)} + k % 3", f"{187 + 14 * (i // 2)}", f"k % 5 > 0 and (k + {i}) % 3 = 0", texts("", a, "")) for i, a in enumerate(intake.ALLERGIES)],
        *[box("342 - k % 13", f"{187 + 13 * i}", f"k % 4 > 0 and (k + {i}) % 4 = 0", texts("", s.upper(), "q")) for i, s in enumerate(intake.SYMPTOMS)],
        *[box(f"{70 + 60 * i} + k % 5 * 60", "362 + k % 4 * 35", f"(k + {i}) % 5 = 0", f"'{c}'") for i, c in enumerate(intake.CLAIM_TYPES)],
    ],
)
_IV = {n: P.variant(ts) for n, ts in intake.ANCHORS.items()}
_IA = _INTAKE.anchors({n: tuple(t for t in ts if len(t) >= 4) for n, ts in _IV.items()}) + ", xv(name, k, v) as (values " + ", ".join(f"('{n}', {q}, '{t}')" for n, ts in _IV.items() for q, t in enumerate(ts)) + """), xa as (select page, name, arg_min(i, (k, i)) i from ln join xv on contains(lower(text), v) group by 1, 2),
av as (select coalesce(x.name, n.name) as name, l.* from (select page, name, i from xa) x full join (select page, name, i from an) n on x.page = n.page and x.name = n.name join ln l on l.page = coalesce(x.page, n.page) and l.i = coalesce(x.i, n.i))"""


def _near(name: str, dx: float, dy: float) -> str:
    return f"select c.*, a.cy ay from av a join ct c on c.page = a.page and a.name = '{name}' and c.kind in ('checkbox', 'radio') and (c.cx < 306) = (a.cx < 306) and abs(c.cy - a.cy) <= {dy} and c.cx - a.x1 between -12 and {dx}"


_OTHERS = tuple(intake.ALLERGIES + intake.SYMPTOMS + intake.CLAIM_TYPES + intake.SEXES)


def _told(name: str, out: str, dx: float, dy: float) -> tuple[str, str]:
    """Expressions of the closest row of an anchor's answer boxes, and the answers."""
    cte = f"{name}_i as (select *, row_number() over (partition by page order by cx, i) n from ({_near(name, dx, dy)}) where label not in {_OTHERS}), {clusters(name + '_i', 6, name + '_c')}, {name}_l as (select page, arg_max(hs, n) hs from {name}_c_f group by page), {name}_b as (select page, arg_min(row_, (abs(hs[row_].h - ay), row_)) b from {name}_c join {name}_l using (page) join {name}_i using (page, i) group by page), {name}_r as (select i.page, row_number() over (partition by i.page order by x, i) n, selected, case label when 'Yes' then 'YES' when 'No' then 'NO' end label from {name}_i i join {name}_c c using (page, i) join {name}_b b using (page) where c.row_ = b.b)"
    return cte, f"left join {_answer(f'select * from {name}_r', out)} using (page)"


_TOLD = [_told("at_smoker", "smoker", 320, 26), _told("at_diabetic", "diabetic", 320, 26), _told("at_work", "work_related", 320, 26), _told("at_auto", "auto_accident", 220, 20)]


def intakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.intake(P.prepare(_INTAKE.pages(spark, sf_dir)))


@query(f"with recursive {_IA}, {', '.join(c for c, _ in _TOLD)} select page, smoker, diabetic, work_related, auto_accident from kk {' '.join(j for _, j in _TOLD)}")
def intake_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intakes(spark, sf_dir).select("page", "smoker", "diabetic", "work_related", "auto_accident")


_SEX_SQL = f"""sx as (select *, row_number() over (partition by page order by cx, i) n, row_number() over (partition by page order by x, i) - 1 px from ({_near("at_sex", 320, 26)})),
sl as (select l.*, a.cy as acy, row_number() over (partition by l.page order by l.cy, l.i) n from ln l join av a on a.page = l.page and a.name = 'at_sex' and (l.cx < 306) = (a.x0 < 306)),
sq(page, n, h, c, r) as (select page, n, cy, 1::bigint, 1::bigint from sl where n = 1 union all select q.page, l.n, case when abs(l.cy - q.h) <= 9 then (q.h * q.c + l.cy) / (q.c + 1) else l.cy end, case when abs(l.cy - q.h) <= 9 then q.c + 1 else 1 end, case when abs(l.cy - q.h) <= 9 then q.r else q.r + 1 end from sq q join sl l on l.page = q.page and l.n = q.n + 1),
sr as (select page, r, arg_max(h, n) h from sq group by 1, 2), sb as (select s.page, s.i, arg_min(sr.r, (abs(sr.h - s.cy), sr.r)) r, min(abs(sr.h - s.cy)) d from sx s join sr on sr.page = s.page group by 1, 2),
sw as (select s.page, s.i, arg_min(l.said, (l.x0 - s.cx, l.i)) said from sx s join sb on sb.page = s.page and sb.i = s.i and d <= 14 join sq on sq.page = s.page and sq.r = sb.r join sl l on l.page = s.page and l.n = sq.n where l.x0 - s.cx between 0 and 60 group by 1, 2),
s1 as (select page, arg_min(coalesce(nullif(trim(label), ''), said), n) v from sx left join sw using (page, i) where selected and coalesce(nullif(trim(label), ''), said) in ('Male', 'Female', 'Other') group by page),
s2 as (select page, {intake.SEXES}[min(px) filter (selected and px < 3) + 1] v from sx group by page), s3 as (select c.page, arg_min(label, case label when 'Male' then 0 when 'Female' then 1 else 2 end) v from ct c join av a on a.page = c.page and a.name = 'at_sex' where selected and label in ('Male', 'Female', 'Other') and abs(c.cy - a.cy) <= 30 group by 1),
s5 as (select page, case when count(*) filter (selected and label in ('Male', 'Female', 'Other')) = 0 then 'Other' end v from sx group by page)"""


@query(f"""with recursive {_IA}, {_SEX_SQL}, ca as (select page, min(i) i from ln where starts_with(lower(said), 'claim type') group by 1), cl as (select l.* from ca join ln l using (page, i)),
c1 as (select c.page, arg_min(o, q) v from ct c join cl a on a.page = c.page join {_options(intake.CLAIM_TYPES)} on o = label where selected and (c.cx < 306) = (a.x0 < 306) and abs(c.cy - a.cy) < 120 and c.cx - a.x1 > -20 and c.cx - a.x1 < 260 group by 1),
c2 as (select page, arg_min(o, q) v from ct join {_options(intake.CLAIM_TYPES)} on o = label where selected group by 1)
select page, coalesce(s1.v, s2.v, s3.v, s5.v) sex, coalesce(c1.v, c2.v) claim_type from kk left join s1 using (page) left join s2 using (page) left join s3 using (page) left join s5 using (page) left join c1 using (page) left join c2 using (page)""")
def intake_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intakes(spark, sf_dir).select("page", "sex", "claim_type")


_BOX = "select b.page, b.o, b.q, b.li, arg_min(selected, (b.x0 - c.cx, c.i)) s from ({}) b join ct c on c.page = b.page and abs(c.cy - b.cy) <= 12 and b.x0 - c.cx between 0 and 35 {} group by 1, 2, 3, 4"


@query(f"""with {_IA}, al as (select l.page, o, q, l.i li, l.x0, l.cy from av a join ln l on l.page = a.page and a.name = 'at_allergies' and l.cy - a.cy between 4 and 220 join {_options(intake.ALLERGIES)} on lower(l.said) = lower(o)),
a1 as (select page, o, min(li) f from ({_BOX.format("select * from al", "")}) where s group by 1, 2), a1s as (select page, string_agg(o, ',' order by f) v from a1 group by 1), a2 as (select page, string_agg(distinct o, ',' order by o) v0, list(distinct {{q: q, o: o}}) l from ct join {_options(intake.ALLERGIES)} on o = label where selected group by 1),
a2s as (select page, array_to_string(list_transform(list_sort(l), lambda zz: zz.o), ',') v from a2),
sl as (select l.page, o, q, arg_min(l.i, (l.y0, l.i)) li, arg_min(l.x0, (l.y0, l.i)) x0, arg_min(l.cy, (l.y0, l.i)) cy, any_value(a.x0) ax from av a join ln l on l.page = a.page and a.name = 'at_symptoms' and (l.cx < 306) = (a.x0 < 306) and l.cy > a.cy join {_options(intake.SYMPTOMS)} on lower(l.said) = lower(o) group by 1, 2, 3),
y1 as (select page, string_agg(o, ',' order by q) v from ({_BOX.format("select * from sl", "and (c.cx < 306) = (b.ax < 306)")}) where s group by 1),
y2 as (select page, array_to_string(list_transform(list_sort(list(distinct {{q: q, o: o}})), lambda zz: zz.o), ',') v from ct join {_options(intake.SYMPTOMS)} on lower(o) = lower(label) where selected group by 1)
select page, coalesce(a1s.v, a2s.v, '') allergies, coalesce(y1.v, y2.v, '') symptoms from kk left join a1s using (page) left join a2s using (page) left join y1 using (page) left join y2 using (page)""")
def intake_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intakes(spark, sf_dir).select("page", F.array_join("allergies", ",").alias("allergies"), F.array_join("symptoms", ",").alias("symptoms"))
