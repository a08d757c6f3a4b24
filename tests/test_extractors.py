"""Extractors, ink, the store and reports where no SQL restates them."""

import re
from concurrent.futures import ThreadPoolExecutor
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwright.extractors import auto, authorization, benefits, claim, generic, injury, ink, intake
from leafwright.extractors import page as P
from leafwright.operators import evaluation, fuzzy, store
from leafwright.sources import readers, sinks

LINES = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>"
CONTROLS = "array<struct<kind:string,x:double,y:double,w:double,h:double,selected:boolean,label:string,conf:double>>"


def raw(spark, lines, controls=(), more=(), kinds=""):
    rows = [(1, [(t, float(x), float(y), float(x + 6 * len(t)), float(y + 10)) for t, x, y in lines], list(controls), *more)]
    return spark.createDataFrame(rows, f"page int, lines {LINES}, controls {CONTROLS}{kinds}")


def page(*args):
    return P.prepare(raw(*args))


def test_anchors_are_found_nearly(spark):
    p = page(spark, [("PAT1ENT NARNE", 0, 0), ("Dale of Servlce", 0, 20), ("something else", 0, 40)])
    found = P.anchored(p, {"a": ("patient name",), "b": ("nothing like it", "date of service"), "c": ("zzzz",)}).select("a.i", "b.i", "c.i").first()
    assert tuple(found) == (0, 1, None)


def _plainly(text, needle, threshold):
    t, n = " ".join(text.lower().split()), " ".join(needle.lower().split())
    windows = [SequenceMatcher(None, t[i : i + len(n) + 4], n).ratio() for i in range(0, max(1, len(t) - len(n) + 1), max(1, len(n) // 4))] if len(t) >= len(n) >= 4 else []
    x, y = (set(re.findall(r"\w+", s)) for s in (t, n))
    words = bool(x and y) and len(x & y) / len(x | y) >= 0.5 and " " in n and len(n) >= 4
    bare = ["".join(c for c in s if c.isascii() and c.isalnum()) for s in (t, n)]
    return n in t or bool(bare[1]) and bare[1] in bare[0] or max(windows, default=0) >= threshold or words


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.78, 0.9])
def test_nearness_is_that_of_plain_windows(spark, threshold):
    rng = np.random.default_rng(7)
    needles = ["patient name", "1. medicare", "abdc", "date of service", "mva", "28. total charge", "aaaa", "née à"]
    texts = ["patlent name", "xx 1.MEDICARE", "abcd", "axbd", "name of the patient", "", "abc", "aaxaa", "NÉE  à Lyon", "--"]
    for n in needles:  # garbled in a few places, alone and inside a line
        for _ in range(12):
            c = list(n)
            for _ in range(rng.integers(1, 5)):
                at = int(rng.integers(0, len(c)))
                c[at : at + int(rng.integers(0, 2))] = list("xq r1"[: rng.integers(0, 3)])
            texts += ["".join(c), "so: " + "".join(c) + " 12/03", "".join(c).upper()]
    table = spark.createDataFrame([(t,) for t in [*texts, *texts, None]], "text string")
    got = fuzzy.nearly(table, needles, threshold).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == {(t, k) for t in set(texts) for k, n in enumerate(needles) if _plainly(t, n, threshold)}


def test_found_texts_are_told_to_rows(spark):
    rows = spark.createDataFrame([(1, ["a", None, "b"]), (1, ["a", None, "b"]), (2, []), (3, None), (4, ["c"] * 3)], "id int, texts array<string>")
    pairs = spark.createDataFrame([("a", 2), ("a", 0), ("b", 1), ("z", 1)], "text string, k int")
    want = [(1, [[0, 2], [], [1]])] * 2 + [(2, []), (3, None), (4, [[], [], []])]
    for sent in (1000, 0):  # as a part of the plan, and by a join
        got = fuzzy.Pairs(pairs, sent).told(rows, "texts", "found").select("id", "found").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        least = fuzzy.Pairs(pairs.withColumn("ratio", F.col("k") / 2), sent).told(rows, "texts", "found", 0.5)
        assert [r["found"] for r in least.where("id = 1").collect()] == [[[2], [], [1]]] * 2
    assert fuzzy.Pairs(pairs.limit(0)).told(rows, "texts", "found").where("id = 4").first()["found"] == [[], [], []]


def test_similarity_of_options(spark):
    texts, options = ["Penicilin", "none known", "Chest  pain", "cough drops", "x", "Known: none?", "chest", ""], intake.ALLERGIES + intake.SYMPTOMS
    want = {}
    for a in texts:
        for k, b in enumerate(options):
            x, y = set(re.findall(r"\w+", a.lower())), set(re.findall(r"\w+", b.lower()))
            ratio = (0.6 * len(x & y) / len(x | y) if x and y else 0) + 0.4 * SequenceMatcher(None, a.lower(), b.lower()).ratio()
            if ratio >= 0.5:
                want[a, k] = ratio
    got = {(r["text"], r["k"]): r["ratio"] for r in fuzzy.alike(spark.createDataFrame([(t,) for t in texts], "text string"), options, 0.5).collect()}
    assert got == pytest.approx(want) and len(want) >= 3


def test_scanned_intake(spark):
    lines = [("Gender", 20, 40), ("Allergies", 20, 100), ("(X) Pollen", 40, 120), ("Latex", 40, 140), ("Symptoms", 20, 200), ("☑ Fever", 40, 220)]
    controls = [("radio", 500.0, 175.0, 30.0, 30.0, True, "© Female", 0.6)]
    p = page(spark, lines, controls, ("ocr", 612.0), ", text_source string, width double")
    r = intake.intake(p).first()
    assert (r["sex"], r["allergies"], r["symptoms"]) == ("Male", ["Pollen"], ["Fever"])
    assert spark.range(1).select(F.expr(intake.cleaned("'So. Yes'")), F.expr(intake.cleaned("'[X] No'"))).first()[:] == ("Yes", "No")


def raster(marks):
    """A white page with outlined boxes (x, y in points) filled or not."""
    image = np.full((400 * 300 // 72, 400 * 300 // 72), 255, np.uint8)
    for x, y, filled in marks:
        a, b = (int(v * 300 / 72) for v in (x, y))
        image[b - 18 : b + 18, a - 18 : a + 18] = 0
        if not filled:
            image[b - 15 : b + 15, a - 15 : a + 15] = 255
    return image


def with_image(p, image):
    h, w = image.shape
    return p.withColumn("image", F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"), F.lit(bytearray(image.tobytes())).alias("data")))


def test_ink_of_scanned_forms(spark):
    lines = [("Sex", 10, 40), ("Male", 60, 40), ("Female", 160, 40), ("Records", 10, 80), ("Office Notes", 60, 100), ("Lab Results", 60, 130), ("On premises", 10, 200), ("Yes", 100, 200), ("No", 200, 200)]
    image = raster([(54, 45, True), (154, 45, False), (52, 105, False), (52, 135, True), (99, 205, False), (196, 205, True)])
    p = with_image(page(spark, lines), image)
    p = ink.best_option(p, "sex", ["Male", "Female", "Other"])
    p = ink.marked_options(p, "records", ["Office Notes", "Lab Results", "Imaging"], "records")
    p = ink.yes_or_no(p, "premises", "on premises")
    assert tuple(p.select("sex", "records", "premises").first()) == ("Male", ["Lab Results"], False)
    blank = ink.yes_or_no(ink.best_option(p.withColumn("image", F.lit(None).cast(p.schema["image"].dataType)), "sex", ["Male"]), "premises", "on premises")
    assert tuple(blank.select("sex", "premises").first()) == (None, None)


def _scan(spark, lines, marks, text_source="ocr"):
    p = with_image(page(spark, lines), raster(marks))
    return p.withColumn("text_source", F.lit(text_source))


def test_claims_are_filled_in_by_ink(spark):
    lines = [("Sex", 10, 40), ("M", 60, 40), ("F", 160, 40), ("Self", 60, 80), ("Spouse", 160, 80), ("YES", 60, 120), ("NO", 160, 120), ("SSN", 60, 160), ("EIN", 160, 160)]
    marks = [(162, 45, True), (154, 85, True), (54, 125, True), (154, 165, True)]
    fields = ("patient_sex", "relationship_to_insured", "condition_auto", "accept_assignment", "tax_id_type")
    assert tuple(claim.claim(_scan(spark, lines, marks)).select(*fields).first()) == ("F", "Spouse", True, True, "EIN")
    assert tuple(claim.claim(_scan(spark, lines, marks, "native")).select(*fields).first()) == (None,) * 5
    assert tuple(claim.claim(_scan(spark, lines, [])).select(*fields).first()) == (None,) * 5


def test_authorizations_are_filled_in_by_ink(spark):
    lines = [("Records to be released", 10, 20), ("Office Notes", 60, 40), ("Lab Results", 60, 60), ("Specially protected information", 10, 90), ("Do NOT release Mental Health", 60, 110), ("Purpose of disclosure", 10, 140), ("Legal Proceedings", 60, 160), ("Expiration", 10, 200), ("Specific date", 60, 220)]
    fields = ("record_types", "excluded_categories", "purposes", "expiration_type")
    marks = [(52, 65, True), (52, 115, True), (52, 165, True), (52, 225, True)]
    assert tuple(authorization.authorization(_scan(spark, lines, marks)).select(*fields).first()) == (["Lab Results"], ["Mental Health"], ["Legal Proceedings"], "specific_date")
    assert tuple(authorization.authorization(_scan(spark, lines, marks[:1])).select(*fields).first()) == (["Lab Results"], [], [], None)


def test_injuries_are_filled_in_by_ink(spark):
    lines = [("On employer premises", 10, 20), ("Yes", 200, 20), ("No", 300, 20), ("Fracture", 60, 60), ("Burn", 60, 80), ("Cause of injury", 10, 110), ("Lifting", 60, 130), ("Treatment received", 10, 160), ("Hospitalized", 60, 180)]
    fields = ("on_premises", "nature_of_injury", "causes", "treatments")
    assert tuple(injury.injury(_scan(spark, lines, [(299, 25, True), (52, 85, True), (52, 135, True), (52, 185, True)])).select(*fields).first()) == (False, "Burn", ["Lifting"], ["Hospitalized"])


def test_codes_of_a_closer_reading(spark):
    p = page(spark, [("Explanation of Benefits", 0, 0)]).withColumn("text_again", F.lit("99213 x 97110 99213 00123"))
    assert tuple(benefits.benefits(p).select("service_line_cpts", "service_line_count").first()) == (["97110", "99213"], 2)


def test_rows_by_ink(spark):
    px = 300 / 72
    controls = [("checkbox", (40 + 30 * c) * px - 18, (50 + 20 * r) * px - 18, 36.0, 36.0, False, "", 0.9) for r in range(3) for c in range(4)]
    p = with_image(page(spark, [], controls), raster([(40 + 30 * c, 50 + 20 * r, c == r) for r in range(2) for c in range(4)]))
    rows = P.clustered(P.by("filter(controls, c -> c.kind = 'checkbox')", "c.cy", value="c"), 5, "c", P.CONTROL)
    assert ink.row_picks(P.staged(p, {"rows": rows}), "picks", "rows").first()["picks"] == [0, 1, None]


def test_density_is_the_share_of_dark_pixels():
    image = np.full((100, 100), 255, np.uint8)
    image[40:60, 40:50] = 0
    assert ink.density(image, 50 * 72 / 300, 50 * 72 / 300, 20 * 72 / 300) == pytest.approx(6 / 12, abs=0.1)
    assert ink.density(image, 0, 0, 1) == 0.0 and ink.density(image, 500, 500, 12) == 0.0


def _put_right(text, least=0.85):
    """The rules of the vocabulary, by comparing everything with everything."""
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    words = text.split()
    for phrase in sorted((v for v in fuzzy.VOCABULARY if " " in v), key=len, reverse=True):
        n = len(phrase.split())
        if phrase not in text.lower():
            for i in range(len(words) - n + 1):
                if ratio(" ".join(words[i : i + n]).lower(), phrase) >= least:
                    return " ".join([*words[:i], phrase, *words[i + n :]])
    out = []
    for w in words:
        bare = w.lower().strip(".,;:!?'\"()-_")
        best = max(((ratio(bare, v), -k, v) for k, v in enumerate(fuzzy.VOCABULARY) if " " not in v and abs(len(v) - len(bare)) <= 2), default=(0,))
        out.append(best[2] if len(bare) >= 5 and bare not in fuzzy.VOCABULARY and best[0] > least else w)
    return " ".join(out)


def test_vocabulary(spark):
    rng = np.random.default_rng(12)
    texts = ["Fatigve and haedache today", "has shortnes of breath", "cat house", "", "  ", "(Penicilln),  dusty", "yes", "a" * 400, "none known, none  known", "date of servlce", "Date of\tService", "patients'"]
    for v in fuzzy.VOCABULARY:
        for _ in range(6):
            c = list(v.upper() if rng.random() < 0.3 else v)
            for _ in range(rng.integers(0, 4)):
                at = int(rng.integers(0, len(c)))
                c[at : at + int(rng.integers(0, 3))] = list("xq e1"[: rng.integers(0, 3)])
            texts.append("so " * int(rng.integers(0, 2)) + "".join(c) + rng.choice(["", ".", " the knee", ": 12"]))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, texts[0]])], "i int, t string")
    got = {r["i"]: r["corrected"] for r in fuzzy.corrected(rows, "t").collect()}
    assert got == {i: None if t is None else _put_right(t) for i, t in enumerate([*texts, None, texts[0]])}
    assert sum(_put_right(t) != " ".join(t.split()) for t in texts) > 60


def test_ratios(spark):
    rows = [("abcd", "abdc"), ("Chest pain", "chest PAIN"), ("", "x")]
    d = spark.createDataFrame(rows, "a string, b string").select(fuzzy.edit_ratio("a", "b"), fuzzy.token_set_ratio(F.col("a"), F.col("b")))
    for (a, b), (r, s) in zip(rows, d.collect(), strict=True):
        x, y = set(a.lower().split()), set(b.lower().split())
        want = SequenceMatcher(None, a.lower(), b.lower()).ratio()
        assert (r, s) == (pytest.approx(want), pytest.approx(0.6 * (len(x & y) / len(x | y) if x and y else 0) + 0.4 * want))


@pytest.fixture
def database(spark, tmp_path):
    spark.sql(f"create database scratch location '{tmp_path}/db'")
    store.create_tables(spark, "scratch")
    yield "scratch"
    spark.sql("drop database scratch cascade")


def test_store_keeps_extractions(spark, database):
    note = raw(spark, [("Patient Name: Ann Lee", 0, 0), ("MRN: A1234", 0, 20), ("Dx M54.2 and S13.4", 0, 40)])
    found = auto.extract(note.select(F.lit("/in/a b.pdf").alias("file"), F.lit(0).alias("page_no"), "lines", "controls"))
    first = store.store_extractions(found, database, "2024-01-01T00:00:00")
    assert [r["file_name"] for r in first.collect()] == ["a b.pdf"]
    old = first.first()["id"]
    # the same again, by itself and beside another, is stored already
    assert store.store_extractions(found.unionByName(found), database).collect() == []
    other = found.withColumn("file", F.lit("/in/c.pdf"))
    assert [r["file_name"] for r in store.store_extractions(found.unionByName(other), database).collect()] == ["c.pdf"]
    ids = sorted((r["file_name"], r["id"]) for r in spark.table("scratch.documents").collect())
    assert [n for n, _ in ids] == ["a b.pdf", "c.pdf"] and ids[0][1] == old != ids[1][1]
    ids = [i for _, i in ids]
    named = spark.table("scratch.fields").where(f"document_id = {old} and field_name = 'patient_name'").collect()
    assert [(r["field_value"], r["field_type"]) for r in named] == [("Ann Lee", "text")]
    assert sorted(r["icd10_code"] for r in spark.table("scratch.diagnoses").where(f"document_id = {ids[1]}").collect()) == ["M54.2", "S13.4"]
    segments = spark.createDataFrame([("b", 1, 2, "P", "01/02/2024", "Lab Result", 2), ("b", 3, 3, "P", None, "Separator", 1)], "bundle string, start_page int, end_page int, provider string, dos string, doc_type string, page_count int")
    store.store_index(segments, database)
    store.store_index(segments, database)
    assert spark.table("scratch.page_index").count() == 1
    spark.sql("use scratch")
    try:
        for name, sql in store.EXAMPLES.items():
            assert store.explore(spark, sql).columns, name
        for sql in ("drop table documents", "insert into diagnoses values (1, 'x', 1)", "create table t (a int)"):
            with pytest.raises(Exception):  # noqa: B017
                store.explore(spark, sql)
    finally:
        spark.sql("use default")


def _records(spark, n, start=0):
    rows = [(f"/in/{k}.pdf", "t", 0.5, '{"a":"%d","diagnoses":["A1%d"],"service_lines":[{"cpt":"99213"}]}' % (k, k % 9)) for k in range(start, start + n)]
    return spark.createDataFrame(rows, "file string, form_type string, confidence double, record string").repartition(3)


def _contents(spark):
    return {t: sorted(map(tuple, spark.table(f"scratch.{t}").drop("extracted_at").collect()), key=str) for t in ("documents", "fields", "service_lines", "diagnoses")}


def test_two_writers_at_once_are_one(spark, database):
    """Both write all rows before either has committed; the other order gives the same."""
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda _: store.store_extractions(_records(spark, 40), database), range(2)))
    assert {r["n"] for r in spark.table("scratch.commits").collect()} == {40}
    both = _contents(spark)
    assert len(both["documents"]) == len({r[0] for r in both["documents"]}) == 40 and len(both["fields"]) == 40 and len(both["diagnoses"]) == 40
    store.store_extractions(_records(spark, 10, 35), database)
    after = _contents(spark)
    assert len(after["documents"]) == 45 == len({r[0] for r in after["documents"]}) and set(both["documents"]) <= set(after["documents"])


def test_a_writer_that_fails_leaves_nothing(spark, database, monkeypatch):
    commit = store._commit
    monkeypatch.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        store.store_extractions(_records(spark, 12), database)
    assert spark.table("scratch.documents_rows").count() == 12 and not any(_contents(spark).values())
    monkeypatch.setattr(store, "_commit", commit)
    store.store_extractions(_records(spark, 12), database)
    once = _contents(spark)
    assert [len(once[t]) for t in ("documents", "fields", "service_lines", "diagnoses")] == [12] * 4
    # ranges that two batches would share are told apart
    taken = spark.table("scratch.commits").first()
    assert store._base(spark, database, taken["batch"], 12) == taken["base"] and store._base(spark, database, taken["batch"][:9] + "0000000-5", 5) >= taken["base"] + 12


def test_only_reading_is_explored(spark, database):
    store.store_extractions(_records(spark, 30), database)
    spark.range(3).write.mode("overwrite").parquet(f"{spark.conf.get('spark.sql.warehouse.dir').removeprefix('file:')}/loose")
    spark.sql("use scratch")
    try:
        for sql, n in {
            "select form_type, count(*) n from documents group by form_type having count(*) > 3": 1, "select sum(x) over w from values (1), (2) t(x) window w as (order by x)": 2, "values (1, 'a'), (2, 'b')": 2,
            "select id from documents order by id limit 10 offset 25": 5, "select id from documents intersect select document_id from fields": 30, "with a as (select id from documents) select * from a where id in (select document_id from diagnoses)": 30,
            "select d.id, x.i from documents d lateral view explode(array(1, 2)) x as i": 60, "select * from range(4)": 4, "select max(id) from scratch.documents": 1, "show tables": 0, "explain select 1": 1,
        }.items():
            got = store.explore(spark, sql).count()
            assert got == n or n == 0 and got > 5, sql
        files = f"parquet.`{spark.conf.get('spark.sql.warehouse.dir')}/loose`"
        for sql in (
            f"select * from {files}", f"with a as (select * from {files}) select * from a", f"select 1 where exists (select 1 from {files})", f"select (select max(id) from {files})", "drop table commits", "insert into commits values ('a', 'b', 1, 1, 'c')",
            "create view v as select 1", "truncate table commits", "set spark.sql.ansi.enabled = false", "select reflect('java.lang.System', 'getProperty', 'user.home')", "delete from commits", "from commits insert into commits select *", "use default",
            "alter table commits add columns (z int)", "cache table documents", "refresh table commits", "add jar 'x.jar'",
        ):
            with pytest.raises(ValueError, match="explored"):
                store.explore(spark, sql)
        assert spark.table("commits").count() == 1
        with pytest.raises(Exception, match="(?i)not_found|cannot be found"):
            store.explore(spark, "select * from nowhere")
        seen, after = [], None
        while page := [r["id"] for r in store.explore(spark, "select id, form_type from documents", 7, ["form_type", "id"], after).collect()]:
            seen += page
            after = ("t", page[-1])
        assert len(seen) == 30 and seen == sorted(seen)
    finally:
        spark.sql("use default")


def test_types_take_their_extractor(spark):
    marked = raw(spark, [("First report of injury", 0, 0), ("Sex", 20, 60), ("M", 60, 62), ("F", 90, 62)]).withColumn("drawings", F.expr("array(named_struct('x0', 88D, 'y0', 60D, 'x1', 100D, 'y1', 72D, 'color', array(1D, 0D, 0D), 'fill', cast(null as array<double>)))"))
    plain = marked.withColumn("page", F.lit(2)).withColumn("drawings", F.expr("filter(drawings, d -> false)"))
    d = marked.unionByName(plain).withColumn("spans", F.expr("array(named_struct('text', 'x', 'size', 9D, 'font', 'H', 'color', 0, 'x0', 0D, 'y0', 0D, 'x1', 1D, 'y1', 1D))"))
    d = d.select(F.concat(F.lit("f"), "page").alias("file"), F.lit(0).alias("page_no"), "lines", "controls", "drawings", "spans")
    got = {r["file"]: r for r in auto.extract(d).withColumn("sex", F.get_json_object("record", "$.employee_sex")).collect()}
    assert {k: (r["form_type"], r["sex"]) for k, r in got.items()} == {"f1": ("froi", "F"), "f2": ("froi", None)}
    assert auto.extract(d.limit(0)).collect() == []


def test_empty_and_null_pages(spark):
    d = spark.createDataFrame([(1, None, None), (2, [], [])], f"page int, lines {LINES}, controls {CONTROLS}")
    assert sorted((r["page"], r["stats"]["text_lines"]) for r in generic.generic(P.prepare(d)).collect()) == [(1, 0), (2, 0)]
    for kind, extractor in auto.EXTRACTORS.items():
        assert extractor(P.prepare(d)).count() == 2, kind


def test_reports(spark, tmp_path):
    many = spark.range(1500).select(F.col("id"), F.when(F.col("id") == 7, "a<b").alias("t"))
    html = sinks.html_table(many, "All & some")
    assert html.count("<tr>") == 1501 and "a&lt;b" in html and "All &amp; some" in html
    sinks.write_html(many, f"{tmp_path}/html")
    assert spark.read.text(f"{tmp_path}/html").where("value like '%a&lt;b%'").count() == 1
    assert "<img" in sinks.review_page(many.limit(1), ["x.png"])
    s = spark.createDataFrame([("b", "P", "01/02/2024", "Lab Result", 1, 2), ("b", "P", None, "Separator", 3, 3)], "bundle string, provider string, dos string, doc_type string, start_page int, end_page int")
    t = spark.createDataFrame([("b", 3, 1, 1)], "bundle string, total_pages int, provider_count int, encounter_count int")
    assert sinks.index_report(s, t).splitlines() == ["b: 3 pages, 1 providers, 1 documents", "P  01/02/2024  Lab Result  pages 1-2"]
    r = spark.createDataFrame([("f", "t", "x", "other", "1", "1"), ("f", "t", "y", "other", None, "1")], "file string, form_type string, field string, compared string, predicted string, truth string")
    shown = evaluation.report(evaluation.judged(r))
    assert "Accuracy: 50.0%  missed: 50.0%" in shown and "f: 50.0% missed y wrong" in shown
    c = spark.createDataFrame([("x", 1.0, 0.5, 0.5)], "field string, accuracy double, before double, change double")
    assert evaluation.comparison(c, 0.75, 0.5).splitlines()[0].split() == ["overall", "50.0%", "->", "75.0%", "(+25.0%)"]


def test_tiers_rasters_and_counts(spark, tmp_path):
    d = spark.createDataFrame([(1, [("n",)], [("o",)]), (2, [], [("o",)]), (3, None, [])], "page int, native array<struct<text:string>>, ocr array<struct<text:string>>")
    assert [(r["text_source"], r["lines"] and r["lines"][0]["text"]) for r in readers.first_text(d, ["native", "ocr"]).orderBy("page").collect()] == [("native", "n"), ("ocr", "o"), ("none", None)]
    (tmp_path / "a.pdf").write_bytes(b"ab")
    files = readers.files(spark, str(tmp_path))
    images = readers.rasterised(files, lambda content, dpi: [(1, 1, content[k : k + 1]) for k in range(len(content))])
    assert [(r["page"], r["image"]["width"]) for r in images.orderBy("page").collect()] == [(0, 1), (1, 1)]
    assert readers.page_counts(images).first()["pages"] == 2
