"""Operators that SQL can't state, against plain restatements."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from leafwright.functions import text as T
from leafwright.operators import compare, fuzzy, layout, segments, store
from leafwright.sources import readers, sinks
from leafwright.streaming import ingest


def test_height_rows(spark):
    rng = random.Random(5)
    items = [(p, i, float(rng.randrange(40)), float(rng.randrange(30))) for p in range(60) for i in range(rng.randrange(1, 25))]
    want = set()
    for p in {x[0] for x in items}:
        rows = []
        for y, _, i in sorted((y, x, i) for q, i, x, y in items if q == p):
            r = next((j for j, (h, _) in enumerate(rows) if abs(h - y) <= 4), None)
            if r is None:
                rows.append((y, 1))
                r = len(rows) - 1
            else:
                h, n = rows[r]
                rows[r] = ((h * (n + 1) + y) / (n + 2), n + 1)
            want.add((p, r, i))
    got = layout.height_rows(spark.createDataFrame(items, "page int, item int, x double, y double"), 4)
    assert {tuple(r) for r in got.collect()} == want


def test_suppress(spark):
    rng = random.Random(6)
    boxes = [(p, i, *(float(rng.randrange(30)) for _ in "xy"), *(float(rng.randrange(5, 20)) for _ in "wh")) for p in range(40) for i in range(12)]
    want = set()
    for p in range(40):
        kept = []
        for b in sorted((b for b in boxes if b[0] == p), key=lambda b: (b[4] * b[5], b[1]), reverse=True):
            def iou(a, b=b):
                w = max(min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), 0) * max(min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]), 0)
                return w / (a[4] * a[5] + b[4] * b[5] - w)

            if all(iou(k) <= 0.3 for k in kept):
                kept.append(b)
        want |= {(p, b[1]) for b in kept}
    got = layout.suppress(spark.createDataFrame(boxes, "page int, box long, x double, y double, w double, h double"))
    assert {tuple(r) for r in got.collect()} == want


def test_shapes_and_columns(spark):
    d = spark.createDataFrame([(["re"], 0.0), (["c", "c"], 50.0), (["l"] * 4, 25.0), (["l", "c"], 500.0), ([], -30.0)], "ops array<string>, x double")
    got = d.select(layout.drawing_shape(F.col("ops")), layout.column_of(F.col("x"), {"a": 0, "b": 50})).collect()
    assert [tuple(r) for r in got] == [("rect", "a"), ("circle", "b"), ("rect", "a"), (None, None), (None, "a")]


def test_fuzzy(spark):
    pairs = [("Patient Name", "patlent name"), ("abcd", "abdc"), ("", "x"), (None, "x"), ("Date  of\nService", "date of service")]
    d = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in d.select(fuzzy.edit_ratio("a", "b")).collect()]
    assert got == [None if a is None else SequenceMatcher(None, a.lower(), b.lower()).ratio() for a, b in pairs]
    d = spark.createDataFrame([("The PATIENT  name:",), ("patientname",), ("xx patlent name",), ("zebra",), ("name of patient",), (None,)], "t string")
    assert [r["found"] for r in fuzzy.contains_like(d, "t", "patient name").collect()] == [True, True, True, False, True, False]


def test_comparators(spark):
    d = spark.createDataFrame([(["a"], ["a", "b"]), ([], []), (None, ["a"]), (["a", "b", "c"], ["a", "b", "x"])], "p array<string>, t array<string>")
    p, t = F.col("p"), F.col("t")
    got = d.select(compare.set_match(p, t), compare.set_match(p, t, 0.5), compare.sequence_match(p, t), compare.sequence_match(p, t, 0.6)).collect()
    assert [tuple(r) for r in got] == [(False, True, False, False), (True, True, True, True), (False, False, False, False), (False, True, False, True)]


def test_store(spark, tmp_path):
    spark.range(5).createOrReplaceTempView("five")
    assert store.explore(spark, "select * from five order by id", 3).count() == 3
    for bad in ("drop table five", "create table x as select 1", "insert into five values (1)"):
        try:
            store.explore(spark, bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    m = spark.sql("select map('a', '1') s, map('a', '2', 'b', '3', 'c', '4') g").select(store.merged(F.col("s"), F.col("g"), ["a", "b"])).first()[0]
    assert m == {"a": "1", "b": "3"}
    assert spark.range(1).select(T.digits_list(F.lit("1, 2,x,"))).first()[0] == [1, 2]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"two words")
    decode = lambda path, raw: [{"page": 0, "lines": [{"line": i, "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "text": w} for i, w in enumerate(raw.decode().split())], "controls": []}]
    pages = readers.decoded(readers.files(spark, str(tmp_path / "in")), decode)
    assert [r.text for r in readers.page_lines(pages).orderBy("line").collect()] == ["two", "words"]
    assert readers.page_controls(pages).count() == 0
    words = spark.createDataFrame([(0, 0, 0, 5.0, 1.0, 9.0, 2.0, "b"), (0, 0, 0, 1.0, 0.0, 4.0, 2.0, "a")], "page int, block int, line int, x0 double, y0 double, x1 double, y1 double, word string")
    assert tuple(readers.lines_of_words(words).first())[3:] == (1.0, 0.0, 9.0, 2.0, "a b")
    (tmp_path / "m.json").write_text('{"eob": [{"pdf": "a.pdf", "json": "a.json"}]}')
    assert [tuple(r) for r in readers.manifest(spark, str(tmp_path / "m.json")).collect()] == [("eob", "a.pdf", "a.json")]
    seg = spark.createDataFrame([("a", "Separator", None), ("b", None, ["x", "y"]), ("c<", "ER Report", [])], "id string, doc_type string, codes array<string>")
    sinks.write_csv(sinks.index_rows(seg), str(tmp_path / "csv"))
    back = readers.table_csv(spark, str(tmp_path / "csv"))
    assert back.columns == ["codes", "doc_type", "id"] and back.count() == 2
    sinks.write_json(seg, str(tmp_path / "json"), by="id")
    assert readers.records(spark, str(tmp_path / "json"), "doc_type string").count() == 3
    page = sinks.html_table(seg.select("id", "doc_type").orderBy("id"), "Index")
    assert "<td>c&lt;</td>" in page and "<td>-</td>" in page


def test_stream(spark, tmp_path):
    rows = [(1, "a", "Explanation of benefits", "2024-01-01 00:10:00"), (1, "a", "Explanation of benefits", "2024-01-01 00:10:00"), (2, "b", "x", "2024-01-01 01:00:00")]
    spark.createDataFrame(rows, "id long, file_name string, text string, at string").write.json(str(tmp_path / "in"))
    kinds = ingest.classified(ingest.pages(spark, str(tmp_path / "in")))
    ingest.append_to(kinds, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.id, r.form_type) for r in out.collect()) == [(1, "eob"), (2, "unknown")]
    assert sorted(r.n for r in ingest.by_window(out).collect()) == [1, 1]


def _folded(pages, h, least):
    """Parts of one bundle's pages (bundle, page, type, is_separator, tokens), one page after the other."""
    out, number, kinds = [], [p[1] for p in pages], [p[2] for p in pages]
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    unlike = [i > 0 and alike(set(p[4]), set(pages[i - 1][4])) < least for i, p in enumerate(pages)]
    start, kind, run = 0, kinds[0], 0

    def cut(last, kind):
        if last >= start:
            out.append((pages[0][0], len(out) + 1, number[start], number[last], kind))
        return last + 1

    for i in range(1, len(pages)):
        if pages[i][3]:
            start = cut(i - 1, kind)
            start, kind, run = cut(i, "separator"), None, 0
        elif kinds[i] is not None and kinds[i] != kind:
            start, kind, run = cut(i - 1, kind), kinds[i], 0
        else:
            run = run + 1 if unlike[i] else 0
            if run >= h:
                start, kind, run = cut(i - h, kind), kinds[i], 0
    cut(len(pages) - 1, kind)
    return out


@pytest.mark.parametrize("block", [1, 3, 512])
def test_parts_are_those_of_a_fold(spark, block):
    rng = random.Random(block)
    rows, want = [], {2: [], 4: []}
    for bundle in [None, *range(40)]:
        numbers = sorted(rng.sample(range(rng.choice([60, 200000])), rng.choice([1, 2, 7, 50])))
        own = [(bundle, n, rng.choice([None, None, "a", "b"]), rng.random() < 0.1, rng.sample("xyzw", rng.randint(0, 3))) for n in numbers]
        rows += own
        for h in want:
            want[h] += _folded(own, h, 0.3)
    d = spark.createDataFrame(rows, "bundle int, page long, type string, is_separator boolean, tokens array<string>").repartition(5)
    for h in want:
        got = segments._parts(d, 0.3, h, block).select("bundle", "part", "start_page", "end_page", "type").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want[h], key=str)


def test_no_pages_have_no_parts(spark):
    d = spark.createDataFrame([], "bundle int, page long, type string, is_separator boolean, tokens array<string>")
    assert segments.split_segments(d, hysteresis=3).collect() == []
