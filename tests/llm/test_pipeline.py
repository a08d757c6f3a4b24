"""The pipeline on a small table, stage by stage."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from leafwright.llm import bpe, mixing, pii, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def _meets(plan, mixed):
    """Words by source within a block of the targets, words by document as the plan takes them."""
    words, by_doc = Counter(), Counter()
    for r in mixed:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        words[r["source"]] += n
        by_doc[r["doc_id"]] += n
    for source, target in zip(plan.sources, plan.targets, strict=True):
        assert abs(words[source] - target) <= 256
    taken = Counter()
    for r in plan.taken().collect():
        taken[r["doc_id"]] += r["taken"]
    assert +by_doc == +taken


def test_stages(spark):
    docs = queries.documents(spark, SF)
    columns = docs.columns
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = P.language(spark, docs, SF)
    assert kept.columns == columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(texts) <= {i for i, t in whole.items() if t and any(c.isalpha() for c in t)}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert good <= set(texts) and len(texts) > 0.9 * len(whole)

    one = P.deduplicate(spark, kept, SF)
    want = brute.text_classes(sorted(texts.items()))
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, c in want.items() if i == c)

    masked = P.personal_data(spark, one, SF)
    assert masked.columns == columns
    for r in masked.collect():
        assert not brute.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not pii.base_spans(texts[r["doc_id"]]) and not pii.proposals(texts[r["doc_id"]], []):
            assert r["text"] == texts[r["doc_id"]]

    mixed = P.mix(spark, masked, SF)
    _meets(mixing.Mix(masked), mixed.collect())

    assert P.run(spark, SF).exceptAll(bpe.round_trip(mixed, queries.BYTE_BPE)).isEmpty()


def test_mix_meets_targets_of_long_documents(spark):
    docs = [(i if i % 9 else None, " ".join(f"é{i}_{k}" for k in range(1 + i * 37 % 2000)) + "\n", "en", "abc"[i % 3], 0) for i in range(90)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = P.mix(spark, docs, SF).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in mixed)
    _meets(mixing.Mix(docs), mixed)


def test_language_rejects_by_score(spark):
    docs = queries.documents(spark, SF)
    odd = spark.createDataFrame([(-1, "zxq vkj qqx wzv xjq kvz " * 20, None, "a", 480), (-2, "12 34", None, "a", 5)], docs.schema)
    clean = docs.where("length(text) > 400 and lang is not null").limit(3).selectExpr("-10 - doc_id as doc_id", "text", "cast(null as string) lang", "source", "n_chars").select(*docs.columns)
    got = {r["doc_id"] for r in P.language(spark, docs.unionByName(odd).unionByName(clean), SF).collect()}
    assert not got & {-1, -2} and len([i for i in got if i <= -10]) == 3
    nameless = docs.withColumn("lang", F.lit(None).cast("string"))
    assert P.language(spark, nameless, SF).count() == docs.count()


def test_labels_are_judged(spark):
    """Texts under another language's label go, and garbled ones whatever their label; clean ones stay."""
    docs = queries.documents(spark, "/root/testdata/sf0.01")
    long = docs.where("length(text) > 200 and doc_id % 20 = 3")
    other = F.expr("case lang when 'en' then 'fr' when 'fr' then 'de' when 'de' then 'es' else 'en' end")
    wrong = long.withColumn("lang", other).withColumn("doc_id", -1 - F.col("doc_id"))
    garbled = spark.createDataFrame([(-100000 - k, "zxq vkj qqx wzv xjq kvz " * (20 + k), lang, "a", 480) for k, lang in enumerate(("en", "fr", "de", "es"))], docs.schema)
    unknown = long.limit(3).withColumn("lang", F.lit("xx")).withColumn("doc_id", 1000000 + F.col("doc_id"))
    got = {r["doc_id"] for r in P.language(spark, docs.unionByName(wrong).unionByName(garbled).unionByName(unknown), SF).collect()}
    assert wrong.count() > 30 and not {i for i in got if i < 0}
    good = {r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").collect()}
    assert len(good - got) <= 0.01 * len(good) and len({i for i in got if i >= 1000000}) == 3


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, "no id but a text", "en", "a", 16), (1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text, "en", "a", 5), (3, "other words here", "en", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = P.deduplicate(spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in got) == {None: 1, 1: 1, 3: 1}
    assert None in {r["doc_id"] for r in P.mix(spark, docs, SF).collect()}


def test_empty_table(spark, tmp_path):
    queries.documents(spark, SF).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
