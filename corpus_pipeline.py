"""The corpus pipeline: language, near-duplicates, personal data, mix, tokens.

Each stage is written as Parquet in the shared folder and read again, so a
lost executor repeats one stage at most.

Null ids and repeated ids or rows are documents like others, up to the second
stage, which keeps one row of equal texts.  Null and empty texts leave in the
first stage.  Further columns, of any name, are carried up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm import bpe, language_id, mixing, near_dups, pii, store
from leafwright.llm.queries import BYTE_BPE


def _whole(docs: DataFrame) -> Column:
    """A document's columns as one, so that no further column clashes with them."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


#: Of its length, a text scores too low by so many spreads of the middle half below that, and
#: a label is wrong if another language is before its own by so much of the usual lead of the best.
SPREADS, LEAD = 8.0, 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages, and in that of their label.

    Those without a letter go.  What is usual is taken from the labelled rows
    of about a text's length whose prediction is their label: a text goes if it
    scores far below them (``SPREADS``), labelled or not, and a labelled one if
    another language is before its own by a good part (``LEAD``) of what tells
    the languages apart there.  Short texts on which languages are close so
    stay.  A label that was not learned contradicts nothing.  All stay if no
    language was learned."""
    model = language_id.prototypes(docs.where(~language_id.held_out()))
    if not model[0]:
        return docs
    def judged(d: DataFrame) -> DataFrame:
        found = d.select(_whole(d), language_id.compared(model).alias("found"))
        return found.select("row", "found.score", "found.own", "found.lead", "found.lang_pred", F.floor(F.log2(F.length("row.text"))).alias("about")).where("lang_pred != 'und'")

    # scored twice rather than written: the scores are cheaper than a copy of the texts
    q = F.percentile_approx("score", [0.25, 0.75], 10000)
    usual = judged(docs.where("lang is not null")).where("row.lang = lang_pred").groupBy("about").agg(q.alias("q"), F.percentile_approx("lead", 0.5, 10000).alias("usual_lead"))
    usual = usual.select("about", "usual_lead", (F.col("q")[0] - SPREADS * (F.col("q")[1] - F.col("q")[0])).alias("least"))
    # one row for each power of two of lengths
    known = judged(docs).join(F.broadcast(usual), "about", "left")
    wrong = F.col("own").isNotNull() & (F.col("score") - F.col("own") > LEAD * F.col("usual_lead"))
    return known.where(~F.coalesce(wrong | (F.col("score") < F.col("least")), F.lit(False))).select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group of equal or near texts;
    rows without an id are documents like others."""
    keyed = store.cut(docs.select(F.monotonically_increasing_id().alias("key"), _whole(docs)), "near-keyed")
    kept = near_dups.classes(keyed.select("key", "row.doc_id", "row.text"), key_col="key").where("kept").select("key")
    # shuffled at any size, as the ids kept grow with the documents; texts stream by unsorted
    return keyed.join(kept.hint("shuffle_hash"), "key", "left_semi").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: one row per slot and piece of a document, its text that piece."""
    drawn = mixing.Mix(docs, whole=True).texts()
    return drawn.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text."""
    return bpe.round_trip(docs, BYTE_BPE)


STAGES = [("language_id", language), ("near_dups", deduplicate), ("pii", personal_data), ("mixing", mix), ("bpe", tokens)]

#: SQL has no hyperdimensional profiles, signatures or byte pairs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
