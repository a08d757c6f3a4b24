"""Queries over the driver's tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm import base_sql, bpe, dac, extraction, language_id, licenses, mixing, near_dups, pii, quality, spelling, token_counts, vectors, whitening

#: The vocabulary files of public tokenizers; all machines hold them.
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_counts.write_flat(documents(spark, sf_dir), BYTE_BPE, end_id=50256)
    return token_counts.scan(spark, path, end_id=50256)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(documents(spark, sf_dir)).taken()


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read_digest(spark, dac.write(documents(spark, sf_dir), WORD_BPE))


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.classes(documents(spark, sf_dir))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_dups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), BYTE_BPE)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


# What SQL can state of a contract, from the same operators.
def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def personal_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_pii(spark, sf_dir).drop("spans", "n_spans")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_quality(spark, sf_dir).drop("kept", "posterior")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def whitening_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_whitening(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_mixing": op2_mixing,
    "op3_licenses": op3_licenses,
    "op4_language_id": op4_language_id,
    "op5_pii": op5_pii,
    "op6_token_binary": op6_token_binary,
    "op7_near_dups": op7_near_dups,
    "op8_vectors": op8_vectors,
    "op9_bpe": op9_bpe,
    "op10_quality": op10_quality,
    "op11_html_extraction": op11_html_extraction,
    "op12_whitening": op12_whitening,
    "op13_spelling": op13_spelling,
    "licenses_base": licenses_base,
    "personal_base": personal_base,
    "quality_base": quality_base,
    "mix_targets": mix_targets,
    "whitening_base": whitening_base,
}

#: SQL has no signatures, profiles, byte pairs, votes, draws, element trees or eigenvectors.
ORACLE_SQL: dict[str, str] = {
    "op8_vectors": base_sql.VECTORS, "licenses_base": base_sql.LICENSES, "personal_base": base_sql.PERSONAL, "quality_base": base_sql.QUALITY, "mix_targets": base_sql.TARGETS,
    "op13_spelling": base_sql.SPELLING, "whitening_base": base_sql.DEVIATIONS,
}
