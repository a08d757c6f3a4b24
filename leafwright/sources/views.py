"""The document model's tables as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A page of each kind, by order number.
PAGES = (
    "HEALTH INSURANCE CLAIM FORM approved by NUCC 1a. Insured", "Patient Health Questionnaire PHQ-9", "HIPAA Authorization - do not release", "First report of injury: body parts injured",
    "Explanation of Benefits. This is not a bill. Plan paid", "Patient intake form: allergies, symptoms, smoker", "Insurance claim form, claim type, auto accident", "Shipping note", "HEALTH INSURANCE CLAIM FORM",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): a page per order."""
    text = F.element_at(F.array(*map(F.lit, PAGES)), (F.col("o_orderkey") % len(PAGES) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, file_name, form_type, confidence, extracted_at, processing_time_ms)."""
    kinds = F.array(*(F.lit(f"form{i}") for i in range(8)))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("doc_"), F.col("o_orderkey"), F.lit(".pdf")).alias("file_name"), F.element_at(kinds, (F.col("o_orderkey") % 8 + 1).cast("int")).alias("form_type"),
        ((F.col("o_orderkey") % 40 + 60) / 100).alias("confidence"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("extracted_at"), (F.col("o_orderkey") % 1000 + 0.25).cast("double").alias("processing_time_ms"),
    )


def service_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("line_number"), (F.col("l_partkey") + 10000).cast("string").alias("cpt_code"),
        F.date_format("l_shipdate", "MM/dd/yyyy").alias("date_of_service"), F.col("l_extendedprice").alias("charge"), F.col("l_quantity").cast("int").alias("units"),
    )


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTVWXYZ"), (F.col("l_partkey") % 25 + 1).cast("int"), F.lit(1))
    code = F.concat(letter, F.lpad((F.col("l_partkey") % 90 + 10).cast("string"), 2, "0"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), code.alias("icd10_code"), F.col("l_linenumber").alias("position"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("document_id"), F.lit("patient_name").alias("field_name"), F.col("c_name").alias("field_value"))


def form_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): a form's lines as one text."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    parts = [
        F.concat(F.lit("Patient Name: Person "), k), F.concat(F.lit("Date of Service: "), F.date_format("o_orderdate", "MM/dd/yyyy")), F.concat(F.lit("NPI: "), F.lpad(k, 10, "0")),
        F.concat(F.lit("Total: $"), (F.col("o_orderkey") % 900 + 100).cast("string"), F.lit(".50 of $20.00")), F.concat(F.lit("SSN 123-45-"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")),
        F.concat(F.lit("Dx M"), (F.col("o_orderkey") % 90 + 10).cast("string"), F.lit(".2 and S13.4")), F.element_at(F.array(*map(F.lit, ("progress note", "MRI of knee", "plain", "surgery"))), (F.col("o_orderkey") % 4 + 1).cast("int")),
    ]
    return o.select(F.col("o_orderkey").alias("id"), F.concat_ws("\n", *parts).alias("text"))


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bundle, page, provider, dos, type, doc_type, is_separator, is_cover, tokens): a page per event."""
    kind, k = F.col("event_type"), F.col("event_id")
    types = F.element_at(F.array(*map(F.lit, ("Clinical Note", "Lab Result", "Clinical Note", "Imaging Report", "Clinical Note", "Clinical Note", "ER Report"))), (k % 7 + 1).cast("int"))
    word = lambda letter, n: F.concat(F.lit(letter), (k % n).cast("string"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("bundle"), k.alias("page"), F.when(kind == "click", "A").when(kind == "purchase", "B").when(kind == "signup", "C").when((kind == "error") & (k % 3 == 0), "B").alias("provider"),
        F.when(k % 3 != 0, F.date_format("ts", "MM/dd/yyyy")).alias("dos"), F.when(kind == "view", None).otherwise(kind).alias("type"), F.when(kind != "error", types).alias("doc_type"),
        (kind == "error").alias("is_separator"), ((kind == "error") & (k % 2 == 0)).alias("is_cover"), F.array(word("w", 3), word("x", 2), word("y", 5), word("z", 7)).alias("tokens"),
    )


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.floor(k / 20).alias("page"), k.alias("ctrl"), (k * 7 % 300).alias("x"), (k * 7 % 300 + 10).alias("edge"), (k * 13 % 200).alias("y"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.floor(k / 20).alias("page"), k.alias("line"), (k * 11 % 320).alias("lx"), (k * 11 % 320 + 25).alias("lcx"), (k * 11 % 320 + 50).alias("right"), (k * 17 % 200).alias("ly"), F.col("p_name").alias("text"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.floor(k / 20).alias("page"), k.alias("box"), (k * 7 % 60).alias("x"), (k * 13 % 60).alias("y"), (k % 9 + 20).alias("w"), (k % 7 + 20).alias("h"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, field, predicted, truth) of labelled documents."""
    d, x = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    guess = F.when(F.col("doc_id") % 7 == 0, None).otherwise((F.col("n_chars") > 400).cast("int").cast("string"))
    return x.join(d, "doc_id").select(F.concat(F.lit("f"), F.floor(F.col("doc_id") / 50)).alias("file"), F.col("source").alias("field"), guess.alias("predicted"), F.col("quality").cast("string").alias("truth"))
