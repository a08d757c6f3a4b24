"""Searches and summaries over the document store's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_child(documents: DataFrame, child: DataFrame, column: str, value: str) -> DataFrame:
    """Documents joined with their rows of ``child`` that have the value."""
    return child.where(F.col(column) == value).join(documents, child["document_id"] == documents["id"])


def search_field(documents: DataFrame, fields: DataFrame, name: str, like: str | None = None) -> DataFrame:
    """Fields of one name whose value holds ``like``, in any case."""
    named = fields.where(F.col("field_name") == name)
    return (named if like is None else named.where(F.col("field_value").ilike(f"%{like}%"))).join(documents, F.col("document_id") == documents["id"])


def breakdown(documents: DataFrame) -> DataFrame:
    """Documents, mean confidence (in percent) and mean time per form type."""
    mean = F.round(F.avg(F.col("confidence").cast("decimal(18,4)")) * 100, 2).cast("double")
    ms = F.round(F.avg(F.col("processing_time_ms").cast("decimal(18,4)"))).cast("double")
    return documents.groupBy("form_type").agg(F.count("*").alias("documents"), mean.alias("confidence_pct"), ms.alias("mean_ms"))


def stats(documents: DataFrame, service_lines: DataFrame, diagnoses: DataFrame, index: DataFrame) -> DataFrame:
    """One row of totals, with the documents of each type, the most first."""
    kinds = documents.groupBy("form_type").agg(F.count("*").alias("n"))
    each = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "form_type", "n")))
    # a few form types; each side is one row
    d = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.count("*").alias("form_types"), F.transform(each, lambda s: F.struct(s["form_type"].alias("form_type"), s["n"].alias("n"))).alias("by_type"))
    s, i = service_lines.agg(F.count("*").alias("service_lines")), index.agg(F.count("*").alias("index_entries"))
    return d.crossJoin(s).crossJoin(i).crossJoin(diagnoses.agg(F.countDistinct("icd10_code").alias("codes")))


#: Keys of a record that are no fields.
NO_FIELDS = ("form_type", "extraction_mode", "stats", "enriched_via_generic", "service_lines", "diagnoses", "marks_detected", "overlays_detected")


def _kind(type_name: str) -> str:
    if type_name.startswith(("array", "struct", "map", "variant")):
        return "json"
    if type_name == "boolean":
        return "boolean"
    return "numeric" if type_name.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")) else "text"


def shred(documents: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(document_id, field_name, field_value, field_type), one row per named
    field, or per column but the id and those of ``NO_FIELDS``.  A null field
    has a null value and is text, as its type can't be told from it; nested
    values are JSON."""
    kinds = dict(documents.dtypes)
    names = [c for c in documents.columns if c != "id" and c not in NO_FIELDS] if names is None else names

    def value(n: str) -> Column:
        kind = _kind(kinds[n])
        shown = F.to_json(n) if kind == "json" else F.initcap(F.col(n).cast("string")) if kind == "boolean" else F.col(n).cast("string")
        return F.struct(F.lit(n).alias("field_name"), shown.alias("field_value"), F.when(F.col(n).isNull(), "text").otherwise(kind).alias("field_type"))

    return documents.select(F.col("id").alias("document_id"), F.explode(F.array(*map(value, names))).alias("f")).select("document_id", "f.*")


def lenient_number(text: Column) -> Column:
    """The number that a text begins with, 0 where it begins with none."""
    return F.when(text.isNotNull(), F.coalesce(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0)))


def listed(documents: DataFrame, form_type: str | None = None) -> DataFrame:
    """All documents, or those of one type, the latest first; an empty type is none."""
    return (documents.where(F.col("form_type") == form_type) if form_type else documents).orderBy(F.desc("extracted_at"))


def by_ids(documents: DataFrame, ids: list[int]) -> DataFrame:
    return documents.where(F.col("id").isin(ids))


#: Bits of registers of a sketch of distinct values, and size of one of quantiles: errors of some 1.6% and 1.7% of ranks.
DISTINCT_BITS, QUANTILE_SIZE = 12, 200


def daily_sketches(documents: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """(day, form_type, n, codes, confidences) of documents (id, form_type,
    confidence, extracted_at): their number, a sketch of their distinct
    diagnosis codes and one of their confidences' quantiles.  A day's rows are
    made once; those of any days and types merge without their documents."""
    day = F.substring("extracted_at", 1, 10).alias("day")
    d = documents.groupBy(day, "form_type").agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col("confidence").cast("double"), F.lit(QUANTILE_SIZE)).alias("confidences"))
    coded = diagnoses.join(documents.select("id", "form_type", day), F.col("document_id") == F.col("id"))
    c = coded.groupBy("day", "form_type").agg(F.hll_sketch_agg("icd10_code", F.lit(DISTINCT_BITS)).alias("codes"))
    return d.join(c, ["day", "form_type"], "left").select("day", "form_type", "n", "codes", "confidences")


def from_sketches(daily: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(form_type, n, codes, quantiles) of each type, and of all (null), from sketches by day."""
    g = daily.rollup("form_type").agg(F.sum("n").alias("n"), F.hll_union_agg("codes").alias("c"), F.kll_merge_agg_double("confidences").alias("q"))
    return g.select("form_type", "n", F.coalesce(F.hll_sketch_estimate("c"), F.lit(0)).alias("codes"), F.array(*(F.kll_sketch_get_quantile_double("q", F.lit(s)) for s in shares)).alias("quantiles"))


def exact_totals(documents: DataFrame, diagnoses: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """What ``from_sketches`` estimates, from all documents and codes."""
    d = documents.rollup("form_type").agg(F.count("*").alias("n"), F.percentile("confidence", F.array(*map(F.lit, shares))).alias("quantiles"))
    c = diagnoses.join(documents.select("id", "form_type"), F.col("document_id") == F.col("id")).rollup("form_type").agg(F.countDistinct("icd10_code").alias("codes"))
    c = c.withColumnRenamed("form_type", "of")
    return d.join(c, F.col("form_type").eqNullSafe(F.col("of")), "left").select("form_type", "n", F.coalesce("codes", F.lit(0)).alias("codes"), "quantiles")
