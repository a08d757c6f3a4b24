"""Accuracy of extracted fields against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_scores(predicted: Column, truth: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two arrays as sets; null counts as empty."""
    p, t = (F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))) for c in (predicted, truth))
    n_p, n_t, both = F.size(p), F.size(t), F.size(F.array_intersect(p, t))
    precision = F.when((n_p == 0) & (n_t == 0), 1.0).when(n_p == 0, 0.0).otherwise(both / n_p)
    recall = F.when(n_t == 0, 1.0).when(n_p == 0, 0.0).otherwise(both / n_t)
    f1 = F.when((n_p == 0) & (n_t == 0), 1.0).otherwise(F.coalesce(2 * both / F.nullif(n_p + n_t, F.lit(0)), F.lit(0.0)))
    return precision, recall, f1


def categorical_match(predicted: Column, truth: Column) -> Column:
    return F.lower(predicted).eqNullSafe(F.lower(truth))


def field_metrics(results: DataFrame) -> DataFrame:
    """Per field of (file, field, predicted, truth): counts and accuracy."""
    ok = categorical_match(F.col("predicted"), F.col("truth"))
    missing = F.col("predicted").isNull() & F.col("truth").isNotNull()
    g = results.groupBy("field").agg(F.count("*").alias("total"), F.count_if(ok).alias("correct"), F.count_if(missing).alias("missing"))
    return g.withColumn("wrong", F.col("total") - F.col("correct") - F.col("missing")).withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 4))


def worst_files(results: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` files of lowest accuracy, ties by name."""
    ok = categorical_match(F.col("predicted"), F.col("truth"))
    g = results.groupBy("file").agg(F.count("*").alias("fields"), F.count_if(ok).alias("correct"))
    return g.withColumn("accuracy", F.round(F.col("correct") / F.col("fields"), 4)).orderBy("accuracy", "file").limit(n)


def severity(total: Column) -> Column:
    """The depression scale's bands of a total of 0 to 27."""
    return F.when(total <= 4, "minimal").when(total <= 9, "mild").when(total <= 14, "moderate").when(total <= 19, "moderately severe").otherwise("severe")
