"""Comparators of extracted values with the truth, and reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.operators.metrics import categorical_match, set_scores


def boolean_match(predicted: Column, truth: Column) -> Column:
    return F.coalesce(predicted == F.coalesce(truth, F.lit(False)), F.lit(False))


def numeric_match(predicted: Column, truth: Column, tolerance: float = 0.01) -> Column:
    both = predicted.isNull() & truth.isNull()
    return both | F.coalesce(F.abs(predicted - truth) < tolerance, F.lit(False))


def tolerant_match(predicted: Column, truth: Column, relative: float = 0.15) -> Column:
    near = F.when(truth == 0, F.abs(predicted) < 1).otherwise(F.abs(predicted - truth) < relative * F.abs(truth))
    return (predicted.isNull() & truth.isNull()) | F.coalesce(near, F.lit(False))


def set_match(predicted: Column, truth: Column, least: float = 1.0) -> Column:
    return set_scores(predicted, truth)[2] >= least


def sequence_match(predicted: Column, truth: Column, least: float | None = None) -> Column:
    """Equal arrays; with ``least``, that share of equal places."""
    if least is None:
        return predicted.eqNullSafe(truth)
    same = F.size(F.filter(F.zip_with(predicted, truth, lambda a, b: a == b), lambda s: F.coalesce(s, F.lit(False))))
    longest = F.greatest(F.size(predicted), F.size(truth))
    return F.coalesce(F.when(longest == 0, True).otherwise(same / longest >= least), predicted.isNull() & truth.isNull())


def summary(results: DataFrame) -> DataFrame:
    """One row over (file, field, predicted, truth): files, fields, accuracy,
    miss rate and files with an error."""
    ok = categorical_match(F.col("predicted"), F.col("truth"))
    missing = F.col("predicted").isNull() & F.col("truth").isNotNull()
    by_file = results.groupBy("file").agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.count_if(missing).alias("missing"))
    rate = lambda c: F.coalesce(F.round(F.sum(c) / F.nullif(F.sum("n"), F.lit(0)), 4), F.lit(0.0))
    return by_file.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("fields"), rate("ok").alias("accuracy"), rate("missing").alias("miss_rate"), F.count_if(F.col("ok") < F.col("n")).alias("files_with_errors"))


def against_baseline(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(field, accuracy, before, change): a field the baseline lacks had 0."""
    before = baseline.select("field", F.col("accuracy").alias("before"))
    d = current.select("field", "accuracy").join(before, "field", "left").withColumn("before", F.coalesce("before", F.lit(0.0)))
    return d.withColumn("change", F.round(F.col("accuracy") - F.col("before"), 4))


def flags(values: dict[str, Column], confidence: dict[str, Column], least: float) -> Column:
    """"ambiguous:<k>" for each null value, then "low_conf:<k,...>" for those
    with a confidence above 0 and below ``least``; joined by semicolons."""
    ambiguous = [F.when(v.isNull(), F.lit(f"ambiguous:{k}")) for k, v in values.items()]
    low = F.array_compact(F.array(*(F.when((c > 0) & (c < least), F.lit(k)) for k, c in confidence.items())))
    return F.concat_ws(";", *ambiguous, F.when(F.size(low) > 0, F.concat(F.lit("low_conf:"), F.array_join(low, ","))))
