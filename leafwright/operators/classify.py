"""Form types of pages by signature phrases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Priority and phrases of each form type.
SIGNATURES = {
    "cms1500": (100, ("health insurance claim form", "approved by national uniform claim committee", "nucc", "1a. insured")),
    "phq9": (90, ("phq-9", "phq 9", "patient health questionnaire", "little interest or pleasure")),
    "hipaa": (85, ("authorization for release of protected health", "hipaa authorization", "specially protected information", "do not release")),
    "froi": (80, ("first report of injury", "workers' compensation", "workers compensation", "employer's first report", "body parts injured", "workers' comp claim", "workers compensation claim", "work-related injury")),
    "eob": (75, ("explanation of benefits", "this is not a bill", "plan paid", "claim detail")),
    "medical": (60, ("patient intake form", "medical intake", "new patient information", "current symptoms", "allergies (check all", "allergies", "symptoms", "smoker", "diabetic")),
    "insurance": (50, ("insurance claim form", "health insurance claim", "claim submission", "claim type", "is this work-related", "auto accident", "policy holder", "services rendered")),
}


def _best(low: Column) -> Column:
    scored = []
    for kind, (priority, phrases) in SIGNATURES.items():
        hits = reduce(lambda a, b: a + b, (F.contains(low, F.lit(p)).cast("int") for p in phrases))
        scored.append(F.when(hits > 0, F.struct((0.7 + 0.3 * hits / len(phrases)).alias("conf"), F.lit(priority).alias("priority"), F.lit(kind).alias("kind"))))
    return F.array_max(F.array_compact(F.array(*scored)))


def classify(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """``pages`` with form_type and confidence: the type with the largest share
    of its phrases, then the highest priority; "unknown" (0) without any."""
    low = F.translate(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "‘’“”", "''\"\"")
    # never copied into the tests of phrases, as it depends on the partition in form
    best = pages.withColumn("_low", F.when(F.spark_partition_id() >= 0, low)).withColumn("_best", _best(F.col("_low"))).drop("_low")
    out = best.withColumn("form_type", F.coalesce("_best.kind", F.lit("unknown")))
    return out.withColumn("confidence", F.coalesce(F.bround("_best.conf", 3), F.lit(0.0))).drop("_best")
