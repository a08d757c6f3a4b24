"""Page content as a stream: classify, append to the store, count by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafwright.operators.classify import classify

PAGES = "id long, file_name string, text string, at timestamp"


def pages(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """JSON files of pages as they arrive."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", per_trigger).json(folder)


def classified(arriving: DataFrame, late: str = "1 day") -> DataFrame:
    """Pages with their form type; one that comes again in ``late`` goes."""
    return classify(arriving.withWatermark("at", late).dropDuplicatesWithinWatermark(["file_name", "id"]))


def by_window(arriving: DataFrame, width: str = "1 hour", late: str = "1 day", at: str = "at", key: str = "form_type") -> DataFrame:
    """(start, key, n): rows per tumbling window; works on tables as well."""
    timed = arriving.withWatermark(at, late) if arriving.isStreaming else arriving
    return timed.groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(arriving: DataFrame, gap: str, key: str, late: str = "1 day", at: str = "at") -> DataFrame:
    """(key, start, n): rows in sessions that end after ``gap`` of silence."""
    timed = arriving.withWatermark(at, late) if arriving.isStreaming else arriving
    return timed.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a Parquet table, each row once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
