"""Tables that a plan is cut at, in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset
on a single machine (tests) a temporary one is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def folder(spark: SparkSession) -> str:
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="leafwright-")
    return _own


def dealt(rows: DataFrame, each: int, *by: str) -> DataFrame:
    """``rows`` of a table that become much more, dealt to a task for each core
    and to more of them if these would hold more than ``each`` rows; rows with
    the same values of the columns ``by`` go to one task."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each)), *by)


def cut(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written and read again, divided by the values of a column if one
    is named: a filter on it then reads nothing else."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer if by is None else writer.partitionBy(by)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
