"""Tables in the folder that all executors share.

A table written there survives the loss of any executor, and cuts the lineage
of what is read back.  The folder is the session's ``spark.checkpoint.dir``;
only where that is unset (tests, a single machine) a temporary one is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    global _own
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="leafwright-")
    return _own


def save(df: DataFrame, name: str, codec: str = "zstd") -> str:
    """Write ``df`` as Parquet to a new folder and return its path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return path


def load(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    return load(df.sparkSession, save(df, name), df.schema)


class Tables:
    """The intermediate tables of one call, removed when it is finished."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(save(df, name))
        return load(self.spark, self.paths[-1], df.schema)

    def forget(self, name: str) -> None:
        """Remove the tables of a name, once no table will be made of them any more."""
        gone = [p for p in self.paths if p.rsplit("/", 1)[-1].rsplit("-", 1)[0] == name]
        drop(self.spark, *gone)
        self.paths = [p for p in self.paths if p not in gone]

    def finish(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read again, with all tables before it removed."""
        out = cut(df, name)
        drop(self.spark, *self.paths)
        return out


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables that no DataFrame reads any more."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
