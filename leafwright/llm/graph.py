"""Connected components of a distributed edge list.

Alternating large-star and small-star steps: every node passes its smallest
neighbour on to the others, so an edge list never grows and each step is two
shuffles of edges.  Hubs are met by partial aggregation and by joins that
adaptive execution splits.  Every step is a table in the shared folder, so a
lost executor repeats one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.llm import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b), a > b."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        kept = edges.join(least, "a")
        out = kept.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has
    an edge (a, b) and is not itself the smallest of its component.

    Edges of a node with itself, null ends and repeated edges do nothing.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b and a is not null and b is not null").distinct()
    path, schema = store.save(e, "edges"), e.schema
    before = None
    while True:
        now = store.load(spark, path, schema)
        step = store.load(spark, store.save(_star(now, True), "edges"), schema)
        after_path = store.save(_star(step, False), "edges")
        after = store.load(spark, after_path, schema).agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum("b")).first()
        store.drop(spark, path)
        path = after_path
        if after == before:
            return store.load(spark, path, schema).select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after
