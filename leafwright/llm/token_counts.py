"""Token counts from flat, unindexed token files.

``write_flat`` lays the ids of all texts of an input partition end to end,
each text followed by the end-of-document id, and cuts the stream into blocks
of fixed length that know nothing of documents.  ``scan`` searches the blocks
for the end id, one vectorised comparison each, and stitches documents that
span blocks with a prefix scan over per-block summaries: how many separators a
block has, the ids before its first, and the ids after its last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwright.llm.fragments import shared_codec
from leafwright.llm.store import load, save
from leafwright.llm.textscan import blocks

#: Ids in a block of a flat file.
BLOCK_IDS = 1 << 16
#: payload: little-endian uint16 ids; docs: the ids of documents in stream order.
SCHEMA = "part int, seq int, payload binary, docs array<long>"


def write_flat(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write token files and, beside them, the order of the documents.

    The end id's string in a text is encoded as ordinary text, so that ids in
    a file equal to ``end_id`` are separators and nothing else.  Null and empty
    texts are a separator alone.
    """
    source = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(tokenizer, plain_specials=True)
        if end_id > 0xFFFF or max(codec.vocab.values()) > 0xFFFF:
            raise ValueError("flat files hold ids of 16 bits")
        rest, part, seq = np.zeros(0, np.uint16), 0, 0

        def row(stream, listed) -> pa.RecordBatch:
            nonlocal seq
            seq += 1
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((part, seq, stream, listed), kinds, strict=True)], ["part", "seq", "payload", "docs"])

        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
            for b in blocks(batch.column(2), 1 << 20):
                ids, starts = codec.encode(b)
                rest = np.concatenate([rest, np.insert(ids, starts[1:], end_id).astype(np.uint16)])
                whole = len(rest) // block_ids * block_ids
                for at in range(0, whole, block_ids):
                    yield row(rest[at : at + block_ids].astype("<u2").tobytes(), None)
                rest = rest[whole:]
                yield row(None, batch.column(1).slice(b.start, len(b)).to_pylist())
        if len(rest):
            yield row(rest.astype("<u2").tobytes(), None)

    return save(source.mapInArrow(run, SCHEMA), "flat")


def block_summaries(files: DataFrame, end_id: int) -> DataFrame:
    """Per block: its ids, separators, ids before the first (``head``) and
    after the last (``tail``), and the lengths in between (``gaps``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for payload in batch.column(2).to_pylist():
                ids = np.frombuffer(payload, "<u2")
                at = np.flatnonzero(ids == end_id)
                rows.append((len(ids), len(at), int(at[0]) if len(at) else len(ids), len(ids) - 1 - int(at[-1]) if len(at) else len(ids), np.diff(at) - 1 if len(at) else []))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                found = [pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], ["part", "seq", "n_ids", "n_sep", "head", "tail", "gaps"])

    return files.where("payload IS NOT NULL").select("part", "seq", "payload").mapInArrow(run, "part int, seq int, n_ids long, n_sep long, head long, tail long, gaps array<long>")


def scan(spark: SparkSession, path: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens): the ids of each document, separator not counted."""
    files = load(spark, path, SCHEMA)
    before = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    s = block_summaries(files, end_id)
    begun = F.coalesce(F.sum("n_ids").over(before), F.lit(0))
    s = s.withColumn("begun", begun).withColumn("ordinal", F.coalesce(F.sum("n_sep").over(before), F.lit(0)))
    # the stream position after the last separator seen so far
    s = s.withColumn("open", F.coalesce(F.max(F.when(F.col("n_sep") > 0, F.col("begun") + F.col("n_ids") - F.col("tail"))).over(before), F.lit(0)))
    ends = s.where("n_sep > 0").select(
        "part", "ordinal", "open",
        F.posexplode(F.concat(F.array(F.col("begun") + F.col("head") - F.col("open")), F.col("gaps"))).alias("k", "n_tokens"),
    )
    counted = ends.select("part", (F.col("ordinal") + F.col("k")).alias("ordinal"), "n_tokens")
    listed = files.where("docs IS NOT NULL").select("part", "seq", "docs")
    listed = listed.withColumn("ordinal", F.coalesce(F.sum(F.size("docs").cast("long")).over(before), F.lit(0)))
    named = listed.select("part", "ordinal", F.posexplode("docs").alias("k", "doc_id")).select("part", (F.col("ordinal") + F.col("k")).alias("ordinal"), "doc_id")
    return named.join(counted, ["part", "ordinal"]).select("doc_id", "n_tokens")
