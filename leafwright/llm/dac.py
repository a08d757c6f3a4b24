"""Token ids as directly addressable codes.

An id is split into 8-bit chunks, least significant first.  Level k holds
chunk k of every id that has one, next to a bitmap that says whether the id
continues on level k + 1; a rank directory with the number of set bits before
every 512-bit stretch of the bitmap gives the id's place on the next level.
Any id can so be read by itself, without decoding a block.

A segment (the unit of the files) is the image

    magic "DAC1", n ids, n documents, n levels          4 x uint32
    document ids int64, null flags uint8, id starts uint32 (n documents + 1)
    per level: n chunks uint32, chunks, bitmap, rank directory uint32

and is stored as the binary column ``payload`` of a Parquet table, so that
Spark's committer makes the files whole on any store, whatever executor dies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm.fragments import shared_codec
from leafwright.llm.store import load, save
from leafwright.llm.textscan import blocks

MAGIC = int.from_bytes(b"DAC1", "little")
RANK_BITS = 512
#: Ids after which a segment is closed (a longer text gets its own).
SEGMENT_IDS = 1 << 18

SCHEMA = "part int, seq int, start_in_part long, n_docs long, n_tokens long, payload binary"


def pack(ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, starts: np.ndarray) -> bytes:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        heads = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        rank = np.zeros(len(heads) + 1, np.uint32)
        np.cumsum(heads, out=rank[1:])
        levels += [np.uint32(len(rest)).tobytes(), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), rank.tobytes()]
        rest = rest[more] >> 8
        if not len(rest):
            break
    head = np.array([MAGIC, len(ids), len(doc_ids), len(levels) // 4], np.uint32)
    return b"".join([head.tobytes(), doc_ids.astype(np.int64).tobytes(), nulls.astype(np.uint8).tobytes(), starts.astype(np.uint32).tobytes(), *levels])


class Segment:
    """A packed segment, read in place."""

    def __init__(self, payload: bytes):
        self.raw, self.at = memoryview(payload), 16
        magic, self.n, self.n_docs, n_levels = np.frombuffer(self.raw[:16], np.uint32).tolist()
        if magic != MAGIC:
            raise ValueError("not a DAC segment")
        self.doc_ids = self._take(np.int64, self.n_docs)
        self.nulls = self._take(np.uint8, self.n_docs).astype(bool)
        self.starts = self._take(np.uint32, self.n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(self._take(np.uint32, 1)[0])
            chunks, bits = self._take(np.uint8, n), self._take(np.uint8, -(-n // 8))
            self.levels.append((chunks, bits, self._take(np.uint32, -(-n // RANK_BITS) + 1)))

    def _take(self, kind, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * n
        self.at += size
        return np.frombuffer(self.raw[self.at - size : self.at], kind)

    def access(self, i: int) -> int:
        """The i-th id alone: one byte per level, and a rank to go on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, rank in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            inside = np.unpackbits(bits[block * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BITS]
            i, shift = int(rank[block]) + int(inside.sum()), shift + 8
        raise ValueError("a continuation bit on the last level")

    def ids(self) -> np.ndarray:
        """All ids at once."""
        out, at = np.zeros(self.n, np.uint32), None
        for k, (chunks, bits, _) in enumerate(self.levels):
            part = chunks.astype(np.uint32) << np.uint32(8 * k)
            if at is None:
                out |= part
            else:
                out[at] |= part
            more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            at = np.flatnonzero(more) if at is None else at[more]
        return out


def write(docs: DataFrame, tokenizer: str, end_id: int = 1, cut_at: str = "space", id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text, append ``end_id``, and write segments in ascending
    order of the id column (nulls first); returns the files' folder.

    A null or empty text holds the end id alone.  Rows with equal ids stay
    apart, in the order of their texts' hashes.
    """
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(tokenizer, cut_at)
        held: list[tuple] = []
        part, seq, begun = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, begun
            lengths = np.concatenate([h[3] for h in held])
            ids = np.concatenate([h[2] for h in held])
            payload = pack(ids, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([[0], np.cumsum(lengths)]))
            row = [[part], [seq], [begun], [len(lengths)], [len(ids)], [payload]]
            held.clear()
            seq, begun = seq + 1, begun + len(ids)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], _NAMES)

        size = 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
            for b in blocks(batch.column(2), 1 << 21):
                ids, starts = codec.encode(b)
                keys = batch.column(1).slice(b.start, len(b))
                nulls = keys.is_null().to_numpy(zero_copy_only=False)
                # the end id goes in after each text's own
                ids = np.insert(ids, starts[1:], end_id)
                held.append((keys.fill_null(0).to_numpy(zero_copy_only=False), nulls, ids, np.diff(starts) + 1))
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return save(ordered.mapInArrow(run, SCHEMA), "dac")


_NAMES = ["part", "seq", "start_in_part", "n_docs", "n_tokens", "payload"]


def segments(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, SCHEMA)


def offsets(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each part.  One number per write task reaches the driver."""
    totals = segments(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    out, at = {}, 0
    for part, n in sorted(map(tuple, totals)):
        out[part] = at
        at += n
    return out


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    before = offsets(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, begun, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                seg = Segment(payload)
                raw, at = memoryview(seg.ids().astype("<u4")).cast("B"), seg.starts.tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg.doc_ids, mask=seg.nulls), pa.array(seg.starts[:-1] + begun + before[part]), pa.array(np.diff(seg.starts)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments(spark, path).select("part", "start_in_part", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                seg = Segment(payload)
                lists = pa.ListArray.from_arrays(pa.array(seg.starts, pa.int32()), pa.array(seg.ids().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(seg.doc_ids, mask=seg.nulls), lists], ["doc_id", "ids"])

    return segments(spark, path).select("payload").mapInArrow(run, "doc_id long, ids array<int>")
