"""Mixing sources to target weights.

1. Targets.  Sources in code-point order (null last) weigh 3, 1, 2, repeating,
   and share 150% of all words; a source's target stops at twice its size and
   the excess is shared again by weight (``targets``).
2. Blocks.  A source's documents stand end to end, in a fixed hashed order,
   and are cut into blocks of ``block_words`` words (``pieces``).
3. Draws.  The mix is a row of output shards of ``SHARD_SLOTS`` slots.  Each
   shard draws its source counts from a multinomial with the targets' shares;
   slots drawn beyond a source's quota go to the sources that were drawn too
   seldom, so that the mix as a whole meets the targets to a block (``slots``).
4. Slots to blocks.  The n-th slot of a source takes block P(n) of the n-th
   pass through the source, P a pseudorandom permutation of the pass; a block
   is so taken once more only after all others were (``slots``).
5. Slots and pieces are joined by (source, block).

Everything is seeded: reruns agree.  Null and empty texts take part with size
zero.  Rows that repeat stand one after the other in the stream and are
reported one by one.  What is collected is one row per source, and one word
count per source and hash group stays distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwright.llm.store import cut
from leafwright.llm.textscan import blocks, tidy, word_spans

BLOCK_WORDS, SHARD_SLOTS, GROUPS, SEED = 128, 8192, 1024, 97
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> list[float]:
    """The target of each source, in source order."""
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, free, rest = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        unit = rest / sum(weight[i] for i in free)
        full = {i for i in free if unit * weight[i] > most * sizes[i]}
        if not full:
            for i in free:
                out[i] = unit * weight[i]
            break
        for i in full:
            out[i] = most * sizes[i]
        free -= full
        rest -= sum(out[i] for i in full)
    return out


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """P(i) of a pseudorandom permutation of range(n), for each row.

    A four-round Feistel network over the next power of four; values beyond n
    are put through again until they fall inside.
    """
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = i.astype(np.uint64).copy(), np.ones(len(i), bool)
    while todo.any():
        a, b = x[todo] >> half[todo], x[todo] & mask[todo]
        for r in range(4):
            a, b = b, a ^ (_mix(b ^ key[todo] ^ np.uint64(r * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & mask[todo])
        x[todo] = a << half[todo] | b
        todo = x >= n.astype(np.uint64)
    return x.astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Mix:
    """The plan of a mix over ``docs`` (doc_id, text, source)."""

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole: bool = False):
        self.spark, self.block, self.seed = docs.sparkSession, block_words, seed
        self.columns, self.text_col, self.keyed = docs.schema, text_col, None
        of, key = F.col, []
        if whole:
            row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
            docs = self.keyed = cut(docs.select(F.monotonically_increasing_id().alias("key"), row), "mix-keyed")
            of, key = lambda c: F.col("row")[c], [F.col("key")]
        sized = docs.select(
            of(id_col).alias("doc_id"), of(source_col).cast("string").alias("source"), *key,
            F.coalesce(F.regexp_count(of(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(of(text_col)).alias("digest"),
        )
        self.docs = cut(sized.withColumn("grp", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(GROUPS)).cast("int")), "mix-docs")
        self.groups = self.docs.groupBy("source", "grp").agg(F.sum("size").alias("n"))
        found = self.groups.groupBy("source").agg(F.sum("n").alias("n")).collect()  # one row a source
        found.sort(key=lambda r: (r[0] is None, r[0] or ""))
        self.sources, self.sizes = [r[0] for r in found], [r[1] for r in found]
        self.targets = targets(self.sizes)
        self.n_blocks = [-(-s // block_words) for s in self.sizes]
        # whole blocks; the last block of a source is short, so it is the mean block that counts
        self.quota = [min(2 * b, round(t * b / s)) if s else 0 for t, b, s in zip(self.targets, self.n_blocks, self.sizes, strict=True)]
        self.source_rows = self.spark.createDataFrame(
            [(i, x, float(t), s) for i, (x, t, s) in enumerate(zip(self.sources, self.targets, self.sizes, strict=True))], "src int, source string, target double, source_size long"
        )

    def placed(self) -> DataFrame:
        """Each document with its source's number and its first word's place."""
        order = W.partitionBy("source").orderBy("grp").rowsBetween(W.unboundedPreceding, -1)
        before = self.groups.withColumn("grp_at", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
        inside = W.partitionBy("source", "grp").orderBy("doc_id", "digest", "size")
        own = self.docs.withColumn("nth", F.row_number().over(inside)).withColumn("own_at", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        same = own["source"].eqNullSafe(before["source"]) & (own["grp"] == before["grp"])
        d = own.join(before, same).select(own["*"], (F.col("own_at") + F.col("grp_at")).alias("at"))
        # one row a source, as collected for the targets
        return d.join(F.broadcast(self.source_rows), d["source"].eqNullSafe(self.source_rows["source"])).drop(self.source_rows["source"])

    def pieces(self) -> DataFrame:
        """The documents' parts by block: (..., block, first, n_words); a
        document without words has one row with a null block."""
        b = self.block
        last = F.greatest(F.col("at"), F.col("at") + F.col("size") - 1)
        d = self.placed().withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / b), F.floor(last / b))).otherwise(F.array(F.lit(None).cast("long")))))
        begin = F.greatest(F.col("at"), F.col("block") * b)
        return d.withColumn("first", begin - F.col("at")).withColumn("n_words", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b) - begin)

    def slots(self) -> DataFrame:
        """(shard, slot, src, pass, block): which block each slot takes."""
        total = sum(self.quota)
        n_shards, seed = -(-total // SHARD_SLOTS), self.seed
        share = np.array(self.quota, float) / max(total, 1)

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for shard in pdf["id"]:
                    n = min(SHARD_SLOTS, total - shard * SHARD_SLOTS)
                    counts = np.random.Generator(np.random.Philox(key=[seed, int(shard)])).multinomial(n, share)
                    used = np.flatnonzero(counts)
                    rows.append(pd.DataFrame({"shard": shard, "src": used, "n": counts[used], "slot_at": np.cumsum(counts[used]) - counts[used]}))
                if rows:
                    yield pd.concat(rows)

        drawn = self.spark.range(n_shards).mapInPandas(draw, "shard long, src int, n long, slot_at long")
        order = W.partitionBy("src").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
        drawn = cut(drawn.withColumn("nth_at", F.coalesce(F.sum("n").over(order), F.lit(0))), "mix-draws")
        got = dict(map(tuple, drawn.groupBy("src").agg(F.sum("n")).collect()))
        quota, blocks_of = np.array(self.quota, np.int64), np.array(self.n_blocks, np.int64)
        got = np.array([got.get(i, 0) for i in range(len(quota))], np.int64)
        over, short = np.maximum(got - quota, 0), np.maximum(quota - got, 0)
        over_at, short_at = np.cumsum(over) - over, np.cumsum(short)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                src, nth = pdf["src"].to_numpy(np.int64), pdf["nth"].to_numpy(np.int64)
                late = np.flatnonzero(nth >= quota[src])
                if len(late):
                    k = over_at[src[late]] + nth[late] - quota[src[late]]
                    to = np.searchsorted(short_at, k, side="right")
                    src, nth = src.copy(), nth.copy()
                    src[late], nth[late] = to, got[to] + k - (short_at - short)[to]
                n = blocks_of[src]
                turn = nth // n
                key = _mix((src * 4 + turn + (seed << 40)).astype(np.uint64))
                yield pd.DataFrame({"shard": pdf["shard"], "slot": pdf["slot"], "src": src, "pass": turn, "block": permuted(nth % n, n, key)})

        # a row of a shard becomes up to SHARD_SLOTS rows
        drawn = drawn.repartition("shard", "src")
        each = drawn.select("shard", "src", "slot_at", "nth_at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
        each = each.select("shard", (F.col("slot_at") + F.col("k")).alias("slot"), "src", (F.col("nth_at") + F.col("k")).alias("nth"))
        return each.mapInPandas(assign, "shard long, slot long, src int, pass long, block long")

    def joined(self) -> DataFrame:
        """The mix: one row per slot and piece of a document."""
        return self.slots().hint("merge").join(self.pieces(), ["src", "block"])

    def texts(self) -> DataFrame:
        """The mix with the columns of ``docs``: one row per slot and piece of
        a document, its text that piece.  Only for a plan made with ``whole``.

        Slots meet pieces by their numbers alone; each document then gets the
        list of its pieces, no longer than its text, and texts move once."""
        at = 1 + self.columns.fieldNames().index(self.text_col)
        # columns go by numbers, as the names of some can't be given to mapInArrow
        names = [f"c{i}" for i in range(len(self.columns))]
        kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, self.columns, strict=True))

        def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                picks = batch.column(0).to_pylist()
                for b in blocks(batch.column(at)):
                    starts, _, n = word_spans(b)
                    first, raw, doc, text = np.cumsum(n) - n, b.data.tobytes(), [], []
                    for i in range(len(b)):
                        for begin, length, times in picks[b.start + i]:
                            x = int(b.offsets[i]) if begin == 0 else int(starts[first[i] + begin])
                            y = int(b.offsets[i + 1]) if begin + length >= n[i] else int(starts[first[i] + begin + length])
                            doc += [b.start + i] * times
                            text += [raw[x:y].decode()] * times
                    own = pa.array(doc, pa.int64())
                    cols = [pa.array(text, pa.string()) if k == at else batch.column(k).take(own) for k in range(1, 1 + len(names))]
                    yield pa.RecordBatch.from_arrays(cols, names)

        times = self.slots().groupBy("src", "block").agg(F.count("*").alias("times"))
        taken = self.pieces().where("size > 0").select("key", "src", "block", "first", "n_words").join(times.hint("merge"), ["src", "block"])
        picks = taken.groupBy("key").agg(F.collect_list(F.array("first", "n_words", "times")).alias("_picks"))
        # picks are built into a table, and texts stream by unsorted
        return self.keyed.join(picks.hint("shuffle_hash"), "key").select("_picks", "row.*").toDF("picks", *names).mapInArrow(tidy(cut_up), kinds).toDF(*self.columns.fieldNames())

    def taken(self) -> DataFrame:
        """(doc_id, source, size, source_size, target, taken) of each document."""
        p = self.pieces()
        s = self.slots().groupBy("src", "block").agg(F.count("*").alias("times"))
        d = p.join(s.hint("merge"), ["src", "block"], "left")
        words = F.coalesce(F.sum(F.col("n_words") * F.col("times")), F.lit(0)).alias("taken")
        return d.groupBy("src", "grp", "nth").agg(*(F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")), words).drop("src", "grp", "nth")
