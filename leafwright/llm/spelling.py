"""Spelling variants by anagram hashing.

A letter's value is the fifth power of its code point, and a word's anagram key
the sum of its letters' values, as a 64-bit integer.  Keys of words one edit
apart differ by the value of the letter that was added or removed, or by the
difference of the values of the two letters that were exchanged.  All three are
equalities of keys after taking one letter's value away from the longer word,
or one from each (``_reduced``), so they are one grouping by integer keys.

A popular key has many anagrams, so the order of the letters is told with it: a
hash of the letters that remain, in order, stands beside the key, and the place
of the letter taken away beside that of an exchange.  So words are paired only
with those of which they have all other letters in the same order; of one place
there is at most one word a letter of the alphabet.  A pair's words are then
compared letter by letter.

A run of letters counts as a word, but for one run in ``NOISE`` by the checksum
of its document's id and itself, which loses the letter that the checksum tells.
A null id is an empty one in that checksum; null and empty texts have no runs;
repeated rows count each; an empty table and one whose words are all rare or
short give no rows; further columns are not read.  Texts and words of any
length are taken whole.  A word that is near several of equal number takes the
first in code-point order.  Forms have at least twice the number of their word,
so following them ends after as many steps as the largest number has bits.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.llm import store
from leafwright.llm.textscan import Block, blocks, spans_of, tidy

LEAST_LENGTH, LEAST_COUNT, NOISE, POWER = 5, 3, 97, 5
#: Bytes of texts that a worker counts at a time; a longer text is taken by itself.
SLICE_BYTES = 1 << 21
#: Bytes up to which the checksums of runs are taken side by side.
_SHORT = 64
_U = np.uint64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The crc32 of each run of bytes, carried on from the checksum of its lead."""
    order = np.argsort(starts - ends, kind="stable")  # longest first
    size, at, crc = (ends - starts)[order], starts[order], ~lead[order].astype(np.uint32)
    for k in range(min(int(size[0]) if len(size) else 0, _SHORT)):
        m = int(np.searchsorted(-size, -k))  # runs longer than k
        crc[:m] = _CRC[(crc[:m] ^ data[at[:m] + k]) & 0xFF] ^ (crc[:m] >> 8)
    crc = ~crc
    for i in range(int(np.searchsorted(-size, -_SHORT))):
        crc[i] = zlib.crc32(data[at[i] + _SHORT : at[i] + size[i]].tobytes(), int(crc[i]))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs as one array of strings."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)])
    own = data[np.repeat(starts - at[:-1], size) + np.arange(at[-1])]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(own)])


def words_of(b: Block, ids: list[str], least: int = LEAST_LENGTH, noise: int = NOISE) -> tuple[pa.Array, np.ndarray]:
    """The words of a block's texts and how often each stands there; ``ids`` in text order."""
    low = np.where((b.data >= 65) & (b.data <= 90), b.data | 0x20, b.data)
    # the letters U+00C0 to U+00FF are two bytes each, of which the first is C3
    wide = low == 0xC3
    inside = (low >= 97) & (low <= 122) | wide
    inside[1:] |= wide[:-1]
    starts, ends, n = spans_of(b, inside) if len(low) else (np.zeros(0, np.int64),) * 2 + (np.zeros(len(b), np.int64),)
    doc = np.repeat(np.arange(len(b)), n)
    wides = np.concatenate([[0], np.cumsum(wide)])
    length = ends - starts - (wides[ends] - wides[starts])
    long = length >= least  # shorter ones can't become words
    starts, ends, doc, length = starts[long], ends[long], doc[long], length[long]
    lead = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    crc = checksums(low, starts, ends, lead[doc])
    hit = crc % noise == 0
    counted = _joined(low, starts[~hit], ends[~hit]).value_counts()
    more: Counter[str] = Counter()
    for s, e, k, size in zip(starts[hit].tolist(), ends[hit].tolist(), crc[hit].tolist(), length[hit].tolist(), strict=True):
        if size > least:
            run = low[s:e].tobytes().decode()
            more[run[: k % size] + run[k % size + 1 :]] += 1
    words = counted.field(0).cast(pa.large_string()).cast(pa.string())
    return pa.concat_arrays([words, pa.array(list(more), pa.string())]), np.concatenate([counted.field(1).to_numpy(), np.fromiter(more.values(), np.int64, len(more))])


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for b in blocks(batch.column(1), SLICE_BYTES):
                words, n = words_of(b, ids[b.start : b.stop])
                yield pa.RecordBatch.from_arrays([words, pa.array(n)], ["word", "n"])

    d = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    return d.mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_STEP = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _reduced(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word, key, order and place of each word as it stands (place -1), and
    without each of its letters.  The order is a polynomial of the letters that
    remain; keys and orders wrap around."""
    points = np.frombuffer(b.data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(_U)
    at = np.concatenate([[0], np.cumsum((b.data & 0xC0) != 0x80)])[b.offsets]
    n = np.diff(at)
    word = np.repeat(np.arange(len(b)), n)
    place = np.arange(len(points)) - at[word]
    value = points**_U(POWER)
    powers = np.ones(int(n.max(initial=0)) + 1, _U)
    powers[1:] = np.multiply.accumulate(np.full(len(powers) - 1, _STEP))
    total = np.concatenate([np.zeros(1, _U), np.cumsum(value)])
    hashed = np.concatenate([np.zeros(1, _U), np.cumsum(_mixed(points + _U(1)) * powers[place])])
    key, order = total[at[1:]] - total[at[:-1]], hashed[at[1:]] - hashed[at[:-1]]
    i = np.arange(len(points))
    left, right = hashed[i] - hashed[at[word]], hashed[at[word + 1]] - hashed[i + 1]
    return (
        np.concatenate([np.arange(len(b)), word]), np.concatenate([key, key[word] - value]),
        np.concatenate([order, left + right * _BACK]), np.concatenate([np.full(len(b), -1), place]),
    )


def _keyed(words: DataFrame) -> DataFrame:
    """(wid, key, order, place) of each word with and without each letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1), SLICE_BYTES >> 3):
                word, key, order, place = _reduced(b)
                wid = batch.column(0).slice(b.start, len(b)).take(pa.array(word))
                yield pa.RecordBatch.from_arrays([wid, pa.array(key.view(np.int64)), pa.array(order.view(np.int64)), pa.array(place, pa.int32())], ["wid", "key", "order", "place"])

    return words.select("wid", "word").mapInArrow(tidy(run), "wid long, key long, order long, place int")


#: Of the words of one key and order by place: the whole word (place -1) with all others, and those of one place with each other.
_PAIRS = """flatten(array(
    flatten(transform(filter(at, x -> x.place < 0), x -> transform(array_except(flatten(transform(at, y -> y.of)), x.of), w -> struct(x.of[0] as a, w as b)))),
    flatten(transform(filter(at, x -> x.place >= 0 and size(x.of) > 1), x -> flatten(transform(x.of, (v, i) -> transform(slice(x.of, i + 2, size(x.of)), w -> struct(v as a, w as b))))))
))"""


def neighbours(words: DataFrame, tables: store.Tables) -> DataFrame:
    """(a, b): the numbers of words (wid, word, n) that are one edit apart, each pair once."""
    # dealt by key and order for both groupings
    dealt = _keyed(words).repartition("key", "order")
    by_place = dealt.groupBy("key", "order", "place").agg(F.sort_array(F.collect_list("wid")).alias("of"))
    by_key = by_place.groupBy("key", "order").agg(F.collect_list(F.struct("place", "of")).alias("at"))
    pairs = by_key.where("size(at) > 1 or size(at[0].of) > 1").select(F.explode(F.expr(_PAIRS)).alias("p")).select("p.*")
    return tables.cut(pairs, "spelling-pairs")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word that stands at least
    ``least_count`` times: its near word of largest number if that is at least
    twice its own, and the last form reached from it."""
    tables = store.Tables(docs.sparkSession)
    words = tables.cut(tables.cut(counts(docs, id_col, text_col, least_count), "spelling-counts").select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "spelling-words")
    pairs = neighbours(words, tables)
    for side in "ab":
        pairs = pairs.join(words.select(F.col("wid").alias(side), F.struct("wid", "word", "n").alias(f"of_{side}")), side)
    pairs = pairs.where(F.levenshtein("of_a.word", "of_b.word", 1) == 1)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("wid"), F.col("of_b").alias("near")), F.struct(F.col("b").alias("wid"), F.col("of_a").alias("near")))).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("near.n")).alias("less"), F.col("near.word").alias("word"), F.col("near.wid").alias("wid"))).alias("best")
    near = both.groupBy("wid").agg(F.count("*").alias("n_near"), best)
    has = F.coalesce(-F.col("best.less") >= 2 * F.col("n"), F.lit(False))
    told = words.join(near, "wid", "left").select(
        "wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"), F.when(has, F.col("best.wid")).alias("to")
    )
    told = tables.cut(told, "spelling-forms")
    last = _followed(told.where("to is not null").select("wid", "to"), tables)
    named = words.select(F.col("wid").alias("to"), F.col("word").alias("root"))
    out = told.drop("to").join(last, "wid", "left").join(named, "to", "left")
    return tables.finish(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "spelling")


def _followed(steps: DataFrame, tables: store.Tables) -> DataFrame:
    """(wid, to) with each ``to`` the last that steps lead to, by doubling them."""
    now = tables.cut(steps, "spelling-steps")
    while True:
        on = now.select(F.col("wid").alias("to"), F.col("to").alias("next"))
        now = tables.cut(now.join(on, "to", "left").select("wid", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "spelling-steps")
        if now.where("moved").isEmpty():
            return now.select("wid", "to")
        now = now.select("wid", "to")
