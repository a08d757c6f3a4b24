"""Near-duplicate documents by DartMinHash signatures and banded joining.

A text is the set of its five-word shingles; each weighs 1 however often it
stands, as in the check of a pair.  Every shingle's weight axis is cut into regions [0, 1),
[1, 2), [2, 4) and so on; in each, darts fall in order of rank at the region's
width as rate, seeded by shingle and region alone.  A text keeps the darts
below its shingles' weights and its rank limit, throws each into one of
``SIZE`` coordinates by hash, and the earliest dart of a coordinate is its
entry; a text with an empty coordinate doubles its limit.  Two texts agree in
a coordinate with the probability of their Jaccard similarity.

Equal texts are one from the start: they are told by their digest, and only
digests, signatures and hashes are shuffled, never a text.  Bands of ``ROWS``
entries are counted; a band value of one text says nothing.  Of a value of at
most ``FEW`` texts all pairs are checked by the Jaccard similarity of their
sets of shingles.  Texts of a more common value are sorted by a second band,
and each meets the text before it and the first one; then all texts of that
value that are not yet in one group are compared, block against block
(``_rest``), so that every pair that shares a band value is in one group or
was checked.

A text of one to four words is one shingle.  A null text or one without a word
is alike to none.  Rows are told apart by a key of their own: a null id and
repeated ids do no harm, equal rows are of one class, and of each class one row
is kept.  An empty table gives no rows; further columns are not read.  A text
of any length is described by itself.  What is collected is a few counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.llm import store
from leafwright.llm.graph import components
from leafwright.llm.textscan import Block, blocks, one_thread, strings, tidy, word_spans

WORDS, SIMILARITY, SIZE, ROWS = 5, 0.8, 80, 4
#: Bytes of texts that a worker describes at a time; each needs some hundred times as much.
SLICE_BYTES = 1 << 18
#: Texts of a band value that are met pair by pair; of more, blocks of so many are met, by so many shingles at a time.
FEW, BLOCK, COLUMNS = 8, 256, 4096
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(b: Block, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each place of a shingle, in text order."""
    from hashlib import blake2b

    starts, ends, n = word_spans(b)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    pieces = strings(b.data, np.stack([starts, ends], 1).ravel()).dictionary_encode()
    table = np.frombuffer(b"".join(blake2b(x, digest_size=8).digest() for x in pieces.dictionary.to_pylist()), _U)
    word = table[pieces.indices.to_numpy(zero_copy_only=False)[::2]]
    doc = np.repeat(np.arange(len(b)), n)
    first = np.cumsum(n) - n
    whole = np.flatnonzero(np.arange(len(word)) - first[doc] <= np.maximum(n[doc] - words, 0))
    code = np.zeros(len(whole), _U)
    for k in range(words):
        at = whole + k
        inside = at < (first + n)[doc[whole]]
        code = mix(code * _U(3) + np.where(inside, word[np.minimum(at, len(word) - 1)], _U(k)) + _U(k))
    return doc[whole], code


def signatures(doc: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """The n signatures of weighted elements (text, element, weight), one row
    each; texts are ascending and each has an element."""
    out = np.zeros((n, size), _U)
    limit = (size * np.log(size) + 2 * size) / np.bincount(doc, weight, n)
    todo = np.ones(n, bool)
    while todo.any():
        own = todo[doc]
        darts = _throw(doc[own], code[own], weight[own], limit)
        d, rank, dart = (np.concatenate(x) for x in zip(*darts, strict=True))
        slot = d * size + (mix(dart + _U(1)) % _U(size)).astype(np.int64)
        late = np.argsort(rank)[::-1]
        seen = np.zeros(n * size, bool)
        seen[slot] = True
        # of equal indices the last is written, which is the earliest dart
        out.reshape(-1)[slot[late]] = dart[late]
        todo &= ~seen.reshape(n, size).all(1)
        limit *= 2
    return out


def _throw(doc: np.ndarray, code: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, rank and hash of all darts below the weights and limits."""
    low, width, region = 0.0, 1.0, 0
    while len(doc):
        live, rank, j = np.arange(len(doc)), np.zeros(len(doc)), 0
        while len(live):
            dart = mix(code[live] ^ mix(np.full(len(live), (region << 40) + j + 1, _U)))
            rank = rank - np.log(((dart >> _U(11)).astype(float) + 0.5) / 2**53) / width
            below = rank < limit[doc[live]]
            live, rank, dart, j = live[below], rank[below], dart[below], j + 1
            height = low + width * (mix(dart ^ _U(0x5851F42D4C957F2D)) >> _U(11)).astype(float) / 2**53
            hit = height < weight[live]
            yield doc[live[hit]], rank[hit], dart[hit]
        low, width, region = low + width, max(low + width, 1.0), region + 1
        more = weight > low
        doc, code, weight = doc[more], code[more], weight[more]


def _described(batches: Iterator[pa.RecordBatch], words: int, size: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Adds shingles and band values, both empty without a word, in the place of the text."""
    for batch in batches:
        for b in blocks(batch.column(3), SLICE_BYTES):
            doc, code = shingles(b, words)
            order = np.lexsort((code, doc))
            doc, code = doc[order], code[order]
            first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1]))) if len(doc) else order
            doc, code = doc[first], code[first]
            has, own = np.unique(doc, return_inverse=True)
            key = np.zeros((len(has), size // rows), _U)
            if len(has):
                sig = signatures(own, code, np.ones(len(code)), len(has), size)
                for k in range(rows):
                    key = mix(key * _U(5) + sig[:, k::rows][:, : size // rows])
                key = mix(key + np.arange(size // rows, dtype=_U)[None])
            at = np.searchsorted(doc, np.arange(len(b) + 1))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(code.view(np.int64)))
            at = np.searchsorted(has, np.arange(len(b) + 1)) * (size // rows)
            keys = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(key.ravel().view(np.int64)))
            kept = [batch.column(i).slice(b.start, len(b)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*kept, lists, keys], ["row", "doc_id", "digest", "shingles", "bands"])


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of a sorted run of (key, side, node): each with the one before and
    the first of its key.  The first and last texts of a partition's first and
    last keys are given with that key, to be met across partitions."""
    key = hub = last = None
    edge: list[tuple[int, int]] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k, t = pdf["key"].to_numpy(), pdf["node"].to_numpy()
        new = np.append(key is None or k[0] != key, k[1:] != k[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        hubs = np.where(start >= 0, t[start], 0 if hub is None else hub)
        before = np.append(0 if last is None else last, t[:-1])
        old = ~new
        yield pd.DataFrame({"a": np.append(hubs[old], before[old]), "b": np.append(t[old], t[old]), "key": pd.array([pd.NA] * (2 * int(old.sum())), "Int64")}).drop_duplicates()
        if not edge:
            edge.append((k[0], t[0]))
        key, hub, last = k[-1], hubs[-1], t[-1]
    if edge:
        edge += [(key, hub), (key, last)]
        yield pd.DataFrame({"a": [e[1] for e in edge], "b": [e[1] for e in edge], "key": pd.array([int(e[0]) for e in edge], "Int64")})


def _neighbours(rows: DataFrame, tables: store.Tables) -> DataFrame:
    """Pairs (a, b) to check, from rows (key, side, node): texts that agree in
    a second band as well stand side by side."""
    near = rows.select("key", "side", "node").repartitionByRange("key", "side", "node").sortWithinPartitions("key", "side", "node")
    met = tables.cut(near.mapInPandas(_meet, "a long, b long, key long"), "met")
    ends = met.where("key is not null")
    across = ends.join(ends.groupBy("key").agg(F.min("a").alias("m")), "key").select("a", F.col("m").alias("b"))
    return met.where("key is null").select("a", "b").unionByName(across)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, size: int = SIZE, rows: int = ROWS, key_col: str | None = None) -> DataFrame:
    """(doc_id, class_id, class_size, kept) of each row: the smallest id of the
    rows whose texts are linked to its own, directly or through others (null
    if none has an id), their number, and whether the row is the one of its
    class to stay, the first with that id.  With ``key_col``, a column of
    distinct integers, that column leads."""
    tables = store.Tables(docs.sparkSession)
    row = F.monotonically_increasing_id() if key_col is None else F.col(key_col)
    text = F.col(text_col)
    # equal texts with a word are one; those that differ in white space only are linked later
    d = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(text))).alias("digest"), text.alias("text"))
    kind = f"row long, doc_id {d.schema['doc_id'].dataType.simpleString()}, digest binary, shingles array<long>, bands array<long>"
    whole = tables.cut(d.mapInArrow(tidy(lambda it: _described(it, words, size, rows)), kind), "texts")
    described = tables.cut(whole.drop("shingles"), "described")
    nodes = tables.cut(described.where("digest is not null").groupBy("digest").agg(F.min("row").alias("node")), "nodes")
    bands = described.select(F.col("row").alias("node"), "bands").join(nodes.select("node").hint("shuffle_hash"), "node", "left_semi")
    bands = tables.cut(bands, "bands")

    held = tables.cut(bands.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "held")
    turned = "explode(zip_with(bands, concat(slice(bands, 2, size(bands) - 1), slice(bands, 1, 1)), (k, s) -> struct(k as key, s as side)))"
    dealt = bands.select("node", F.expr(turned).alias("at")).select("node", "at.*")
    few = dealt.drop("side").join(held.where(f"n <= {FEW}").select("key").hint("shuffle_hash"), "key").groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("of"))
    pairs = few.select(F.explode(F.expr("flatten(transform(of, (x, i) -> transform(slice(of, i + 2, size(of)), y -> struct(x as a, y as b))))")).alias("p")).select("p.*")
    many = tables.cut(dealt.join(tables.cut(held.where(f"n > {FEW}"), "many-held"), "key"), "many")
    pairs = pairs.unionByName(_neighbours(many, tables)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    pairs = tables.cut(pairs.distinct(), "pairs")

    met = pairs.select(F.explode(F.array("a", "b")).alias("row")).unionByName(many.select(F.col("node").alias("row"))).distinct()
    sets = tables.cut(whole.select("row", "shingles").join(tables.cut(met, "in-pairs"), "row", "left_semi").withColumnRenamed("row", "node"), "sets")
    tables.forget("texts")  # the largest one; what follows needs the sets of those that met alone
    links = tables.cut(_checked(pairs, sets, similarity), "links")
    group = tables.cut(components(links), "groups")
    if not many.isEmpty():
        grouped = many.join(group, "node", "left").select("key", "n", "node", F.coalesce("component", "node").alias("grp"))
        more = _rest(grouped, sets, similarity, tables)
        if not more.isEmpty():
            group = tables.cut(components(links.unionByName(more)), "groups")
    return tables.finish(_membership(described, nodes, group, key_col, tables), "near-dups")


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    # the pairs are built into a table, and sets stream by unsorted
    p = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).join(pairs.hint("shuffle_hash"), "a")
    p = p.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
    smaller, larger = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    shared = F.when(smaller >= similarity * larger - 1e-9, F.size(F.array_intersect("x", "y"))).otherwise(0)
    return p.where(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")


def _rest(rows: DataFrame, sets: DataFrame, similarity: float, tables: store.Tables) -> DataFrame:
    """Links (a, b) between all texts of a band value that are not in one
    group, from rows (key, n, node, grp); of linked texts of two blocks as many
    links as join them.  The largest group of a key is not met with itself."""
    rows = tables.cut(rows, "grouped")
    held = rows.groupBy("key", "grp").agg(F.count("*").alias("n")).groupBy("key")
    held = held.agg(F.max(F.struct("n", "grp")).alias("top"), F.count("*").alias("groups")).where("groups > 1")
    many = rows.join(held.select("key", F.col("top.n").alias("most"), F.col("top.grp").alias("bulk")), "key")
    many = many.withColumn("others", F.ceil((F.col("n") - F.col("most")) / BLOCK)).withColumn("blocks", F.col("others") + F.ceil(F.col("most") / BLOCK))
    salt, bulk = F.xxhash64("node"), F.col("grp") == F.col("bulk")
    many = many.withColumn("own", F.when(bulk, F.col("others") + F.pmod(salt, F.col("blocks") - F.col("others"))).otherwise(F.pmod(salt, F.col("others"))))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(bulk, F.col("others")).otherwise(F.col("blocks")) - 1)))
    dealt = many.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "grp").join(sets.hint("merge"), "node")
    links = dealt.groupBy("key", "i", "j").applyInPandas(lambda key, pdf: _between(key, pdf, similarity), "a long, b long")
    return tables.cut(links.distinct(), "more-links")


def _between(key: tuple[int, int, int], pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links that join the linked texts of two blocks of one key."""
    one_thread()
    left, right = pdf[pdf["own"] == key[1]], pdf[pdf["own"] == key[2]]
    if not len(left) or not len(right):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    n, m = (x["shingles"].map(len).to_numpy(np.int64) for x in (left, right))
    shared = _shared(left["shingles"].to_list(), right["shingles"].to_list())
    linked = (shared >= similarity * (n[:, None] + m[None] - shared) - 1e-9) & (left["grp"].to_numpy()[:, None] != right["grp"].to_numpy()[None])
    a, b = left["node"].to_numpy(), right["node"].to_numpy()
    out, rows_left, cols_left = [], linked.any(1), np.ones(len(b), bool)
    while rows_left.any():
        rows = [int(np.flatnonzero(rows_left)[0])]
        rows_left[rows[0]] = False
        while rows:
            r = rows.pop()
            for c in np.flatnonzero(linked[r] & cols_left):
                cols_left[c] = False
                out.append((a[r], b[c]))
                more = np.flatnonzero(linked[:, c] & rows_left)
                rows_left[more] = False
                out += [(a[x], b[c]) for x in more]
                rows += more.tolist()
    ends = np.array(out, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": ends.min(1), "b": ends.max(1)})


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``left`` shares with each of ``right``."""
    sides = [(np.repeat(np.arange(len(x)), [len(s) for s in x]), np.concatenate(x)) for x in (left, right)]
    both = np.intersect1d(sides[0][1], sides[1][1])
    at = []
    for of, values in sides:
        column = np.minimum(np.searchsorted(both, values), max(len(both) - 1, 0))
        use = both[column] == values if len(both) else np.zeros(len(values), bool)
        order = np.argsort(column[use], kind="stable")
        at.append((of[use][order], column[use][order]))
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(both), COLUMNS):
        dense = []
        for x, (of, column) in zip((left, right), at, strict=True):
            own = slice(*np.searchsorted(column, [low, low + COLUMNS]))
            d = np.zeros((len(x), min(COLUMNS, len(both) - low)), np.float32)
            d[of[own], column[own] - low] = 1
            dense.append(d)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def _membership(described: DataFrame, nodes: DataFrame, group: DataFrame, key_col: str | None, tables: store.Tables) -> DataFrame:
    of = nodes.join(group, "node", "left").select("digest", F.coalesce("component", "node").alias("of"))
    members = described.select("row", "doc_id", "digest").join(of, "digest", "left").select("row", "doc_id", F.coalesce("of", "row").alias("class"))
    members = tables.cut(members, "members")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("first")
    # a table of its own, so that the join with a class of many rows can be split
    held = tables.cut(members.groupBy("class").agg(F.count("*").alias("n"), first).where("n > 1"), "classes")
    lead = [] if key_col is None else [F.col("row").alias(key_col)]
    alone = F.col("n").isNull()
    return members.join(held, "class", "left").select(
        *lead, "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.coalesce("n", F.lit(1).cast("long")).alias("class_size"),
        (alone | F.coalesce(F.col("row") == F.col("first.row"), F.lit(False))).alias("kept"),
    )
