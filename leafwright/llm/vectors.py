"""Near-duplicate embeddings by an inverted multi-index.

Vectors of one label are compared.  Each half of a unit vector is coded by its
own codebook, and the pair of codes is a cell of the product grid.  A vector is
a member of its own cell and visits cells in the order of the summed distances
of its halves to the centroids (multi-sequence traversal).  How many cells are
visited is found when the index is fitted: for sampled vectors turned by just
the angle of the threshold in a random direction, the visits after which the
original's cell is reached for ``RECALL`` of them.  All vectors are indexed and
all of them search; every pair met is verified in double precision.

The codebooks are fitted on at most ``SAMPLE`` vectors (k-means, seeded); their
size grows with the square root of the number of vectors, so that cells stay
of even size.  Equal vectors of one label are one row with a count.  A cell
with more than ``SLICE`` members is split by hash, and so are its visitors if
they are more than ``ASKERS``; each slice of the one meets each of the other.
A task counts links and gives a spanning forest of them, not the pairs.

Vectors of one label are compared with those of equal length.  A vector that is
null, all zero or with a null or non-finite component links with nothing, as
does one whose label or id is null.  Equal rows link with each other, rows of
one id are rows of their own, an empty table gives no rows, and further columns
are not read.
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
from leafwright.llm.textscan import one_thread, tidy

COSINE, RECALL, SAMPLE, SLICE, ASKERS, SEED = 0.93, 0.98, 20_000, 512, 8192, 11
#: Members of a cell over all labels, on average.
CELL = 64


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = _distance(x, c).argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None]


class Index:
    """The two codebooks and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float, recall: float = RECALL, seed: int = SEED):
        rng = np.random.Generator(np.random.Philox(seed))
        self.k = int(np.clip(round((n / CELL) ** 0.5), 1, 4096))
        self.half = sample.shape[1] // 2
        self.books = [_kmeans(h, self.k, rng) for h in (sample[:, : self.half], sample[:, self.half :])]
        self.visits = self.k**2
        if self.k > 1:
            probe = sample[rng.choice(len(sample), min(2000, len(sample)), replace=False)]
            side = rng.standard_normal(probe.shape)
            side -= (side * probe).sum(1, keepdims=True) * probe
            side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
            turned = cosine * probe + (1 - cosine**2) ** 0.5 * side
            a, b = self.distances(turned)
            i, j = (d.argmin(1) for d in self.distances(probe))
            rows = np.arange(len(probe))
            reached = a[rows, i] + b[rows, j]
            before = np.array([(a[r][:, None] + b[r][None] < reached[r]).sum() for r in rows])
            self.visits = int(np.quantile(before, recall, method="higher")) + 1

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distance(x[:, : self.half], self.books[0]), _distance(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's own cell, and the cells that it visits, nearest first."""
        a, b = self.distances(x)
        own = a.argmin(1) * self.k + b.argmin(1)
        out = np.empty((len(x), self.visits), np.int64)
        ranks = np.arange(1, self.k + 1)
        # a pair of ranks (r, s) comes after r * s - 1 others at least
        r, s = np.nonzero(ranks[:, None] * ranks[None] <= self.visits)
        ia, ib = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        for at in range(0, len(x), 256):
            rows = slice(at, at + 256)
            p, q = ia[rows][:, r], ib[rows][:, s]
            d = np.take_along_axis(a[rows], p, 1) + np.take_along_axis(b[rows], q, 1)
            best = d.argsort(1, kind="stable")[:, : self.visits]
            out[rows] = np.take_along_axis(p * self.k + q, best, 1)
        return own, out


def _units(vectors: pa.Array) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _place(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            own, visits = index.cells(_units(part.column(3)))
            ends = pa.array(np.arange(len(own) + 1) * index.visits, pa.int32())
            cols = [*part.columns, pa.array(own), pa.ListArray.from_arrays(ends, pa.array(visits.ravel()))]
            yield pa.RecordBatch.from_arrays(cols, ["rep", "label", "n", "v", "cell", "visits"])


def _compare(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of one slice of a cell: counts per vector, and a spanning forest."""
    one_thread()
    m, q = pdf[pdf["member"]], pdf[~pdf["member"]]
    none = pd.DataFrame({"rep": [], "links": [], "to": []}, dtype="int64")
    if not len(m) or not len(q):
        return none
    x, who, n_who = _units(pa.array(m["v"])), m["rep"].to_numpy(), m["n"].to_numpy()
    # (member, visited cell) as one number each, in order
    width = int(max(max(int(np.max(v)) for v in m["visits"]), int(q["home"].max()))) + 1
    seen = np.sort(np.concatenate([k * width + np.asarray(v, np.int64) for k, v in enumerate(m["visits"])]))
    nodes, links = np.unique(np.concatenate([who, q["rep"].to_numpy()])), {}
    count, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    at_m = np.searchsorted(nodes, who)
    pairs = []
    for at in range(0, len(q), 2048):
        part = q.iloc[at : at + 2048]
        rep, n, home = part["rep"].to_numpy(), part["n"].to_numpy(), part["home"].to_numpy()
        near = (_units(pa.array(part["v"])) @ x.T >= cosine) & (rep[:, None] != who[None])
        i, j = np.nonzero(near)
        at_q = np.searchsorted(nodes, rep[i])
        np.add.at(count, at_q, n_who[j])
        # a pair that the member's own search does not meet counts for the member too
        asked = j * width + home[i]
        lone = seen[np.minimum(np.searchsorted(seen, asked), len(seen) - 1)] != asked
        np.add.at(count, at_m[j[lone]], n[i[lone]])
        pairs.append((at_q, at_m[j]))
    a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = pd.DataFrame({"rep": nodes, "links": count, "to": nodes[label]})
    return out[(out["links"] > 0) | (out["to"] != out["rep"])]


def near_dups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    spark = vectors.sparkSession
    d = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    d = d.withColumn("ok", F.coalesce(fine & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False)))
    # -0.0 and 0.0 are one; label and components can't run into each other
    d = store.cut(d.withColumn("v", F.when(F.col("ok"), F.transform("v", lambda e: e + F.lit(0.0)))).withColumn("digest", F.md5(F.to_json(F.struct("label", "v")))), "vec-rows")
    one = d.where("ok").groupBy("digest").agg(F.min("row").alias("rep"), F.min("id").alias("least"), F.first("label").alias("label"), F.count("*").alias("n"), F.first("v").alias("v"))
    one = store.cut(one, "vec-distinct")
    sizes = one.groupBy(F.size("v").alias("dim")).count().collect()  # one row per length
    parts = [_search(one.where(F.size("v") == r["dim"]), r["count"], r["dim"], cosine) for r in sizes]
    out = d.select("id", F.when(F.col("ok"), F.col("digest")).alias("digest"))
    if not parts:
        return out.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = store.cut(found, "vec-found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    per = one.select("digest", "rep", "least", "n").join(links, "rep", "left").join(group, F.col("rep") == F.col("node"), "left")
    per = store.cut(per.select("digest", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "vec-groups")
    # rows are numbers so far; a component is named by the smallest id of its rows
    named = per.groupBy("component").agg(F.min("least").alias("component_id"))
    per = per.join(named, "component").select("digest", "n_links", "component_id")
    out = out.join(per, "digest", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _search(one: DataFrame, n: int, dim: int, cosine: float) -> DataFrame:
    """(rep, links, to) found by the index over ``one`` (rep, label, n, v)."""
    if dim < 2:
        sample = np.ones((1, max(dim, 1)))
    else:
        taken = one.select("v").orderBy(F.xxhash64("rep")).limit(SAMPLE) if n > SAMPLE else one.select("v").orderBy("rep")
        sample = _units(taken.toArrow()["v"].combine_chunks())
    index = Index(sample, n if dim > 1 else 1, cosine)
    kind = "rep long, label string, n long, v array<double>, cell long, visits array<long>"
    placed = store.cut(one.select("rep", "label", "n", "v").mapInArrow(tidy(lambda it: _place(it, index)), kind), "vec-placed")
    asked = placed.select("label", F.explode("visits").alias("cell")).groupBy("label", "cell").agg(F.count("*").alias("asks"))
    large = placed.groupBy("label", "cell").agg(F.count("*").alias("n_own")).join(asked, ["label", "cell"]).where((F.col("n_own") > SLICE) | (F.col("asks") > ASKERS))
    large = large.select("label", "cell", F.ceil(F.col("n_own") / SLICE).cast("int").alias("slices"), F.ceil(F.col("asks") / ASKERS).cast("int").alias("ask_slices"))
    home = F.col("cell").alias("home")
    members = placed.select("rep", "label", "n", "v", "visits", "cell", home, F.lit(True).alias("member"))
    asks = placed.select("rep", "label", "n", "v", F.array().cast("array<long>").alias("visits"), F.explode("visits").alias("cell"), home, F.lit(False).alias("member"))
    asks = asks.join(placed.select("label", "cell").distinct(), ["label", "cell"], "left_semi")
    own = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    members = members.join(large, ["label", "cell"], "left").withColumn("slice", own("slices", 1)).withColumn("ask_slice", every("ask_slices"))
    asks = asks.join(large, ["label", "cell"], "left").withColumn("slice", every("slices")).withColumn("ask_slice", own("ask_slices", 2))
    rows = members.unionByName(asks)
    return rows.groupBy("label", "cell", "slice", "ask_slice").applyInPandas(lambda pdf: _compare(pdf, cosine), "rep long, links long, to long")
