"""Whitening of embeddings by a distributed singular value decomposition.

Entries become integers x (``SCALE`` times the entry, rounded down, moved by
``SHIFT``), so that counts, sums S and squared deviations of the fit list are
exact.  The rows n*x - S over n, which are centred before anything multiplies
them, are a distributed matrix, whose right singular vectors
(``RowMatrix.computeSVD``) are the components: unit eigenvectors of the
covariance V.  A singular value s gives the eigenvalue s * s / n, since V has
the divisor n.  The trace of V doesn't come from the singular values, of which
only the largest are found, but from the exact deviations: it is their sum
over n to the third.  A row's whitened value is its projection on a component
over the root of the eigenvalue.  The whitened rows' own covariance, centred
anew, is measured against the identity.

Rows go through tasks as they lie; what meets in the driver is one sum for each
dimension and one number for each pair of dimensions, whatever the rows.

A row is left out whose vector is null or empty, or holds null, non-finite or
too large entries (beyond ``LARGEST``, which as integers could not be told
exactly).  Vectors of unequal lengths have no common covariance: those of each
length are a fit list of their own.  Components without variance (eigenvalue
at most ``RANK`` squared times the largest, as with a single row or equal rows)
can't be whitened and have no rows.  Null ids, repeated ids and repeated rows
are rows like others, an empty table gives no rows, further columns are not
read.  A deviation too large for a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.llm import store
from leafwright.llm.textscan import tidy

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: The largest size of an entry whose integer is exact, and the least share of the largest singular value that counts.
LARGEST, RANK = float(1 << 46), 3e-6

SCHEMA = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x) of the rows that remain."""
    d = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("c"))
    fine = F.forall("c", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) <= LARGEST), F.lit(False)))
    # the rows are told before their entries are rounded: a cast of others would fail
    return d.select("vec_id", F.when(fine & (F.size("c") > 0), F.transform("c", lambda e: F.floor(F.when(F.abs(e) <= LARGEST, e) * SCALE).cast("long") + SHIFT)).alias("x")).where("x is not null")


def _deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """The sum over dimensions of (n*x - S)^2 of each row, exactly."""
    most = max((n * max(int(x.max()), -int(x.min())) + max(map(abs, total.tolist()))) if x.size else 0, 1)
    if most * most * max(x.shape[1], 1) < 1 << 63:
        y = n * x - total.astype(np.int64)
        return (y * y).sum(1).tolist()
    y = n * x.astype(object) - total.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (y * y).sum(1)]


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x less the mean, by way of integers: (n*x - S) / n."""
    exact = n * (max(int(x.max()), -int(x.min())) + 1) < 1 << 62 and max(map(abs, total.tolist())) < 1 << 62
    y = n * x - total.astype(np.int64) if exact else n * x.astype(object) - total
    return y.astype(float) / n


def _rows(arr: pa.Array) -> np.ndarray:
    return arr.flatten().to_numpy(zero_copy_only=False).reshape(len(arr), -1)


def _lists(y: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(np.ascontiguousarray(y).ravel()))


def _matrix(df: DataFrame, col: str) -> RowMatrix:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(col).alias("v")), "v"))


class Whitening:
    """The components fitted to ``fit`` (vec_id, x), all of ``dim`` dimensions."""

    def __init__(self, fit: DataFrame, dim: int, k: int = COMPONENTS):
        sums = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()  # one row a dimension
        sums.sort()
        self.fit, self.n = fit, sums[0]["n"]
        self.total = np.array([int(r["s"]) for r in sums], object)
        # from a hundred dimensions on, the method multiplies by the rows again and again
        rows = self.centred() if dim < 100 else store.cut(self.centred(), "whiten-centred")
        svd = _matrix(rows, "y").computeSVD(min(k, dim), computeU=False, rCond=RANK)
        s = np.array(svd.s.toArray())
        self.components = svd.V.toArray()[:, : len(s)][:, s > 0]
        self.values = s[s > 0] ** 2 / self.n

    def centred(self) -> DataFrame:
        """(y) of each row."""
        n, total = self.n, self.total

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([_lists(_centred(_rows(batch.column(0)), n, total))], ["y"])

        return self.fit.select("x").mapInArrow(tidy(run), "y array<double>")

    def transformed(self) -> DataFrame:
        """(vec_id, deviation, w) of each row."""
        n, total, unit = self.n, self.total, self.components / np.sqrt(self.values)[None]
        kind = self.fit.schema["vec_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _rows(batch.column(1))
                    cols = [batch.column(0), pa.array(_deviations(x, n, total), pa.int64()), _lists(_centred(x, n, total) @ unit)]
                    yield pa.RecordBatch.from_arrays(cols, ["vec_id", "deviation", "w"])

        return self.fit.select("vec_id", "x").mapInArrow(tidy(run), f"vec_id {kind}, deviation long, w array<double>")

    def trace(self, whitened: DataFrame) -> float:
        """The total variance, from the exact deviations."""
        if whitened.where("deviation is null").isEmpty():
            total = whitened.agg(F.sum(F.col("deviation").cast("decimal(38,0)"))).first()[0]
            return float(int(total)) / self.n**3
        # deviations beyond a long are summed as doubles, of which each is right to its last digit
        return self.centred().select(F.sum(F.aggregate("y", F.lit(0.0), lambda a, e: a + e * e))).first()[0] / self.n

    def identity_error(self, whitened: DataFrame) -> float:
        """The largest entry of the whitened rows' covariance less the identity."""
        # centred by the matrix before it multiplies, with the divisor n - 1
        cov = _matrix(whitened, "w").computeCovariance().toArray() * ((self.n - 1) / self.n)
        return float(np.abs(cov - np.eye(len(cov))).max())


def _whitened(fit: DataFrame, dim: int, k: int) -> DataFrame | None:
    model = Whitening(fit, dim, k)
    if not len(model.values):
        return None
    rows = store.cut(model.transformed(), "whitened")
    trace, error = model.trace(rows), model.identity_error(rows)
    out = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.element_at(F.lit((model.values / trace).tolist()), F.col("at") + 1)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of
    each row that remains and each of its ``k`` first components."""
    fit = store.cut(integers(vectors, id_col, vec_col), "whiten-fit")
    dims = sorted(r[0] for r in fit.select(F.size("x")).distinct().collect())  # one row a length
    parts = [p for p in (_whitened(fit.where(F.size("x") == dim), dim, k) for dim in dims) if p is not None]
    if not parts:
        return vectors.sparkSession.createDataFrame([], SCHEMA.format(id=fit.schema["vec_id"].dataType.simpleString()))
    return reduce(DataFrame.unionByName, parts)
