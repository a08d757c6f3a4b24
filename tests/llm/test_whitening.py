"""Whitening against eigenvectors of the exact covariance."""

import numpy as np
import pytest

from leafwright.llm import queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id int, embedding array<double>, x int, n string, w string"


def _restated(rows, k=32):
    """(deviations, values, vectors) by integers and a full decomposition."""
    x = np.array([[int(np.floor(64 * float(c))) + 1000000 for c in v] for v in rows], object)
    y = len(x) * x - x.sum(0)
    v = (y.T @ y).astype(float) / float(len(x)) ** 3
    e, q = np.linalg.eigh(v)
    return (y**2).sum(1), e[::-1][:k], y.astype(float) / len(x) @ q[:, ::-1][:, :k], np.trace(v)


def test_rows_and_components(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    deviations, values, projected, trace = _restated([r["embedding"] for r in table])
    found = {(r["vec_id"], r["component"]): r for r in queries.op12_whitening(spark, SF).collect()}
    assert len(found) == 32 * len(table)
    for c in range(32):
        got = np.array([found[r["vec_id"], c + 1]["whitened"] for r in table])
        want = projected[:, c] / np.sqrt(values[c])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-6
        assert np.mean(got * got) == pytest.approx(1, abs=1e-6)
    for i, r in enumerate(table):
        row = found[r["vec_id"], 1]
        assert (row["n"], row["deviation"]) == (len(table), deviations[i])
    assert [found[table[0]["vec_id"], c + 1]["explained"] for c in range(32)] == pytest.approx(list(values / trace), rel=1e-6)
    assert {r["identity_error"] for r in found.values()}.pop() < 1e-8


def test_odd_rows(spark):
    good = [(1, [1.0, 2.0]), (2, [3.0, 4.5]), (None, [0.5, 0.25]), (2, [3.0, 4.5]), (11, [9.0, -1.0])]
    bad = [(3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [1e300, 1.0]), (7, []), (8, [float("inf"), 0.0])]
    other = [(20, [1.0, 2.0, 3.0]), (21, [1.0, 2.0, 4.0]), (22, [5.0])]  # lengths of their own; a single row has no variance
    rows = [(i, v, 1, "", "") for i, v in good + bad + other]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in found) == sorted([(i or 0, c, 5) for i, _ in good for c in (1, 2)] + [(20, 1, 2), (21, 1, 2)])
    deviations = _restated([v for _, v in good])[0]
    assert sorted({(r["vec_id"] or 0, r["deviation"]) for r in found if r["n"] == 5}) == sorted({(i or 0, d) for (i, _), d in zip(good, deviations, strict=True)})
    assert all(r["identity_error"] < 1e-9 for r in found)
    for rows in ([], rows[:1], [rows[0]] * 3):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_large_entries_are_exact():
    x = np.array([[1 << 52, 5], [0, 7]], np.int64)
    assert whitening._deviations(x, 2, x.sum(0).astype(object)) == [None, None]
    x = np.array([[1 << 30, 5], [0, 7], [3, 9]], np.int64)
    assert whitening._deviations(x, 3, x.sum(0).astype(object)) == [int(v) for v in ((3 * x.astype(object) - x.sum(0)) ** 2).sum(1)]


def test_more_dimensions_than_a_gram_matrix_is_made_for(spark):
    rng = np.random.default_rng(4)
    rows = (rng.standard_normal((300, 120)) * np.linspace(1, 3, 120)).tolist()
    found = whitening.whiten(spark.createDataFrame([(i, v, 0, "", "") for i, v in enumerate(rows)], SCHEMA), k=8).collect()
    _, values, _, trace = _restated(rows, 8)
    by = {r["component"]: r for r in found}
    assert [by[c]["explained"] for c in range(1, 9)] == pytest.approx(list(values / trace), rel=1e-4)
    assert found[0]["identity_error"] < 1e-4
