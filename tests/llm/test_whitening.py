import math

import numpy as np
import pytest

from docketloom.llm import queries, whitening
from tests.llm import samples

SCHEMA = "vec_id long, embedding array<float>, n string, x int"


def expected(vectors, k=16):
    """{vec_id: deviation}, eigenvalues, unit vectors and centred rows by a dense eigendecomposition."""
    x = {i: [math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in vectors.items()}
    fit = np.array(sorted({tuple(v) for v in x.values()}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in x.items()}
    centred = ((n * fit - sums) / n).astype(float)
    values, unit = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, values[::-1], unit[:, ::-1], {i: ((n * np.array(v, dtype=object) - sums) / n).astype(float) for i, v in x.items()}


def agree(rows, vectors, k):
    n, deviation, values, unit, centred = expected(vectors)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(vectors) * k
    for c in range(1, k + 1):
        column = np.array([got[i, c].whitened for i in vectors])
        want = np.array([centred[i] @ unit[:, c - 1] for i in vectors]) / np.sqrt(values[c - 1])
        assert min(np.abs(column - want).max(), np.abs(column + want).max()) < 1e-7
    for r in rows:
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10
        assert r.identity_error < 1e-9


def test_query(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{samples.SF}/embeddings.parquet").collect()}
    agree(queries.op12_whitening(spark, samples.SF).collect(), vectors, 16)


def test_edges(spark):
    random = np.random.default_rng(1)
    good = [random.standard_normal(5).tolist() for _ in range(30)]
    rows = [(i, v, "a", 1) for i, v in enumerate(good)] + [(None, good[0], "a", 1), (3, good[3], "a", 1), (100, None, "a", 1), (101, [], "a", 1), (102, [1.0, None, 1.0, 1.0, 1.0], "a", 1)]
    rows += [(103, [1.0, float("nan"), 1.0, 1.0, 1.0], "a", 1), (104, [1.0, float("inf"), 1.0, 1.0, 1.0], "a", 1), (105, [1.0, 1e30, 1.0, 1.0, 1.0], "a", 1), (106, [1.0] * 7, "a", 1)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 32 * 5 and {r.n for r in out} == {30}
    once = {(r.vec_id, r.component): r for r in out if r.vec_id is not None}
    agree(list(once.values()), {i: np.float32(v).tolist() for i, v in enumerate(good)}, 5)
    by = {}
    for r in out:
        by.setdefault((r.vec_id, r.component), []).append(r.whitened)
    assert all(by[None, c] == by[0, c] for c in range(1, 6)) and all(len(set(by[3, c])) == 1 and len(by[3, c]) == 2 for c in range(1, 6))
    one = spark.createDataFrame([(1, good[0], "a", 1), (2, good[0], "a", 1)], SCHEMA)
    assert whitening.whiten(one).count() == 0  # no variance
    two = whitening.whiten(spark.createDataFrame([(1, good[0], "a", 1), (2, good[1], "a", 1)], SCHEMA)).collect()
    assert [(r.component, round(r.explained, 12)) for r in two] == [(1, 1.0)] * 2 and sorted(round(r.whitened, 9) for r in two) == [-1.0, 1.0]
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def spectrum(values, seed=3):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return q, (q * values) @ q.T


@pytest.mark.parametrize("values", [np.r_[np.linspace(9, 3, 20), np.full(180, 1.0)], np.r_[[5.0] * 12, np.linspace(1, 0.1, 188)], 0.97 ** np.arange(200), np.r_[[3.0, 2.0], np.zeros(198)]])
def test_lanczos_restarts_and_breakdowns(values):
    """Clusters, repeated eigenvalues, slow decay and low rank, with a basis too small for the space."""
    q, v = spectrum(values)
    calls = []

    def times(block):
        calls.append(block.shape[1])
        return v @ block

    got, unit = whitening.lanczos(times, 200, 12, block=8, most=40, tol=1e-12)
    assert np.abs(got - np.sort(values)[::-1][:12]).max() < 1e-9
    assert np.abs(unit.T @ unit - np.eye(12)).max() < 1e-9 and np.linalg.norm(v @ unit - unit * got, axis=0).max() < 1e-9
    assert max(calls) <= 8


def test_large_deviations():
    x = np.array([[2**40, -(2**40)], [0, 0]])
    assert whitening.deviations(x, 2, x.sum(axis=0)) == [None, None]
    assert whitening.deviations(x // 2**20, 2, x.sum(axis=0) // 2**20) == [2 * (2**20) ** 2] * 2
