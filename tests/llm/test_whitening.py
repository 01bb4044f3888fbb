"""Whitening against numpy's eigenvalues, and the qd solver on awkward matrices."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from cohortforge.llm import whitening
from cohortforge.llm.bidiagonal import bidiagonalise, dqds, right_singular
from cohortforge.llm.common import read


def square(m):
    r = np.linalg.qr(np.asarray(m, float), mode="r")
    return np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])


def matrices():
    rng = np.random.default_rng(3)
    q, u = (np.linalg.qr(rng.normal(size=s))[0] for s in ((40, 40), (120, 40)))
    yield "random", rng.normal(size=(200, 40))
    yield "graded", rng.normal(size=(200, 40)) * np.logspace(0, -6, 40)
    yield "graded upwards", rng.normal(size=(200, 40)) * np.logspace(-6, 0, 40)
    yield "equal values", np.vstack([q, q])
    yield "clusters", u @ np.diag([3.0] * 10 + [2.0] * 10 + [1.0] * 20) @ q
    yield "tight cluster", u @ np.diag(1 + 1e-9 * np.arange(40)) @ q
    yield "low rank", rng.normal(size=(200, 7)) @ rng.normal(size=(7, 40))
    yield "few rows", rng.normal(size=(5, 40))
    yield "zero columns", rng.normal(size=(100, 40)) * (np.arange(40) % 3 > 0)
    yield "one column", rng.normal(size=(9, 1))
    for i in range(30):
        yield f"small integers {i}", rng.integers(-2, 3, size=(rng.integers(2, 30), rng.integers(1, 12))).astype(float)


@pytest.mark.parametrize("name,m", list(matrices()), ids=lambda x: x if isinstance(x, str) else "")
def test_solver(name, m):
    values, vectors = right_singular(square(m), 16)
    want = np.linalg.svd(m, compute_uv=False) ** 2
    if not want[0]:
        return
    want = np.concatenate([want, np.zeros(max(0, m.shape[1] - len(want)))])[:16]
    assert np.abs(values - want).max() < 1e-13 * want[0]
    assert np.abs(m.T @ m @ vectors - vectors * values).max() < 1e-13 * want[0]
    kept = want > 1e-20 * want[0]
    assert np.abs((vectors.T @ vectors - np.eye(len(values)))[np.ix_(kept, kept)]).max() < 1e-11


def test_bidiagonal_form_and_small_values():
    m = square(np.random.default_rng(1).normal(size=(50, 12)))
    a, b, v = bidiagonalise(m)
    bi = np.diag(a) + np.diag(b, 1)
    assert np.abs(v @ bi.T @ bi @ v.T - m.T @ m).max() < 1e-12 and np.abs(v.T @ v - np.eye(12)).max() < 1e-13
    # a tiny value beside large ones keeps its digits: B = [[1, 1], [0, t]] has the product of its squared values t * t
    t = 1e-12
    big, small = dqds([1.0, t * t], [1.0])
    assert big * small == pytest.approx(t * t, rel=1e-13) and big == pytest.approx(2.0)


def reference(rows, most=16):
    """Per usable row (vec_id, x) the deviation and whitened entries by numpy, with n, the explained shares and the directions."""
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in usable), default=0)
    x = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v) + (1_000_000,) * (dim - len(v))) for i, v in usable]
    fit = sorted({v for _, v in x})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    off = np.array([[n * a - b for a, b in zip(v, s)] for _, v in x], object)
    centred = np.array([[n * a - b for a, b in zip(v, s)] for v in fit], float) / n
    _, values, axes = np.linalg.svd(centred)
    total, values, axes = (centred**2).sum() / n, values[:most] ** 2 / n, axes.T[:, :len(values)][:, :most]
    kept = values > 1e-18 * values[0]
    values, axes = values[kept], axes[:, kept]
    whitened = off.astype(float) / n @ axes / np.sqrt(values)
    return x, n, [int(sum(o * o)) for o in off], whitened, values / total


def check(df, rows, most=16):
    x, n, deviation, whitened, explained = reference(rows, most)
    seen, places = collections.Counter(), []
    for r in (got := df.collect()):  # equal rows are told apart by their number
        places.append((str(r.vec_id), r.deviation, seen[r.vec_id, r.deviation, r.component], r.component))
        seen[r.vec_id, r.deviation, r.component] += 1
    got = [got[i] for i in sorted(range(len(got)), key=places.__getitem__)]
    k = len(explained)
    assert len(got) == len(x) * k and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    order = sorted(range(len(x)), key=lambda i: (str(x[i][0]), deviation[i]))
    mine = np.array([r.whitened for r in got]).reshape(-1, k)
    assert [r.deviation for r in got[::k]] == [deviation[i] for i in order]
    want = whitened[order]
    sign = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine - want * sign).max() < 1e-8
    assert np.abs(np.array([r.explained for r in got[:k]]) - explained).max() < 1e-12
    assert {r.identity_error for r in got} == {got[0].identity_error} and 0 <= got[0].identity_error < 1e-10


def test_embeddings(spark):
    vectors = read(spark, SF_SMALL, "embeddings")
    check(whitening.whiten(vectors), [(r.vec_id, r.embedding) for r in vectors.collect()])


NAN, INF = float("nan"), float("inf")


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 3)
    monkeypatch.setattr(whitening, "GROUP", 2)  # several rounds of triangles
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=4) * [1, 2, 900, 40000]]) for i in range(60)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (100, None), (101, [1.0, None, 2.0, 3.0]), (102, [NAN, 1.0, 1.0, 1.0]),
             (103, [INF, 0.0, 0.0, 0.0]), (104, []), (105, [0.5]), (106, [0.5, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, raw string").repartition(5)
    check(whitening.whiten(df), rows)
    check(whitening.whiten(df, 2), rows, 2)


def test_floats_and_few_directions(spark):
    rows = [(i, [float(i % 5), 2.0 * (i % 5), 1.0]) for i in range(40)]  # one direction, five vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    check(whitening.whiten(df), rows)


def test_nothing_to_whiten(spark):
    shape = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        got = whitening.whiten(spark.createDataFrame(rows, shape))
        assert got.count() == 0 and len(got.columns) == 7


def test_deviation_beyond_a_long(spark):
    rows = [(i, [float(i) * 2.0**40, float(i * i)]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where(F.col("component") == 1).collect()
    x, n, deviation, *_ = reference(rows)
    assert {r.vec_id: r.deviation for r in got} == {i: d if d < 1 << 63 else None for (i, _), d in zip(x, deviation)}
