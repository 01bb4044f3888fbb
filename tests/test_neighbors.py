"""Pruned neighbour search and grid clustering against brute force, with many small cells."""

import numpy as np
import pytest

from cohortforge.operators import neighbors
from cohortforge.operators.cluster import dbscan, local_links
from cohortforge.operators.kdcells import SLACK, Metric, grow


def _frame(spark, x, first_id=0):
    names = [f"X{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(first_id + i, *map(float, v)) for i, v in enumerate(x)],
                                 "ID long, " + ", ".join(f"{n} double" for n in names)), names


def _clumps(rng, n, d=3):
    return np.concatenate([rng.normal(c, 0.3, size=(n // 4, d)) for c in (0, 3, 7, 50)]).round(3)


@pytest.mark.parametrize("k", [1, 4])
def test_pruned_search_equals_brute_force_and_compares_few_pairs(spark, k):
    rng = np.random.default_rng(11)
    p, q = _clumps(rng, 1200), np.concatenate([_clumps(rng, 200), rng.uniform(-90, 90, size=(40, 3))])
    (pf, names), (qf, _) = _frame(spark, p, 7000), _frame(spark, q)
    got = {}
    for r in neighbors.nearest(qf, pf, names, "ID", "ID", None, k, block_rows=16).collect():
        got.setdefault(r["ID"], []).append((r["RANK"], r["NN_ID"]))
    for i, v in enumerate(q):
        order = np.lexsort((np.arange(len(p)), ((p - v) ** 2).sum(axis=1)))[:k]
        assert [x for _, x in sorted(got[i])] == [7000 + int(j) for j in order]
    n = neighbors.compared_pairs(qf, pf, names, "ID", k, block_rows=16).first()
    assert n["QUERIES"] == 240 and n["ENTRIES"] == 1200 and 0 < n["COMPARED"] < 240 * 1200 / 5


def test_more_neighbours_than_a_home_cell_holds(spark):
    rng = np.random.default_rng(5)
    p, q = rng.normal(size=(90, 2)), rng.normal(size=(20, 2))
    (pf, names), (qf, _) = _frame(spark, p), _frame(spark, q)
    rows = neighbors.nearest(qf, pf, names, "ID", "ID", None, 25, block_rows=4).collect()
    for i, v in enumerate(q):
        want = np.argsort(((p - v) ** 2).sum(axis=1), kind="stable")[:25]
        assert [r["NN_ID"] for r in sorted((r for r in rows if r["ID"] == i), key=lambda r: r["RANK"])] == want.tolist()


def test_empty_pool_and_empty_queries(spark):
    (some, names), none = _frame(spark, np.ones((3, 2))), spark.createDataFrame([], "ID long, X0 double, X1 double")
    assert [r["NN_ID"] for r in neighbors.nearest(some, none, names, "ID", "ID").collect()] == [None] * 3
    assert neighbors.nearest(none, some, names, "ID", "ID").count() == 0


def test_gower_over_many_cells(spark):
    rng = np.random.default_rng(2)
    p, q = rng.integers(0, 9, size=(400, 3)).astype(float), rng.integers(0, 11, size=(80, 3)).astype(float)
    (pf, names), (qf, _) = _frame(spark, p), _frame(spark, q)
    got = {r["ID"]: r["GOWER_DIST"] for r in neighbors.gower_nearest(qf, pf, names[:2], names[2:], "ID", "ID", block_rows=16).collect()}
    spans = np.ptp(p[:, :2], axis=0)
    for i, v in enumerate(q):
        d = (np.abs(p[:, :2] - v[:2]) / spans).sum(axis=1) + (p[:, 2] != v[2])
        assert got[i] == pytest.approx(d.min() / 3)


@pytest.mark.parametrize("metric", [Metric.squared(3), Metric.gower([4.0, 2.0, 1.0], [False, False, True])])
def test_box_bounds_hold(metric):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 5, size=(500, 3)).astype(float)
    cells = grow(x[::5], 20, metric)
    home = cells.home(x)
    used = np.unique(home)
    cells = cells.with_boxes(used, np.array([(home == c).sum() for c in used]), np.array([x[home == c].min(axis=0) for c in used]),
                             np.array([x[home == c].max(axis=0) for c in used]))
    q = rng.uniform(-2, 7, size=(40, 3))
    d = metric.distance(q[:, None, :], x[None, :, :])
    assert (np.sort(d, axis=1)[:, 9] <= cells.sure_bound(q, 10) * SLACK).all()
    bound = np.sort(d, axis=1)[:, 9]
    rows, cell = cells.within(q, bound)
    reached = set(zip(rows.tolist(), cell.tolist()))
    assert all((i, home[j]) in reached for i, j in zip(*np.nonzero(d <= bound[:, None])))


def test_local_links_are_the_components():
    near = np.array([[1, 0, 0, 0], [1, 1, 0, 0], [0, 0, 1, 0]], dtype=bool)
    a, b = local_links(near, np.array([5, 9, 30]), np.array([5, 7, 20, 40]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(7, 5), (9, 5), (30, 20)]


def _plain_dbscan(x, eps, min_samples):
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps + 1e-12
    core = near.sum(axis=1) >= min_samples
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        lower = np.where(core, np.where(near & core[None, :], label[None, :], len(x)).min(axis=1), len(x))
        if (lower == label).all():
            break
        label = lower
    out = np.where(near & core[None, :], label[None, :], len(x)).min(axis=1)
    return np.where(out == len(x), -1, out)


@pytest.mark.parametrize("block_rows", [8, 64, 2048])
def test_dbscan_equals_the_plain_rule(spark, block_rows):
    rng = np.random.default_rng(4)
    x = np.concatenate([_clumps(rng, 240, 2), rng.uniform(-2, 9, size=(60, 2)).round(1), np.repeat([[20.0, 20.0]], 6, axis=0)])
    frame, names = _frame(spark, x)
    got = {r["ID"]: r["CLUSTER"] for r in dbscan(frame, names, "ID", 0.25, 4, block_rows).collect()}
    assert [got[i] for i in range(len(x))] == _plain_dbscan(x, 0.25, 4).tolist()
