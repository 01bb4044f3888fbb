"""Network generator, fan-out pool join and label vectors against plain versions."""

import collections
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortforge.operators import embed, joins
from cohortforge.operators import generators as gen


def _xor_frame(spark):
    # C is A xor B, D copies A nine times of ten: no pair of A, B, C is dependent, the three together are
    return spark.range(1600).selectExpr(
        "concat('a', id % 2) A", "concat('b', (id div 2) % 2) B", "concat('c', (id % 2 + (id div 2) % 2) % 2) C",
        "concat('d', case when id % 10 = 9 then 1 - id % 2 else id % 2 end) D")


def test_entropies_equal_plain_counts(spark):
    df = _xor_frame(spark).withColumn("B", F.when(F.rand(3) > 0.1, F.col("B")))
    df = gen.cut_lineage(df)
    rows = [r for r in df.collect() if r.B is not None]
    got, n = gen.subset_entropies(df, ["A", "B", "C", "D"], 3)
    assert n == len(rows) and len(got) == 14
    for k in (1, 2, 3):
        for s in itertools.combinations("ABCD", k):
            c = collections.Counter(tuple(r[f] for f in s) for r in rows)
            h, states = got[frozenset(s)]
            assert states == len(c) and h == pytest.approx(-sum(x / n * math.log(x / n) for x in c.values()))


def test_network_finds_what_a_tree_cannot(spark):
    df = _xor_frame(spark)
    net = gen.network_structure(df, ["A", "B", "C", "D"], 2)
    parents = dict(net)
    assert any(len(p) == 2 and {f, *p} == {"A", "B", "C"} for f, p in net)
    assert "A" in parents["D"] or "D" in parents["A"]
    seen = set()
    for f, p in net:
        assert set(p) <= seen
        seen.add(f)
    assert all(len(p) <= 1 for _, p in gen.network_structure(df, ["A", "B", "C", "D"], 1))

    def kept(max_parents):
        rows = gen.tabular_synth_sample(gen.tabular_synth_fit(df, ["A", "B", "C", "D"], max_parents), 800, spark).collect()
        assert len(rows) == 800
        return sum((r.A[1] != r.B[1]) == (r.C[1] == "1") for r in rows) / 800
    assert kept(2) > 0.97 and kept(1) < 0.6


def test_network_of_an_empty_table(spark):
    df = _xor_frame(spark).limit(0)
    assert gen.network_structure(df, ["B", "A"]) == [("A", ()), ("B", ())]
    assert all(r.A is None for r in gen.tabular_synth_sample(gen.tabular_synth_fit(df, ["B", "A"]), 2, spark).collect())


@pytest.mark.parametrize("chunk_rows", [2, 3, 4096])
def test_fanout_join_multiplies_rows(spark, chunk_rows):
    left = [(i, "hot" if i % 3 == 0 else f"k{i % 7}" if i % 5 else None, i % 2) for i in range(60)]
    right = [(500 + i, "hot" if i % 2 == 0 else f"k{i % 4}" if i % 9 else None, i % 2, f"v{i}") for i in range(40)]
    pop = spark.createDataFrame(left, "RECORD_ID long, K string, _lc int")
    pool = spark.createDataFrame(right, "RECORD_ID long, K string, X int, V string")
    got = joins.join_pool_fanout(pop, pool, ["K"], ["V"], chunk_rows=chunk_rows)
    assert got.columns == ["RECORD_ID", "K", "_lc", "V", "POOL_ID"]
    want = []
    for i, k, x in left:
        hits = [(i, k, x, v, j) for j, kk, _, v in right if k is not None and kk == k]
        want += hits or [(i, k, x, None, None)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert joins.join_pool_fanout(pop, pool.limit(0), ["K"], ["V"], chunk_rows=chunk_rows).count() == 60


def test_hot_key_is_spread(spark):
    side = spark.range(300).selectExpr("id RECORD_ID", "'hot' K", "id V")
    got = joins.join_pool_fanout(side.drop("V"), side, ["K"], ["V"], chunk_rows=50)
    # six chunks a side: 36 units of about 50 x 50 rows instead of one key of 90,000
    assert got.count() == 90000 and got.select("RECORD_ID", "POOL_ID").distinct().count() == 90000


@pytest.mark.parametrize("block_values", [8, 12, 1 << 21])
def test_top_labels_by_blocks(spark, block_values):
    rng = np.random.default_rng(0)
    x, m = rng.integers(-3, 4, size=(50, 4)).astype(float), rng.integers(-3, 4, size=(9, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [1.0, None, 0.0, 0.0])], "id long, v array<double>")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "label int, vector array<double>")
    got = {}
    for r in embed.top_k_long(df, "id", "v", vectors, 3, block_values).collect():
        got.setdefault(r.id, []).append((r.RANK, r.LABEL))
    assert set(got) == set(range(50))
    for i, v in enumerate(x):
        assert [b for _, b in sorted(got[i])] == np.lexsort((np.arange(9), -(m @ v)))[:3].tolist()
    assert embed.top_k_long(df, "id", "v", vectors.limit(0)).count() == 0


def test_learned_vectors_equal_plain_descent(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, size=90)
    x = rng.normal(size=(90, 5)) + 2 * np.eye(3, 5)[y]
    df = spark.createDataFrame([(f"l{a}", v.tolist()) for a, v in zip(y, x)] + [(None, [0.0] * 5), ("l9", None)], "y string, v array<double>")
    got = np.array([r.vector for r in embed.learned_label_vectors(df, "v", "y", rounds=8).orderBy("label").collect()])
    w = np.zeros((3, 5))
    for _ in range(8):
        p = np.exp(x @ w.T)
        p = p / p.sum(axis=1, keepdims=True) - np.eye(3)[y]
        w = w - (p.T @ x / 90 + 1e-3 * w)
    assert np.allclose(got, w)
    assert embed.learned_label_vectors(df.limit(0), "v", "y").count() == 0
