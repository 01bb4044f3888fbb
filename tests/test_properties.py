"""Properties: partition independence, agreement with brute force, marginals."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_samplers_do_not_depend_on_partitioning(spark):
    from cohortforge.operators import sampling
    base = spark.range(5000).select(F.col("id").alias("RECORD_ID"), (F.col("id") % 7).alias("Y"), (F.col("id") % 5 + 1).alias("W"))
    for parts in (1, 8):
        df = base.repartition(parts)
        got = (_rows(sampling.sample_n(df, 300)), _rows(sampling.split_stratified(df, "Y", 0.25)[1]),
               _rows(sampling.sample_weighted_replace(df, "W", 1000)), _rows(sampling.sample_stratified_n(df, "Y", 500)))
        if parts == 1:
            ref = got
        else:
            assert got == ref
    assert len(ref[0]) == 300 and len(ref[3]) == 500 and len(ref[2]) == 1000


def test_group_rank_equals_row_number(spark):
    from pyspark.sql import Window
    from cohortforge.functions.random import uniform
    from cohortforge.operators.rowindex import group_rank
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 3).alias("g"), uniform("t", "id").alias("u"))
    a = group_rank(df, ["g"], "u", "id", buckets=16).select("id", "_rank")
    b = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy("u", "id")).alias("_rank"))
    assert _rows(a) == _rows(b)


def test_row_index_is_dense_in_key_order(spark):
    from cohortforge.operators.rowindex import with_row_index
    df = spark.range(0, 20000, 7).select((F.col("id") * 3 + 11).alias("k"))
    got = [r["_idx"] for r in with_row_index(df, "k").orderBy("k").collect()]
    assert got == list(range(len(got)))


def test_nearest_matches_brute_force(spark):
    from cohortforge.operators.neighbors import nearest
    rng = np.random.default_rng(0)
    q = rng.integers(0, 6, size=(200, 3)).astype(float)
    p = rng.integers(0, 6, size=(300, 3)).astype(float)
    qdf = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(q)], "QID long, A double, B double, C double")
    pdf = spark.createDataFrame([(1000 + i, *map(float, v), f"l{i % 4}") for i, v in enumerate(p)],
                                "PID long, A double, B double, C double, L string")
    got = {r["QID"]: (r["NN_ID"], r["NN_DIST"]) for r in nearest(qdf, pdf, ["A", "B", "C"], "QID", "PID", "L", 1, block_rows=64).collect()}
    for i, v in enumerate(q):
        d2 = ((p - v) ** 2).sum(axis=1)
        j = int(np.lexsort((np.arange(len(p)), d2))[0])
        assert got[i] == (1000 + j, pytest.approx(float(np.sqrt(d2[j]))))


def test_roc_auc_matches_pairwise_count(spark):
    from cohortforge.operators.metrics import roc_auc
    rng = np.random.default_rng(1)
    s = rng.integers(0, 20, 400).astype(float)
    y = (rng.random(400) < 0.4).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    pos, neg = s[y == 1], s[y == 0]
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert roc_auc(df, "s", "y").first()["AUC"] == pytest.approx(brute, abs=1e-6)


def test_markov_matches_pandas(spark):
    import pandas as pd
    from cohortforge.operators.mining import markov_transitions
    rng = np.random.default_rng(2)
    n = 500
    pdf = pd.DataFrame({"u": rng.integers(0, 3, n), "s": rng.choice(list("abc"), n), "id": np.arange(n),
                        "ts": pd.to_datetime(rng.integers(0, 10 * 3600, n), unit="s")})
    df = spark.createDataFrame(pdf)
    got = {(r["FROM_STATE"], r["TO_STATE"]): r["N"] for r in markov_transitions(df, "u", "s", "ts", "id", bucket_seconds=600).collect()}
    srt = pdf.sort_values(["u", "ts", "id"])
    srt["nx"] = srt.groupby("u")["s"].shift(-1)
    exp = srt.dropna().groupby(["s", "nx"]).size().to_dict()
    assert got == exp


def test_ipf_marginals_match_targets(spark):
    from cohortforge.operators.generators import cells, ipf_fit, marginal_targets
    df = spark.range(2000).select((F.col("id") % 3).cast("string").alias("A"), (F.col("id") % 4).cast("string").alias("B"))
    tgt = marginal_targets(spark.range(1000).select((F.col("id") % 3).cast("string").alias("A"),
                                                    (F.col("id") % 7 % 4).cast("string").alias("B")), ["A", "B"], 2.0)
    w, _, _ = ipf_fit(cells(df, ["A", "B"]), ["A", "B"], tgt, max_iter=200, tol=1e-9)
    t = {(r["FEATURE"], r["CATEGORY"]): r["TARGET"] for r in tgt.collect()}
    for f in ("A", "B"):
        for r in w.groupBy(f).agg(F.sum(F.col("N") * F.col("W")).alias("s")).collect():
            assert r["s"] == pytest.approx(t[(f, r[f])], rel=1e-5)


def test_shares_sum_to_one(spark):
    from cohortforge.operators.aggregates import value_shares
    df = spark.range(999).select((F.col("id") % 13).alias("c"))
    assert sum(r["share"] for r in value_shares(df, "c").collect()) == pytest.approx(1.0, abs=1e-5)


def test_k_nearest_matches_brute_force_with_ties(spark):
    from cohortforge.operators.neighbors import nearest
    rng = np.random.default_rng(3)
    q = rng.integers(0, 3, size=(120, 2)).astype(float)
    p = rng.integers(0, 3, size=(200, 2)).astype(float)
    qdf = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(q)], "QID long, A double, B double")
    pdf = spark.createDataFrame([(5000 - i, *map(float, v)) for i, v in enumerate(p)], "PID long, A double, B double")
    got = {}
    for r in nearest(qdf, pdf, ["A", "B"], "QID", "PID", None, 3, block_rows=32).collect():
        got.setdefault(r["QID"], []).append((r["RANK"], r["NN_ID"]))
    ids = 5000 - np.arange(len(p))
    for i, v in enumerate(q):
        d2 = ((p - v) ** 2).sum(axis=1)
        order = np.lexsort((ids, d2))[:3]
        assert [x for _, x in sorted(got[i])] == [int(ids[j]) for j in order]
