"""Hand-computed cases for rules at the edges: nulls, unseen categories, permuted headers, outlying ids, long chains."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortforge.functions.random import py_uniform, uniform
from cohortforge.operators import (aggregates, clean, cluster, encode, generators, joins, metrics, mining, models, neighbors, ordering,
                                   privacy, rowindex, sampling, stats)
from cohortforge.session import scratch_path
from cohortforge.sources import files, sinks
from cohortforge.streaming.ingest import chunked_ingest


def test_chain_of_300_links_is_one_cluster(spark):
    rows = [(i, float(i)) for i in range(301)] + [(900, 1000.0), (901, None)]
    got = {r.RECORD_ID: r.CLUSTER for r in cluster.dbscan(
        spark.createDataFrame(rows, "RECORD_ID long, x double"), ["x"], "RECORD_ID", 1.0, 2).collect()}
    assert {got[i] for i in range(301)} == {0} and got[900] == got[901] == -1 and len(got) == 303


def test_neighbours_keep_rows_with_null_features(spark):
    q = spark.createDataFrame([(1, 0.0), (2, None), (3, 9.0)], "id long, x double")
    p = spark.createDataFrame([(10, 1.0, "a"), (11, 8.0, "b"), (12, None, "c")], "id long, x double, y string")
    got = {r.id: (r.NN_ID, r.NN_DIST) for r in neighbors.nearest(q, p, ["x"], "id", "id", "y").collect()}
    assert got == {1: (10, 1.0), 2: (None, None), 3: (11, 1.0)}
    vote = {r.id: r.PRED for r in neighbors.nn_vote_k(q, p, ["x"], "id", "id", "y", 1).collect()}
    assert vote == {1: "a", 2: None, 3: "b"}


def test_uniform_has_52_bits(spark):
    u = spark.range(2000).select("id", uniform("t", "id").alias("u")).collect()
    assert all(r.u == py_uniform("t", r.id) and 0 <= r.u < 1 for r in u)
    assert any(r.u * 2.0**32 % 1 for r in u)


def test_chi_square_with_an_unseen_category(spark):
    e = spark.createDataFrame([("a",), ("b",)], "c string")
    o = spark.createDataFrame([("a",), ("b",), ("z",), ("z",)], "c string")
    assert stats.chi_square_gof(e, o, "c").first()["STATISTIC"] == math.inf
    even = stats.chi_square_gof(e, e.union(e), "c").first()
    assert (even["STATISTIC"], even["DOF"]) == (0.0, 1)


def test_contingency_and_information(spark):
    df = spark.createDataFrame([("x", "p")] * 30 + [("y", "q")] * 10, "a string, b string")
    r = stats.contingency_chi2(df, "a", "b").first()
    assert (r["STATISTIC"], r["DOF"]) == (40.0, 1)
    want = -(0.75 * math.log(0.75) + 0.25 * math.log(0.25))
    assert math.isclose(stats.mutual_information(df, "a", "b").first()["MI"], want, abs_tol=1e-6)


def test_information_of_all_pairs_equals_each_pair(spark):
    df = spark.createDataFrame([("x", 1, "p"), ("x", 2, "q"), ("y", 1, "q"), ("y", 1, None), ("x", 2, "p")], "a string, b int, c string")
    got = {(r.A, r.B): r.MI for r in stats.pairwise_information(df, ["a", "b", "c"]).collect()}
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        assert math.isclose(got[a, b], stats.mutual_information(df, a, b).first()["MI"], abs_tol=2e-6)


def test_rare_pairs_show_their_true_support(spark):
    real = spark.createDataFrame([(i, ["a", "b"]) for i in range(50)] + [(i, ["a", "c"]) for i in range(50, 100)], "o long, items array<string>")
    syn = spark.createDataFrame([(0, ["a", "b"])] + [(i, ["a", "c"]) for i in range(1, 100)], "o long, items array<string>")
    pairs, _ = mining.comorbidity_compare(real, syn, "o", 0.1)
    got = {r.ITEMS: (r.S_REAL, r.S_SYNTH) for r in pairs.collect()}
    assert got == {"a|b": (0.5, 0.01), "a|c": (0.5, 0.99)}


def test_crosstab_takes_its_domain_from_the_data(spark):
    df = spark.createDataFrame([("F", "1"), ("F", "9"), ("M", "1"), ("M", None), ("X", None)], "s string, r string")
    got = {(r.s, r.r): (r.n, r.share) for r in aggregates.crosstab_rownorm(df, "s", "r").collect()}
    assert got == {("F", "1"): (1, 0.5), ("F", "9"): (1, 0.5), ("M", "1"): (1, 1.0), ("M", "9"): (0, 0.0),
                   ("X", "1"): (0, None), ("X", "9"): (0, None)}


def test_rows_without_a_label_are_a_class(spark):
    df = spark.createDataFrame([(i, "a" if i < 8 else None) for i in range(12)], "RECORD_ID long, y string")
    tr, te = sampling.split_stratified(df, "y", 0.25)
    assert sorted((r.y is None) for r in te.collect()) == [False, False, True] and tr.count() == 9
    assert sampling.sample_stratified_n(df, "y", 100).count() == 12
    got = sampling.sample_stratified_n(df, "y", 6).collect()
    assert sum(r.y is None for r in got) == 2 and len(got) == 6


def test_sample_n_is_the_n_smallest_draws(spark):
    df = spark.range(5000).withColumnRenamed("id", "RECORD_ID")
    want = sorted(range(5000), key=lambda i: py_uniform("sample", i))[:300]
    assert sorted(r.RECORD_ID for r in sampling.sample_n(df, 300).collect()) == sorted(want)


def test_missing_predictions_are_misses(spark):
    p = spark.createDataFrame([("a", "a"), ("b", None)], "y string, pred string")
    assert metrics.accuracy(p).first()[0] == 0.5
    rows = {r.CLASS: r for r in metrics.per_class(p).collect()}
    assert rows["b"].FN == 1 and rows["b"].RECALL == 0.0 and set(rows) == {"a", "b"}


def test_auc_of_one_class_is_null_and_ties_share_ranks(spark):
    one = spark.createDataFrame([(0.3, 1), (0.4, 1)], "s double, l int")
    assert metrics.roc_auc(one, "s", "l").first()["AUC"] is None
    two = spark.createDataFrame([(0.1, 0), (0.5, 0), (0.5, 1), (0.9, 1)], "s double, l int")
    assert metrics.roc_auc(two, "s", "l").first()["AUC"] == 0.875


def test_argmax_label_of_strings(spark):
    t = spark.createDataFrame([("k", "B10"), ("k", "A01"), ("k", "B10"), ("m", "C1"), ("m", "A9")], "c string, y string")
    model = metrics.frequency_classifier_fit(t, ["c"], "y")
    got = metrics.frequency_classifier_label(model, spark.createDataFrame([("k",), ("m",), ("z",)], "c string"), ["c"], "y", "p")
    assert {r.c: r.p for r in got.collect()} == {"k": "B10", "m": "A9", "z": "B10"}


def test_quantiles_and_positions_with_an_outlying_id(spark):
    ids = [*range(1000), 10**15]
    df = spark.createDataFrame([(i,) for i in ids], "k long")
    got = rowindex.with_row_index(df, "k", out="p").collect()
    assert {r.k: r.p for r in got} == {k: p for p, k in enumerate(ids)}
    per = rowindex.in_key_order(df, "k").groupBy("_part").count().collect()
    assert max(r["count"] for r in per) < 500
    values = np.random.default_rng(2).integers(0, 50, 300).astype(float)
    v = spark.createDataFrame([("g", float(x), True) for x in values] + [("h", None, False)], "g string, D double, f boolean")
    for q in (0.05, 0.5, 1.0):
        assert math.isclose(privacy.exact_quantile(v, "D", q), np.quantile(values, q))
    row = {r.g: r for r in aggregates.mean_percentile(v, ["g"], "D", "f").collect()}
    assert math.isclose(row["g"].P05, round(np.quantile(values, 0.05), 6)) and row["h"].P05 is None


def test_zip_keeps_the_longer_side(spark):
    a = spark.createDataFrame([(i, f"a{i}") for i in range(5)], "k long, x string")
    b = spark.createDataFrame([(i, f"b{i}") for i in range(3)], "j long, y string")
    got = joins.positional_zip(a, b, "k", "j", ["y"]).collect()
    assert sorted((r.x, r.y) for r in got if r.y) == [("a0", "b0"), ("a1", "b1"), ("a2", "b2")] and len(got) == 5


def test_raking_stops_by_its_rule_and_survives_a_zero_target(spark):
    c = spark.createDataFrame([("x", "p", 10), ("x", "q", 20), ("y", "p", 30), ("y", "q", 40)], "a string, b string, N long")
    t = spark.createDataFrame([("a", "x", 60.0), ("a", "y", 40.0), ("b", "p", 50.0), ("b", "q", 50.0)],
                              "FEATURE string, CATEGORY string, TARGET double")
    w, steps, done = generators.ipf_fit(c, ["a", "b"], t)
    assert done and steps < 50
    got = {(r.a, r.b): r.N * r.W for r in w.collect()}
    assert math.isclose(got["x", "p"] + got["x", "q"], 60, rel_tol=1e-4) and math.isclose(got["x", "p"] + got["y", "p"], 50, rel_tol=1e-4)
    zero = t.withColumn("TARGET", F.when(F.col("CATEGORY") == "x", 0.0).otherwise(F.col("TARGET")))
    w, _, _ = generators.ipf_fit(c, ["a", "b"], zero, max_iter=3)
    assert {r.W for r in w.collect() if r.a == "x"} <= {0.0, None}


def test_matrix_raking_from_the_seed(spark):
    c = spark.createDataFrame([("a1", "s1", 5), ("a2", "s2", 5)], "a string, s string, N long")  # two cells unobserved
    t = spark.createDataFrame([("a", "a1", 30.0), ("a", "a2", 70.0), ("s", "s1", 60.0), ("s", "s2", 40.0)],
                              "FEATURE string, CATEGORY string, TARGET double")
    seed = generators.ipf_seed(c, ["a", "s"], t)
    assert seed.count() == 4 and all(25 <= r.SEED < 75 for r in seed.collect())
    m, _, done = generators.ipf_matrix(seed, "a", "s", t)
    got = {(r.a, r.s): r.W for r in m.collect()}
    assert done and math.isclose(got["a1", "s1"] + got["a1", "s2"], 30, abs_tol=1e-4)
    assert math.isclose(got["a1", "s1"] + got["a2", "s1"], 60, abs_tol=1e-4)


def test_policies(spark):
    df = spark.createDataFrame([(70, 0, 0.5, 0.5), (30, 3, 0.9, 0.05), (30, 0, 0.85, 0.2)], "age int, score int, o double, i double")
    high = [(r.o_ADJ, r.i_ADJ) for r in clean.high_risk_cohort(df, "age", "score", "o", "i").collect()]
    assert np.allclose(high, [(0.8, 0.4), (0.95, 0.01), (0.85, 0.2)])
    early = [(r.o_ADJ, r.i_ADJ) for r in clean.high_risk_cohort(df, "age", "score", "o", "i", "early").collect()]
    assert np.allclose(early, [(0.7, 0.5), (0.9, 0.05), (0.9, 0.2)])


def test_codes_from_one_stored_vocabulary(spark):
    df = spark.createDataFrame([(3, "b", "z"), (1, "a", None), (2, "b", "y")], "k long, p string, q string")
    vocab = encode.fit_vocabulary(df, ["p", "q"])
    assert {(r.COLUMN, r.CATEGORY): r.CODE for r in vocab.collect()} == {
        ("p", "a"): 0, ("p", "b"): 1, ("q", "nan"): 0, ("q", "y"): 1, ("q", "z"): 2}
    seen = encode.fit_vocabulary(df, ["p", "q"], order="first_seen", order_key="k")
    assert {(r.COLUMN, r.CATEGORY): r.CODE for r in seen.collect()} == {
        ("p", "a"): 0, ("p", "b"): 1, ("q", "nan"): 0, ("q", "y"): 1, ("q", "z"): 2}
    assert {r.p: r.CODE for r in ordering.first_seen_codes(df, "p", "k").collect()} == {"a": 0, "b": 1}


def test_label_drawn_from_class_probabilities(spark):
    df = spark.range(4000).select("id", F.array(F.lit(0.2), F.lit(0.0), F.lit(0.8)).alias("p"))
    got = generators.label_by_probability(df, "p", ["a", "b", "c"], "y", "id").groupBy("y").count().collect()
    n = {r.y: r["count"] for r in got}
    assert set(n) == {"a", "c"} and abs(n["a"] / 4000 - 0.2) < 0.03


@pytest.mark.parametrize("classes", [2, 31])
def test_boosted_stays_boosted(spark, classes):
    df = spark.createDataFrame([(i, str(i % classes), str(i % classes)) for i in range(80)], "RECORD_ID long, f string, y string")
    model, pred, _ = models.fit_predict("boosted", df, df, ["f"], "y", maxIter=2)
    assert model.kind == "booster" and model.n_classes == classes and pred.count() == 80


def test_bundle_scores_from_disk_and_beats_the_majority(spark):
    rows = [(i, "ab"[i % 2], "xyz"[i % 3], "L" + "ab"[i % 2]) for i in range(240)] + [(1000 + i, "a", "x", "La") for i in range(60)]
    df = spark.createDataFrame(rows, "RECORD_ID long, f string, g string, y string")
    model, pred, prep = models.fit_predict("random_forest", df, df, ["f", "g"], "y", numTrees=5, maxDepth=4)
    assert metrics.accuracy(pred).first()[0] > 0.95
    path = scratch_path(spark, "bundle-test")
    models.save_bundle(model, prep, path)
    back = models.score_bundle(spark, path, df.drop("y"))
    assert sorted((r.id, r.pred) for r in back.collect()) == sorted((r.id, r.pred) for r in pred.collect())


class Fitted(Exception):
    pass


@pytest.mark.parametrize("key, kind, label, size", [
    ("train_random_forest", "random_forest", "APR_MDC", {"numTrees": 200, "maxDepth": 20}),
    ("train_boosted", "boosted", "APR_MDC", {"maxIter": 300, "maxDepth": 8, "stepSize": 0.05}),
    ("feature_importance", "random_forest", "APR_MDC", {"numTrees": 200, "maxDepth": 20}),
    ("load_bundle", "random_forest", "APR_MDC", {"numTrees": 200, "maxDepth": 20}),
    ("label_by_model_probability", "random_forest", "APR_MDC", {"numTrees": 200, "maxDepth": 20}),
    ("label_by_model_argmax", "random_forest", "ICD3", {"numTrees": 300, "maxDepth": 20}),
])
def test_registered_models_have_the_reference_sizes(spark, monkeypatch, key, kind, label, size):
    from cohortforge.plans.registry import QUERIES, load_all
    load_all()
    seen = {}

    def fit(kind, train, test, features, label, **params):
        seen.update(params, kind=kind, label=label)
        raise Fitted

    monkeypatch.setattr(models, "fit_predict", fit)
    with pytest.raises(Fitted):
        QUERIES[key](spark, "/root/testdata/sf0.001")
    assert size.items() | {"kind": kind, "label": label}.items() <= seen.items()


def test_two_stages_reach_the_diagnosis_code(spark, monkeypatch):
    from cohortforge.plans.registry import QUERIES, load_all
    load_all()
    calls = []

    def fit(kind, train, test, features, label, **params):
        calls.append((kind, features[-1], label, params))
        return None, test.select(F.col("RECORD_ID").alias("id"), F.col(label).cast("string").alias("y"),
                                 F.lit("1").alias("pred"), F.array(F.lit(1.0)).alias("prob")), None

    monkeypatch.setattr(models, "fit_predict", fit)
    assert QUERIES["two_stage_model"](spark, "/root/testdata/sf0.001").columns == ["id", "y", "pred"]
    assert all(c[0] == "random_forest" and c[2:] == ("APR_MDC", {"numTrees": 200, "maxDepth": 20}) for c in calls[:3])
    assert calls[3][:3] == ("boosted", "MDC_HAT", "PRINC_DIAG_CODE")
    assert {"maxIter": 300, "maxDepth": 8, "stepSize": 0.05}.items() <= calls[3][3].items()


def test_model_select_has_three_families(spark):
    grids = models.reference_grids(1000)
    assert {k: sorted(g) for k, g in grids.items()} == {
        "boosted": ["maxIter"], "random_forest": ["maxDepth", "minSplit", "numTrees"], "logistic": ["regParam"]}
    assert grids["boosted"]["maxIter"] == grids["random_forest"]["numTrees"] == [200, 400]
    assert np.allclose(grids["logistic"]["regParam"], [0.01, 0.001, 0.0001])
    df = spark.createDataFrame([(i, "abc"[i % 3], "xy"[i % 2], "L" + "abc"[i % 3]) for i in range(90)], "RECORD_ID long, f string, g string, y string")
    small = {"boosted": {"maxIter": [1, 2]}, "random_forest": {"numTrees": [2]}, "logistic": {"regParam": [0.01]}}
    res, best, _ = models.model_select(df, ["f", "g"], "y", grids=small, folds=2)
    assert {k for k, _, _ in res} == set(grids) and len(res) == 4 and all(0 < m <= 1 for _, _, m in res)
    assert res == sorted(res, key=lambda r: -r[2]) and best is not None


def test_multinomial_draws_match_brute_force(spark):
    weights = [None if i % 7 == 0 else float(i % 4) for i in range(600)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "RECORD_ID long, w double").repartition(5)
    got = sampling.sample_weighted_replace(df, "w", 500, mode="multinomial", tag="m").collect()
    total = sum(w or 0 for w in weights)
    cum = np.cumsum([round((w or 0) * ((1 << 52) / total)) for w in weights])
    want = np.bincount(np.searchsorted(cum, [min(math.floor(py_uniform("m", i) * float(cum[-1])), cum[-1] - 1) for i in range(500)], side="right"),
                       minlength=600)
    n = np.bincount([r.RECORD_ID for r in got], minlength=600)
    assert len(got) == 500 and (n == want).all() and n.max() > 3
    assert sorted(r.DRAW for r in got if r.RECORD_ID == n.argmax()) == list(range(1, n.max() + 1))
    with pytest.raises(ValueError):
        sampling.sample_weighted_replace(df, "w", 5, mode="other")


@pytest.fixture
def extracts(tmp_path):
    for name, text in {"BASE_1.txt": "A\tB\tC\n1\t2\t3\n4\n5\t6\t7\t\n", "BASE_2.txt": "C\tX\tA\tB\n30\tx\t10\t20\n", "BASE_3.txt": "B\n7\n",
                       "BASE_4.txt": "A\tB\né\t8\t9\t9\nü\t8\n"}.items():
        (tmp_path / name).write_bytes(text.encode("latin-1"))
    return tmp_path


WANT = {("1", "2", "3"), ("4", None, None), ("10", "20", "30"), (None, "7", None), ("ü", "8", None)}


def test_tsv_columns_are_found_by_name(spark, extracts):
    got = files.scan_tsv(spark, str(extracts / "*.txt"), ["A", "B", "C"])
    assert {(r.A, r.B, r.C) for r in got.collect()} == WANT and got.count() == len(WANT)
    bad = files.bad_lines(spark, str(extracts / "*.txt"))
    assert {os.path.basename(r._file_path): r.N_BAD for r in bad.collect()} == {"BASE_1.txt": 1, "BASE_4.txt": 1}


def test_chunked_ingest_reads_the_same_rows(spark, extracts):
    out, checkpoint = scratch_path(spark, "ingest-out"), scratch_path(spark, "ingest-ckpt")
    assert chunked_ingest(spark, str(extracts), ["A", "B", "C"], out, checkpoint) == 4
    assert {(r.A, r.B, r.C) for r in spark.read.parquet(out).collect()} == WANT


def test_report_renders_every_row(spark):
    path = scratch_path(spark, "text-report")
    sinks.render_report(spark.range(1500).select("id", F.lit("x").alias("name")), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert len(lines) == 1501 and "  id  name" in lines and "1499     x" in lines
