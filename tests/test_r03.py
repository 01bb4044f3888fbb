"""Findings of round 3: the work that a step does, not its result alone."""

import numpy as np

from cohortforge.operators import boosting, forest


def cells_of(n=600, features=6, classes=5, seed=3):
    rng = np.random.default_rng(seed)
    return rng.integers(-1, 9, (n, features)).astype(np.int32), rng.integers(0, classes, n), rng.integers(1, 4, n)


def test_a_level_tries_only_the_drawn_features(monkeypatch):
    x, y, w = cells_of()
    plain, sizes = forest.thresholds, []
    monkeypatch.setattr(forest, "thresholds", lambda slot, *rest: sizes.append(len(slot)) or plain(slot, *rest))
    rules = forest.Rules(depth=4, per_split=2)
    forest.grow(x, y, w, forest.root_key(rules, 0), 0, rules)
    assert sum(sizes) <= 4 * 2 * len(y) + 1


def test_the_order_of_cells_does_not_change_a_tree():
    x, y, w = cells_of()
    rules = forest.Rules(depth=None, stop_depths=(3,), stop_weights=(4,))
    order = np.random.default_rng(0).permutation(len(y))
    a, b = (forest.grow(x[o], y[o], w[o], forest.root_key(rules, 1), 0, rules) for o in (slice(None), order))
    assert a == b


def test_the_driver_holds_stored_pieces_only(spark):
    rows = [([i % 7, i % 3], i % 4, 1) for i in range(200)]
    fitted = forest.fit_forest(spark.createDataFrame(rows, "x array<int>, y int, n long"), 2, 4, 3, forest.Rules())
    block = fitted.block(0, 3)
    assert len(block) == 3 and all(isinstance(piece, bytes) for _, _, piece in block)
    assert [t for t, _ in forest._trees(block)] == [0, 1, 2]


def test_boosting_sorts_each_feature_once():
    x, _, _ = cells_of()
    x = np.unique(x, axis=0).astype(np.int64)
    rng = np.random.default_rng(5)
    g, h = rng.normal(size=(len(x), 3)), rng.random((len(x), 3)) + 0.1
    seen, plain = [], boosting.cuts

    def cuts(slot, code, ge, he, slots, min_child, order):
        own = np.lexsort((np.arange(len(slot)), code, slot))
        seen.append(np.array_equal(own, order))
        return plain(slot, code, ge, he, slots, min_child, order)

    try:
        boosting.cuts = cuts
        boosting.grow_trees(x, g, h, np.ones((3, x.shape[1]), bool), boosting.Boost(depth=4))
    finally:
        boosting.cuts = plain
    assert len(seen) == 4 * x.shape[1] and all(seen)


def test_a_draw_is_computed_once_a_row(spark):
    from pyspark.sql import functions as F

    from cohortforge.functions.random import inverse_cdf
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        counts = rng.integers(1, 5, rng.integers(1, 70))
        rows.append((i, [f"l{j}" for j in range(len(counts))], np.cumsum(counts).tolist(), float(rng.random())))
    rows += [(300, None, None, 0.5), (301, ["a", "b"], [1, 2], None), (302, ["a"], [3], 0.0)]
    df = spark.createDataFrame(rows, "i int, cats array<string>, cum array<long>, u double")
    got = {r.i: r.l for r in df.select("i", inverse_cdf(F.col("cats"), F.col("cum"), F.col("u")).alias("l")).collect()}
    for i, cats, cum, u in rows[:300]:
        assert got[i] == cats[int(np.searchsorted(cum, int(u * cum[-1]), side="right"))]
    assert [got[i] for i in (300, 301, 302)] == [None, "a", "a"]
    plan = df.select(inverse_cdf(F.col("cats"), F.col("cum"), F.length(F.md5(F.col("u").cast("string"))) / 64.0).alias("l"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("md5(") <= 1 and "filter(" not in text


def test_small_stored_vocabularies_are_broadcast_whatever_their_estimate(spark):
    from pyspark.sql import functions as F

    from cohortforge.operators.encode import apply_vocabulary
    from cohortforge.session import DEFAULT_BROADCAST_BYTES, estimated_bytes
    vocab = spark.range(1 << 24).where("id % 8388608 = 0").select(
        F.lit("f").alias("COLUMN"), F.col("id").cast("string").alias("CATEGORY"), F.col("id").cast("int").alias("CODE"))
    assert estimated_bytes(vocab) > DEFAULT_BROADCAST_BYTES
    df = spark.range(10).select("id", (F.col("id") * 8388608).cast("string").alias("f"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = apply_vocabulary(df, vocab, ["f"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r.id: r.f for r in out.collect()} == {i: i * 8388608 if i < 2 else -1 for i in range(10)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_of_rare_items_are_not_formed(spark, monkeypatch):
    from itertools import combinations

    from cohortforge.operators import mining
    rng = np.random.default_rng(2)
    sides = []
    for seed in range(2):
        rows = [(i, sorted({f"i{v}" for v in rng.zipf(1.6, 6) if v < 40})) for i in range(300)] + [(None, ["i1", "i2"])]
        sides.append([r for r in rows if r[1]])
    want, counts = {}, []
    for rows in sides:
        n = {}
        for b, items in rows:
            for p in combinations(items, 2):
                n[p] = n.get(p, 0) + 1
        counts.append(n)
    for p in set(counts[0]) | set(counts[1]):
        if any(c.get(p, 0) >= 0.1 * len(rows) for c, rows in zip(counts, sides)):
            none = p == ("i1", "i2")  # the basket without a name is not joined
            want["|".join(p)] = tuple(round(max(0, c.get(p, 0) - none) / len(rows), 6) for c, rows in zip(counts, sides))
    frames = [spark.createDataFrame(rows, "o long, items array<string>") for rows in sides]
    monkeypatch.setattr(mining, "freq_itemsets", None)  # itemsets of other sizes are not needed
    pairs, _ = mining.comorbidity_compare(*frames, "o", 0.1)
    got = {r.ITEMS: (r.S_REAL, r.S_SYNTH) for r in pairs.collect()}
    assert len(want) > 3 and got == want


def forest_rows(spark):
    rows = [([i % 7, i % 3], i % 4, 1) for i in range(200)]
    return spark.createDataFrame(rows, "x array<int>, y int, n long")


def test_dense_and_sorted_sums_give_the_same_splits(monkeypatch):
    rng = np.random.default_rng(7)
    for i in range(40):
        n = int(rng.integers(1, 300))
        args = (np.sort(rng.integers(0, 20, n)), rng.integers(-1, 40, n), rng.integers(0, 9, n), rng.integers(1, 5 if i % 2 else 1 << 20, n), 20)
        got = []
        for dense in (0, 4, 1 << 20):
            monkeypatch.setattr(forest, "DENSE", dense)
            got.append(forest.thresholds(*args))
        for other in got[1:]:
            assert all(np.array_equal(a, b) for a, b in zip(got[0], other))


def test_cells_are_counted_once_for_all_trees(spark, monkeypatch):
    cells = forest_rows(spark)
    kind, counted = type(cells), []
    plain = kind.count
    monkeypatch.setattr(kind, "count", lambda df: counted.append(1) or plain(df))
    forest.fit_forest(cells, 2, 4, 5, forest.Rules())
    assert len(counted) == 1


def test_a_block_reads_its_own_trees_alone(spark):
    fitted = forest.fit_forest(forest_rows(spark), 2, 4, 6, forest.Rules())
    one = fitted.pieces.where("tree >= 2 and tree < 3")
    assert {r.f for r in one.selectExpr("input_file_name() f").collect()} < {r.f for r in fitted.pieces.selectExpr("input_file_name() f").collect()}
    assert "PartitionFilters: [isnotnull(tree" in one._jdf.queryExecution().executedPlan().toString()


def test_a_vector_is_scored_once_however_many_rows_hold_it(spark, monkeypatch):
    from cohortforge.operators import models

    rows = [(i, "ab"[i % 2], "xyz"[i % 3], "L" + "ab"[i % 2]) for i in range(240)]
    df = spark.createDataFrame(rows, "RECORD_ID long, f string, g string, y string")
    scored, plain = [], forest.score_vectors
    monkeypatch.setattr(forest, "score_vectors", lambda model, vectors, *rest: scored.append(vectors.count()) or plain(model, vectors, *rest))
    _, pred, _ = models.fit_predict("random_forest", df, df.union(df), ["f", "g"], "y", numTrees=3)
    got = pred.collect()
    assert scored == [6] and len(got) == 480 and all(r.pred == r.y and abs(sum(r.prob) - 1) < 1e-12 for r in got)


def test_a_round_sends_its_margins_alone_and_drops_them(spark, monkeypatch):
    from pyspark import Broadcast, SparkContext

    sent, gone = [], []
    send, drop = SparkContext.broadcast, Broadcast.destroy
    monkeypatch.setattr(SparkContext, "broadcast", lambda sc, value: sent.append(type(value)) or send(sc, value))
    monkeypatch.setattr(Broadcast, "destroy", lambda held, *rest: gone.append(1) or drop(held, *rest))
    boosting.fit_boosted(forest_rows(spark), 2, 4, boosting.Boost(rounds=4, depth=2))
    assert sent.count(boosting._State) == 1 and sent.count(np.ndarray) == 4 and len(gone) == 5
