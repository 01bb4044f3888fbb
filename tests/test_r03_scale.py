"""Fan-out join and privacy distances: work is cut by the rows that come out, and the data is read a bounded number of times."""

from pyspark.sql import functions as F

from cohortforge.operators import joins, neighbors, privacy


def test_fanout_tasks_follow_the_result(spark):
    side = spark.range(4000).selectExpr("id RECORD_ID", "concat('k', id % 40) K", "id V")
    for chunk_rows in (4096, 30):  # all keys plain, all keys cut into chunks
        got = joins.join_pool_fanout(side.drop("V"), side, ["K"], ["V"], chunk_rows=chunk_rows, task_rows=2000)
        assert got.count() == 40 * 100 * 100
        # 400,000 rows from a few KB: 200 tasks by the counts, where the input's size asks for one
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 25


def test_pool_entries_without_a_window(spark):
    rows = [(5, 1.0, "b"), (None, 1.0, "a"), (3, 2.0, "d"), (3, 2.0, "c"), (9, 2.0, "a"), (1, None, "a"), (4, 3.0, None)]
    pool = spark.createDataFrame(rows, "i long, x double, l string")
    for label, want in ((None, [(1.0, None, None, 2), (2.0, 3, None, 3), (3.0, 4, None, 1)]),
                        ("l", [(1.0, None, "a", 2), (2.0, 3, "c", 3), (3.0, 4, None, 1)])):
        got = neighbors.pool_entries(pool, ["x"], "i", label, 1)
        assert sorted(map(tuple, got.select("x", "_pid", "_plab", "_pmult").collect())) == want
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_privacy_report_reads_its_tables_few_times(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        reads.add(1)
        return float(x)

    def side(first, n, step):
        return spark.range(first, first + n).select(F.col("id").alias("RECORD_ID"), seen((F.col("id") * step) % 23).alias("A"),
                                                    (F.col("id") % 7).cast("double").alias("B"))
    train, synth, test = side(0, 400, 5), side(1000, 200, 3), side(2000, 100, 11)
    got = privacy.privacy_report(train, synth, test, ["A", "B"]).first()
    assert 0 <= got.privacy_score <= 100
    assert reads.value <= 5 * 700  # 7,092 when the samples were drawn anew for each use and the entries for each search


def test_mia_auc_with_repeated_and_null_ids(spark):
    # labels are joined by id: two rows of an id meet twice each, rows without an id drop out
    def side(rows):
        return spark.createDataFrame(rows, "RECORD_ID long, A double")
    train = side([(1, 0.0), (1, 4.0), (2, 1.0), (None, 9.0)])
    test, synth = side([(11, 2.0), (12, 7.0), (12, 3.0), (None, 5.0)]), side([(21, 0.0), (22, 6.0)])
    near = lambda a: -min(abs(a), abs(a - 6.0))
    pos, neg = [near(0.0), near(4.0)] * 2 + [near(1.0)], [near(2.0)] + [near(7.0), near(3.0)] * 2
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    got = privacy.mia_distance_auc(train, test, synth, ["A"]).first()
    assert (got.AUC, got.N_POS, got.N_NEG) == (round(wins / 25, 6), 5, 5)
