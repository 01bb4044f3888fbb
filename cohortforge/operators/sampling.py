"""Splits and samples. Every draw is u(tag, key), so membership does not depend on
partitioning or retries; ranks come from the skew-safe group_rank (no single-partition sort)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import py_uniform, uniform
from ..session import bounded_broadcast, cut_lineage
from .rowindex import BUCKET_ROWS, group_rank, in_key_order, part_offsets, with_row_index


def split_random(df: DataFrame, frac: float = 0.8, tag: str = "split", id_col: str = "RECORD_ID"):
    u = uniform(tag, id_col)
    return df.where(u < frac), df.where(u >= frac)


def split_stratified(df: DataFrame, label: str, test_frac: float = 0.25, tag: str = "strat", id_col: str = "RECORD_ID"):
    """Per class, the round(test_frac * n_y) rows with the smallest u go to test; the rest to train.
    Rows without a label are a class of their own."""
    x = df.withColumn("_u", uniform(tag, id_col))
    ranked = group_rank(x, [label], "_u", id_col, out="_rank")
    sizes = x.groupBy(F.col(label).alias("_y")).agg(F.count("*").alias("_ny"))
    quota = F.round(F.col("_ny") * F.lit(test_frac))
    r = ranked.join(sizes, F.col(label).eqNullSafe(F.col("_y")), "inner").withColumn("_test", F.col("_rank") <= quota)
    cols = df.columns
    return r.where(~F.col("_test")).select(*cols), r.where(F.col("_test")).select(*cols)


def largest_remainder(sizes: DataFrame, label: str, n: int) -> DataFrame:
    """Allocate n rows over classes proportionally (Hamilton method); ties by class. Runs on the
    class table only."""
    total = F.sum("_ny").over(Window.partitionBy())
    exact = F.col("_ny") * F.lit(n) / total
    base = sizes.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact").cast("bigint")) \
        .withColumn("_rem", F.col("_exact") - F.col("_floor"))
    left = F.lit(n) - F.sum("_floor").over(Window.partitionBy())
    order = F.row_number().over(Window.orderBy(F.col("_rem").desc(), F.col(label).asc_nulls_last()))
    return base.withColumn("_quota", F.col("_floor") + F.when(order <= left, 1).otherwise(0)).select(label, "_ny", "_quota")


def sample_stratified_n(df: DataFrame, label: str, n: int, tag: str = "stratn", id_col: str = "RECORD_ID") -> DataFrame:
    """Stratified subsample to at most n rows (unchanged when already small enough). Rows without a label
    are a class of their own."""
    x = df.withColumn("_u", uniform(tag, id_col))
    sizes = x.groupBy(label).agg(F.count("*").alias("_ny"))
    total = sizes.agg(F.sum("_ny")).first()[0] or 0
    if total <= n:
        return df
    quotas = largest_remainder(sizes, label, n).withColumnRenamed(label, "_y")
    ranked = group_rank(x, [label], "_u", id_col, out="_rank")
    return (ranked.join(quotas, F.col(label).eqNullSafe(F.col("_y")), "inner").where(F.col("_rank") <= F.col("_quota"))
            .select(*df.columns))


def sample_n(df: DataFrame, n: int, tag: str = "sample", id_col: str = "RECORD_ID", total: int | None = None) -> DataFrame:
    """min(n, len) rows without replacement: the n smallest u. Only rows below a bound on u that leaves a little
    more than n of them are ranked; should they be fewer than n, all rows are. `total`: the number of rows, if it is known."""
    x = df.withColumn("_u", uniform(tag, id_col))
    if total is None:
        total = x.count()
    if total <= n:
        return df
    near = x.where(F.col("_u") < (n + 8 * n ** 0.5 + 64) / total)
    found = near.count()
    near, found = (near, found) if found >= n else (x, total)
    r = group_rank(near, [], "_u", id_col, out="_rank", buckets=-(-found // BUCKET_ROWS) or 1, max_rank=n)
    return r.where(F.col("_rank") <= n).select(*df.columns)


def sample_frac(df: DataFrame, frac: float = 0.5, tag: str = "frac", id_col: str = "RECORD_ID") -> DataFrame:
    return df.where(uniform(tag, id_col) < frac)


def prefix_sum(df: DataFrame, key: str, value: str, out: str = "_cum") -> DataFrame:
    """Inclusive running sum of `value` in `key` order, two-level (offsets of range partitions + a window inside each)."""
    ordered = in_key_order(df, key)
    w = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return (ordered.join(bounded_broadcast(part_offsets(ordered, F.sum(value))), "_part")
            .withColumn(out, F.col("_off") + F.sum(value).over(w)).drop("_part", "_off"))


def sample_weighted_replace(df: DataFrame, weight: str, n: int | None = None, id_col: str = "RECORD_ID",
                            tag: str = "systematic", mode: str = "systematic") -> DataFrame:
    """n = min(n, len) draws with replacement, probability proportional to weight (null -> 0).

    Systematic resampling: one uniform offset u0, positions (i + u0) * W / n; row j is repeated
    floor(n*C_j/W + u0) - floor(n*C_{j-1}/W + u0) times, where C is the running weight sum in key
    order. Each row's copies are emitted locally with explode(sequence) (no range join).

    Multinomial: each draw i on its own picks the row whose range of the running sum holds u(tag, i) * W; DRAW counts
    the copies of a row from 1 as well. Ranges are cut into blocks of the mean draw distance, so a draw is an equi join
    on its block and a range test inside."""
    if mode not in ("systematic", "multinomial"):
        raise ValueError(mode)
    x = df.withColumn("_w", F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))
    stats = x.agg(F.count("*").alias("N"), F.sum("_w").alias("W")).first()
    size = int(stats["N"]) if n is None else min(int(n), int(stats["N"]))
    total = float(stats["W"] or 0.0)
    if size == 0 or total <= 0:
        return df.limit(0).withColumn("DRAW", F.lit(0))
    if mode == "multinomial":
        return _multinomial(df, x, total, size, id_col, tag)
    u0 = py_uniform(tag, 0)
    c = prefix_sum(x, id_col, "_w")
    hi = F.floor(F.lit(size) * F.col("_cum") / F.lit(total) + F.lit(u0))
    lo = F.floor(F.lit(size) * (F.col("_cum") - F.col("_w")) / F.lit(total) + F.lit(u0))
    k = F.least(hi, F.lit(size)) - F.least(lo, F.lit(size))
    return (c.withColumn("_k", k.cast("int")).where(F.col("_k") > 0)
            .select(*df.columns, F.explode(F.sequence(F.lit(1), F.col("_k"))).alias("DRAW")))


def _multinomial(df: DataFrame, x: DataFrame, total: float, size: int, id_col: str, tag: str) -> DataFrame:
    # whole units of total / 2^52, so that ranges meet without gaps at any partitioning; stored, so that equal ids keep their places
    units = x.withColumn("_w", F.round(F.col("_w") * F.lit((1 << 52) / total)).cast("long")).where(F.col("_w") > 0)
    cum = cut_lineage(prefix_sum(units, id_col, "_w").withColumn("_lo", F.col("_cum") - F.col("_w")))
    end = cum.agg(F.max("_cum")).first()[0]
    block = F.lit(-(-end // size))
    ranges = cum.select("_lo", "_cum", F.explode(F.sequence(F.floor(F.col("_lo") / block), F.floor((F.col("_cum") - 1) / block))).alias("_block"))
    at = F.least(F.floor(uniform(tag, "id") * F.lit(float(end))), F.lit(end - 1))
    draws = df.sparkSession.range(size).select(at.alias("_at")).withColumn("_block", F.floor(F.col("_at") / block))
    hit = draws.join(ranges, "_block").where((F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_cum")))
    copies = hit.groupBy("_lo").agg(F.count("*").cast("int").alias("_k"))
    return cum.join(copies, "_lo").select(*df.columns, F.explode(F.sequence(F.lit(1), F.col("_k"))).alias("DRAW"))


def sample_replace(df: DataFrame, n: int, id_col: str = "RECORD_ID", tag: str = "replace") -> DataFrame:
    """n uniform draws with replacement: draw i picks the row at position floor(u(tag, i) * N)."""
    idx = with_row_index(df, id_col, out="_pos")
    total = idx.count()
    draws = df.sparkSession.range(n).select(F.col("id").alias("DRAW"),
                                            F.floor(uniform(tag, "id") * F.lit(total)).cast("bigint").alias("_pos"))
    return draws.join(idx, "_pos", "inner").drop("_pos")
