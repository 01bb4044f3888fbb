"""Aggregations. Everything is a partial/final hash aggregate; windows run only over
already-aggregated category tables (size bounded by the category domain, not by rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.divergence import r6
from ..session import bounded_broadcast


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(col, count) with nulls dropped, most frequent first."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("count"))
            .orderBy(F.col("count").desc(), F.col(col)))


def value_shares(df: DataFrame, col: str) -> DataFrame:
    c = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("count"))
    return c.select(col, "count", r6(F.col("count") / F.sum("count").over(Window.partitionBy())).alias("share"))


def group_weight_sum(df: DataFrame, keys: str | Sequence[str], weight: str) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(r6(F.sum(weight)).alias("weight"))


def dup_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and duplicated rows (rows - distinct), one row."""
    d = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return d.agg(F.sum("_n").alias("N_ROWS"), F.count("*").alias("N_DISTINCT"),
                 (F.sum("_n") - F.count("*")).alias("N_DUPLICATED"))


def nunique(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct non-null values per column, as (COLUMN, NUNIQUE) rows, one pass."""
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("COLUMN"), F.col(c).cast("string").alias("VALUE")) for c in cols]))
    return (df.select(stack.alias("_s")).select("_s.*").where(F.col("VALUE").isNotNull())
            .groupBy("COLUMN", "VALUE").agg(F.count("*").alias("_n"))
            .groupBy("COLUMN").agg(F.count("*").alias("NUNIQUE")))


def crosstab_long(df: DataFrame, row: str, col: str) -> DataFrame:
    """Complete (row, col) grid of counts with zeros, long form; the column domain is what the data holds. Everything after
    the grouped count runs on the count table: each row's counts become a map that is read at every column of the domain."""
    counts = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    domain = F.collect_set(col).over(Window.partitionBy())
    per_row = counts.withColumn("_all", domain).groupBy(row).agg(
        F.first("_all").alias("_all"), F.map_from_entries(F.collect_list(F.struct(col, "n"))).alias("_n"))
    rows = df.where(F.col(row).isNotNull()).select(row).distinct()  # rows whose column is always null still show zeros
    per_row = rows.join(per_row, row, "left").withColumn("_all", F.coalesce("_all", F.first("_all", ignorenulls=True).over(
        Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return per_row.select(row, F.explode("_all").alias(col), "_n").select(
        row, col, F.coalesce(F.try_element_at("_n", F.col(col)), F.lit(0)).alias("n"))


def crosstab_rownorm(df: DataFrame, row: str, col: str, digits: int | None = 6) -> DataFrame:
    g = crosstab_long(df, row, col)
    tot = F.sum("n").over(Window.partitionBy(row))
    share = F.when(tot > 0, F.col("n") / tot)
    return g.select(row, col, "n", (F.round(share, digits) if digits is not None else share).alias("share"))


def crosstab_truncate(ct: DataFrame, row: str, col: str, keep_rows: int = 2, keep_cols: int = 2) -> DataFrame:
    """Keep the first `keep_rows` rows and `keep_cols` columns (by sorted key) of a long crosstab."""
    rr = F.dense_rank().over(Window.orderBy(row))
    cr = F.dense_rank().over(Window.orderBy(col))
    return ct.withColumn("_r", rr).withColumn("_c", cr).where((F.col("_r") <= keep_rows) & (F.col("_c") <= keep_cols)) \
        .drop("_r", "_c")


def pivot_matrix(long: DataFrame, row: str, col: str, value: str, name) -> DataFrame:
    """Wide form with one column per value that the data holds (Spark's pivot reads the domain); `name` maps a value, as a
    string, to its column's name."""
    wide = long.where(F.col(col).isNotNull()).groupBy(row).pivot(col).agg(F.first(value))
    return wide.toDF(row, *[name(c) for c in wide.columns[1:]])


def mean_percentile(df: DataFrame, keys: Sequence[str], value: str, flag: str, q: float = 0.05) -> DataFrame:
    """Mean, q-th percentile (linear interpolation, exact) and mean of a boolean flag.

    The percentile is read from the (keys, value) count table: its running count per key tells which values hold the two
    ranks around q * (n - 1), so no aggregation buffer gathers a group's values."""
    stats = df.groupBy(*keys).agg(
        r6(F.avg(value)).alias("MEAN"), r6(F.avg(F.col(flag).cast("double"))).alias("FLAG_RATE"),
        (F.lit(q) * (F.count(value) - 1)).alias("_at"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    cum = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    j = counts.withColumn("_cum", cum).join(bounded_broadcast(stats.select(*keys, "_at")), list(keys))
    low, high = F.floor("_at"), F.ceil("_at")
    p = j.groupBy(*keys).agg(F.min(F.when(F.col("_cum") > low, F.col("_v"))).alias("_a"),
                             F.min(F.when(F.col("_cum") > high, F.col("_v"))).alias("_b"), F.first("_at").alias("_at"))
    p = p.select(*keys, r6(F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).alias("P05"))
    return stats.join(p, list(keys), "left").select(*keys, "MEAN", "P05", "FLAG_RATE")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))


def min_count_classes(a: DataFrame, b: DataFrame, label: str, min_count: int = 2) -> DataFrame:
    """Classes with at least `min_count` rows in both frames."""
    ca = class_counts(a, label).where(F.col("n") >= min_count).select(label, F.col("n").alias("N_A"))
    cb = class_counts(b, label).where(F.col("n") >= min_count).select(label, F.col("n").alias("N_B"))
    return ca.join(cb, label, "inner")


def cumulative_share(df: DataFrame, label: str) -> DataFrame:
    """Class table with share and cumulative share in descending frequency order (ties: label asc).
    The window runs over the class table (one row per class)."""
    c = class_counts(df, label)
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    w = Window.orderBy(F.col("n").desc(), F.col(label)).rowsBetween(Window.unboundedPreceding, 0)
    return c.withColumn("share", share).withColumn("cum_share", F.sum("share").over(w))


def cum_coverage_classes(df: DataFrame, label: str, threshold: float = 0.7) -> DataFrame:
    """Most frequent classes until the cumulative share reaches the threshold (boundary included)."""
    cs = cumulative_share(df, label)
    return cs.where(F.col("cum_share") - F.col("share") < F.lit(threshold) - F.lit(1e-12))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("COLUMN"), F.col(c).alias("N_NULL")) for c in cols]))
                      .alias("_s")).select("_s.*")


def label_coverage(train: DataFrame, test: DataFrame, label: str, examples: int = 20) -> DataFrame:
    """Distinct test labels unseen in train: count, fraction of distinct test labels, examples."""
    tl = test.where(F.col(label).isNotNull()).select(label).distinct()
    unseen = tl.join(train.select(label).distinct(), label, "left_anti")
    n_test = tl.agg(F.count("*").alias("N_TEST_LABELS"))
    n_unseen = unseen.agg(F.count("*").alias("N_UNSEEN"))
    ex = unseen.orderBy(label).limit(examples).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(label)), lambda x: x.cast("string")), ",").alias("EXAMPLES"))
    return combine_rows(n_test, n_unseen, ex).select(
        "N_UNSEEN", "N_TEST_LABELS", F.round(F.col("N_UNSEEN") / F.col("N_TEST_LABELS"), 6).alias("FRACTION"), "EXAMPLES")


def bincount_smoothed(a: DataFrame, b: DataFrame, label: str, eps: float = 1e-9) -> DataFrame:
    """Aligned class shares of both sides after adding eps to each count (for smoothed JS)."""
    from .joins import outer_align
    al = outer_align(a, b, label)
    pa = F.col("N_A") + F.lit(eps)
    pb = F.col("N_B") + F.lit(eps)
    all_ = Window.partitionBy()
    return al.select(label, (pa / F.sum(pa).over(all_)).alias("P_A"), (pb / F.sum(pb).over(all_)).alias("P_B"))


def histogram_density(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram between min and max (right edge in the last bin), as density."""
    mm = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).first()
    lo, hi, n = float(mm["lo"]), float(mm["hi"]), int(mm["n"])
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(value) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (df.where(F.col(value).isNotNull()).groupBy(b.alias("BIN")).agg(F.count("*").alias("N"))
            .select("BIN", "N", r6(F.lit(lo) + F.col("BIN") * F.lit(width)).alias("LEFT"),
                    r6(F.col("N") / (F.lit(n) * F.lit(width))).alias("DENSITY")))


def group_sample_list(df: DataFrame, group: str, value: str, k: int = 5, tag: str = "gsl", id_col: str = "RECORD_ID") -> DataFrame:
    """Per group up to k values drawn without replacement by hash order, as a sorted '|'-joined list.
    Ranking is skew-safe (group_rank), and only k rows per group are ever gathered."""
    from ..functions.random import uniform
    from .rowindex import top_k_per_group
    s = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(
        group, value, id_col, uniform(tag, id_col).alias("_u"))
    top = top_k_per_group(s, [group], "_u", id_col, k)
    return top.groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(F.col(value).cast("string"))), "|").alias("SAMPLE"))


def state_counts(df: DataFrame, step: str, state: str) -> DataFrame:
    return df.groupBy(step, state).agg(F.count("*").alias("N"))


def combine_rows(*frames: DataFrame) -> DataFrame:
    """Put the columns of several one-row frames (global aggregates) side by side without a join:
    each frame becomes one struct in a union of single rows, and one final aggregate picks them up.
    Column names must be distinct across frames."""
    names = [f"_r{i}" for i in range(len(frames))]
    parts = []
    for i, f in enumerate(frames):
        cols = [F.struct(*[F.col(c) for c in f.columns]).alias(n) if j == i else F.lit(None).alias(n)
                for j, n in enumerate(names)]
        parts.append(f.select(*cols))
    u = parts[0]
    for p in parts[1:]:
        u = u.union(p)
    row = u.agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])
    return row.select(*[F.col(f"{n}.{c}").alias(c) for n, f in zip(names, frames) for c in f.columns])
