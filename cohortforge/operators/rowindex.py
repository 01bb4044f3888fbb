"""Dense, deterministic row index (0..N-1 in key order) without a single-partition window.

Two-level prefix sum: rows are range partitioned by the key (bounds from the data itself, so neither outlying nor
clustered keys fill one partition) and stored once with their partition number; partition sizes come from one
partial/final aggregate, their offsets from a window over one row per partition, and the rank inside a partition
from a window partitioned by that number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast, cut_lineage

#: Rows that one in-bucket window should see on average.
BUCKET_ROWS = 1 << 16


def in_key_order(df: DataFrame, *keys: str, part: str = "_part") -> DataFrame:
    """``df`` stored in range partitions of ``keys``, with the partition's number (ascending with the keys)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(n, *keys).withColumn(part, F.spark_partition_id()))


def part_offsets(ordered: DataFrame, amount, part: str = "_part", out: str = "_off") -> DataFrame:
    """Per partition number, the sum of ``amount`` over all partitions before it (one row per partition)."""
    sums = ordered.groupBy(part).agg(amount.alias("_s"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(part, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias(out))


def with_row_index(df: DataFrame, *keys: str, out: str = "_idx") -> DataFrame:
    """Add `out` = 0-based position of each row when ordered by `keys`, unique together (nulls first)."""
    ordered = in_key_order(df, *keys)
    ranked = ordered.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    return (ranked.join(bounded_broadcast(part_offsets(ordered, F.count(F.lit(1)))), "_part")
            .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("bigint"))
            .drop("_part", "_off", "_rn"))


def group_rank(df: DataFrame, keys, u_col: str, tie: str, out: str = "_rank", buckets: int | None = None,
               max_rank=None) -> DataFrame:
    """1-based rank of each row within `keys` ordered by (u_col, tie), where u_col is in [0, 1).

    Equivalent to row_number() over (partition by keys order by u, tie) but skew-safe: rows are
    split into `buckets` order-preserving sub-groups floor(u*buckets); sub-group sizes come from a
    partial/final aggregate, their offsets from a window over at most `buckets` rows per key, and the
    in-bucket position from a window partitioned by (keys, bucket). By default there is a bucket per
    BUCKET_ROWS rows (one count), so a key holding a third of all rows is ranked by many tasks at any
    size. Null keys form a group. With `max_rank`, buckets that start beyond it are pruned
    before the row-level window (cheap top-k / sample-n). `max_rank` may be a column of the offset
    table's keys (e.g. a per-key quota) or an int.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if buckets is None:
        buckets = -(-df.count() // BUCKET_ROWS) or 1
    b = F.least(F.floor(F.col(u_col) * buckets), F.lit(buckets - 1)).cast("int")
    keyed = df.withColumn("_b", b)
    sizes = keyed.groupBy(*keys, "_b").agg(F.count("*").alias("_bn"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_b")
    offsets = sizes.select(*keys, "_b", (F.sum("_bn").over(w) - F.col("_bn")).alias("_off"))
    if max_rank is not None:
        limit = max_rank if not isinstance(max_rank, int) else F.lit(max_rank)
        if isinstance(max_rank, int):
            offsets = offsets.where(F.col("_off") < limit)
    names = {k: f"_o{i}" for i, k in enumerate([*keys, "_b"])}
    offsets = offsets.select(*[F.col(k).alias(n) for k, n in names.items()], "_off")
    joined = keyed.join(offsets, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], "inner").drop(*names.values())
    rn = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(u_col, tie))
    return joined.withColumn(out, (F.col("_off") + rn).cast("bigint")).drop("_b", "_off")


def top_k_per_group(df: DataFrame, keys, order_col: str, tie: str, k: int, out: str = "_rank") -> DataFrame:
    """Rows with the k smallest `order_col` (in [0,1)) per group, skew-safe (see group_rank)."""
    r = group_rank(df, keys, order_col, tie, out=out, max_rank=k)
    return r.where(F.col(out) <= k)


def k_smallest_per_group(df: DataFrame, keys, order_cols, k: int, salt_of: str, salts: int | None = None,
                         out: str = "_rank") -> DataFrame:
    """The k rows with the smallest `order_cols` per group, for arbitrary (non-uniform) order values.

    Two stages: rank within (keys, salt) sub-groups (salt = hash of `salt_of` mod `salts`) and keep
    k, then rank the at most k*salts survivors per group. A hot group is ranked by `salts` tasks
    and only k*salts of its rows ever meet in one task. By default there is a salt per BUCKET_ROWS rows."""
    if salts is None:
        salts = -(-df.count() // BUCKET_ROWS) or 1
    keys = [keys] if isinstance(keys, str) else list(keys)
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_of)), F.lit(salts)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order_cols)
    s1 = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(*order_cols)
    return s1.withColumn(out, F.row_number().over(w2)).where(F.col(out) <= k)
