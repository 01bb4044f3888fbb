"""Contiguous balanced shards from global byte-size prefix sums (DataFrame operations only).

Rows are put in a total order by range partitioning. Each partition's total size is summed, a running sum over those
totals gives every partition its global offset, and a running sum inside the partition gives every row its place on
the byte line [0, total). The line is cut into ``n_shards`` equal lengths; a row belongs to the cut that holds its
middle byte. Only one row per partition meets in one place.

Defined results: an empty table gives an empty result; a null text counts as no bytes and has the checksum of the empty
text; equal rows are interchangeable and each gets its own slot; all sizes zero: everything is in shard 0; a row larger than
a whole shard leaves neighbouring shards empty rather than being cut. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut_lineage, fresh, parts


def shard_by_bytes(df: DataFrame, n_shards: int, size: Column, order_by: list[str]) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 within the shard, in the total order).

    ``size`` is a non-negative long expression; ``order_by`` names the columns of the total order. The rows are checkpointed
    once, in order, so that partition numbers are facts of the stored data and not of a later run.
    """
    z, salt, part, at, row, off, first, t, n = fresh(
        df, "size", "salt", "part", "at", "row", "off", "first", "total", "rows")
    spark = df.sparkSession
    # the salt splits a run of equal rows over several partitions; it decides only among interchangeable rows
    keyed = df.withColumn(z, size).withColumn(salt, F.rand(17))
    ordered = (
        keyed.repartitionByRange(parts(spark), *order_by, z, salt)
        .sortWithinPartitions(*order_by, z, salt)
        .withColumn(part, F.spark_partition_id())
    )
    ordered = cut_lineage(ordered)
    sums = ordered.groupBy(part).agg(F.sum(z).alias(t), F.count(F.lit(1)).alias(n))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = sums.select(  # one row per partition
        F.col(part).alias(f"{part}_o"),
        F.coalesce(F.sum(t).over(before), F.lit(0)).alias(off),
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first),
        F.sum(t).over(everything).alias(t),
    )
    inside = Window.partitionBy(part).orderBy(*order_by, z, salt)
    placed = (
        ordered
        .withColumn(at, F.coalesce(F.sum(z).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn(row, F.row_number().over(inside) - 1)
        .join(bounded_broadcast(offsets), F.col(part) == F.col(f"{part}_o"))
        .withColumn(row, F.col(row) + F.col(first))
        .withColumn("shard", F.least(
            F.lit(n_shards - 1),
            F.coalesce(F.expr(f"try_divide(cast((2 * (`{at}` + `{off}`) + `{z}`) as decimal(38,0)) * {n_shards},"
                              f" cast(2 * `{t}` as decimal(38,0)))"), F.lit(0)).cast("int")))
    )
    starts = cut_lineage(placed.groupBy("shard").agg(F.min(row).alias(first)))  # n_shards rows at most
    starts = starts.select(F.col("shard").alias(f"{part}_s"), F.col(first).alias(f"{first}_s"))
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    return (
        placed.join(F.broadcast(starts), F.col("shard") == F.col(f"{part}_s"))
        .select(*[F.col(f"`{c}`") for c in keep], "shard", (F.col(row) - F.col(f"{first}_s")).alias("slot"))
    )


def shard_documents(documents: DataFrame, n_shards: int = 24, overhead: int = 8) -> DataFrame:
    """Shard assignment of ``documents`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select(
        "doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard_by_bytes(narrow, n_shards, F.col("size"), ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
