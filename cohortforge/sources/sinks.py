"""Sinks: Parquet and CSV writers, JDBC writer options, metric reports."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import estimated_bytes

TARGET_FILE_BYTES = 200 * 1024 * 1024


def write_parquet(df: DataFrame, path: str, target_bytes: int = TARGET_FILE_BYTES, partition_by: str | None = None) -> None:
    """Snappy Parquet with files of about `target_bytes`: a REBALANCE hint lets AQE split or merge
    shuffle partitions to the advisory size at run time (no driver-side count)."""
    spark = df.sparkSession
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    previous = spark.conf.get(key, None)
    spark.conf.set(key, str(target_bytes))
    try:
        out = df.hint("rebalance", partition_by) if partition_by else df.hint("rebalance")
        w = out.write.mode("overwrite").option("compression", "snappy")
        if partition_by:
            w = w.partitionBy(partition_by)
        w.parquet(path)
    finally:
        if previous is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, previous)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def jdbc_writer(df: DataFrame, url: str, table: str, user_env: str = "DB_USER", password_env: str = "DB_PASSWORD",
                batchsize: int = 10000, num_partitions: int | None = None):
    """A configured DataFrameWriter for a JDBC bulk load; credentials come from the environment.
    Returned unexecuted (call .save()); no database is contacted here."""
    opts: Mapping[str, str] = {"url": url, "dbtable": table, "batchsize": str(batchsize),
                               "user": os.environ.get(user_env, ""), "password": os.environ.get(password_env, "")}
    src = df.repartition(num_partitions) if num_partitions else df
    w = src.write.format("jdbc").mode("append")
    for k, v in opts.items():
        w = w.option(k, v)
    return w


def write_report(df: DataFrame, path: str) -> None:
    """A metric frame (one row per class or feature) as CSV with a header, in as many files as it has partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)


def render_report(df: DataFrame, path: str) -> None:
    """A report frame as fixed-width text under ``path``: widths come from one aggregate, every row is rendered by Spark."""
    cols = df.columns
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols])
    w = text.agg(*[F.coalesce(F.max(F.length(c)), F.lit(0)).alias(c) for c in cols]).first()
    line = lambda cells: F.concat_ws("  ", *[F.lpad(x, max(w[c], len(c)), " ") for c, x in zip(cols, cells)])
    head = df.sparkSession.range(1).select(line([F.lit(c) for c in cols]).alias("value"))
    head.union(text.select(line([F.col(c) for c in cols]))).write.mode("overwrite").text(path)


def audit_removed(df: DataFrame, kept_labels: DataFrame, label: str, reason: str) -> DataFrame:
    """Rows whose label is not among `kept_labels`, with a reason column."""
    return df.join(kept_labels.select(label).distinct(), label, "left_anti").withColumn("reason", F.lit(reason))


def profile_counts(df: DataFrame, name: str):
    """Attach a row-count observation to a plan (no extra pass); read `obs.get` after an action."""
    from pyspark.sql import Observation
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs
