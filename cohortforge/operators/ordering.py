"""Window, sort, limit and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import class_counts
from .rowindex import with_row_index


def dense_label_codes(df: DataFrame, label: str, code: str = "CODE") -> DataFrame:
    """Sorted distinct labels -> 0..N-1 (positions over range partitions of the distinct labels)."""
    d = df.where(F.col(label).isNotNull()).select(label).distinct()
    return with_row_index(d, label).select(label, F.col("_idx").cast("int").alias(code))


def first_seen_codes(df: DataFrame, label: str, order_key: str, code: str = "CODE") -> DataFrame:
    """Codes by first appearance (pandas factorize): order distinct labels by their first row key."""
    first = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(order_key).alias("_first"))
    return with_row_index(first, "_first", label).select(label, F.col("_idx").cast("int").alias(code))


def head_classes(df: DataFrame, label: str, n: int) -> DataFrame:
    """Top-n most frequent classes (TakeOrdered over the class table)."""
    return class_counts(df, label).orderBy(F.col("n").desc(), F.col(label)).limit(n)


def tail_classes(df: DataFrame, label: str, n: int) -> DataFrame:
    """Bottom-n classes in the same order (least frequent last)."""
    return class_counts(df, label).orderBy(F.col("n").asc(), F.col(label).desc()).limit(n)


def sort_report(df: DataFrame, by: Sequence, ascending: bool | Sequence[bool] = True) -> DataFrame:
    return df.orderBy(*by, ascending=ascending)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def intersect_labels(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    return a.select(label).where(F.col(label).isNotNull()).intersect(b.select(label))


def except_labels(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    return a.select(label).where(F.col(label).isNotNull()).subtract(b.select(label))


def union_domain(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    return a.select(label).union(b.select(label)).where(F.col(label).isNotNull()).distinct()
