"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_broadcast, cut_lineage, ensure_checkpoint_dir, scratch_path, table_path

__all__ = ["bounded_broadcast", "counted_broadcast", "cut_lineage", "ensure_checkpoint_dir", "scratch_path", "read", "written",
           "fold_of", "fresh", "WORD", "parts"]

#: The words of the contracts, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: the rows are fixed from then on,
    and a lost executor costs no recomputation of what is above."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; -1 for a null key, which is in no held-out fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds, F.lit(-1))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, so that extra columns never clash with working ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def counted_broadcast(stored: DataFrame, most_rows: int = 1 << 20) -> DataFrame:
    """A broadcast hint for a stored table of a few short columns if it has ``most_rows`` at most, else the table as it is
    (a checkpoint keeps the size estimate of the plan above it, so its rows are counted)."""
    return F.broadcast(stored) if stored.count() <= most_rows else stored
