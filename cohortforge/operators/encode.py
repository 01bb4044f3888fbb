"""Encoders and feature preparation.

A vocabulary is a long DataFrame (COLUMN, CATEGORY, CODE): one unpivot + distinct, then positions over range
partitions of the distinct values (no task holds all values of a column), stored once. Applying it is one
left join per column against that column's slice (broadcast while the slices' measured sizes are small, else a shuffle join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import DEFAULT_BROADCAST_BYTES, bounded_broadcast, cut_lineage
from .rowindex import with_row_index

NULL_TOKEN = "nan"


def _as_category(c: str, null_token: str | None) -> F.Column:
    s = F.col(c).cast("string")
    return F.coalesce(s, F.lit(null_token)) if null_token is not None else s


def _stack(df: DataFrame, cols: Sequence[str], null_token: str | None) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("COLUMN"), _as_category(c, null_token).alias("CATEGORY")) for c in cols])
    return df.select(F.explode(arr).alias("_s")).select("_s.*").where(F.col("CATEGORY").isNotNull())


def fit_vocabulary(frames: DataFrame | Sequence[DataFrame], cols: Sequence[str], null_token: str | None = NULL_TOKEN,
                   order: str = "lexical", order_key: str | None = None) -> DataFrame:
    """Codes 0..K-1 per column. order='lexical' sorts categories (code-point order, like sorted str);
    order='first_seen' numbers them by the smallest `order_key` where they occur (factorize)."""
    frames = [frames] if isinstance(frames, DataFrame) else list(frames)
    if order == "first_seen":
        parts = [f.select(*[_as_category(c, null_token).alias(c) for c in cols], F.col(order_key).alias("_key"))
                 for f in frames]
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
        arr = F.array(*[F.struct(F.lit(c).alias("COLUMN"), F.col(c).alias("CATEGORY")) for c in cols])
        long = u.select(F.explode(arr).alias("_s"), "_key").select("_s.*", "_key").where(F.col("CATEGORY").isNotNull())
        d = long.groupBy("COLUMN", "CATEGORY").agg(F.min("_key").alias("_first"))
        return _numbered(d, "_first", "CATEGORY")
    u = None
    for f in frames:
        s = _stack(f, cols, null_token)
        u = s if u is None else u.unionByName(s)
    return _numbered(u.distinct(), "CATEGORY")


def _numbered(values: DataFrame, *order: str) -> DataFrame:
    """CODE = position within COLUMN by ``order``: the position over all columns less that of the column's first value."""
    placed = cut_lineage(with_row_index(values, "COLUMN", *order))
    first = placed.groupBy("COLUMN").agg(F.min("_idx").alias("_start"))  # one row per column
    coded = placed.join(bounded_broadcast(first), "COLUMN")
    return cut_lineage(coded.select("COLUMN", "CATEGORY", (F.col("_idx") - F.col("_start")).cast("int").alias("CODE")))


def apply_vocabulary(df: DataFrame, vocab: DataFrame, cols: Sequence[str], unseen: int | None = -1,
                     null_token: str | None = NULL_TOKEN, suffix: str = "") -> DataFrame:
    """Replace each column by its code; unseen categories -> `unseen` (None keeps null)."""
    # a stored vocabulary keeps the estimate of the frame that it was fitted on: its columns are measured (a row per column)
    sizes = dict(vocab.where(F.col("COLUMN").isin(list(cols))).groupBy("COLUMN").agg(
        F.sum(F.coalesce(F.octet_length("CATEGORY"), F.lit(0)) + 64)).collect())
    out, sent = df, 0
    for c in cols:
        v = vocab.where(F.col("COLUMN") == c).select(F.col("CATEGORY").alias(f"_cat_{c}"), F.col("CODE").alias(f"_code_{c}"))
        if sent + sizes.get(c, 0) <= DEFAULT_BROADCAST_BYTES:  # all columns together: they are joined in one pass
            v, sent = F.broadcast(v), sent + sizes.get(c, 0)
        out = out.withColumn(f"_cat_{c}", _as_category(c, null_token)).join(v, f"_cat_{c}", "left")
        code = F.col(f"_code_{c}")
        if unseen is not None:
            code = F.coalesce(code, F.lit(unseen))
        out = out.withColumn(c + suffix, code.cast("int")).drop(f"_cat_{c}", f"_code_{c}")
    return out


def label_encode(df: DataFrame, cols: Sequence[str], null_token: str | None = NULL_TOKEN) -> DataFrame:
    vocab = fit_vocabulary(df, cols, null_token)
    return apply_vocabulary(df, vocab, cols, unseen=-1, null_token=null_token)


def category_codes(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Codes for the remaining string columns (null -> -1)."""
    cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name not in set(exclude)]
    vocab = fit_vocabulary(df, cols, null_token=None)
    return apply_vocabulary(df, vocab, cols, unseen=-1, null_token=None)


def standardize_fit(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One-row (mean, population std) per column; zero variance -> scale 1."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return train.agg(*aggs)


def standardize_apply(df: DataFrame, stats_row, cols: Sequence[str]) -> DataFrame:
    out = df
    for c in cols:
        mean = stats_row[f"{c}__mean"]
        std = stats_row[f"{c}__std"]
        scale = std if std not in (None, 0, 0.0) else 1.0
        out = out.withColumn(c, (F.col(c) - F.lit(mean)) / F.lit(scale))
    return out


def standardize(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str]) -> list[DataFrame]:
    """Fit on train (one aggregated row read on the driver), apply to train and the other frames."""
    row = standardize_fit(train, cols).first()
    return [standardize_apply(f, row, cols) for f in [train, *others]]


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features", fill: float = -1.0) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    filled = df.select(*[c for c in df.columns if c not in cols],
                       *[F.coalesce(F.col(c).cast("double"), F.lit(fill)).alias(c) for c in cols])
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(filled)


def pca_project(df: DataFrame, cols: Sequence[str], k: int = 7, center: bool = True):
    """PCA on the numeric feature columns; returns (projected frame, explained variance ratios)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array
    x = df
    if center:
        means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
        x = df.select(*[c for c in df.columns if c not in cols], *[(F.col(c) - F.lit(means[c])).alias(c) for c in cols])
    a = assemble(x, cols, "_features", fill=0.0)
    model = PCA(k=k, inputCol="_features", outputCol="_pca").fit(a)
    proj = model.transform(a).withColumn("_pc", vector_to_array("_pca"))
    proj = proj.select(*[c for c in df.columns if c not in cols], *[F.col("_pc")[i].alias(f"PC{i + 1}") for i in range(k)])
    return proj, list(model.explainedVariance.toArray())
