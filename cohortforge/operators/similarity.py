"""Distribution similarity between a real and a synthetic table.

All variants reduce to one plan: tag rows by side, union, one grouped count per
(group..., category) with partial aggregation (so a hot group costs one partial row per map task
and category), then a window over the small (group x category) table for the per-group shares and
a final per-group sum of Jensen-Shannon terms. No per-group driver loop, no per-group collect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.divergence import js_term, r6, similarity_from_distance


def side_counts(real: DataFrame, synth: DataFrame, keys: Sequence[str], cat: str) -> DataFrame:
    """(keys..., cat, n_real, n_synth) counts over both tables with one shuffle.

    Null categories are kept (group sizes count them); rows with a null group key are dropped.
    """
    keys = list(keys)
    sel = [*keys, F.col(cat).alias("_cat")]
    tagged = real.select(*sel, F.lit(True).alias("_is_real")).unionByName(
        synth.select(*sel, F.lit(False).alias("_is_real")))
    for k in keys:
        tagged = tagged.where(F.col(k).isNotNull())
    return tagged.groupBy(*keys, "_cat").agg(
        F.count_if(F.col("_is_real")).alias("n_real"),
        F.count_if(~F.col("_is_real")).alias("n_synth"),
    )


def js_from_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: JS distance of the normalized non-null category shares + group sizes.

    Returns keys..., js (null when a side has no non-null category), N_real, N_synth.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    known = F.col("_cat").isNotNull()
    c = counts.select(
        *keys, "_cat", "n_real", "n_synth",
        F.sum(F.when(known, F.col("n_real"))).over(w).alias("_R"),
        F.sum(F.when(known, F.col("n_synth"))).over(w).alias("_S"),
    )
    # groups present on one side only have a zero total on the other: null share, no ANSI error
    p = F.try_divide(F.col("n_real"), F.col("_R"))
    q = F.try_divide(F.col("n_synth"), F.col("_S"))
    agg = c.groupBy(*keys).agg(
        F.sum(F.when(known, js_term(p, q))).alias("_js2"),
        F.max("_R").alias("_R"), F.max("_S").alias("_S"),
        F.sum("n_real").alias("N_real"), F.sum("n_synth").alias("N_synth"),
    )
    js = F.when((F.col("_R") > 0) & (F.col("_S") > 0), F.sqrt(F.greatest(F.col("_js2"), F.lit(0.0))))
    return agg.select(*keys, js.alias("js"), "N_real", "N_synth")


def js_by_group(real: DataFrame, synth: DataFrame, group_cols: str | Sequence[str], cat: str = "APR_MDC") -> DataFrame:
    """Group report: JS_similarity, JS_divergence, N_real, N_synth, TOTAL, PERCENTAGE per group
    present in both tables (sizes include rows with a null category)."""
    keys = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    per = js_from_counts(side_counts(real, synth, keys, cat), keys)
    per = per.where((F.col("N_real") > 0) & (F.col("N_synth") > 0))
    total = F.col("N_real") + F.col("N_synth")
    # The grand total is a sum over the (already small) per-group result.
    out = per.select(*keys, "js", "N_real", "N_synth", total.alias("TOTAL"))
    grand = F.sum("TOTAL").over(Window.partitionBy())
    return out.select(
        *keys,
        r6(similarity_from_distance(F.col("js"))).alias("JS_similarity"),
        r6(F.col("js")).alias("JS_divergence"),
        "N_real", "N_synth", "TOTAL",
        r6(F.col("TOTAL") / grand).alias("PERCENTAGE"),
    )


def stack_features(df: DataFrame, cols: Sequence[str], feature: str = "FEATURE", value: str = "CATEGORY") -> DataFrame:
    """Unpivot columns to (FEATURE, CATEGORY) rows as strings (nulls kept as null categories)."""
    arr = F.array(*[F.struct(F.lit(c).alias(feature), F.col(c).cast("string").alias(value)) for c in cols])
    return df.select(F.explode(arr).alias("_s")).select("_s.*")


def js_report(real: DataFrame, synth: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Similarity per feature for several columns at once: one unpivot, one shuffle for all features."""
    a = stack_features(real, cols)
    b = stack_features(synth, cols)
    per = js_from_counts(side_counts(a, b, ["FEATURE"], "CATEGORY"), ["FEATURE"])
    return per.select(F.col("FEATURE").alias("Feature"), r6(similarity_from_distance(F.col("js"))).alias("Similarity"))


def js_similarity(real: DataFrame, synth: DataFrame, col: str) -> DataFrame:
    return js_report(real, synth, [col])


def js_cell_matrix(real: DataFrame, synth: DataFrame, row: str, col: str) -> DataFrame:
    """Per crosstab cell: row-normalized share p (real) and q (synth); JS similarity (1 - JS) * 100 of (p, 1-p) and (q, 1-q)."""
    from .aggregates import crosstab_rownorm
    a = crosstab_rownorm(real, row, col, None).select(row, col, F.col("share").alias("P"))
    b = crosstab_rownorm(synth, row, col, None).select(row, col, F.col("share").alias("Q"))
    j = a.join(b, [row, col], "full").na.fill(0.0, subset=["P", "Q"])
    p, q = F.col("P"), F.col("Q")
    js = F.sqrt(js_term(p, q) + js_term(F.lit(1.0) - p, F.lit(1.0) - q))
    return j.select(row, col, r6(p).alias("P"), r6(q).alias("Q"), r6(similarity_from_distance(js)).alias("JS_SIMILARITY"))


def js_smoothed(real: DataFrame, synth: DataFrame, col: str, eps: float = 1e-9) -> DataFrame:
    """1 - JS distance of class shares after adding eps to each aligned count (one row)."""
    from .aggregates import bincount_smoothed
    b = bincount_smoothed(real, synth, col, eps)
    return b.agg(r6(F.lit(1.0) - F.sqrt(F.sum(js_term(F.col("P_A"), F.col("P_B"))))).alias("SIMILARITY"))


def js_positional(real: DataFrame, synth: DataFrame, col: str) -> DataFrame:
    """Rank-order variant: value_counts shares of each side aligned by frequency rank (one row).
    The rank window runs over each side's class table."""
    def ranked(df):
        c = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
        return c.select(F.row_number().over(Window.orderBy(F.col("n").desc(), F.col(col))).alias("RANK"),
                        (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))
    j = ranked(real).join(ranked(synth).withColumnRenamed("p", "q"), "RANK", "full").na.fill(0.0, subset=["p", "q"])
    return j.agg(r6(similarity_from_distance(F.sqrt(F.sum(js_term(F.col("p"), F.col("q")))))).alias("Similarity"))
