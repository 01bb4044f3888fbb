"""Privacy metrics: distance-to-closest-record, leakage, membership inference,
combined score. Distances come from the exact blocked nearest-neighbour search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.divergence import r6
from ..session import bounded_broadcast, cut_lineage
from .aggregates import combine_rows
from .encode import standardize
from .metrics import roc_auc
from .neighbors import nearest, pool_entries
from .rowindex import in_key_order, part_offsets
from .sampling import sample_n

DIST_DIGITS = 9  # distances are rounded before threshold comparisons (engine-independent ties)


def nn_distances(queries: DataFrame, pool: DataFrame, feats: Sequence[str], q_id: str, p_id: str,
                 entries: DataFrame | None = None) -> DataFrame:
    """Distance of every query row to its closest pool row, stored once: mean, threshold, leak and AUC read it. A pool that is
    searched more than once passes its `entries`, stored."""
    nb = nearest(queries, pool, feats, q_id, p_id, None, 1, entries=entries)
    return cut_lineage(nb.select(q_id, F.round("NN_DIST", DIST_DIGITS).alias("D")))


def exact_quantile(df: DataFrame, value: str, q: float) -> float | None:
    """The q-th quantile with linear interpolation: values with their counts in range partitions, then the two values at
    the wanted ranks; no task holds all distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ordered = in_key_order(counts, "_v")
    w = Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cum = ordered.join(bounded_broadcast(part_offsets(ordered, F.sum("_n"))), "_part").withColumn(
        "_cum", F.col("_off") + F.sum("_n").over(w))
    n = ordered.agg(F.sum("_n")).first()[0]
    if not n:
        return None
    at = q * (n - 1)
    low, high = int(at), min(int(at) + 1, n - 1)
    # the value of 0-based rank r is the smallest one with more than r values up to it
    a, b = cum.agg(F.min(F.when(F.col("_cum") > low, F.col("_v"))), F.min(F.when(F.col("_cum") > high, F.col("_v")))).first()
    return a + (b - a) * (at - low)


def nnd(train: DataFrame, synth: DataFrame, test: DataFrame, feats: Sequence[str], id_col: str = "RECORD_ID"):
    """Standardize on train (population std, zero variance -> 1), then nearest-train distances of
    synthetic and of held-out real rows. Returns (synth distances, test distances)."""
    tr, sy, te = standardize(train.select(id_col, *feats), [synth.select(id_col, *feats), test.select(id_col, *feats)], feats)
    entries = cut_lineage(pool_entries(tr, feats, id_col, None, 1))
    return nn_distances(sy, tr, feats, id_col, id_col, entries), nn_distances(te, tr, feats, id_col, id_col, entries)


def leak_rate(synth_d: DataFrame, real_d: DataFrame, q: float = 0.05) -> DataFrame:
    """Share of synthetic distances strictly below the q-th percentile (linear) of real distances."""
    thr = exact_quantile(real_d, "D", q)
    return synth_d.agg(r6(F.avg((F.col("D") < F.lit(thr)).cast("double"))).alias("LEAK_RATE"),
                       r6(F.lit(thr)).alias("THRESHOLD"))


def mia_distance_auc(train: DataFrame, test: DataFrame, synth: DataFrame, feats: Sequence[str], id_col: str = "RECORD_ID",
                     n: int | None = None) -> DataFrame:
    """Membership inference scored by closeness to the synthetic data: n members (train) and n
    non-members (test), n = min(|train|, |test|) unless given; score = -distance to the nearest
    synthetic row; AUC of members vs non-members."""
    n_train, n_test = train.count(), test.count()
    if n is None:
        n = min(n_train, n_test)
    mem = sample_n(train.select(id_col, *feats), n, tag="member", id_col=id_col, total=n_train).withColumn("_lab", F.lit(1))
    non = sample_n(test.select(id_col, *feats), n, tag="nonmember", id_col=id_col, total=n_test).withColumn("_lab", F.lit(0))
    # stored, as its vectors, its rows and its labels are read apart: otherwise both samples would be drawn three times
    both = cut_lineage(mem.unionByName(non))
    d = nn_distances(both, synth.select(id_col, *feats), feats, id_col, id_col).join(both.select(id_col, "_lab"), id_col)
    return roc_auc(d.withColumn("_score", -F.col("D")), "_score", "_lab")


def privacy_score(auc: F.Column, mean_nnd: F.Column, leak: F.Column) -> dict:
    p_mia = F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(2.0) * F.abs(auc - F.lit(0.5)))
    p_nnd = mean_nnd / (mean_nnd + F.lit(1.0))
    p_leak = F.lit(1.0) - leak
    return {"P_MIA": p_mia, "P_NND": p_nnd, "P_LEAKAGE": p_leak,
            "privacy_score": (p_mia + p_nnd + p_leak) / F.lit(3.0) * F.lit(100.0)}


def privacy_report(train: DataFrame, synth: DataFrame, test: DataFrame, feats: Sequence[str], id_col: str = "RECORD_ID") -> DataFrame:
    """One row: P_MIA, P_NND, P_LEAKAGE, privacy_score, mean_nnd, real_nnd, leak_rate, mia_auc."""
    tr, sy, te = standardize(train.select(id_col, *feats), [synth.select(id_col, *feats), test.select(id_col, *feats)], feats)
    entries = cut_lineage(pool_entries(tr, feats, id_col, None, 1))
    sd, rd = nn_distances(sy, tr, feats, id_col, id_col, entries), nn_distances(te, tr, feats, id_col, id_col, entries)
    m = combine_rows(sd.agg(F.avg("D").alias("mean_nnd")), rd.agg(F.avg("D").alias("real_nnd")))
    lk = leak_rate(sd, rd).select(F.col("LEAK_RATE").alias("leak_rate"))
    auc = mia_distance_auc(tr, te, sy, feats, id_col).select(F.col("AUC").alias("mia_auc"))
    row = combine_rows(m, lk, auc)  # one-row frames side by side, no join
    sc = privacy_score(F.col("mia_auc"), F.col("mean_nnd"), F.col("leak_rate"))
    return row.select(*[r6(v).alias(k) for k, v in sc.items()], r6(F.col("mean_nnd")).alias("mean_nnd"),
                      r6(F.col("real_nnd")).alias("real_nnd"), "leak_rate", "mia_auc")
