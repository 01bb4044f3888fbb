"""Evaluation of predictions: all metrics come from one grouped confusion count
(y, pred) -> n, which has one row per observed label pair, so nothing scales with rows after the
first partial/final aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.divergence import r6
from ..session import bounded_broadcast
from .rowindex import in_key_order, part_offsets


def frequency_classifier_fit(train: DataFrame, context: Sequence[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Class counts per context and globally (the fitted state of the frequency-table classifier)."""
    t = train.where(F.col(label).isNotNull())
    per = t.groupBy(*context, label).agg(F.count("*").alias("_n"))
    glob = t.groupBy(label).agg(F.count("*").alias("_n"))
    return per, glob


def frequency_classifier_predict(model, test: DataFrame, context: Sequence[str], label: str, id_col: str = "RECORD_ID",
                                 topk: int = 3) -> DataFrame:
    """Predictions frame: id, y, pred (mode of the context, ties -> smallest label, unseen context ->
    global mode), p_true (share of the true class in the used distribution), topk ('|'-joined)."""
    per, glob = model
    key = list(context)
    ordw = Window.partitionBy(*key).orderBy(F.col("_n").desc(), F.col(label).asc())
    ranked = per.withColumn("_r", F.row_number().over(ordw)).withColumn("_tot", F.sum("_n").over(Window.partitionBy(*key)))
    top = ranked.where(F.col("_r") <= topk).groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("_r", F.col(label).cast("string").alias("_l")))).alias("_top"))
    top = top.select(*key, F.col("_top")[0]["_l"].alias("_mode"),
                     F.array_join(F.transform("_top", lambda s: s["_l"]), "|").alias("_topk"))
    gtot = glob.agg(F.sum("_n")).first()[0]
    gtop = glob.orderBy(F.col("_n").desc(), F.col(label).asc()).limit(topk).collect()
    gmode = str(gtop[0][label]) if gtop else None
    gtopk = "|".join(str(r[label]) for r in gtop)
    t = test.where(F.col(label).isNotNull()).select(id_col, *key, F.col(label).alias("_y"))
    j = t.join(top, key, "left")
    # probability of the true class: context count / context total, else global share
    pt = ranked.select(*key, F.col(label).alias("_y"), (F.col("_n") / F.col("_tot")).alias("_pc"))
    pg = glob.select(F.col(label).alias("_y"), (F.col("_n") / F.lit(float(gtot))).alias("_pg"))
    j = j.join(pt, [*key, "_y"], "left").join(bounded_broadcast(pg), "_y", "left")
    seen = F.col("_mode").isNotNull()
    return j.select(
        F.col(id_col).alias("id"), F.col("_y").cast("string").alias("y"),
        F.when(seen, F.col("_mode")).otherwise(F.lit(gmode)).alias("pred"),
        F.when(seen, F.coalesce(F.col("_pc"), F.lit(0.0))).otherwise(F.coalesce(F.col("_pg"), F.lit(0.0))).alias("p_true"),
        F.when(seen, F.col("_topk")).otherwise(F.lit(gtopk)).alias("topk"),
    )


def frequency_classifier_label(model, df: DataFrame, context: Sequence[str], label: str, out: str) -> DataFrame:
    """Assign the arg-max label of the row's context (ties -> smallest; unseen -> global mode)."""
    per, glob = model
    key = list(context)
    best = per.groupBy(*key).agg(F.min(F.struct((-F.col("_n")).alias("_neg"), F.col(label).alias("_mode"))).alias("_b"))
    best = best.select(*key, F.col("_b._mode").alias("_mode"))
    g = glob.orderBy(F.col("_n").desc(), F.col(label).asc()).limit(1).collect()
    gmode = g[0][label] if g else None
    return df.join(best, key, "left").withColumn(out, F.coalesce(F.col("_mode"), F.lit(gmode))).drop("_mode")


def confusion_counts(pred: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    return pred.groupBy(F.col(y).alias("y"), F.col(p).alias("pred")).agg(F.count("*").alias("n"))


def accuracy(pred: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """Share of rows predicted right; a row without a prediction is a miss."""
    return pred.agg(r6(F.avg(F.coalesce(F.col(y) == F.col(p), F.lit(False)).cast("double"))).alias("ACCURACY"))


def per_class(pred: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """Per label of y ∪ pred: TP, FP, FN, support, precision, recall, F1 (zero division -> 0).
    A row without a prediction is a miss of its class."""
    cc = confusion_counts(pred, y, p)
    right = F.col("y").eqNullSafe(F.col("pred"))
    a = cc.select(F.col("y").alias("CLASS"), F.when(right, F.col("n")).otherwise(0).alias("tp"),
                  F.lit(0).cast("bigint").alias("fp"), F.when(~right, F.col("n")).otherwise(0).alias("fn"),
                  F.col("n").alias("support"))
    b = cc.where(~right).select(F.col("pred").alias("CLASS"), F.lit(0).cast("bigint").alias("tp"),
                                                      F.col("n").alias("fp"), F.lit(0).cast("bigint").alias("fn"),
                                                      F.lit(0).cast("bigint").alias("support"))
    s = a.unionByName(b).where(F.col("CLASS").isNotNull()).groupBy("CLASS").agg(
        F.sum("tp").alias("TP"), F.sum("fp").alias("FP"), F.sum("fn").alias("FN"), F.sum("support").alias("SUPPORT"))
    prec = F.when(F.col("TP") + F.col("FP") > 0, F.col("TP") / (F.col("TP") + F.col("FP"))).otherwise(0.0)
    rec = F.when(F.col("TP") + F.col("FN") > 0, F.col("TP") / (F.col("TP") + F.col("FN"))).otherwise(0.0)
    s = s.withColumn("PRECISION", prec).withColumn("RECALL", rec)
    f1 = F.when(F.col("PRECISION") + F.col("RECALL") > 0,
                2 * F.col("PRECISION") * F.col("RECALL") / (F.col("PRECISION") + F.col("RECALL"))).otherwise(0.0)
    return s.withColumn("F1", f1)


def f1_scores(pred: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    pc = per_class(pred, y, p)
    return pc.agg(r6(F.avg("F1")).alias("F1_MACRO"),
                  r6(F.sum(F.col("F1") * F.col("SUPPORT")) / F.sum("SUPPORT")).alias("F1_WEIGHTED"))


def classification_report(pred: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    pc = per_class(pred, y, p)
    rows = pc.select("CLASS", r6(F.col("PRECISION")).alias("PRECISION"), r6(F.col("RECALL")).alias("RECALL"),
                     r6(F.col("F1")).alias("F1"), F.col("SUPPORT"))
    macro = pc.agg(F.lit("macro avg").alias("CLASS"), r6(F.avg("PRECISION")).alias("PRECISION"), r6(F.avg("RECALL")).alias("RECALL"),
                   r6(F.avg("F1")).alias("F1"), F.sum("SUPPORT").alias("SUPPORT"))
    sw = F.sum("SUPPORT")
    weighted = pc.agg(F.lit("weighted avg").alias("CLASS"),
                      r6(F.sum(F.col("PRECISION") * F.col("SUPPORT")) / sw).alias("PRECISION"),
                      r6(F.sum(F.col("RECALL") * F.col("SUPPORT")) / sw).alias("RECALL"),
                      r6(F.sum(F.col("F1") * F.col("SUPPORT")) / sw).alias("F1"), sw.alias("SUPPORT"))
    return rows.unionByName(macro).unionByName(weighted)


def topk_accuracy(pred: DataFrame, y: str = "y", topk: str = "topk") -> DataFrame:
    return pred.agg(r6(F.avg(F.array_contains(F.split(F.col(topk), "\\|"), F.col(y)).cast("double"))).alias("TOPK_ACCURACY"))


def log_loss(pred: DataFrame, p_true: str = "p_true", eps: float = 1e-15) -> DataFrame:
    return pred.agg(r6(-F.avg(F.log(F.least(F.greatest(F.col(p_true), F.lit(eps)), F.lit(1 - eps))))).alias("LOG_LOSS"))


def roc_auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Exact binary AUC by the rank-sum statistic with average ranks for tied scores.

    Per distinct score: positives and total (partial/final aggregate), stored once in score order by range
    partitions; partition totals give offsets and a window inside each partition gives the rank. The input is read
    once. With one class only the AUC is null. One row: AUC, N_POS, N_NEG.
    """
    d = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("_s")).agg(
        F.count("*").alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_p"))
    ordered = in_key_order(d, "_s")
    w = Window.partitionBy("_part").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    r = ordered.join(bounded_broadcast(part_offsets(ordered, F.sum("_n"))), "_part").withColumn(
        "_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    avg_rank = F.col("_off") + F.col("_before") + (F.col("_n") + 1) / 2.0
    agg = r.agg(F.sum(F.col("_p") * avg_rank).alias("_rs"), F.sum("_p").alias("N_POS"), (F.sum("_n") - F.sum("_p")).alias("N_NEG"))
    auc = F.try_divide(F.col("_rs") - F.col("N_POS") * (F.col("N_POS") + 1) / 2.0, F.col("N_POS") * F.col("N_NEG"))
    return agg.select(r6(auc).alias("AUC"), "N_POS", "N_NEG")
