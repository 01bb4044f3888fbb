"""Co-occurrence mining and sequence statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.divergence import js_term, r6
from ..session import cut_lineage


def baskets(df: DataFrame, basket: str, item: str) -> DataFrame:
    """One row per basket with its distinct items (basket size is bounded by the basket, e.g. an order)."""
    return df.where(F.col(item).isNotNull()).groupBy(basket).agg(F.array_sort(F.collect_set(F.col(item).cast("string"))).alias("items"))


def _itemset_str(c) -> F.Column:
    return F.array_join(F.array_sort(c), "|")


def freq_itemsets(bk: DataFrame, min_support: float, min_confidence: float = 0.0):
    """Distributed FP-growth (Spark ML). Returns (itemsets, rules) DataFrames."""
    from pyspark.ml.fpm import FPGrowth
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(bk)
    return model.freqItemsets, model.associationRules


def itemsets_report(itemsets: DataFrame) -> DataFrame:
    return itemsets.select(_itemset_str(F.col("items")).alias("ITEMS"), F.size("items").alias("SIZE"), F.col("freq").alias("FREQ"))


def rules_report(rules: DataFrame) -> DataFrame:
    return rules.select(_itemset_str(F.col("antecedent")).alias("ANTECEDENT"), _itemset_str(F.col("consequent")).alias("CONSEQUENT"),
                        r6(F.col("confidence")).alias("CONFIDENCE"), r6(F.col("lift")).alias("LIFT"),
                        r6(F.col("support")).alias("SUPPORT"))


def markov_transitions(events: DataFrame, entity: str, state: str, ts: str, tie: str,
                       bucket_seconds: int = 3600) -> DataFrame:
    """Row-normalized transition probabilities between consecutive states per entity.

    Skew-safe: the successor is found inside (entity, time bucket) partitions; the transition that
    crosses a bucket boundary joins each bucket's last event to the first event of the entity's
    next non-empty bucket, found with a window over the per-bucket summary (one row per entity and
    bucket). A very active entity is thus spread over many tasks.
    """
    e = events.where(F.col(state).isNotNull()).select(
        entity, state, ts, tie, F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / bucket_seconds).alias("_b"))
    w = Window.partitionBy(entity, "_b").orderBy(ts, tie)
    inner = e.withColumn("_next", F.lead(state).over(w)).where(F.col("_next").isNotNull()) \
        .select(F.col(state).alias("FROM_STATE"), F.col("_next").alias("TO_STATE"))
    order = F.struct(F.col(ts), F.col(tie))
    summ = e.groupBy(entity, "_b").agg(F.max_by(state, order).alias("_last"), F.min_by(state, order).alias("_first"))
    wb = Window.partitionBy(entity).orderBy("_b")
    cross = summ.withColumn("_nf", F.lead("_first").over(wb)).where(F.col("_nf").isNotNull()) \
        .select(F.col("_last").alias("FROM_STATE"), F.col("_nf").alias("TO_STATE"))
    t = inner.unionByName(cross).groupBy("FROM_STATE", "TO_STATE").agg(F.count("*").alias("N"))
    return t.withColumn("P", r6(F.col("N") / F.sum("N").over(Window.partitionBy("FROM_STATE"))))


def pair_counts(bk: DataFrame, items: DataFrame, basket: str) -> DataFrame:
    """(x, y, n, held): the baskets that hold both of two of ``items`` (item), and those of them that have a name. Only the kept items of a
    basket are paired, so its pairs are bounded by theirs."""
    kept = bk.crossJoin(F.broadcast(items.agg(F.collect_set("item").alias("kept")))).select(  # one row: mean basket size / min_support items
        basket, F.array_sort(F.array_intersect("items", "kept")).alias("items")).where(F.size("items") > 1)
    pairs = F.flatten(F.transform("items", lambda x, i: F.transform(
        F.slice("items", i + 2, F.size("items")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return kept.select(basket, F.explode(pairs).alias("p")).groupBy("p.x", "p.y").agg(
        F.count("*").alias("n"), F.count(basket).alias("held"))


def comorbidity_compare(real: DataFrame, synth: DataFrame, basket: str, min_support: float):
    """Support on both sides of the item pairs that are frequent on either side (counted, so a pair that is rare on one side
    shows its true support there), their difference, and the JS similarity of the two normalized profiles.

    Items are counted first: a pair can be frequent on a side only if both its items are, so the pairs of all other items are not formed."""
    sides = [cut_lineage(bk) for bk in (real, synth)]  # baskets are built once for all counts
    sizes = [bk.count() for bk in sides]
    least = [math.ceil(min_support * n) for n in sizes]
    single = [bk.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= m).select("item")
              for bk, m in zip(sides, least)]
    items = cut_lineage(single[0].union(single[1]).distinct())  # 1 / min_support baskets' worth at most
    c = [pair_counts(bk, items, basket).select("x", "y", F.col("n").alias(f"n{i}"), F.col("held").alias(f"h{i}")) for i, bk in enumerate(sides)]
    both = c[0].join(c[1], ["x", "y"], "full").na.fill(0).where((F.col("n0") >= max(1, least[0])) | (F.col("n1") >= max(1, least[1])))
    j = cut_lineage(both.select("x", "y", *[(F.col(f"h{i}") / F.lit(float(n or 1))).alias(s) for i, (n, s) in enumerate(zip(sizes, ("S_REAL", "S_SYNTH")))]))
    j = j.select(F.concat_ws("|", "x", "y").alias("ITEMS"), "S_REAL", "S_SYNTH")
    pairs = j.select("ITEMS", r6(F.col("S_REAL")).alias("S_REAL"), r6(F.col("S_SYNTH")).alias("S_SYNTH"),
                     r6(F.col("S_SYNTH") - F.col("S_REAL")).alias("DIFF"))
    all_ = Window.partitionBy()
    p = F.col("S_REAL") / F.sum("S_REAL").over(all_)
    q = F.col("S_SYNTH") / F.sum("S_SYNTH").over(all_)
    sim = j.select(js_term(p, q).alias("_t")).agg(r6((F.lit(1.0) - F.sqrt(F.sum("_t"))) * 100).alias("JS_SIMILARITY"))
    return pairs, sim
