"""Joins: equi joins left to Catalyst/AQE, plus the pool-label draw and the
positional bind, both expressed as equi joins (no range or nested-loop joins)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import inverse_cdf, uniform
from ..session import bounded_broadcast, cut_lineage
from .rowindex import with_row_index


def join_left(a: DataFrame, b: DataFrame, key: str = "RECORD_ID") -> DataFrame:
    """Left equi join; duplicate keys on the right fan out (reference semantics)."""
    return a.join(b, on=key, how="left")


def join_inner(a: DataFrame, b: DataFrame, key: str = "RECORD_ID") -> DataFrame:
    return a.join(b, on=key, how="inner")


def join_outer_suffix(a: DataFrame, b: DataFrame, key: str = "RECORD_ID",
                      suffixes: tuple[str, str] = ("_BASE", "_GROUPER")) -> DataFrame:
    """Full outer join; clashing non-key columns get suffixes; without a shared key, stack rows."""
    if key not in a.columns or key not in b.columns:
        return a.unionByName(b, allowMissingColumns=True)
    clash = (set(a.columns) & set(b.columns)) - {key}
    a2 = a.select(*[F.col(c).alias(c + suffixes[0]) if c in clash else F.col(c) for c in a.columns])
    b2 = b.select(*[F.col(c).alias(c + suffixes[1]) if c in clash else F.col(c) for c in b.columns])
    return a2.join(b2, on=key, how="full")


def label_distribution(pool: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Per key combination: labels sorted ascending and their integer cumulative counts.

    Counting is a partial/final aggregate (a hot key group costs one partial row per task and
    label); the per-key arrays hold one entry per distinct label (bounded by the label vocabulary).
    """
    keys = list(keys)
    counts = pool.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(label).rowsBetween(Window.unboundedPreceding, 0) if keys else \
        Window.orderBy(label).rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("_c", F.sum("_n").over(w))
    grouped = cum.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(label), F.col("_c")))).alias("_d"))
    return grouped.select(*keys, F.transform("_d", lambda s: s[label]).alias("_cats"),
                          F.transform("_d", lambda s: s["_c"]).alias("_cum"))


def join_pool_one(pop: DataFrame, pool: DataFrame, keys: Sequence[str], label: str, id_col: str = "RECORD_ID",
                  tag: str = "pool", out: str | None = None) -> DataFrame:
    """Left join population to pool on keys, picking ONE pool label per row by an inverse-CDF draw
    over the group's label counts (no fan-out). Rows with no matching group get null."""
    out = out or label
    dist = label_distribution(pool, keys, label)
    joined = pop.join(bounded_broadcast(dist), on=list(keys), how="left")
    draw = inverse_cdf(F.col("_cats"), F.col("_cum"), uniform(tag, id_col))
    return joined.withColumn(out, draw).drop("_cats", "_cum")


#: Rows of one side of a key that a task of the fan-out join should join at most; a key with more is cut into chunks.
CHUNK_ROWS = 4096
#: Result rows wanted per task of the fan-out join, and the most tasks it is cut into (beyond that tasks grow).
TASK_ROWS = 1 << 24
MAX_TASKS = 1 << 15


def join_pool_fanout(pop: DataFrame, pool: DataFrame, keys: Sequence[str], values: Sequence[str], id_col: str = "RECORD_ID",
                     pool_id: str = "RECORD_ID", out_id: str = "POOL_ID", chunk_rows: int = CHUNK_ROWS,
                     task_rows: int = TASK_ROWS) -> DataFrame:
    """Left join of population and pool on keys in which rows multiply: a row per pool match with the pool's `values` and its id
    as `out_id`; a row without a match (or with a null key) comes out once, with nulls.

    Both sides are counted first. A key with more than `chunk_rows` rows on a side is cut there into chunks by a hash of the id,
    and each (population chunk, pool chunk) pair is a join key of its own, so a hot key's product is written by as many tasks
    as it has chunk pairs. All other keys are one plain left equi join. Both joins have a task per `task_rows` result rows, known
    from the counts: the sizes of the inputs, which the optimizer goes by, say nothing of the rows that come out. They merge sorted
    sides, which reads the matches of a row one after the other (a hash join looks each of them up).
    """
    keys = list(keys)
    taken = {c.lower() for c in (*pop.columns, *pool.columns)}
    left_chunk, right_chunk, left_n, right_n = (next(n for n in ("_" * i + name for i in range(1, 99)) if n.lower() not in taken)
                                                for name in ("lc", "rc", "nl", "nr"))
    right = pool.select(*keys, *values, F.col(pool_id).alias(out_id))
    sized = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    counts = cut_lineage(sized(pop, left_n).join(sized(pool, right_n), keys))
    is_hot = (F.col(left_n) > chunk_rows) | (F.col(right_n) > chunk_rows)
    pairs, n_hot = counts.agg(F.sum(F.col(left_n).cast("decimal(38,0)") * F.col(right_n)), F.count_if(is_hot)).first()
    tasks = max(int(pop.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MAX_TASKS, -(-int(pairs or 0) // task_rows)))

    def merged(a: DataFrame, b: DataFrame, on: Sequence[str], how: str) -> DataFrame:
        return a.repartition(tasks, *on).join(b.repartition(tasks, *on).hint("merge"), on, how)

    columns = [*[F.col(f"`{c}`") for c in pop.columns], *values, out_id]
    if not n_hot:
        return merged(pop, right, keys, "left").select(*columns)
    chunks = lambda n: F.ceil(F.col(n) / chunk_rows).cast("int").alias(n)
    hot = counts.where(is_hot).select(*keys, chunks(left_n), chunks(right_n))
    # at most one hot key per chunk_rows input rows, counted before it is broadcast
    hot = F.broadcast(hot) if n_hot <= 1 << 20 else hot
    cold = merged(pop.join(hot.select(*keys), keys, "left_anti"), right.join(hot.select(*keys), keys, "left_anti"), keys, "left")
    chunk = lambda key, n: F.pmod(F.xxhash64(F.col(key)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ls = pop.join(hot, keys).withColumn(left_chunk, chunk(id_col, left_n)).withColumn(right_chunk, every(right_n))
    rs = right.join(hot, keys).withColumn(right_chunk, chunk(out_id, right_n)).withColumn(left_chunk, every(left_n))
    many = merged(ls.drop(left_n, right_n), rs.drop(left_n, right_n), [*keys, left_chunk, right_chunk], "inner")
    return cold.select(*columns).unionByName(many.select(*columns))


def draw_from_counts(df: DataFrame, counts: DataFrame, label: str, u: "F.Column", out: str) -> DataFrame:
    """Draw `out` for every row of df from a global (label, n) count table: inverse CDF by labels sorted
    ascending, k = floor(u*N), pick the label whose cumulative range [prev, cum) contains k.

    The range lookup is an equi join on blocks of width W ~ N / #labels: each label row is exploded
    into the blocks its range touches (about 2 x #labels rows in total), and each draw joins its
    block with the range test inside the (left) join condition, so every input row comes out once.
    No nested-loop join, no literal arrays in the plan, and the input is referenced once.
    """
    stats = counts.agg(F.sum("n").alias("N"), F.count("*").alias("L")).first()
    if stats is None or not stats["N"]:
        return df.withColumn(out, F.lit(None).cast(counts.schema[label].dataType))
    total, n_labels = int(stats["N"]), int(stats["L"])
    width = max(1, -(-total // n_labels))
    cum = counts.select(label, "n", F.sum("n").over(Window.orderBy(label).rowsBetween(Window.unboundedPreceding, 0))
                        .alias("_cum"))  # one row per label (vocabulary-bounded)
    blocks = cum.select(F.col(label).alias("_lab"), (F.col("_cum") - F.col("n")).alias("_prev"), "_cum",
                        F.explode(F.sequence(F.floor((F.col("_cum") - F.col("n")) / width).cast("bigint"),
                                             F.floor((F.col("_cum") - 1) / width).cast("bigint"))).alias("_bb"))
    k = F.floor(u * F.lit(total)).cast("bigint")
    keyed = df.withColumn("_k", k).withColumn("_blk", F.floor(F.col("_k") / width).cast("bigint"))
    b = bounded_broadcast(blocks)
    cond = (keyed["_blk"] == b["_bb"]) & (keyed["_k"] >= b["_prev"]) & (keyed["_k"] < b["_cum"])
    hit = keyed.join(b, cond, "left")
    return hit.withColumn(out, F.col("_lab")).drop("_blk", "_bb", "_k", "_lab", "_prev", "_cum")


def fallback_fill(df: DataFrame, pool: DataFrame, label: str, id_col: str = "RECORD_ID", tag: str = "fallback") -> DataFrame:
    """Rows whose label is null get a draw (with replacement) from the global pool distribution."""
    counts = pool.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    drawn = draw_from_counts(df.withColumnRenamed(label, "_orig"), counts, label, uniform(tag, id_col), "_fb")
    return drawn.withColumn(label, F.coalesce(F.col("_orig"), F.col("_fb"))).select(*df.columns)


def anti_keys(a: DataFrame, b: DataFrame, key: str = "RECORD_ID") -> DataFrame:
    """(SIDE, key) for keys present on one side only: 'A_NOT_B' and 'B_NOT_A'."""
    ka, kb = a.select(key).distinct(), b.select(key).distinct()
    return (ka.join(kb, key, "left_anti").withColumn("SIDE", F.lit("A_NOT_B"))
            .unionByName(kb.join(ka, key, "left_anti").withColumn("SIDE", F.lit("B_NOT_A"))))


def anti_keys_summary(a: DataFrame, b: DataFrame, key: str = "RECORD_ID", examples: int = 5) -> DataFrame:
    """Per side: number of missing keys and the `examples` smallest as text."""
    return _anti_summary(anti_keys(a, b, key), key, examples)


def _anti_summary(ak: DataFrame, key: str, examples: int) -> DataFrame:
    cnt = ak.groupBy("SIDE").agg(F.count("*").alias("N_MISSING"))
    parts = []
    for side in ("A_NOT_B", "B_NOT_A"):
        # top-k per side is a distributed TakeOrdered (k rows per task), not a per-side sort
        parts.append(ak.where(F.col("SIDE") == side).orderBy(key).limit(examples))
    small = parts[0].unionByName(parts[1])
    ex = small.groupBy("SIDE").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.col(key))),
                                                            lambda x: x.cast("string")), ",").alias("EXAMPLES"))
    return cnt.join(ex, "SIDE", "left")


def semi_common(a: DataFrame, b: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Keep rows of each frame whose label exists in both."""
    common = a.select(label).intersect(b.select(label))
    return a.join(common, label, "left_semi"), b.join(common, label, "left_semi")


def map_join(df: DataFrame, mapping: DataFrame, key: str, value: str, out: str | None = None, inner: bool = False) -> DataFrame:
    """Series.map(dict): look up `key` in a (key, value) table; missing -> null (or dropped if inner)."""
    m = mapping.select(F.col(key), F.col(value).alias(out or value))
    return df.join(bounded_broadcast(m), key, "inner" if inner else "left")


def positional_zip(a: DataFrame, b: DataFrame, a_key: str, b_key: str, b_cols: Sequence[str]) -> DataFrame:
    """Column-bind b's columns to a by row position (a ordered by a_key, b by b_key). The shorter side is filled
    with nulls, so no row of either is lost."""
    ai = with_row_index(a, a_key, out="_pos")
    bi = with_row_index(b.select(b_key, *b_cols), b_key, out="_pos").drop(b_key)
    return ai.join(bi, "_pos", "full").drop("_pos")


def outer_align(a: DataFrame, b: DataFrame, cat: str) -> DataFrame:
    """Counts of `cat` on both sides over the union of categories; missing -> 0 (one shuffle)."""
    t = a.select(F.col(cat), F.lit(True).alias("_a")).unionByName(b.select(F.col(cat), F.lit(False).alias("_a")))
    return t.where(F.col(cat).isNotNull()).groupBy(cat).agg(
        F.count_if(F.col("_a")).alias("N_A"), F.count_if(~F.col("_a")).alias("N_B"))
