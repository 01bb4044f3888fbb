"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame operations only).

Targets: every source asks for words in proportion to its weight; a source that would exceed ``max_repeat`` times its size
stops there and the rest is shared again by weight (solved in closed form over the sources sorted by cap / weight).

Draws: the documents of a source are permuted by a hash and cut into blocks. A source with target T takes its permuted
blocks in order, again from the start once all are used, until T words are reached; that is its exact block quota. The tree
divides the quotas among the output shards: at each node a random half of the node's drawn blocks (all sources together)
goes left, so the sources' counts in a child follow the multivariate hypergeometric law, and every drawn block belongs to
one shard only. What the mix takes of a document is the sum over its draws. Inside a shard, documents are ordered by a second hash.

Sizes are counted in one pass over the texts and stored; totals, blocks and quotas come from the stored sizes. Sources join by
broadcast (their number is counted first), so no shuffle is by source: the finest common key is (source, block).

All hashes are md5 of (seed, tag, doc_id), so reruns agree and another engine can recompute the draw.

Defined results: a null source is a source of its own, last in the order; a null or empty text has size 0 and is never taken; an
empty table gives an empty result; rows with equal doc_id and text are interchangeable; a source whose documents are all
empty has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, counted_broadcast, cut_lineage, fresh, written

#: Source weights, repeating over the sources in code point order.
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2
BLOCK_ROWS = 256
SHARDS = 8


def hash60(tag: str, *key: Column) -> Column:
    """First 60 bits of md5(tag|key|...) as a long."""
    text = [F.coalesce(k.cast("string"), F.lit("")) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(tag), *text)), 1, 15), 16, 10).cast("long")


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, cap: float = MAX_REPEAT) -> DataFrame:
    """``sizes`` (source, source_size, rows; one row per source) with ``target``.

    Water filling: with the sources sorted by cap / weight, the level is the first (budget - caps before) / (weights from here
    on) that does not exceed the source's own ratio; sources before it stop at their cap, the others get weight * level.
    One row per source meets in a window.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1,
                             F.lit(len(weights))) + 1).cast("int"))
    top = F.col("source_size") * F.lit(float(cap))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (
        sizes.withColumn("weight", w).withColumn("top", top).withColumn("ratio", F.col("top") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("top").over(before), F.lit(0.0)))
                    / F.sum("weight").over(onward))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level")))
                    .over(everything)["level"])
        .withColumn("target", F.least(F.col("top"), F.coalesce(F.col("weight") * F.col("level"), F.col("top"))))
        .drop("top", "ratio", "budget", "level")
    )


def split_tree(units: DataFrame, n_shards: int, seed: str, keys: list[str]) -> DataFrame:
    """``units`` (one row per drawn block) with ``shard``: log2(n_shards) times, a random half of each node goes left.

    The rank within a node is found in two steps, so that no task orders a whole node: hash ranges of about 4,096 units are
    counted, a running sum over those counts gives each range its first rank, and units are ranked inside their range.
    """
    levels = n_shards.bit_length() - 1
    if 1 << levels != n_shards:
        raise ValueError("the number of shards must be a power of two")
    units = units.withColumn("node", F.lit(0))
    for level in range(levels):
        node = units.groupBy("node").agg(F.count(F.lit(1)).alias("n_node"))
        u = units.withColumn("u", hash60(f"{seed}-{level}", *[F.col(k) for k in keys]))
        u = u.join(F.broadcast(node), "node")  # at most n_shards rows
        u = u.withColumn("range", F.floor(F.col("u") / F.lit(float(1 << 60)) * F.ceil(F.col("n_node") / 4096)))
        ranges = u.groupBy("node", "range").agg(F.count(F.lit(1)).alias("n"))
        up_to = Window.partitionBy("node").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.select("node", "range", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("first"))
        rank = F.row_number().over(Window.partitionBy("node", "range").orderBy("u", *keys)) + F.col("first")
        units = (
            u.join(ranges, ["node", "range"])
            .withColumn("rank", rank)
            .withColumn("node", F.col("node") * 2 + F.when(F.col("rank") * 2 <= F.col("n_node") + 1, 0).otherwise(1))
            .drop("u", "n_node", "range", "first", "rank")
        )
        units = cut_lineage(units)
    return units.withColumnRenamed("node", "shard")


def mix(df: DataFrame, size: Column, n_shards: int = SHARDS, seed: str = "mix", weights=WEIGHTS,
        share: float = TOTAL_SHARE, cap: int = MAX_REPEAT, block_rows: int = BLOCK_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """``df`` (doc_id, source, ...) with size, source_size, target, taken and ``draws``, an array of
    (epoch, shard, words): the shards that draw the document and how many of its words each takes.

    ``counted``: the same rows as stored (doc_id, source, size), so that ``size`` is not evaluated again for the totals."""
    keep = [c for c in df.columns if c not in ("size", "source_size", "target", "taken", "draws")]
    key, u, block, start, inside, here, drawn_by = fresh(
        df, "source_key", "u", "block", "start", "inside", "here", "drawn_by")

    def keyed(rows: DataFrame, amount: Column, columns: list[str]) -> DataFrame:
        # the source as a key without nulls, so that windows and joins below share one partitioning
        return rows.select(*[F.col(f"`{c}`") for c in columns], amount.alias("size"), hash60(seed, F.col("doc_id")).alias(u),
                           F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias(key))

    def in_blocks(rows: DataFrame) -> DataFrame:
        return rows.join(sources, key).withColumn(
            block, F.least(F.floor(F.col(u) / F.lit(float(1 << 60)) * F.col(block)), F.col(block) - 1))

    base = keyed(df, size, keep)
    lengths = base.select("source", key, "size", u) if counted is None else keyed(counted, F.col("size"), ["source"])
    sizes = lengths.groupBy("source", key).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = counted_broadcast(cut_lineage(source_targets(sizes, weights, share, cap).select(
        key, "source_size", "target", F.round("target").cast("long").alias(here),
        F.ceil(F.col("rows") / block_rows).alias(block))))
    docs = in_blocks(base)
    blocks = in_blocks(lengths).groupBy(key, block).agg(
        F.sum("size").alias("words"), F.first("source_size").alias("all"), F.first(here).alias("wanted"))
    blocks = cut_lineage(blocks.withColumn("range", F.floor(F.col(block) / 4096)))
    # the words before a block: those of the ranges of blocks before, and of the blocks before inside its range
    earlier = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.groupBy(key, "range").agg(F.sum("words").alias("n")).select(
        key, "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    in_order = Window.partitionBy(key, "range").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut_lineage(blocks.join(ranges, [key, "range"]).withColumn(
        start, F.col("first") + F.coalesce(F.sum("words").over(in_order), F.lit(0))).drop("range", "first"))
    units = (
        blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(int(cap) - 1))))
        .where((F.col("epoch") * F.col("all") + F.col(start) < F.col("wanted")) & (F.col("words") > 0))
        .select(key, block, "epoch")
    )
    drawn = split_tree(units, n_shards, seed, [key, block, "epoch"])
    drawn = drawn.groupBy(key, block).agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias(drawn_by))
    by_block = blocks.select(key, block, start).join(drawn, [key, block], "left")
    before = Window.partitionBy(key, block).orderBy(u, "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn(inside, F.coalesce(F.sum("size").over(before), F.lit(0))).join(by_block, [key, block])
    words = lambda d: F.greatest(F.lit(0), F.least(
        F.col("size"), F.col(here) - d["epoch"] * F.col("source_size") - F.col(start) - F.col(inside)))
    draws = F.filter(
        F.transform(F.coalesce(F.col(drawn_by), F.array().cast("array<struct<epoch:int,shard:int>>")),
                    lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), words(d).alias("words"))),
        lambda d: d["words"] > 0)
    placed = placed.withColumn("draws", draws)
    return placed.select(
        *[F.col(f"`{c}`") for c in keep], "size", "source_size", "target",
        F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]).alias("taken"), "draws")


def word_sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size), stored."""
    return written(documents.select("doc_id", "source", word_count().alias("size")), "mix-sizes")


def mix_documents(documents: DataFrame) -> DataFrame:
    """The mix of ``documents`` (doc_id, text, source) without their texts: one row per document, with ``draws`` as text:
    epoch:shard:words of every draw, joined by commas (empty: not drawn)."""
    out = mix(word_sizes(documents), F.col("size"))
    draws = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["epoch"], d["shard"], d["words"])), ",")
    return out.select("doc_id", "size", "source_size", "target", "taken", draws.alias("draws"))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: one row per drawn copy, with the columns of ``documents``, in shards shuffled locally.

    Whole documents are drawn: of the document that a source's target cuts, a copy is drawn if at least half of it is wanted.
    """
    cols = documents.columns
    out = mix(documents, word_count(), counted=word_sizes(documents), **options)
    draw, key = fresh(out, "draw", "key")
    copies = out.withColumn(draw, F.explode("draws")).where(F.col(f"{draw}.words") * 2 >= F.col("size"))
    return (
        copies.withColumn(key, hash60("shuffle", F.col(f"{draw}.epoch"), F.col("doc_id")))
        .repartition(F.col(f"{draw}.shard"), F.col(key) % 64)
        .sortWithinPartitions(f"{draw}.shard", key)
        .select(*[F.col(f"`{c}`") for c in cols])
    )
