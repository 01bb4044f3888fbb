"""Exact nearest-neighbour search.

Both sides are reduced to distinct feature vectors (categorical data repeats heavily). The pool is cut into k-d cells
(`kdcells.py`): the cuts come from a sample, each cell's box from all its vectors, so the box
bounds are exact whatever the sample. A search has two rounds:

1. every query is compared with its home cell; its k-th smallest distance there is an upper bound;
2. the query goes on to the other cells whose box lies within that bound, found by walking the cell tree.

A round is one cogroup over units (cell, pool chunk, query chunk) of at most `block_rows` rows a side, cut by counts, so
neither a crowded cell nor a cell that all queries reach is held by one task; distances are computed with numpy and only k
candidates per query and unit come out. Neither side is broadcast; the driver holds the cells' boxes (at most MAX_CELLS).
Ties are broken by the smaller pool id. A row with a null feature has no distance to anything: as a query it keeps one
row with null results, in the pool it is nobody's neighbour.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .kdcells import SLACK, Cells, Metric, grow
from .rowindex import k_smallest_per_group

DEFAULT_BLOCK = 2048
#: Wanted pool vectors per cell; beyond LEAF_ROWS * MAX_CELLS vectors the cells grow instead (and are cut into chunks).
LEAF_ROWS = 512
MAX_CELLS = 1 << 14
#: Sampled vectors per cell that the cuts are taken from.
SAMPLE_PER_CELL = 16
#: Queries that walk the cell tree together.
WALK_ROWS = 128


def _chunk(cols: Sequence[str], n: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols]), n).cast("int")


def _cells(pv: DataFrame, feats: list[str], metric: Metric, leaf_rows: int) -> tuple[DataFrame, Cells]:
    """The pool with its cell numbers (stored) and the cells with their boxes and sizes."""
    n = pv.count()
    wanted = min(MAX_CELLS, max(1, -(-n // leaf_rows)))
    sample = np.empty((0, len(feats)))
    if wanted > 1:
        # a hash sample of the distinct vectors, about SAMPLE_PER_CELL for each cell
        share = F.pmod(F.xxhash64(F.lit("cells"), *feats), F.lit(n)) < F.lit(wanted * SAMPLE_PER_CELL)
        sample = pv.where(share).select(*feats).distinct().toPandas().sort_values(feats).to_numpy(dtype=np.float64)
    cells = grow(sample, wanted, metric)
    home = F.pandas_udf(lambda *x: pd.Series(cells.home(np.column_stack(x)), dtype="int32"), "int")
    placed = cut_lineage(pv.withColumn("_cell", home(*feats)))
    sides = [f(c).alias(f"{name}{i}") for i, c in enumerate(feats) for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = placed.groupBy("_cell").agg(F.count("*").alias("n"), *sides).toPandas()
    numbers = range(len(feats))
    return placed, cells.with_boxes(boxes["_cell"].to_numpy(), boxes["n"].to_numpy(),
                                    boxes[[f"lo{i}" for i in numbers]].to_numpy(dtype=np.float64),
                                    boxes[[f"hi{i}" for i in numbers]].to_numpy(dtype=np.float64))


def units(q: DataFrame, placed: DataFrame, feats: list[str], block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Queries and pool entries keyed by (_cell, _pc, _qc): both sides of a cell are cut into chunks of about `block_rows`
    rows and every pair of chunks is a unit. The size table has a row per cell (MAX_CELLS at most)."""
    sizes = F.broadcast(q.groupBy("_cell").agg(F.ceil(F.count("*") / block_rows).alias("_kq")).join(
        placed.groupBy("_cell").agg(F.ceil(F.count("*") / block_rows).alias("_kp")), "_cell"))
    qs = q.join(sizes, "_cell").withColumn("_qc", _chunk(feats, F.col("_kq"))) \
        .withColumn("_pc", F.explode(F.sequence(F.lit(0), (F.col("_kp") - 1).cast("int"))))
    ps = placed.join(sizes, "_cell").withColumn("_pc", _chunk([*feats, "_pid"], F.col("_kp"))) \
        .withColumn("_qc", F.explode(F.sequence(F.lit(0), (F.col("_kq") - 1).cast("int"))))
    return qs.drop("_kp", "_kq"), ps.drop("_kp", "_kq")


def _kernel(feats: list[str], metric: Metric, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Distances of one unit: the k nearest entries of each query within its `_bound`."""
    columns = [*feats, "_d2", "_pid", "_plab", "_pmult"]

    def compare(qdf: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if qdf.empty or pdf.empty:
            return pd.DataFrame({c: [] for c in columns})
        pdf = pdf.sort_values("_pid", kind="stable")  # so that a stable order by distance breaks ties by id
        qx, px = qdf[feats].to_numpy(dtype=np.float64), pdf[feats].to_numpy(dtype=np.float64)
        bound = qdf["_bound"].to_numpy(dtype=np.float64) * SLACK
        outs = []
        step = max(1, (1 << 22) // max(1, px.size))
        for s in range(0, len(qx), step):
            qs = qx[s:s + step]
            d2 = metric.distance(qs[:, None, :], px[None, :, :])
            limit = bound[s:s + step]
            if k == 1:
                c = np.argmin(d2, axis=1)  # the first minimum, so the smallest id
                r = np.arange(len(qs))
                near = d2[r, c] <= limit
                r, c = r[near], c[near]
            else:
                kk = min(k, d2.shape[1])
                limit = np.minimum(limit, np.partition(d2, kk - 1, axis=1)[:, kk - 1])
                r, c = np.nonzero(d2 <= limit[:, None])
                order = np.lexsort((c, d2[r, c], r))
                r, c = r[order], c[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
                r, c = r[keep], c[keep]
            part = pd.DataFrame(qs[r], columns=feats)
            part["_d2"] = d2[r, c]
            for name in ("_pid", "_plab", "_pmult"):
                part[name] = pdf[name].to_numpy()[c]
            outs.append(part)
        return pd.concat(outs, ignore_index=True)

    return compare


def _walk(feats: list[str], cells: Cells, k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Queries with their bound (null: none yet) to rows (query, bound, cell) for the cells within the bound, but for the home
    cell, which round one has seen."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), WALK_ROWS):
                part = batch.iloc[s:s + WALK_ROWS]
                x = part[feats].to_numpy(dtype=np.float64)
                bound = part["_bound"].to_numpy(dtype=np.float64, na_value=np.inf).copy()
                short = np.isinf(bound)
                if short.any():
                    bound[short] = cells.sure_bound(x[short], k)
                qi, cell = cells.within(x, bound)
                other = cell != cells.home(x)[qi]
                qi, cell = qi[other], cell[other]
                out = pd.DataFrame(x[qi], columns=feats)
                out["_bound"], out["_cell"] = bound[qi], cell.astype(np.int32)
                yield out

    return walk


def _rounds(qv: DataFrame, pv: DataFrame, feats: Sequence[str], k: int, block_rows: int,
            metric: Metric | None) -> tuple[DataFrame, list[DataFrame], Callable[[DataFrame], DataFrame], DataFrame]:
    """(placed pool, the (query, bound, cell) rows of each round, the comparison of such rows, round one's candidates)."""
    feats = list(feats)
    metric = metric or Metric.squared(len(feats))
    placed, cells = _cells(cut_lineage(pv), feats, metric, min(LEAF_ROWS, block_rows))
    columns = ", ".join(f"`{f}` double" for f in feats)

    def compare(q: DataFrame) -> DataFrame:
        qs, ps = units(q, placed, feats, block_rows)
        unit = ["_cell", "_pc", "_qc"]
        return qs.groupBy(*unit).cogroup(ps.groupBy(*unit)).applyInPandas(
            _kernel(feats, metric, k), f"{columns}, _d2 double, _pid bigint, _plab string, _pmult bigint")

    pairs = f"{columns}, _bound double, _cell int"
    home_of = F.pandas_udf(lambda *x: pd.Series(cells.home(np.column_stack(x)), dtype="int32"), "int")
    home = cut_lineage(qv.withColumn("_bound", F.lit(float("inf"))).withColumn("_cell", home_of(*feats)))
    first = cut_lineage(compare(home))
    if cells.count == 1:
        return placed, [home], compare, first
    seen = k_smallest_per_group(first, feats, ["_d2", "_pid"], k, "_pid", salts=1, out="_r").groupBy(*feats).agg(
        F.when(F.count("*") >= k, F.max("_d2")).alias("_bound"))
    # a query whose home cell gave nothing still walks: its bound is null
    bounds = home.select(*feats).join(seen, feats, "left")
    return placed, [home, cut_lineage(bounds.mapInPandas(_walk(feats, cells, k), pairs))], compare, first


def _candidates(qv: DataFrame, pv: DataFrame, feats: Sequence[str], k: int, block_rows: int,
                metric: Metric | None = None) -> DataFrame:
    """qv: distinct query vectors (feats as double). pv: pool entries (feats, _pid bigint, _plab string,
    _pmult bigint). Returns (feats..., _d2, _pid, _plab, _pmult) candidate rows, among them the k nearest entries
    of each query."""
    _, rounds, compare, first = _rounds(qv, pv, feats, k, block_rows, metric)
    return first if len(rounds) == 1 else first.unionByName(compare(rounds[1]))


def compared_pairs(queries: DataFrame, pool: DataFrame, feats: Sequence[str], p_id: str, k: int = 1,
                   block_rows: int = DEFAULT_BLOCK) -> DataFrame:
    """One row: distinct query vectors, pool entries, and the pairs whose distance the search computes."""
    feats = list(feats)
    qv, pv = _vectors(queries, feats), pool_entries(pool, feats, p_id, None, k)
    placed, rounds, _, _ = _rounds(qv, pv, feats, k, block_rows, None)
    sizes = F.broadcast(placed.groupBy("_cell").agg(F.count("*").alias("_n")))
    met = [r.groupBy("_cell").agg(F.count("*").alias("_q")) for r in rounds]
    pairs = met[0] if len(met) == 1 else met[0].unionByName(met[1])
    return pairs.join(sizes, "_cell").agg(F.sum(F.col("_q") * F.col("_n")).cast("bigint").alias("COMPARED")).select(
        F.lit(rounds[0].count()).alias("QUERIES"), F.lit(placed.count()).alias("ENTRIES"), "COMPARED")


def _vectors(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f).cast("double").alias(f) for f in feats]).dropna(subset=list(feats)).distinct()


def pool_entries(pool: DataFrame, feats: Sequence[str], id_col: str, label: str | None, per_vector: int) -> DataFrame:
    """Pool as (feats, _pid, _plab, _pmult): the `per_vector` smallest ids of each distinct vector, with the vector's multiplicity.
    One id per vector is a partial/final aggregate (null is the smallest id, as in an ordering), more are a skew-safe k-smallest."""
    x = pool.select(*[F.col(f).cast("double").alias(f) for f in feats], F.col(id_col).cast("bigint").alias("_pid"),
                    (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("_plab"))
    x = x.dropna(subset=list(feats))
    if per_vector == 1:
        if label:
            first = x.groupBy(*feats).agg(F.min(F.struct("_pid", "_plab")).alias("_f"), F.count("*").alias("_pmult"))
            return first.select(*feats, F.col("_f._pid").alias("_pid"), F.col("_f._plab").alias("_plab"), "_pmult")
        smallest = F.when(F.count("_pid") == F.count("*"), F.min("_pid"))
        return x.groupBy(*feats).agg(smallest.alias("_pid"), F.count("*").alias("_pmult")).select(
            *feats, "_pid", F.lit(None).cast("string").alias("_plab"), "_pmult")
    mult = x.groupBy(*feats).agg(F.count("*").alias("_pmult"))
    firsts = k_smallest_per_group(x, list(feats), ["_pid"], per_vector, "_pid").drop("_rank")
    return firsts.join(mult, list(feats), "inner")


def nearest(queries: DataFrame, pool: DataFrame, feats: Sequence[str], q_id: str, p_id: str, label: str | None = None,
            k: int = 1, block_rows: int = DEFAULT_BLOCK, entries: DataFrame | None = None) -> DataFrame:
    """For each query row: its k nearest pool rows (RANK 1..k, NN_ID, NN_DIST, NN_LABEL). `entries`: the pool's `pool_entries`,
    if they are at hand."""
    feats = list(feats)
    qv = _vectors(queries, feats)
    pv = pool_entries(pool, feats, p_id, label, k) if entries is None else entries
    cand = _candidates(qv, pv, feats, k, block_rows)
    best = k_smallest_per_group(cand, feats, ["_d2", "_pid"], k, "_pid", salts=1, out="RANK")
    qrows = queries.select(F.col(q_id), *[F.col(f).cast("double").alias(f) for f in feats])
    return qrows.join(best, feats, "left").select(
        q_id, "RANK", F.col("_pid").alias("NN_ID"), F.sqrt("_d2").alias("NN_DIST"), F.col("_plab").alias("NN_LABEL"))


def nn_label_1(queries, pool, feats, q_id, p_id, label, block_rows=DEFAULT_BLOCK) -> DataFrame:
    return nearest(queries, pool, feats, q_id, p_id, label, 1, block_rows).drop("RANK")


def nn_vote_k(queries, pool, feats, q_id, p_id, label, k: int = 3, block_rows=DEFAULT_BLOCK) -> DataFrame:
    """Distance-weighted vote of the k nearest rows (weight 1/d); if any neighbour is an exact
    match, only exact matches vote (weight 1). Ties -> smallest label. Pool rows without a label
    cannot vote and are left out."""
    nb = nearest(queries, pool.where(F.col(label).isNotNull()), feats, q_id, p_id, label, k, block_rows)
    has0 = F.max((F.col("NN_DIST") == 0).cast("int")).over(Window.partitionBy(q_id))
    w = F.when(F.col("_has0") == 1, F.when(F.col("NN_DIST") == 0, 1.0).otherwise(0.0)).otherwise(1.0 / F.col("NN_DIST"))
    votes = nb.withColumn("_has0", has0).withColumn("_w", w).groupBy(q_id, "NN_LABEL").agg(F.sum("_w").alias("_score"))
    r = votes.withColumn("_r", F.row_number().over(Window.partitionBy(q_id).orderBy(F.col("_score").desc(), F.col("NN_LABEL"))))
    return r.where(F.col("_r") == 1).select(q_id, F.col("NN_LABEL").alias("PRED"), F.round("_score", 6).alias("SCORE"))


def k_distance(df: DataFrame, feats: Sequence[str], id_col: str, k: int, block_rows: int = DEFAULT_BLOCK) -> DataFrame:
    """Distance of every row to its k-th nearest row of the same table (the row itself counts),
    computed on distinct vectors with multiplicities."""
    feats = list(feats)
    qv = _vectors(df, feats)
    pv = pool_entries(df, feats, id_col, None, 1)
    cand = _candidates(qv, pv, feats, k, block_rows)
    best = k_smallest_per_group(cand, feats, ["_d2", "_pid"], k, "_pid", salts=1, out="_r")
    cum = F.sum("_pmult").over(Window.partitionBy(*feats).orderBy("_d2", "_pid").rowsBetween(Window.unboundedPreceding, 0))
    kd = best.withColumn("_cum", cum).where(F.col("_cum") >= k).groupBy(*feats).agg(F.min("_d2").alias("_kd2"))
    rows = df.select(id_col, *[F.col(f).cast("double").alias(f) for f in feats])
    return rows.join(kd, feats, "left").select(id_col, F.sqrt("_kd2").alias("KDIST"))


def radius_visits(vectors: DataFrame, feats: Sequence[str], eps: float, block_rows: int = DEFAULT_BLOCK) -> tuple[DataFrame, DataFrame]:
    """vectors: distinct (feats as double, _pid, ...), stored. Returns them with their own cell, and a row (feats, _pid, _cell)
    for every cell whose box lies within eps of a vector (its own included): all vectors within eps of it are in those cells."""
    feats = list(feats)
    placed, cells = _cells(vectors, feats, Metric.squared(len(feats)), min(LEAF_ROWS, block_rows))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), WALK_ROWS):
                part = batch.iloc[s:s + WALK_ROWS]
                x = part[feats].to_numpy(dtype=np.float64)
                rows, cell = cells.within(x, np.full(len(x), within_radius(eps)))
                yield part.iloc[rows].assign(_cell=cell.astype(np.int32))

    columns = ", ".join(f"`{f}` double" for f in feats)
    return placed, cut_lineage(vectors.select(*feats, "_pid").mapInPandas(walk, f"{columns}, _pid bigint, _cell int"))


def within_radius(eps: float) -> float:
    """The largest squared distance that counts as within eps."""
    return eps * eps + 1e-12


def gower_nearest(queries: DataFrame, pool: DataFrame, num_feats: Sequence[str], cat_feats: Sequence[str], q_id: str,
                  p_id: str, block_rows: int = DEFAULT_BLOCK) -> DataFrame:
    """Gower distance of each query row to its nearest pool row: mean over features of |diff|/range
    (numeric; range taken over the pool) and 0/1 mismatch (categorical, integer-coded)."""
    feats = [*num_feats, *cat_feats]
    rng = pool.agg(*[(F.max(f) - F.min(f)).cast("double").alias(f) for f in num_feats]).first() if num_feats else {}
    ranges = [float(rng[f] or 0.0) for f in num_feats] + [1.0] * len(cat_feats)
    is_cat = [False] * len(num_feats) + [True] * len(cat_feats)
    qv = _vectors(queries, feats)
    pv = pool_entries(pool, feats, p_id, None, 1)
    cand = _candidates(qv, pv, feats, 1, block_rows, Metric.gower(ranges, is_cat))
    best = k_smallest_per_group(cand, feats, ["_d2", "_pid"], 1, "_pid", salts=1, out="_r")
    qrows = queries.select(F.col(q_id), *[F.col(f).cast("double").alias(f) for f in feats])
    return qrows.join(best, feats, "left").select(q_id, F.col("_pid").alias("NN_ID"), F.col("_d2").alias("GOWER_DIST"))
