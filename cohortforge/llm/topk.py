"""Exact top-k inner product search over an impact-ordered, score-at-a-time index.

Components become integers floor(256 * x). The index of a block of vectors has, for each dimension, the vectors in descending order
of the component's size, cut into segments of equal quantised size (LEVELS). For a query, a segment's impact is the query
component's size times the segment's largest size; segments are processed in descending impact, a batch at a time, so that of each
dimension a prefix of its postings is done. By Cauchy-Schwarz and the means' inequality the rest of a vector's score is at most half the sum of
what is left of both squared lengths (scaled to like size), so each posting lowers its vector's bound by half of (x - q)^2. The k-th best exact score so far is a threshold: once only few vectors can still
reach it, those are rescored exactly and nothing else can be a member; processing never stops otherwise.

First each query searches one block; its k-th score there is a lower bound of its k-th score of all and the threshold that it brings to
all other blocks, so a block without near vectors is given up early. Query blocks meet candidate blocks in one task each; a pair of blocks
sends on k rows per query at most, and only those that reach the query's bound.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without id; rows are vectors, also
if they share a vec_id: each such row is a query of its own and a candidate of the other; shorter vectors count as filled with zeros; ties go
to the smaller vec_id; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 256
TOP = 5
EVERY = 50
LEVELS = 16
BLOCK = 4096


class ImpactIndex:
    """Postings of one block of integer vectors."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        self.rows, self.ids, self.x = rows, ids, x
        self.norms = (x.astype(np.float64) ** 2).sum(axis=1)
        self.mean_norm = float(self.norms.mean())
        self.float = x.astype(np.float64)
        size = np.abs(x)
        self.order = np.argsort(-size, axis=0, kind="stable").T.astype(np.int32)  # dimension, posting
        self.values = np.take_along_axis(x.T, self.order, axis=1).astype(np.float64)
        top = max(1, int(size.max(initial=1)))
        step = -(-top // LEVELS)
        level = (np.abs(self.values) + step - 1) // step  # 0: component 0, adds nothing
        n_dim = x.shape[1]
        # segment (dimension, level): postings from ends[level + 1] to ends[level]
        self.ends = np.stack([np.searchsorted(-level[d], -np.arange(LEVELS + 2), side="right") for d in range(n_dim)])
        self.largest = np.arange(LEVELS + 2) * float(step)

    def search(self, q: np.ndarray, own: int, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows of the block with a score of ``least`` or more, without the row ``own``."""
        n, dims = self.x.shape
        alive = self.rows != own
        whole, q = q, q.astype(np.float64)
        weight = np.abs(q)
        impact = weight[:, None] * self.largest[None, 1:LEVELS + 1]
        order = np.argsort(-impact, axis=None, kind="stable")
        sizes = (self.ends[:, 1:LEVELS + 1] - self.ends[:, 2:LEVELS + 2]).ravel()[order]
        live = (sizes > 0) & (impact.ravel()[order] > 0)
        order, sizes = order[live], sizes[live]
        done = np.cumsum(sizes)
        query_norm = float((weight**2).sum())
        # any positive scale gives a bound; the best one makes both lengths alike
        scale = max(1e-9, np.sqrt(self.mean_norm / query_norm)) if query_norm and self.mean_norm else 1.0
        bound = (self.norms / scale + query_norm * scale) / 2
        best, at = least, 0
        x_scale, q_scaled = 1 / np.sqrt(scale), q * np.sqrt(scale)
        ends = np.zeros(dims, np.int64)
        for share in (1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 1):
            to = int(np.searchsorted(done, share * done[-1])) + 1 if len(done) else 0
            to = min(to, len(order))
            dim, level = np.divmod(order[at:to], LEVELS)
            at = to
            if len(dim):
                reached = ends.copy()
                np.maximum.at(reached, dim, self.ends[dim, level + 1])
                dim = np.flatnonzero(reached > ends)
                docs = np.concatenate([self.order[d, ends[d]:reached[d]] for d in dim])
                part = np.concatenate([self.values[d, ends[d]:reached[d]] for d in dim])
                part *= x_scale
                part -= np.repeat(q_scaled[dim], (reached - ends)[dim])
                part *= part
                bound -= np.bincount(docs, part, n) / 2
                ends = reached
            likely = np.argpartition(-np.where(alive, bound, -np.inf), min(4 * k, n - 1))[:4 * k]
            likely = likely[alive[likely]]
            if len(likely) >= k:
                best = max(best, np.partition(self.float[likely] @ q, len(likely) - k)[len(likely) - k])
            # components that are zero on one side are in no segment that counts: what they leave in the bound is only too much
            member = np.flatnonzero(alive & (bound + 0.5 >= best))
            # to rescore a vector costs less than to go on with a few of its postings
            if len(member) <= max(64, n // 6) or at == len(order):
                break
        exact = self.x[member] @ whole
        member, exact = member[exact >= least], exact[exact >= least]
        top = np.lexsort((self.ids[member], -exact))[:k]
        return self.ids[member[top]], exact[top]


def _vectors(t: pa.Table) -> list[np.ndarray]:
    return [np.asarray(v.values.to_numpy()) for v in t.column("x").combine_chunks()]


def _search(k: int):
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        rows, queries = _vectors(left), _vectors(right)
        dim = max(map(len, [*rows, *queries]))
        fill = lambda x: np.stack([np.pad(v, (0, dim - len(v))) for v in x])
        index = ImpactIndex(left.column("row").to_numpy(), left.column("vec_id").to_numpy(), fill(rows))
        out = []
        for row, own, least, q in zip(*(right.column(c).to_pylist() for c in ("row", "vec_id", "least")), fill(queries)):
            got, score = index.search(q, row, k, -np.inf if least is None else least)
            out.append((np.full(len(got), row), np.full(len(got), own), got, score))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    return run


def top_inner_products(vectors: DataFrame, k: int = TOP, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, embedding) whose id is divisible by ``every``, its ``k``
    largest integer inner products with all other rows."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & usable).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("x"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "integers")  # stored, so row numbers are facts
    queries = rows.where(F.col("vec_id") % every == 0).select(*[F.col(c).alias(c) for c in rows.columns])  # columns of their own
    n_rows, n_queries = -(-rows.count() // block) or 1, -(-queries.count() // block) or 1
    rows = rows.withColumn("c", F.pmod(F.xxhash64("row"), F.lit(n_rows)).cast("int"))
    # a query's first block is dealt by another hash than its place, so that a block's first queries are from all blocks
    first = F.pmod(F.xxhash64(F.lit("first"), "row"), F.lit(n_rows)).cast("int")
    queries = queries.withColumn("first", first).withColumn("q", F.pmod(F.xxhash64("row"), F.lit(n_queries)).cast("int"))
    answer = "query long, query_id long, vec_id long, score long"
    early = written(rows.groupBy("c").cogroup(queries.withColumn("c", F.col("first")).withColumn("least", F.lit(None).cast("long")).groupBy("c"))
                    .applyInArrow(_search(k), answer), "first-scores")
    # fewer than k rows in the first block are no bound
    least = early.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least")).withColumnRenamed("query", "row")
    left = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    right = queries.join(least, "row", "left").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))).where("c <> first")
    late = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInArrow(_search(k), answer)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return (early.union(late).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
