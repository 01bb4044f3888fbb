"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

Vectors are scaled to length 1, where cosine c means distance sqrt(2 - 2c). A table's key is ``k`` quantised Gaussian projections
floor((a.x + b) / w); two vectors at distance r agree in one with probability p(r), so in a table with p(r)**k. ``k`` grows with the
logarithm of the number of vectors, so that a bucket holds few unrelated vectors at any size, and the number of tables
follows from it, so that a pair exactly at the threshold is missed with probability MISS at most (closer pairs much less).

Equal vectors are one class with a count. Inside a bucket all cosines are computed in double precision by blocks of at most CHUNK vectors (larger
buckets are dealt out as pairs of blocks), TILE rows at a time; what leaves the block are counts of links and a spanning star of each linked set, never
the pairs. A pair that meets in several tables is counted in the first one only.

Defined results: vectors that are null, zero, empty or hold null or non-finite components link with nothing and are kept; vectors of
different lengths link with nothing; rows are vectors, also if they share a vec_id: each has its own links and component, and
a component is named by the smallest vec_id of its rows; a row without vec_id links with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, written
from ..operators.components import connected_components
from .textcore import U64, fmix

THRESHOLD = 0.95
MISS = 1e-3
BUCKET = 16
CHUNK = 1024
#: Rows of a block whose cosines are held at once, and pairs whose keys are compared at once.
TILE = 256
PAIRS = 1 << 14


def agreement(ratio: float) -> float:
    """Probability that one quantised projection agrees, for width / distance = ratio."""
    below = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * below - math.sqrt(2 / math.pi) / ratio * (1 - math.exp(-ratio * ratio / 2))


def plan_tables(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[float, int, int]:
    """Width, projections per table and number of tables for ``n`` vectors."""
    near, far = math.sqrt(2 - 2 * threshold), math.sqrt(2)
    width = 4 * near
    k = max(1, math.ceil(math.log(max(2.0, n / BUCKET)) / -math.log(agreement(width / far))))
    return width, k, math.ceil(math.log(miss) / math.log(1 - agreement(width / near) ** k))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)  # first by the largest component, so that squares cannot overflow
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector's bytes, null where it takes no part."""
    for batch in batches:
        column = batch.column(1)
        kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
        out = []
        for v in column:
            x = None if not v.is_valid else v.values
            if x is None or x.null_count or not len(x):
                out.append(None)
                continue
            x = np.asarray(x.to_numpy(zero_copy_only=False), kind)
            out.append((x + kind(0)).tobytes() if np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "raw"])


def _matrix(raw: pa.Array, kind) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), kind) for x in raw])


def _bucket(width: float, k: int, tables: int, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple] = {}
        mix = fmix(np.arange(1, k + 1, dtype=U64)) | U64(1)
        for batch in batches:
            raw = batch.column(1)
            size = np.array([len(x.as_buffer()) for x in raw])
            for s in np.unique(size):
                rows = np.flatnonzero(size == s)
                dim = int(s) // np.dtype(kind).itemsize
                if dim not in planes:
                    rng = np.random.default_rng([20, dim])
                    planes[dim] = rng.standard_normal((dim, tables * k)), rng.random(tables * k) * width
                a, b = planes[dim]
                for x in range(0, len(rows), 2048):
                    some = rows[x:x + 2048]
                    cell = np.floor((_unit(_matrix(raw.take(pa.array(some)), kind)) @ a + b) / width).astype(np.int64).view(U64)
                    key = fmix((fmix(cell.reshape(len(some), tables, k)) * mix).sum(axis=2, dtype=U64) + U64(dim))
                    keys = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * tables),
                                                    pa.array(key.ravel().view(np.int64)))
                    at = pa.array(some)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), raw.take(at), batch.column(2).take(at), keys], ["class", "raw", "n", "keys"])
    return run


def _tiles(x: np.ndarray, side: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, which of all rows each of the next TILE rows is linked with): the cosines of a tile are all that is held at once."""
    for a in range(0, len(x), TILE):
        hit = x[a:a + TILE] @ x.T >= threshold
        np.fill_diagonal(hit[:, a:], False)
        if side[0] != 2:  # two blocks of one bucket: pairs within a block are found elsewhere
            hit &= side[a:a + TILE, None] != side[None, :]
        yield a, hit


def _links_of_block(ids, n, x, keys, table: int, side, threshold: float):
    """Links found in one block: (id, count) and star edges (id, smallest of its linked set)."""
    links, bits = np.zeros(len(ids), np.int64), []
    for first, hit in _tiles(x, side, threshold):
        i, j = np.nonzero(hit)
        bits.append(None if not len(i) else hit if len(ids) <= TILE else np.packbits(hit, axis=1))
        for a in range(0, len(i), PAIRS):  # links that an earlier table has found are not counted again
            some, other = i[a:a + PAIRS] + first, j[a:a + PAIRS]
            if table:
                new = ~(keys[some, :table] == keys[other, :table]).any(axis=1)
                some, other = some[new], other[new]
            links += np.bincount(some, n[other], len(ids)).astype(np.int64) if len(some) else 0
    if all(b is None for b in bits):  # as in most buckets
        return None
    label, moved = ids.copy(), True
    while moved:
        moved = False
        for first, packed in zip(range(0, len(ids), TILE), bits):
            if packed is not None:
                rows = slice(first, first + len(packed))
                hit = packed if packed.dtype == bool else np.unpackbits(packed, axis=1, count=len(ids)).view(bool)
                low = np.minimum(label[rows], np.where(hit, label[None, :], np.iinfo(np.int64).max).min(axis=1))
                moved |= bool((low < label[rows]).any())
                label[rows] = low
    return links, label


def _verify(threshold: float, kind):
    def block(t: pa.Table) -> pa.RecordBatch | None:
        table = t.column("t")[0].as_py()
        ids, n, side = (t.column(c).to_numpy() for c in ("class", "n", "side"))
        keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        raw = t.column("raw").combine_chunks()
        out = []
        if len({len(x.as_buffer()) for x in raw}) > 1:  # two lengths under one key by accident
            return None
        found = _links_of_block(ids, n, _unit(_matrix(raw, kind)), keys, table, side, threshold)
        if found is None:
            return None
        links, label = found
        out = np.flatnonzero((links > 0) | (label != ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(label[out]), pa.array(links[out])], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            ends = _ends(held)
            for a, b in zip(ends[:-2], ends[1:-1]):  # the last block may go on in the next batch
                if b - a > 1 and (found := block(held.slice(a, b - a))) is not None:
                    yield found
            held = held.slice(ends[-2])
        if held is not None and held.num_rows > 1 and (found := block(held)) is not None:
            yield found
    return run


def _ends(t: pa.Table) -> list[int]:
    cols = [t.column(c).to_numpy() for c in ("t", "key", "c", "d")]
    change = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return [0, *(np.flatnonzero(change) + 1).tolist(), t.num_rows]


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    kind = np.float32 if "float" in vectors.schema["embedding"].dataType.simpleString() else np.float64
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    packed = written(source.mapInArrow(_pack, "vec_id long, raw binary"), "vectors")
    # a class is a stored row with a number of its own; the ids of its rows are values only, as different vectors may share one
    classes = packed.where("raw is not null and vec_id is not null").groupBy("raw").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = cut_lineage(classes.withColumn("class", F.monotonically_increasing_id()))
    width, k, tables = plan_tables(max(1, classes.count()), threshold, miss)
    hashed = written(classes.select("class", "raw", "n").mapInArrow(
        _bucket(width, k, tables, kind), "class long, raw binary, n long, keys array<long>"), "hashed")
    entries = hashed.select("class", F.posexplode("keys").alias("t", "key"))
    shared = cut_lineage(entries.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    spread = (
        hashed.select("class", "raw", "n", "keys", F.posexplode("keys").alias("t", "key")).join(shared, ["t", "key"])
        .withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("class", "t"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    )
    # a bucket of one block is side 2; of two or more, each pair of blocks looks across only, and each block also at itself
    side = F.when(F.col("chunk") == F.col("other"), 2).otherwise((F.col("chunk") > F.col("other")).cast("int"))
    blocks = spread.select("t", "key", F.least("chunk", "other").alias("c"), F.greatest("chunk", "other").alias("d"),
                           side.alias("side"), "class", "n", "raw", "keys")
    blocks = blocks.repartition("t", "key", "c", "d").sortWithinPartitions("t", "key", "c", "d", "class")
    found = cut_lineage(blocks.mapInArrow(_verify(threshold, kind), "a long, b long, links long"))
    links = found.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    merged = connected_components(found.select("a", "b")).withColumnRenamed("node", "class")
    named = cut_lineage(classes.join(links, "class", "left").join(merged, "class", "left").select(
        "raw", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("set")))
    smallest = named.groupBy("set").agg(F.min("rep").alias("component"))
    of_class = cut_lineage(named.join(smallest, "set").select("raw", "n_links", "component"))
    out = packed.join(of_class, "raw", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long")
                      .alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
