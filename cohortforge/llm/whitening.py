"""Whitening of vectors through a blockwise QR factorisation and the bidiagonal qd route.

Vectors become integers x = floor(64 c) + 1000000. The covariance is that of the distinct x vectors. Their sums are exact, so that n x - S is
exact too; tasks factor blocks of the centred rows and keep one triangle, triangles are factored together in groups until a few
are left, and the last one (as large as the dimension squared, whatever the rows) goes through ``bidiagonal.right_singular``. The
covariance matrix itself is never formed. Directions are computed once and sent to the tasks that project all rows.

Defined results: rows whose vector is null or holds null or non-finite entries, or entries whose x is not a long, take no part; shorter
vectors count as filled with entries of 0 (an empty one is all such entries); repeated rows are rows, counted once in the fit; a row
without vec_id takes part and keeps its null; directions without variance (singular value below RANK of the largest) cannot be
scaled and are left out, so one distinct vector or an empty table gives no rows; a deviation beyond a long is null. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bidiagonal import right_singular
from .common import written

SCALE = 64
OFFSET = 1_000_000
TOP = 16
RANK = 1e-10
BLOCK = 2048
#: Triangles that one task factors together, and how many the driver may take.
GROUP = 16
_LIMB = 32


def _rows(t: pa.RecordBatch, dim: int) -> np.ndarray:
    """The stored vectors as a matrix of x - OFFSET, filled to ``dim``."""
    raw = t.column(t.schema.get_field_index("raw"))
    size = np.array([len(x.as_buffer()) for x in raw], np.int64)
    out = np.zeros((len(raw), dim), np.int64)
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        data = np.frombuffer(b"".join(raw.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), int(s))
        for wide, kind in ((2, np.int16), (8, np.int64)):
            some = data[:, 0] == wide
            if some.any() and s > 1:
                out[at[some], :(s - 1) // wide] = np.ascontiguousarray(data[some, 1:]).view(kind)
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id and x - OFFSET without zeros at the end, as a width (2 or 8) and that many bytes each; rows that take no part are left out."""
    for batch in batches:
        column = batch.column(1)
        valid = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        lists = column.take(pa.array(valid))
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
        bad = np.concatenate([[0], np.cumsum(~(np.abs(x) < 2.0**62))])
        usable = np.flatnonzero(bad[ends[1:]] == bad[ends[:-1]])
        raw = []
        for i in usable:
            v = x[ends[i]:ends[i + 1]].astype(np.int64)
            filled = np.flatnonzero(v)
            v = v[:filled[-1] + 1] if len(filled) else v[:0]
            small = not len(v) or (v.min() >= -32768 and v.max() < 32768)
            raw.append(b"\x02" + v.astype(np.int16).tobytes() if small else b"\x08" + v.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(valid[usable])), pa.array(raw, pa.binary())], ["vec_id", "raw"])


def _sums(dim: int):
    """One row per task: the rows and the sums of the entries, in two limbs so that they stay exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            x = _rows(batch, dim)
            n += len(x)
            high += (x >> _LIMB).sum(axis=0)
            low += (x & ((1 << _LIMB) - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([high.tolist()]), pa.array([low.tolist()])], ["n", "high", "low"])
    return run


def _off(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n x - S, exact: as longs where they fit, else as Python's integers. The offset cancels."""
    most = n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, s), default=0)
    if most < 1 << 62:
        return n * x - np.array(s, np.int64)
    return x.astype(object) * n - np.array(s, object)


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _factor(dim: int, n: int, s: list[int]):
    """One triangle per task from the centred rows, block by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dim))
        for batch in batches:
            x = _rows(batch, dim)
            for a in range(0, len(x), BLOCK):
                r = _triangle(np.vstack([r, _off(x[a:a + BLOCK], n, s).astype(np.float64) / n]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])
    return run


def _refactor(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dim))
        for batch in batches:
            for x in batch.column(0):
                r = _triangle(np.vstack([r, np.frombuffer(x.as_buffer()).reshape(-1, dim)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])
    return run


def _spread(dim: int, n: int, s: list[int], directions: np.ndarray):
    """One row per task: sums of the whitened rows and of their products."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = directions.shape[1]
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = (_off(_rows(batch, dim), n, s).astype(np.float64) / n) @ directions
            total += w.sum(axis=0)
            products += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([[*total, *products.ravel()]])], ["sums"])
    return run


def _project(dim: int, n: int, s: list[int], directions: np.ndarray, explained: np.ndarray, error: float, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = directions.shape[1]
        for batch in batches:
            off = _off(_rows(batch, dim), n, s)
            top = max(1, int(np.abs(off).max(initial=0)))
            wide = off if dim * top * top < 1 << 63 else off.astype(object)
            deviation = [int(d) if d < 1 << 63 else None for d in (wide * wide).sum(axis=1)]
            whitened = (off.astype(np.float64) / n) @ directions
            rows = np.repeat(np.arange(len(off)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(off))),
                pa.array(np.full(len(rows), n)), pa.array(deviation, pa.int64()).take(pa.array(rows)), pa.array(whitened.ravel()),
                pa.array(np.tile(explained, len(off))), pa.array(np.full(len(rows), error))], schema=schema)
    return run


def _one_triangle(triangles: DataFrame, dim: int) -> np.ndarray:
    """Factor stored triangles together in groups of GROUP, round by round, until one task's worth is left."""
    left = triangles.count()
    while left > GROUP:
        parts = -(-left // GROUP)
        triangles = written(triangles.repartition(parts, F.xxhash64("r")).mapInArrow(_refactor(dim), "r binary"), "triangles")
        left = triangles.count()
    last = [np.frombuffer(row.r).reshape(-1, dim) for row in triangles.collect()]
    r = _triangle(np.vstack(last)) if last else np.zeros((0, dim))
    return np.vstack([r, np.zeros((dim - len(r), dim))])


def whiten(vectors: DataFrame, most: int = TOP) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row of ``vectors`` (vec_id, embedding) and each
    of the first ``most`` components."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    packed = written(vectors.select("vec_id", "embedding").mapInArrow(_pack, f"vec_id {kind}, raw binary"), "packed")
    fit = written(packed.select("raw").distinct(), "fit")
    width = F.when(F.substring("raw", 1, 1) == F.lit(b"\x02"), 2).otherwise(8)
    dim = int(fit.agg(F.max(((F.octet_length("raw") - 1) / width).cast("int"))).first()[0] or 0)
    names = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    if not dim:
        return spark.createDataFrame([], names)
    parts = fit.mapInArrow(_sums(dim), "n long, high array<long>, low array<long>")
    sums = parts.agg(F.sum("n").alias("n"), *[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("high", "low") for i in range(dim)]).first()
    n, s = int(sums.n), [(int(sums[f"high{i}"]) << _LIMB) + int(sums[f"low{i}"]) for i in range(dim)]
    r = _one_triangle(written(fit.mapInArrow(_factor(dim, n, s), "r binary"), "triangles"), dim)
    squares, axes = right_singular(r, most)
    kept = squares > RANK * RANK * squares.max(initial=0.0)
    squares, axes = squares[kept], axes[:, kept]
    if not len(squares):
        return spark.createDataFrame([], names)
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    directions = axes / np.sqrt(squares / n)
    sums = fit.mapInArrow(_spread(dim, n, s, directions), "sums array<double>")
    k = len(squares)
    sums = np.array(sums.agg(*[F.sum(F.col("sums")[i]) for i in range(k + k * k)]).first())
    mean = sums[:k] / n
    error = float(np.abs(sums[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = squares / float((r * r).sum())
    empty = spark.createDataFrame([], names)
    schema = pa.schema([(f.name, t) for f, t in zip(empty.schema, _arrow_types(empty))])
    return packed.mapInArrow(_project(dim, n, s, directions, explained, error, schema), names)


def _arrow_types(df: DataFrame) -> list[pa.DataType]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    return [kinds[f.dataType.simpleString()] for f in df.schema]
