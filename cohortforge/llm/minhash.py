"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Every document becomes the set of its distinct k-word shingles (64-bit hashes) and a signature of ``coords`` minima. Documents
   with equal sets form a class; only one member of a class goes on.
2. Two sets of similarity s agree in each coordinate with probability s. A pair is a candidate if at least ``matches`` coordinates
   agree. Coordinate-value pairs are ordered by how many signatures hold them, rare ones first; two signatures that agree in
   ``matches`` coordinates then share one of the ``coords - matches + 1`` rarest of each (the prefix), so only those
   are posted, and values that nobody shares are skipped altogether.
3. In a posting list, collisions are counted against the list's first document, pairs with enough collisions are confirmed on their
   full shingle sets, and confirmed pairs are merged into components. Then the lists that still hold more than one component
   count the collisions of their cross-component pairs, each pair in the first list that it shares. The documents of pairs with enough
   collisions meet once more in that list with their shingle sets; all pairs are confirmed there, as intersections of bit sets, and
   only a spanning forest of the confirmed ones leaves the task. A pair that is left out is in one component already, so no
   component is lost, and no group is sent out as all its pairs. Lists of more than ``CHUNK`` documents or ``CHUNK_BYTES`` of shingle
   sets are dealt out by chunk (first pass) and by pairs of chunks (second pass), so very long documents make chunks of few documents.

With 32 coordinates and 15 matches, a pair of similarity exactly 0.8 is missed with probability 6e-6, less above.

Defined results: no words or a null text: an empty set, linked with nothing; fewer words than a shingle: the whole sequence is the one
shingle; rows are documents, also if they share a doc_id, and a component is named by the smallest doc_id in it; a row without doc_id is linked
with nothing and kept by near_duplicates, while drop_near_duplicates links it by its text as any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted_broadcast, cut_lineage, fresh, written
from ..operators.components import connected_components
from .textcore import LOWER, U64, fmix, text_slices, word_hashes, word_spans

COORDS = 32
MATCHES = 15
CHUNK = 1024
CHUNK_BYTES = 16 << 20
#: What a task gathers of a sorted partition before it works on the whole lists among it: rows, bytes.
HELD_ROWS, HELD_BYTES = 20_000, 32 << 20
#: Bit sets of a list beyond this size are not made; its sets are intersected pair by pair.
BIT_BYTES = 32 << 20


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = fmix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    return a, fmix(a + U64(0x632BE59BD9B4E019))


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of a slice of documents and the number of shingles before each document."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    n_words = np.diff(first)
    count = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    bounds = np.zeros(len(offsets), np.int64)
    np.cumsum(count, out=bounds[1:])
    at = np.repeat(first[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    length = np.repeat(np.minimum(n_words, k), count)
    weights, _ = _multipliers(k)
    padded = np.concatenate([words, np.zeros(k, U64)])
    h = length.astype(U64) * U64(0xA0761D6478BD642F)
    for j in range(k):
        h += np.where(j < length, padded[at + j], U64(0)) * weights[j]
    return fmix(h), bounds


def distinct_sets(h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        s = np.sort(h[a:b])
        keep = np.ones(len(s), bool)
        np.not_equal(s[1:], s[:-1], out=keep[1:])
        out.append(s[keep])
    return out


def signatures(h: np.ndarray, bounds: np.ndarray, coords: int) -> np.ndarray:
    """One row of ``coords`` 32-bit minima per document; rows of empty documents are zero."""
    out = np.zeros((len(bounds) - 1, coords), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        a, b = _multipliers(coords)
        for j in range(coords):
            out[full, j] = np.minimum.reduceat((h * a[j] + b[j]) >> U64(32), bounds[full]).astype(np.uint32)
    return out


def _sign(k: int, coords: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, data, offsets in text_slices(batch.column(1)):
                h, bounds = shingles(data, offsets, k)
                sets = distinct_sets(h, bounds)
                sizes = np.array([len(x) for x in sets], np.int64)
                flat, to = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])
                sums = []
                for seed in (0x8BB84B93962EACC9, 0x2D358DCCAA6C78A5):
                    total = np.concatenate([np.zeros(1, U64), np.cumsum(fmix(flat ^ U64(seed)))])
                    sums.append((total[to[1:]] - total[to[:-1]]).view(np.int64))
                sig = signatures(h, bounds, coords).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(sizes)), batch.column(2).slice(row, len(sizes)), pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * coords),
                                              pa.array(sig.ravel()))],
                    ["doc_id", "digest", "n_shingles", "set_a", "set_b", "sig"])
    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(1)):
                sets = distinct_sets(*shingles(data, offsets, k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(sets)), pa.array([x.tobytes() for x in sets], pa.binary())],
                    ["rep", "shingles"])
    return run


def _lists(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """Whole posting lists of a sorted partition, many at a time: (list number of each row, columns, signatures).
    The first ``keys`` columns name a list, the last one is the signature."""
    held: pa.Table | None = None

    def out(table: pa.Table):
        cols = [c.to_numpy(zero_copy_only=False) for c in table.combine_chunks().columns[:-1]]
        sig = table.column(table.num_columns - 1).combine_chunks()
        sig = sig.flatten().to_numpy().reshape(table.num_rows, -1)
        new = np.ones(len(cols[0]), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0)
        return np.cumsum(new) - 1, cols, sig

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < HELD_ROWS and held.nbytes < HELD_BYTES:
            continue
        cols = [c.to_numpy() for c in held.columns[:keys]]
        same = np.all([c == c[-1] for c in cols], axis=0)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last list may go on
        if cut:
            yield out(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield out(held)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_PAIR)


def _against_first(matches: int):
    """Of each (item, chunk) list, its first document with every other that collides often enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (_, _, rep), sig in _lists(batches, 2):
            lead = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])[number]
            hit = (np.count_nonzero(sig == sig[lead], axis=1) >= matches) & (rep != rep[lead])
            if hit.any():
                yield _pairs(rep[lead[hit]], rep[hit])
    return run


def _cross_pairs(number, coord, rep, comp, side, mask, sig, matches: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of one list in different components that collide often enough, if this list is the first that they share."""
    low, high = (np.full(int(number[-1]) + 1, x) for x in (np.iinfo(np.int64).max, np.iinfo(np.int64).min))
    np.minimum.at(low, number, comp)
    np.maximum.at(high, number, comp)
    live = np.flatnonzero((low != high)[number])
    bits = np.arange(sig.shape[1])
    lag = 1
    while lag < len(live):
        i = np.flatnonzero(number[live[lag:]] == number[live[:-lag]])
        if not len(i):
            break
        i, j = live[i], live[i + lag]
        # in a pair of two chunks, pairs within a chunk are counted elsewhere (side: 2 if there is only one chunk)
        ok = (comp[i] != comp[j]) & ((side[i] != side[j]) | (side[i] == 2))
        i, j = i[ok], j[ok]
        for x in range(0, len(i), 1 << 16):
            a, b = i[x:x + (1 << 16)], j[x:x + (1 << 16)]
            same = sig[a] == sig[b]
            posted = ((mask[a] & mask[b])[:, None] >> bits) & 1
            hit = (np.count_nonzero(same, axis=1) >= matches) & ((same & (posted == 1)).argmax(axis=1) == coord[a])
            if hit.any():
                yield a[hit], b[hit]
        lag += 1


def _meeting(matches: int):
    """Of each (item, chunk pair) list, the documents that take part in a pair to be confirmed there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (item, c, d, rep, comp, side, mask), sig in _lists(batches, 3):
            take = np.zeros(len(rep), bool)
            for a, b in _cross_pairs(number, item >> 32, rep, comp, side, mask, sig, matches):
                take[a] = take[b] = True
            if take.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[take]) for x in (item, c, d, rep, comp, side, mask)] + [
                    pa.ListArray.from_arrays(pa.array(np.arange(take.sum() + 1, dtype=np.int32) * sig.shape[1]),
                                             pa.array(sig[take].ravel()))],
                    ["item", "c", "d", "rep", "comp", "side", "mask", "sig"])
    return run


def _bit_sets(sets: list[np.ndarray]) -> np.ndarray | None:
    """One row of bits per set, over the values that at least two of the sets hold; None if that is more than BIT_BYTES."""
    flat = np.concatenate(sets)
    values, where, n = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    words = int((n > 1).sum() + 63) // 64
    if len(sets) * words * 8 > BIT_BYTES:
        return None
    out = np.zeros((len(sets), max(1, words)), U64)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = n[where] > 1
    at = column[where[shared]]
    np.bitwise_or.at(out, (row[shared], at >> 6), U64(1) << (at & 63).astype(U64))
    return out


def _common(sets: list[np.ndarray], bits: np.ndarray | None, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``i`` with the sets ``j``."""
    if bits is None:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    out, step = np.zeros(len(i), np.int64), max(1, (1 << 20) // bits.shape[1])
    for x in range(0, len(i), step):
        out[x:x + step] = np.bitwise_count(bits[i[x:x + step]] & bits[j[x:x + step]]).sum(axis=1, dtype=np.int64)
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph with edges (a, b)."""
    root: dict[int, int] = {}
    out = []

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return tuple(np.array(out, np.int64).reshape(-1, 2).T)


def _across(matches: int, num: int, den: int):
    """Of each (item, chunk pair) list of meeting documents, a spanning forest of the pairs with den * intersection >= num * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (item, _, _, rep, comp, side, mask, raw), sig in _lists(batches, 3):
            edges = [[], []]
            first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            for s, e in zip(first, np.r_[first[1:], len(number)]):
                if e - s < 2:
                    continue
                sets = [np.frombuffer(x, U64) for x in raw[s:e]]
                size, bits = np.array([len(x) for x in sets]), _bit_sets(sets)
                for a, b in _cross_pairs(number[s:e] - number[s], item[s:e] >> 32, rep[s:e], comp[s:e], side[s:e], mask[s:e],
                                         sig[s:e], matches):
                    both = _common(sets, bits, a, b)
                    hit = den * both >= num * (size[a] + size[b] - both)
                    edges[0].append(rep[s:e][a[hit]])
                    edges[1].append(rep[s:e][b[hit]])
            if edges[0] and len(np.concatenate(edges[0])):
                yield _pairs(*_forest(np.concatenate(edges[0]), np.concatenate(edges[1])))
    return run


def _confirm(num: int, den: int):
    """Pairs whose shingle sets have den * intersection >= num * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                u, v = np.frombuffer(x[i].as_buffer(), U64), np.frombuffer(y[i].as_buffer(), U64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok[i] = den * both >= num * (len(u) + len(v) - both)
            if ok.any():
                yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], schema=_PAIR)
    return run


def _sets_of(reps: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(rep, shingles) of the classes with the given numbers, from the document that stands for each."""
    wanted = reps.distinct().join(classes.select("rep", "least"), "rep").select(
        "rep", F.col("least.doc_id").alias("_id"), F.col("least.digest").alias("_digest"))
    texts = docs.join(wanted, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("rep", "text")
    return written(texts.mapInArrow(_sets(k), "rep long, shingles binary"), "sets")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    pairs = cut_lineage(pairs.distinct())
    sets = _sets_of(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")), classes, docs, k)
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return cut_lineage(joined.mapInArrow(_confirm(num, den), "a long, b long").distinct())


def _text_digest() -> F.Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def _linked(documents: DataFrame, k: int, num: int, den: int, coords: int, matches: int, without_id: bool) -> DataFrame:
    """doc_id, digest, n_shingles of every row and ``least``: of all documents that it can reach by links, itself included, the doc_id and digest
    of the one with the smallest doc_id (null last), then digest; null for rows without shingles and, if not ``without_id``, without id."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_digest().alias("digest"))
    signed = written(docs.mapInArrow(
        _sign(k, coords), "doc_id long, digest binary, n_shingles long, set_a long, set_b long, sig array<int>"), "signatures")
    key = ["set_a", "set_b", "n_shingles"]
    # a class (documents with one set) is a stored row with a number of its own: ids are values only, as different texts may share one
    takes_part = (F.col("n_shingles") > 0) & (F.lit(without_id) | F.col("doc_id").isNotNull())
    classes = signed.where(takes_part).groupBy(*key).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("least"), F.first("sig").alias("sig"))
    classes = cut_lineage(classes.withColumn("rep", F.monotonically_increasing_id()))

    item = F.shiftleft(F.col("coord").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(0xFFFFFFFF))
    items = classes.select("rep", "n_shingles", F.posexplode("sig").alias("coord", "value")).select("rep", "n_shingles", item.alias("item"))
    per_item = items.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total")).where("n > 1")
    shared = cut_lineage(per_item.select("item", "n", F.greatest(
        F.ceil(F.col("n") / CHUNK), F.ceil(F.col("total") * 8 / CHUNK_BYTES)).cast("int").alias("chunks")))
    # values held by one signature only come first in the order and fill the prefix without being posted. Spark takes a signature for one
    # number, exploded or not, and would broadcast some thirty times what it reckons: both joins are told to merge
    prefix = (
        items.hint("merge").join(shared, "item").groupBy("rep")
        .agg(F.sort_array(F.collect_list(F.struct("n", "item", "chunks"))).alias("held"))
        .select("rep", F.slice("held", F.lit(1), F.greatest(
            F.lit(0), F.size("held") - F.lit(matches - 1))).alias("held"))
        .where(F.size("held") > 0)
    )
    chunks = F.col("x.chunks")
    coords_posted = F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x["item"], 32).cast("int"))))
    posted = cut_lineage(
        prefix.withColumn("mask", coords_posted).join(classes.select("rep", "sig").hint("merge"), "rep")
        .select("rep", "sig", "mask", F.explode("held").alias("x"))
        .select(F.col("x.item").alias("item"), chunks.alias("chunks"),
                F.pmod(F.xxhash64("rep"), chunks).cast("int").alias("chunk"), "rep", "mask", "sig"))

    first = posted.select("item", "chunk", "rep", "sig")
    first = first.repartition("item", "chunk").sortWithinPartitions("item", "chunk", "rep")
    edges = _confirmed(first.mapInArrow(_against_first(matches), "a long, b long"), classes, docs, k, num, den)
    merged = connected_components(edges)

    comp = merged.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    open_lists = posted.join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = open_lists.groupBy("item").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    mixed = cut_lineage(mixed.where("low <> high").select("item"))
    second = open_lists.join(mixed, "item").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("chunk") == F.col("other"), 2).otherwise((F.col("chunk") > F.col("other")).cast("int"))
    second = second.select("item", F.least("chunk", "other").alias("c"), F.greatest("chunk", "other").alias("d"), "rep",
                           "comp", side.alias("side"), "mask", "sig")
    by_list = lambda df: df.repartition("item", "c", "d").sortWithinPartitions("item", "c", "d", "rep")
    meeting = "item long, c int, d int, rep long, comp long, side int, mask long"
    met = cut_lineage(by_list(second).mapInArrow(_meeting(matches), meeting + ", sig array<int>"))
    sets = _sets_of(met.select("rep"), classes, docs, k)
    met = met.join(sets, "rep").select("item", "c", "d", "rep", "comp", "side", "mask", "shingles", "sig")
    more = cut_lineage(by_list(met).mapInArrow(_across(matches, num, den), "a long, b long"))
    merged = connected_components(merged.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    placed = cut_lineage(classes.select("rep", "least", *key).join(merged.withColumnRenamed("node", "rep"), "rep", "left")
                         .select(*key, "least", F.coalesce("component", "rep").alias("component")))
    smallest = placed.groupBy("component").agg(F.min("least").alias("_least"))
    of_class = cut_lineage(placed.join(smallest, "component").select(*key, F.col("_least").alias("least")))
    out = signed.drop("sig").join(of_class, key, "left")
    return out.select("doc_id", "digest", "n_shingles", F.when(takes_part, F.col("least")).alias("least"))


def near_duplicates(documents: DataFrame, k: int = 4, num: int = 80, den: int = 100, coords: int = COORDS,
                    matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``documents`` (doc_id, text)."""
    out = _linked(documents, k, num, den, coords, matches, without_id=False)
    component = F.coalesce("least.doc_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``documents`` with one row of each group of near-duplicates, rows without doc_id included: the one with the smallest doc_id (null
    last), then digest; of rows that share id and text, one. Rows without words all stay."""
    found = _linked(documents, k, num, den, COORDS, MATCHES, without_id=True)
    ids, digests, rows, own = fresh(documents, "odd_id", "odd_digest", "odd_rows", "own_digest")
    chosen = (F.col("least.digest") == F.col("digest")) & F.col("least.doc_id").eqNullSafe(F.col("doc_id"))
    per_row = found.where("least is not null").groupBy("doc_id", "digest").agg(
        F.max(chosen).alias("chosen"), F.count(F.lit(1)).alias("rows"))
    odd = cut_lineage(per_row.where("not chosen or rows > 1").select(
        F.col("doc_id").alias(ids), F.col("digest").alias(digests), F.when(F.col("chosen"), F.col("rows")).alias(rows)))
    odd = counted_broadcast(odd, 1 << 19)  # some 150 bytes a row, held several times; beside a larger table the texts are shuffled
    marked = documents.withColumn(own, _text_digest()).join(
        odd, (F.col(own) == F.col(digests)) & F.col("doc_id").cast("long").eqNullSafe(F.col(ids)), "left")
    single = marked.where(F.col(digests).isNull())
    repeated = marked.where(F.col(rows).isNotNull()).dropDuplicates(["doc_id", own])
    return single.select(*[F.col(f"`{c}`") for c in documents.columns]).union(
        repeated.select(*[F.col(f"`{c}`") for c in documents.columns]))
