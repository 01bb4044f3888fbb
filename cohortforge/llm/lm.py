"""Language-model scoring by context-tree weighting over bytes, and the unigram word baseline.

Model. A byte is eight binary decisions; the decision node is the bits of the byte so far, its context the 0 to ORDER bytes before it.
Every node of the context tree (context, bits so far) has the Krichevsky-Trofimov probability KT(n0, n1) of the bits it saw in
training, and the weighted probability Pw = (KT + prod Pw(children)) / 2 (Pw = KT at depth ORDER). After training the tree is frozen: a bit's
probability is the mixture along its path, weighing a node's own estimate (n + 1/2) / (n0 + n1 + 1) against its child's mixture by
KT : prod Pw(children); a child that saw nothing leaves its parent's estimate as it is. A text is what the word baseline scores: its words
with A-Z lowered, one space between them, then an end (byte 0, as before the start). Its score is the sum of the log10 probabilities.

Jobs. 1. Tasks count words and strings of ORDER + 1 bytes of all documents (training counts, 0 for what only other documents
hold) and send them packed, by key range for words and by the two nearest context bytes for strings, so that a range holds whole
subtrees from depth 2 down; merged ranges are written as a table. 2. Depths 1 and 0 need 65,280 sums at most, which reach the driver; with them each
range derives the cost of every string. 3. Tasks score whole texts by looking up words and strings. The TOP_WORDS and TOP_STRINGS most
frequent ones are broadcast (a bounded size); occurrences of all others leave the task as rows, are joined with the tables
written before, and are added to their documents. So the statistics cover all documents at any size.

Words and strings are told apart by 64-bit hashes and exact 48-bit codes. Defined results: a null text is empty (its end is one token); a row without
doc_id is a training row; repeated rows count and are scored each on their own; without training rows counts are 0 and bits cost 1 bit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, parts, written
from .textcore import LOWER, SPACE, U64, Lookup, fmix, grams, sums_between, text_slices, word_hashes, word_spans

ORDER = 5
TOP_WORDS = 1 << 19
TOP_STRINGS = 1 << 21
WORDS, STRINGS = 0, 1
_HELD = 4 << 20


# --- the context tree -------------------------------------------------------------------------------------------------

_STEPS = np.array([math.lgamma(i + 0.5) for i in range(64)])
_WHOLE = np.array([math.lgamma(i + 1.0) for i in range(64)])


def _lgamma(n: np.ndarray, shift: float, table: np.ndarray) -> np.ndarray:
    """ln Gamma(n + shift) of whole n >= 0: a table for small n, Stirling's series above."""
    x = np.maximum(n, 32) + shift
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 64, table[np.minimum(n, 63).astype(np.int64)], series)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability."""
    return (_lgamma(n0, 0.5, _STEPS) + _lgamma(n1, 0.5, _STEPS) - _lgamma(n0 + n1, 1.0, _WHOLE) - math.log(math.pi))


def _weigh(kt: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln Pw and the weight of the node's own estimate."""
    return (np.logaddexp(kt, children) - math.log(2), 1 / (1 + np.exp(np.clip(children - kt, -700, 700))))


class _Depth:
    """All nodes of one depth, of the strings in ``keys`` (sorted; context above the low byte, which is the next byte)."""

    def __init__(self, keys: np.ndarray, count: np.ndarray):
        self.keys, self.count = keys, count
        self.node, self.n0, self.n1 = [], [], []
        for bit in range(8):
            prefix = keys >> U64(8 - bit)
            first = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            self.node.append(np.cumsum(first) - 1)
            at = np.flatnonzero(first)
            one = ((keys >> U64(7 - bit)) & U64(1)).astype(np.int64)
            ones = np.add.reduceat(count * one, at)
            self.n1.append(ones.astype(np.float64))
            self.n0.append((np.add.reduceat(count, at) - ones).astype(np.float64))


def depths_of(keys: np.ndarray, count: np.ndarray, order: int, least: int) -> tuple[list[_Depth], list[list]]:
    """Depths ``least`` to ``order`` and, for each, per bit (ln Pw, own weight, children's position in the depth above)."""
    levels = {order: _Depth(keys, count)}
    for d in range(order - 1, least - 1, -1):
        below = levels[d + 1]
        short, where = np.unique(below.keys & U64((1 << 8 * (d + 1)) - 1), return_inverse=True)
        levels[d] = _Depth(short, np.bincount(where, below.count, len(short)).astype(np.int64))
        levels[d].of_below = where
    weights: dict[int, list] = {}
    for d in range(order, least - 1, -1):
        at, out = levels[d], []
        for bit in range(8):
            kt = log_kt(at.n0[bit], at.n1[bit])
            if d == order:
                out.append((kt, np.ones(len(kt))))
                continue
            # each child node belongs to the node of any of its strings
            below = levels[d + 1]
            child = below.node[bit]
            lead = np.flatnonzero(np.concatenate([[True], child[1:] != child[:-1]]))
            parent = at.node[bit][at.of_below[lead]]
            out.append(_weigh(kt, np.bincount(parent, weights[d + 1][bit][0], len(kt))))
        weights[d] = out
    return levels, weights


class Roots:
    """Depths 1 and 0, from the sums over depth-2 nodes: rows (context byte << 8 | bits so far, n0, n1, sum of ln Pw)."""

    def __init__(self, code: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        self.n0, self.n1, self.own = np.zeros((3, 2, 1 << 16))
        pw = np.zeros(1 << 16)
        self.n0[1, code], self.n1[1, code] = n0, n1
        pw[code], self.own[1, code] = _weigh(log_kt(n0, n1), below)
        prefix = code & 0xFF
        self.n0[0], self.n1[0] = np.bincount(prefix, n0, 1 << 16), np.bincount(prefix, n1, 1 << 16)
        _, self.own[0] = _weigh(log_kt(self.n0[0], self.n1[0]), np.bincount(prefix, pw[code], 1 << 16))


def string_costs(keys: np.ndarray, count: np.ndarray, order: int, roots: Roots) -> np.ndarray:
    """log10 probability of the last byte of each string after the bytes before it."""
    levels, weights = depths_of(keys, count, order, 2)
    position = {order: np.arange(len(keys))}
    for d in range(order - 1, 1, -1):
        position[d] = levels[d].of_below[position[d + 1]]
    out = np.zeros(len(keys))
    symbol = (keys & U64(0xFF)).astype(np.int64)
    context = ((keys >> U64(8)) & U64(0xFF)).astype(np.int64)
    for bit in range(8):
        one = ((symbol >> (7 - bit)) & 1).astype(bool)
        prefix = (1 << bit) | (symbol >> (8 - bit))
        mixed, seen = np.zeros(len(keys)), np.zeros(len(keys), bool)
        for d in range(order, -1, -1):
            if d > 1:
                node = levels[d].node[bit][position[d]]
                n0, n1, own = levels[d].n0[bit][node], levels[d].n1[bit][node], weights[d][bit][1][node]
            else:
                node = (context << 8 | prefix) if d else prefix
                n0, n1, own = roots.n0[d][node], roots.n1[d][node], roots.own[d][node]
            kt = (np.where(one, n1, n0) + 0.5) / (n0 + n1 + 1)
            mixed = np.where(seen, own * kt + (1 - own) * mixed, kt)
            seen = seen | (n0 + n1 > 0)
        out += np.log10(mixed)
    return out


# --- counting -----------------------------------------------------------------------------------------------------------

def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def token_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each document of a slice with one space between them and a byte 0 as the end."""
    data = np.insert(data, offsets[1:], 0x20)
    offsets = offsets + np.arange(len(offsets))
    solid = ~SPACE[data]
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # the white space right after a word; every document ends in white space now
    last = offsets[1:] - 1
    before = np.concatenate([[0], np.cumsum(keep)])
    keep[last[np.diff(before[offsets]) == 0]] = True  # the end of a document without words
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    out = np.where(solid, data, 0x20).astype(np.uint8)[keep]
    out[at[1:] - 1] = 0
    return out, at


def _packed(kind: int, key: np.ndarray, count: np.ndarray, buckets: int) -> pa.RecordBatch:
    near = key if kind == WORDS else fmix((key >> U64(8)) & U64(0xFFFF))
    bucket = (near % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    key, count = key[order], count[order].astype(np.uint32)
    ends = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
    some = np.flatnonzero(np.diff(ends))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(some), kind, np.int32)), pa.array(some.astype(np.int32)),
         pa.array([key[ends[b]:ends[b + 1]].tobytes() for b in some], pa.binary()),
         pa.array([count[ends[b]:ends[b + 1]].tobytes() for b in some], pa.binary())], ["kind", "bucket", "keys", "counts"])


def _count(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {WORDS: ([], []), STRINGS: ([], [])}

        def add(kind: int, key: np.ndarray, training: np.ndarray):
            for part, weigh in ((key[training], True), (key[~training], False)):
                k, n = np.unique(part, return_counts=True)
                held[kind][0].append(k)
                held[kind][1].append(n if weigh else np.zeros(len(k), np.int64))

        def send(kind: int):
            key, count = _merge(*held[kind])
            held[kind] = ([], [])
            # a count that 32 bits cannot hold goes out in several parts
            while len(key):
                yield _packed(kind, key, np.minimum(count, 0xFFFFFFFF), buckets)
                more = count > 0xFFFFFFFF
                key, count = key[more], count[more] - 0xFFFFFFFF

        for batch in batches:
            training = batch.column(0).to_numpy(zero_copy_only=False)
            for row, data, offsets in text_slices(batch.column(1), 2 << 20):
                here = training[row:row + len(offsets) - 1]
                data = LOWER[data]
                starts, ends, first = word_spans(data, offsets)
                add(WORDS, word_hashes(data, starts, ends), np.repeat(here, np.diff(first)))
                data, offsets = token_bytes(data, offsets)
                add(STRINGS, grams(data, offsets, order), np.repeat(here, np.diff(offsets)))
                for kind in held:
                    if sum(map(len, held[kind][0])) > _HELD:
                        yield from send(kind)
        for kind in held:
            yield from send(kind)
    return run


_RANGE = ("kind int, bucket int, keys binary, counts binary, total long, seen long, sizes array<long>, roots binary")


def _merge_ranges(order: int):
    """Merge what the tasks sent of one range; of strings also the depth-2 sums by depth-1 node."""
    def run(t: pa.Table) -> pa.Table:
        kind, bucket = t.column("kind")[0].as_py(), t.column("bucket")[0].as_py()
        keys = [np.frombuffer(x.as_buffer(), U64) for x in t.column("keys")]
        counts = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in t.column("counts")]
        key, count = _merge(keys, counts)
        width = np.zeros(len(count), np.int64)
        positive = count > 0
        width[positive] = np.floor(np.log2(count[positive])).astype(np.int64) + 1
        roots = b""
        if kind == STRINGS:
            levels, weights = depths_of(key, count, order, 2)
            top, out = levels[2], []
            for bit in range(8):
                node = top.node[bit]
                lead = top.keys[np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))]
                code = ((lead >> U64(8)) & U64(0xFF)).astype(np.int64) << 8 | (1 << bit) | (
                    (lead & U64(0xFF)).astype(np.int64) >> (8 - bit))
                at, where = np.unique(code, return_inverse=True)
                out.append(np.stack([at, np.bincount(where, top.n0[bit]), np.bincount(where, top.n1[bit]),
                                     np.bincount(where, weights[2][bit][0])], axis=1))
            roots = np.concatenate(out).astype(np.float64).tobytes()
        return pa.table([pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([key.tobytes()], pa.binary()),
                         pa.array([count.astype(np.int64).tobytes()], pa.binary()), pa.array([int(count.sum())]),
                         pa.array([int(positive.sum())]), pa.array([np.bincount(width, minlength=64)[:64]], pa.list_(pa.int64())),
                         pa.array([roots], pa.binary())],
                        names=["kind", "bucket", "keys", "counts", "total", "seen", "sizes", "roots"])
    return run


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    keys, counts = batch.column(batch.schema.names.index("keys")), batch.column(batch.schema.names.index("counts"))
    for k, c in zip(keys, counts):
        yield np.frombuffer(k.as_buffer(), U64), np.frombuffer(c.as_buffer(), np.int64)


def _root_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.column(0):
            x = np.frombuffer(r.as_buffer(), np.float64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int64)), *[pa.array(x[:, i]) for i in (1, 2, 3)]],
                                             ["code", "n0", "n1", "below"])


def _level(sizes: np.ndarray, top: int) -> int:
    """The least power of two such that at most ``top`` items have that count or more; sizes[i]: items of 2**i to 2**(i + 1) - 1."""
    more = np.cumsum(sizes[::-1])[::-1]  # items of at least each bit length
    return 1 << int(np.flatnonzero(np.append(more, 0) <= top)[0])


class Model:
    """What every task gets: the frequent words' and strings' values, and the totals."""

    def __init__(self, order: int, train_tokens: int, distinct: int, end_count: int, words, strings):
        self.order, self.train_tokens, self.distinct = order, train_tokens, distinct
        self.scale = math.log10(train_tokens + 0.5 * (distinct + 1))
        self.end_value, self.end_known = math.log10(end_count + 0.5) - self.scale, int(end_count > 0)
        self.word_keys, self.word_counts = words
        self.string_keys, self.string_costs = strings
        self._tables = None

    def tables(self) -> tuple[Lookup, np.ndarray, Lookup, np.ndarray]:
        if self._tables is None:
            self._tables = (Lookup(self.word_keys), np.log10(self.word_counts + 0.5) - self.scale,
                            Lookup(self.string_keys), self.string_costs)
            self.word_keys = self.string_keys = None
        return self._tables


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        words, word_values, strings, costs = m.tables()
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(2)):
                n = len(offsets) - 1
                data = LOWER[data]
                starts, ends, first = word_spans(data, offsets)
                h = word_hashes(data, starts, ends)
                at = words.find(h)
                known = at >= 0
                value = np.where(known, word_values[at] if len(word_values) else 0.0, 0.0)
                rare = np.concatenate([[0], np.cumsum(~known)])[first]
                base = sums_between(value, first) + m.end_value
                n_known = np.diff(np.concatenate([[0], np.cumsum(known)])[first]) + m.end_known
                data, offsets = token_bytes(data, offsets)
                gram = grams(data, offsets, m.order)
                place = strings.find(gram)
                found = place >= 0
                score = sums_between(np.where(found, costs[place] if len(costs) else 0.0, 0.0), offsets)
                odd = np.concatenate([[0], np.cumsum(~found)])[offsets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid + np.arange(n)), batch.column(0).slice(row, n), batch.column(1).slice(row, n),
                     pa.array(np.diff(first) + 1), pa.array(n_known), pa.array(base), pa.array(score),
                     _lists(h[~known], rare), _lists(gram[~found], odd)],
                    ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "words", "strings"])
                uid += n
    return run


def score_documents(documents: DataFrame, order: int = ORDER, top_words: int = TOP_WORDS, top_strings: int = TOP_STRINGS,
                    folds: int = 5, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``documents`` (doc_id, text)."""
    spark = documents.sparkSession
    fold = (fold_of("doc_id", folds) == held_out).alias("held_out")
    training = documents.select((~fold).alias("training"), "text")
    buckets = 2 * parts(spark)
    ranges = written(
        training.mapInArrow(_count(order, buckets), "kind int, bucket int, keys binary, counts binary")
        .groupBy("kind", "bucket").applyInArrow(_merge_ranges(order), _RANGE), "ranges")

    # one row per kind
    totals = {r["kind"]: r for r in ranges.groupBy("kind").agg(
        F.sum("total").alias("total"), F.sum("seen").alias("seen"),
        F.array(*[F.sum(F.element_at("sizes", i + 1)) for i in range(64)]).alias("sizes")).collect()}
    train_docs = training.where("training").count()
    of = lambda kind, field: totals[kind][field] if kind in totals else 0
    tokens, distinct = of(WORDS, "total") + train_docs, of(WORDS, "seen") + int(train_docs > 0)
    level = {k: _level(np.array(r["sizes"][1:], np.int64), top) for (k, top), r in
             ((x, totals[x[0]]) for x in ((WORDS, top_words), (STRINGS, top_strings)) if x[0] in totals)}

    strings = ranges.where(F.col("kind") == STRINGS).select("keys", "counts", "roots")
    sums = strings.select("roots").mapInArrow(_root_rows, "code long, n0 double, n1 double, below double")
    sums = sums.groupBy("code").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")]).toArrow()  # 65,280 rows at most
    roots = spark.sparkContext.broadcast(Roots(*[sums[c].to_numpy() for c in ("code", "n0", "n1", "below")]))

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, count in _arrays(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.tobytes()], pa.binary()), pa.array([count.tobytes()], pa.binary()),
                     pa.array([string_costs(key, count, order, roots.value).tobytes()], pa.binary())], ["keys", "counts", "costs"])

    costed = written(strings.select("keys", "counts").mapInArrow(cost, "keys binary, counts binary, costs binary"), "costs")

    def pick(kind: int, frequent: bool):
        least = level.get(kind, 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, (key, count) in enumerate(_arrays(batch)):
                    value = count if kind == WORDS else np.frombuffer(batch.column(2)[i].as_buffer(), np.float64)
                    take = (count >= least) == frequent
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[take].view(np.int64)), pa.array(value[take].astype(np.float64))], ["key", "value"])
        return run

    packed = {WORDS: ranges.where(F.col("kind") == WORDS).select("keys", "counts"), STRINGS: costed}

    def frequent(kind: int) -> tuple[np.ndarray, np.ndarray]:
        t = packed[kind].mapInArrow(pick(kind, True), "key long, value double").toArrow()  # at most top_words, top_strings rows
        return t["key"].to_numpy().view(U64), t["value"].to_numpy()

    model = Model(order, tokens, distinct, train_docs, frequent(WORDS), frequent(STRINGS))
    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = written(
        documents.select("doc_id", fold, "text").mapInArrow(
            _score(spark.sparkContext.broadcast(model)),
            f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double,"
            " words array<long>, strings array<long>"), "scored")

    rest = {k: packed[k].mapInArrow(pick(k, False), "key long, value double") for k in packed}
    rare_words = (
        scored.select("uid", F.explode("words").alias("key")).join(written(rest[WORDS], "rare-words"), "key")
        .select("uid", (F.log10(F.col("value") + 0.5) - model.scale).alias("base"), (F.col("value") > 0).cast("long")
                .alias("known"), F.lit(0.0).alias("cost")))
    rare_strings = (
        scored.select("uid", F.explode("strings").alias("key")).join(written(rest[STRINGS], "rare-strings"), "key")
        .select("uid", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"), F.col("value").alias("cost")))
    rare = rare_words.union(rare_strings).groupBy("uid").agg(
        F.sum("base").alias("base"), F.sum("known").alias("known"), F.sum("cost").alias("cost"))
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return scored.drop("words", "strings").join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "known"), F.lit(tokens).cast("long").alias("train_tokens"),
        plus("base_score", "base"), plus("score", "cost"))
