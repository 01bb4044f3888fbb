"""Language identification by prediction by partial matching (PPM) over bytes.

For every language, the contexts of 0 to ``order`` bytes form a context tree with counts frozen after training. A byte costs, in its
longest seen context, -log2 n / (T + U); if the context has not seen it, an escape U / (T + U) and the cost in the next
shorter context; below order 0 every byte has 1/256 (T: bytes seen in the context, U: distinct ones; escape method C without exclusion).
A text's code length under a language is the exact sum over all its bytes; the language with the shortest code is predicted, and the
score is its posterior under equal priors. ASCII letters count as lower case.

Training reads a bounded sample: TRAIN_BYTES are shared among the languages by water filling (what small languages leave unused goes to the
larger ones, LEAST_BYTES each at least), and a language's share is filled by its documents in hash order, each with a FEW-th of it
first and, where that leaves room, with more of the longer ones; a document that is not read whole gives a window at a hashed place. So every language with a non-empty training document has a tree.
That bounds the trees, which are collected and broadcast; with many languages they are held as lists of the languages that saw a context,
with the same code lengths. Everything else covers all documents.

Defined results: a null or letterless text is ``und`` with score 0; without any training text every text is ``und``; ties go to the smaller
language name; rows are predicted one by one, so repeated rows agree. Rows equal in doc_id, text and lang train once; a null doc_id is no obstacle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import counted_broadcast, cut_lineage, fold_of, fresh
from .textcore import U64, Lookup, grams, sums_between, text_slices

ORDER = 4
TRAIN_BYTES = 16 << 20
LEAST_BYTES = 1 << 10
FEW = 8
#: Up to this many languages, the costs of known strings are held as a table of strings by languages.
DENSE = 64
UNKNOWN = "und"


class ContextTrees:
    """Frozen context trees of several languages, over counts of (order + 1)-byte strings."""

    def __init__(self, languages: list[str], order: int, lang: np.ndarray, gram: np.ndarray, count: np.ndarray):
        self.languages, self.order = languages, order
        self.symbols, self.contexts = [], []
        for k in range(order + 1):
            key = gram & U64((1 << 8 * (k + 1)) - 1)
            n = self._table(key, lang, count)
            seen = (n[1] > 0).astype(np.float64)
            context = n[0] >> U64(8)
            keys, where = np.unique(context, return_inverse=True)
            total, distinct = np.zeros((2, len(keys), len(languages)))
            np.add.at(total, where, n[1])
            np.add.at(distinct, where, seen)
            self.symbols.append((Lookup(n[0]), n[1]))
            self.contexts.append((Lookup(keys), total, distinct))
        known = np.unique(gram)
        self.known = Lookup(known)
        self.costs = np.ascontiguousarray(self.code_lengths(known).T.astype(np.float32))

    def _table(self, key: np.ndarray, lang: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(key, return_inverse=True)
        n = np.zeros((len(keys), len(self.languages)))
        np.add.at(n, (where, lang), count)
        return keys, n

    def code_lengths(self, gram: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each string after the bytes before it: (strings, languages)."""
        p = np.full((len(gram), len(self.languages)), 1 / 256)
        for k in range(self.order + 1):
            (symbol, n), (context, total, distinct) = self.symbols[k], self.contexts[k]
            at = context.find((gram & U64((1 << 8 * (k + 1)) - 1)) >> U64(8))
            seen = np.where((at >= 0)[:, None], total[at], 0) if len(total) else np.zeros_like(p)
            kinds = np.where((at >= 0)[:, None], distinct[at], 0) if len(total) else np.zeros_like(p)
            at = symbol.find(gram & U64((1 << 8 * (k + 1)) - 1))
            here = np.where((at >= 0)[:, None], n[at], 0) if len(n) else np.zeros_like(p)
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(here > 0, here / (seen + kinds), np.where(seen > 0, kinds / (seen + kinds), 1) * p)
        return -np.log2(p)

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each document under each language: (documents, languages)."""
        gram = grams(data, offsets, self.order)
        row = self.known.find(gram)
        new = np.flatnonzero(row < 0)
        if len(new):
            strings, where = np.unique(gram[new], return_inverse=True)
            costs = self.code_lengths(strings)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for x in range(len(self.languages)):
            cost = self.costs[x][row] if self.costs.shape[1] else np.zeros(len(row), np.float32)
            if len(new):
                cost[new] = costs[where, x]
            out[:, x] = sums_between(cost, offsets)
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; null texts are unknown."""
        names, scores = [], []
        for row, data, offsets in text_slices(texts):
            if not self.languages:
                names += [UNKNOWN] * (len(offsets) - 1)
                scores.append(np.zeros(len(offsets) - 1))
                continue
            step = max(1, (1 << 22) // len(self.languages))
            for at in range(0, len(offsets) - 1, step):
                cut = offsets[at:at + step + 1]
                bits = self.bits(data[cut[0]:cut[-1]], cut - cut[0])
                best = bits.argmin(axis=1)  # the languages are sorted, the first of equal ones wins
                with np.errstate(over="ignore"):
                    score = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
                known = texts.slice(row + at, len(best)).is_valid().to_numpy(zero_copy_only=False)
                names += [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
                scores.append(np.where(known, score, 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


class SparseTrees(ContextTrees):
    """The same trees for many languages: an order adds to a byte's cost only for the languages that saw its context, so only they are held."""

    def __init__(self, languages: list[str], order: int, lang: np.ndarray, gram: np.ndarray, count: np.ndarray):
        self.languages, self.order = languages, order
        low, bits = U64((1 << 24) - 1), U64(24)
        self.base, self.levels = np.zeros((256, len(languages)), np.float32), []
        for k in range(order + 1):
            pair, where = np.unique((gram & U64((1 << 8 * (k + 1)) - 1)) << bits | lang.astype(U64), return_inverse=True)
            n = np.bincount(where, count)
            symbol, of = pair >> bits, (pair & low).astype(np.int32)
            context, where = np.unique(symbol >> U64(8) << bits | pair & low, return_inverse=True)
            total, distinct = np.bincount(where, n), np.bincount(where)
            cost, escape = np.log2((total + distinct)[where] / n), np.log2((total + distinct) / distinct)
            if k == 0:
                self.base[:] = 8 + escape  # every language has one context of no bytes
                self.base[symbol.astype(np.int64), of] = cost
            else:
                # a seen string was seen without its first byte too, where its cost is known
                shorter = cost_before[np.searchsorted(pair_before, (symbol & U64((1 << 8 * k) - 1)) << bits | pair & low)]
                self.levels.append((self._lists(context >> bits, (context & low).astype(np.int32), escape),
                                    self._lists(symbol, of, cost - shorter - escape[where])))
            pair_before, cost_before = pair, cost

    @staticmethod
    def _lists(keys: np.ndarray, lang: np.ndarray, bits: np.ndarray):
        known, start = np.unique(keys, return_index=True)
        return Lookup(known), np.append(start, len(keys)), lang, bits.astype(np.float32)

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        gram = grams(data, offsets, self.order)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        flat, owner = out.reshape(-1), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        if not len(gram):
            return out
        byte, times = np.unique(owner << 8 | (gram & U64(255)).astype(np.int64), return_counts=True)
        first = np.flatnonzero(np.diff(byte >> 8, prepend=-1))
        for a, b in zip(first, np.append(first[1:], len(byte))):
            out[byte[a] >> 8] = times[a:b] @ self.base[byte[a:b] & 255].astype(np.float64)
        for k, (escapes, resets) in enumerate(self.levels, 1):
            symbol = gram & U64((1 << 8 * (k + 1)) - 1)
            for keys, (table, start, lang, bits) in ((symbol >> U64(8), escapes), (symbol, resets)):
                row = table.find(keys)
                seen = np.flatnonzero(row >= 0)
                found, times = np.unique(owner[seen] * table.size + row[seen], return_counts=True)
                doc, row = np.divmod(found, max(table.size, 1))
                size = start[row + 1] - start[row]
                ends = np.cumsum(size)
                at = 0
                while at < len(row):  # some 4M list entries at a time
                    end = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + (1 << 22), side="right")))
                    part = size[at:end]
                    entry = np.arange(part.sum()) + np.repeat(start[row[at:end]] - (np.cumsum(part) - part), part)
                    np.add.at(flat, np.repeat(doc[at:end] * len(self.languages), part) + lang[entry],
                              np.repeat(times[at:end], part) * bits[entry].astype(np.float64))
                    at = end
        return out


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.column(0).dictionary_encode()
            langs = named.indices.to_numpy()
            for row, data, offsets in text_slices(batch.column(1)):
                of = np.repeat(langs[row:row + len(offsets) - 1], np.diff(offsets))
                place = np.lexsort((gram := grams(data, offsets, order), of))
                of, gram = of[place], gram[place]
                first = np.flatnonzero((np.diff(of, prepend=-1) != 0) | np.concatenate([[True], gram[1:] != gram[:-1]])[:len(gram)])
                yield pa.RecordBatch.from_arrays(
                    [named.dictionary.take(pa.array(of[first])), pa.array(gram[first].view(np.int64)),
                     pa.array(np.diff(np.append(first, len(gram))))], ["lang", "gram", "n"])
    return run


def level(sizes: np.ndarray, budget: int) -> int:
    """The most that each of ``sizes`` may use so that all together use ``budget`` at most."""
    sizes = np.sort(sizes)
    left = budget - np.concatenate([[0], np.cumsum(sizes)[:-1]])
    each = left // np.arange(len(sizes), 0, -1)
    short = np.flatnonzero(each < sizes)
    return int(each[short[0]] if len(short) else max(sizes, default=0))


def train(documents: DataFrame, train_bytes: int = TRAIN_BYTES, order: int = ORDER, folds: int = 4, held_out: int = 2) -> ContextTrees:
    """Context trees from ``documents`` (doc_id, text, lang), without the rows of the held-out fold."""
    docs = documents.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(
        (fold_of("doc_id", folds) != held_out) & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    size, key = F.octet_length("text").cast("long"), F.xxhash64("doc_id", "lang", "text").alias("key")
    sizes = docs.select("lang", key, size.alias("bytes"))
    # by language and power of two of the size: enough to see how far documents reach that give no more than a part each
    totals = cut_lineage(sizes.groupBy("lang", F.floor(F.log2("bytes")).alias("power")).agg(
        F.sum("bytes").alias("all"), F.count("*").alias("docs"), F.min("key").alias("lowest")))
    by_lang = totals.groupBy("lang").agg(F.sum("all").alias("all")).select("all").toArrow()["all"].to_numpy()  # one number a language
    each = max(level(by_lang, train_bytes), LEAST_BYTES)
    part = max(1, each // FEW)
    likely = cut_lineage(totals.groupBy("lang").agg(
        F.sum(F.least("all", F.col("docs") * part)).alias("all"), F.sum("docs").alias("docs"), F.min("lowest").alias("lowest")))
    u = F.col("key") / F.lit(float(1 << 64)) + 0.5
    # by hash first, so that the windows below see a bounded number of rows: three times the share, 64 documents in expectation and one for certain
    likely = sizes.join(counted_broadcast(likely), "lang").where(
        (u * F.col("all") < 3.0 * each) | (u * F.col("docs") < 64) | (F.col("key") == F.col("lowest")))
    likely = likely.groupBy("lang", "key").agg(F.min("bytes").alias("bytes"))
    before = Window.partitionBy("lang").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    first = F.greatest(F.lit(0), F.least("bytes", F.lit(part), each - F.coalesce(F.sum(F.least("bytes", F.lit(part))).over(before), F.lit(0))))
    chosen = likely.withColumn("first", first).where(F.col("first") > 0)
    left = each - F.sum("first").over(Window.partitionBy("lang"))
    longer = F.col("bytes") - F.col("first")
    more = F.greatest(F.lit(0), F.least(longer, left - F.coalesce(F.sum(longer).over(before), F.lit(0))))
    chosen = cut_lineage(chosen.select("lang", "key", (F.col("first") + more).cast("int").alias("take")))
    # a window at a hashed place, as the beginnings of long documents are often alike
    place = F.pmod(F.xxhash64("key"), F.octet_length("text") - F.col("take") + 1).cast("int") + 1
    sample = docs.select("lang", key, "text").join(counted_broadcast(chosen), ["lang", "key"]).select(
        "lang", "key", F.substring(F.col("text").cast("binary"), place, F.col("take")).alias("text"))
    counts = (
        sample.dropDuplicates(["lang", "key"]).select("lang", "text")
        .mapInArrow(_count(order), "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # no more rows than sampled bytes
    )
    named = counts["lang"].combine_chunks().dictionary_encode()
    held = named.dictionary.to_pylist()
    names = sorted(held)
    number = {x: i for i, x in enumerate(names)}
    lang = np.array([number[x] for x in held], np.int64)[named.indices.to_numpy()]
    kind = ContextTrees if len(names) <= DENSE else SparseTrees
    return kind(names, order, lang, counts["gram"].to_numpy().view(U64), counts["n"].to_numpy())


def identify(documents: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``documents`` (doc_id, text, lang)."""
    trees = documents.sparkSession.sparkContext.broadcast(train(documents, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = trees.value.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    lettered = F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text")
    held_out = (fold_of("doc_id", options.get("folds", 4)) == options.get("held_out", 2)).alias("held_out")
    docs = documents.select("doc_id", held_out, lettered)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(documents: DataFrame, least_score: float = 0.5, **options) -> DataFrame:
    """``documents`` without the rows whose language is unknown or whose score is below ``least_score``."""
    trees = documents.sparkSession.sparkContext.broadcast(train(documents, **options))
    (lettered,) = fresh(documents, "lettered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = trees.value.predict(batch.column(batch.num_columns - 1))
            keep = [n != UNKNOWN and s >= least_score for n, s in zip(names, scores)]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    docs = documents.withColumn(lettered, F.when(F.col("text").rlike(r"\p{L}"), F.col("text")))
    return docs.mapInArrow(run, documents.schema)
