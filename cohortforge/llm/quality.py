"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text is reduced to FEATURES in one vectorised pass. The trees are fitted on a bounded sample of labelled rows (SAMPLE_ROWS in
expectation, by a hash of doc_id; all other labelled rows are left out of training only): features are cut into quantile
bins, each level of a tree is grown from gradient histograms over those bins, with Newton leaf values for the logistic loss. All
trees have the same depth and are flattened into three arrays, so that a batch goes through all trees at once.

Defined results: a null text is scored as the empty text; without labels the score is 0.5, with labels of one class only the smoothed share
of that class; repeated rows agree; label rows without a document or without a value are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted_broadcast, cut_lineage, fold_of
from .textcore import LOWER, U64, fmix, text_slices, word_hashes, word_spans

SAMPLE_ROWS = 40_000
TREES, DEPTH, BINS, RATE, SMOOTH = 80, 4, 64, 0.15, 1.0
FEATURES = ("log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "other_bytes", "space", "line_breaks", "entropy",
            "distinct_words", "top_word", "distinct_pairs", "longest_word", "symbol_ends", "one_byte_words", "repeated_lines",
            "upper_words", "sentence_ends", "symbol_only_words")
THRESHOLD = 0.7

_CODE = np.arange(256)
_UPPER = (_CODE >= 65) & (_CODE < 91)
_DIGIT = (_CODE >= 48) & (_CODE < 58)
_LOWER = (_CODE >= 97) & (_CODE < 123)
_SPACE = np.isin(_CODE, [32, *range(9, 14)])
_SYMBOL = (_CODE < 128) & ~_UPPER & ~_DIGIT & ~_LOWER & ~_SPACE
_PLAIN_END = np.isin(_CODE, [ord(x) for x in ".,;:?"])
_CLASSES = np.stack([_UPPER, _DIGIT, _SYMBOL, _CODE >= 128, _SPACE, _CODE == 10], axis=1).astype(np.float64)


def _share_of_distinct(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the most frequent one, per document."""
    distinct, most = np.zeros((2, len(bounds) - 1))
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        if b > a:
            s = np.sort(h[a:b])
            edges = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            distinct[i], most[i] = len(edges) - 1, np.diff(edges).max()
    return distinct, most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, FEATURES) of a slice of documents."""
    n_docs, size = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n_docs), size)
    histogram = np.bincount(doc * 256 + data, minlength=256 * n_docs).reshape(n_docs, 256)
    per = 1.0 / np.maximum(size, 1)
    upper, digit, symbol, other, space, breaks = (histogram @ _CLASSES).T * per
    p = histogram * per[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)

    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first)
    each = 1.0 / np.maximum(words, 1)
    length = ends - starts
    count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
    h = word_hashes(LOWER[data], starts, ends)
    distinct, most = _share_of_distinct(h, first)
    pair = fmix(h[:-1] * U64(3) + h[1:]) if len(h) else h
    pairs, _ = _share_of_distinct(np.append(pair, U64(0)), np.stack([first[:-1], np.maximum(first[1:] - 1, first[:-1])], 1).ravel())
    pairs = pairs[::2]
    longest = np.zeros(n_docs)
    full = np.flatnonzero(words)
    if len(full):
        longest[full] = np.maximum.reduceat(length, first[full])
    head, tail = data[starts], data[ends - 1]
    symbols_before = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    upper_before = np.concatenate([[0], np.cumsum(_UPPER[data])])
    only_symbols = symbols_before[ends] - symbols_before[starts] == length
    mostly_upper = (upper_before[ends] - upper_before[starts]) * 2 > length

    line_end = np.flatnonzero(data == 10)
    cut = np.unique(np.concatenate([offsets[:-1], line_end + 1])) if len(data) else np.zeros(0, np.int64)
    cut = cut[cut < len(data)]
    stop = np.append(cut[1:], len(data)) if len(cut) else cut
    lines = np.searchsorted(cut, offsets)
    kinds, _ = _share_of_distinct(word_hashes(data, cut, stop) if len(cut) else np.zeros(0, U64), lines)
    n_lines = np.diff(lines)
    return np.stack([
        np.log1p(size), np.log1p(words), count(length) * each, upper, digit, symbol, other, space, breaks, entropy,
        distinct * each, most * each, pairs / np.maximum(words - 1, 1), longest,
        count(_SYMBOL[tail] & ~_PLAIN_END[tail]) * each, count(length == 1) * each, 1 - kinds / np.maximum(n_lines, 1),
        count(mostly_upper) * each, count(np.isin(tail, [33, 46, 63])) * each, count(only_symbols & (head >= 0)) * each], axis=1)


def statistics_of(texts: pa.Array) -> np.ndarray:
    out = [statistics(data, offsets) for _, data, offsets in text_slices(texts)]
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


@dataclass
class Forest:
    """Trees of equal depth as arrays (tree, node): node i has children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        margin = np.full(len(x), self.base)
        if trees:
            tree, rows = np.arange(trees), np.arange(len(x))[:, None]
            node = np.zeros((len(x), trees), np.int64)
            for _ in range(int(inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
            margin = margin + self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE,
               smooth: float = SMOOTH) -> Forest:
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    inner, n_features = (1 << depth) - 1, x.shape[1]
    empty = Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(np.unique(y)) < 2:
        return empty
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(n_features)]
    code = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(n_features)], axis=1)
    margin = np.full(len(y), base)
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            best = np.full(width, 1e-9)
            split = np.full(width, bins)
            which = np.zeros(width, np.int64)
            for f in range(n_features):
                key = node * bins + code[:, f]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + smooth) + (ga - gs) ** 2 / (ha - hs + smooth) - ga**2 / (ha + smooth)
                gain[(hs < 1) | (ha - hs < 1)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better], split[better], which[better] = top[better], at[better], f
            for i in np.flatnonzero(split < bins):
                feature[t, first + i], threshold[t, first + i] = which[i], cuts[which[i]][min(split[i], len(cuts[which[i]]) - 1)]
            right = (split[node] < bins) & (x[np.arange(len(y)), feature[t, first + node]] > threshold[t, first + node])
            node = 2 * node + right
        gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        leaf[t] = rate * gs / (hs + smooth)
        margin += leaf[t][node]
    return Forest(base, feature, threshold, leaf)


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = 4, held_out: int = 2) -> Forest:
    """Fit on documents (doc_id, text) and labels (doc_id, quality), without the rows of the held-out fold."""
    known = labels.select("doc_id", F.col("quality").cast("double").alias("quality")).where(
        (fold_of("doc_id", folds) != held_out) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    n = known.count()
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = cut_lineage(known.where(u * n < sample_rows))  # about sample_rows rows
    rows = documents.select("doc_id", "text").join(counted_broadcast(sample), "doc_id").select("quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["quality", "x"])

    got = rows.mapInArrow(run, "quality double, x array<double>").toArrow()
    y = (got["quality"].to_numpy() > 0.5).astype(np.float64)
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if len(y) else np.zeros((0, len(FEATURES)))
    order = np.lexsort([*x.T, y])  # the fit does not depend on the order in which tasks end
    return fit_forest(x[order], y[order])


def classify(documents: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``."""
    forest = documents.sparkSession.sparkContext.broadcast(train(documents, labels, folds=folds, held_out=held_out, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = forest.value.score(statistics_of(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["doc_id", "held_out", "score"])

    docs = documents.select("doc_id", (fold_of("doc_id", folds) == held_out).alias("held_out"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``documents`` without the rows that score below ``threshold``."""
    forest = documents.sparkSession.sparkContext.broadcast(train(documents, labels, **options))
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = forest.value.score(statistics_of(batch.column(at)))
            yield batch.filter(pa.array(score >= threshold))

    return documents.mapInArrow(run, documents.schema)
