"""Periodic runs of words in texts: descending-LCP Kruskal over suffix classes.

A run is a stretch of words with smallest period q (words q apart are equal) that no neighbouring word extends; it counts if
its length is at least max(least, exponent * q). If it starts at s and ends before e, the suffixes at s and s + q agree in exactly
L = e - s - q words, and L >= max(least - q, (exponent - 1) * q): at least GRAM words, whatever q is.

So only positions whose first GRAM words occur again in the same text matter. Their suffixes are put in order by prefix doubling, with the
common prefix (LCP) of neighbours in that order. The neighbour pairs are taken by decreasing LCP, as Kruskal's algorithm takes edges, and
the classes of both suffixes are united, the smaller into the larger; a class is the ordered set of its positions. At level L, positions
that become neighbours inside a class, at a distance q within L, seed the run (q, end = second position + L). The first seed of an end
and period is the run's start, as every later one has a shorter common prefix. No nearer position can lie between s and s + q in the class:
by Fine and Wilf's theorem q would not be the smallest period.

Texts are worked on in batches of some hundred thousand words; a text is never cut. Tasks need no shuffle.

Defined results: a null or empty text has no words, so no runs and an empty collapsed text; repeated rows are rows; an empty table gives an
empty result; only the key and the text are read, so that extra columns cannot clash.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD
from .textcore import U64, fmix

BATCH_WORDS = 1 << 18
CHUNK_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def gram_words(least: int, exponent: int) -> int:
    """The fewest words in which the suffixes at a run's start and one period later agree."""
    return min(max(least - q, (exponent - 1) * q) for q in range(1, max(2, least + 1)))


def _split(text: bytes) -> Iterator[list[bytes]]:
    """The words (separated by ASCII white space), a megabyte of the text at a time."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + CHUNK_BYTES) if at + CHUNK_BYTES < len(text) else None
        end = space.start() if space else len(text)
        yield text[at:end].split()
        at = end


def _repeated(words: np.ndarray, text_of: np.ndarray, room: np.ndarray, gram: int) -> np.ndarray:
    """Positions whose next ``gram`` words are, by their hash, not the only ones of their kind in the text."""
    h = fmix(text_of[room].astype(U64))
    for j in range(gram):
        h = fmix(h * U64(31) + words[room + j].astype(U64))
    in_order = np.sort(h)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(twice):
        return room[:0]
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    return room[twice[at] == h]


def _dense(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(order), bool)
    for k in keys:
        sorted_key = k[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _neighbours(words: np.ndarray, text_of: np.ndarray, repeated: np.ndarray, gram: int):
    """(a, b, lcp) of neighbours in suffix order that agree in ``gram`` words or more. ``words`` is padded by ``gram`` zeros."""
    last = len(text_of) - 1
    at = np.union1d(repeated, repeated + gram)  # the words that follow decide the order
    slot = np.full(last + 2, -1, np.int64)
    slot[at] = np.arange(len(at))
    keys = [text_of[at], *(words[at + j] for j in range(gram))]
    order = np.lexsort(keys[::-1])
    rank = _dense(order, keys)
    levels, width = [(gram, rank)], gram
    while rank.max() + 1 < len(at):
        follow = slot[np.minimum(at + width, last + 1)]
        key = rank * (len(at) + 1) + np.where(follow < 0, 0, rank[follow] + 1)
        order = np.argsort(key, kind="stable")
        rank, width = _dense(order, [key]), 2 * width
        levels.append((width, rank))
    order = np.argsort(rank)
    a, b = at[order[:-1]], at[order[1:]]
    same = text_of[a] == text_of[b]
    a, b = a[same], b[same]
    lcp = np.zeros(len(a), np.int64)
    for width, rank in levels[::-1]:
        x, y = slot[np.minimum(a + lcp, last + 1)], slot[np.minimum(b + lcp, last + 1)]
        lcp += width * ((x >= 0) & (y >= 0) & (rank[x] == rank[y]))
    deep = lcp >= gram
    a, b, lcp = a[deep], b[deep], lcp[deep]
    going = np.ones(len(a), bool)
    for _ in range(gram - 1):  # the words after the last full gram
        going &= words[np.minimum(a + lcp, last)] == words[np.minimum(b + lcp, last)]
        lcp += going
    return a, b, lcp


def _kruskal(a: np.ndarray, b: np.ndarray, lcp: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) from the neighbour pairs."""
    order = np.argsort(-lcp, kind="stable")
    class_of: dict[int, list[int]] = {}
    seen: set[tuple[int, int]] = set()
    runs = []

    def seed(i: int, j: int, level: int) -> None:
        q = j - i
        if (exponent - 1) * q <= level and q + level >= least and (q, j + level) not in seen:
            seen.add((q, j + level))
            runs.append((i, q + level, q))

    for i, j, level in zip(a[order].tolist(), b[order].tolist(), lcp[order].tolist()):
        large, small = class_of.get(i) or [i], class_of.get(j) or [j]
        if len(large) < len(small):
            large, small = small, large
        before = -1
        for k, x in enumerate(small):
            at = bisect_left(large, x)
            after = small[k + 1] if k + 1 < len(small) else None
            if at and large[at - 1] > before:
                seed(large[at - 1], x, level)
            if at < len(large) and (after is None or large[at] < after):
                seed(x, large[at], level)
            before = x
        if 16 * len(small) < len(large):
            for x in small:
                insort(large, x)
        else:
            if len(large) == 1:
                class_of[large[0]] = large
            large.extend(small)
            large.sort()
        for x in small:
            class_of[x] = large
    return runs


def runs_of(texts: list[np.ndarray], least: int = 6, exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """For each text (word numbers from 1, equal for equal words): its runs (start, length, period) by start, then period."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    gram = gram_words(least, exponent)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(texts) or not sizes.any():
        return out
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # a zero ends each text
    words = np.zeros(int(starts[-1]) + 2 * gram, np.int64)
    for t, s in zip(texts, starts):
        words[s:s + len(t)] = t
    text_of = np.repeat(np.arange(len(texts)), sizes + 1)
    position = np.arange(len(text_of))
    room = position[position + gram <= (starts[:-1] + sizes)[text_of]]
    repeated = _repeated(words, text_of, room, gram)
    if not len(repeated):
        return out
    for start, length, period in _kruskal(*_neighbours(words, text_of, repeated, gram), least, exponent):
        t = text_of[start]
        out[t].append((start - int(starts[t]), length, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def _collapsed(words: np.ndarray, runs, names: dict[int, bytes]) -> bytes:
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return b" ".join([names[i] for i in words[kept].tolist()])


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _task(least: int, exponent: int):
    def work(keys: pa.Array, texts: list[bytes], numbers: list[np.ndarray], vocabulary: dict) -> pa.RecordBatch:
        found = runs_of(numbers, least, exponent)
        names = {i: w for w, i in vocabulary.items()} if any(found) else {}
        plain = [_collapsed(n, r, names) if r else b" ".join([b" ".join(w) for w in _split(t) if w])
                 for t, n, r in zip(texts, numbers, found)]
        runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
        return pa.RecordBatch.from_arrays(
            [keys, pa.array([len(n) for n in numbers], pa.int64()), pa.array(runs, _RUNS), pa.array(plain, pa.binary()).cast(pa.string())],
            ["key", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            first, total, held, numbers, vocabulary, count = 0, 0, [], [], {}, itertools.count(1)
            for row in range(batch.num_rows):
                text = texts[row].as_py() or b""
                number = [np.fromiter(map(vocabulary.setdefault, w, count), np.int64, len(w)) for w in _split(text)]
                held.append(text)
                numbers.append(np.concatenate(number) if number else np.zeros(0, np.int64))
                total += len(numbers[-1])
                if total >= BATCH_WORDS or row + 1 == batch.num_rows:
                    yield work(batch.column(0).slice(first, row + 1 - first), held, numbers, vocabulary)
                    first, total, held, numbers, vocabulary, count = row + 1, 0, [], [], {}, itertools.count(1)
    return run


def find_runs(df: DataFrame, key: str = "doc_id", text: str | Column = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """(key, n_words, runs, collapsed) per row of ``df``: the runs of the text's words as structs (start, length, period) by start, then
    period, and the text with single spaces where of each run only the first period is left."""
    rows = df.select(F.col(key).alias("key"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(_task(least, exponent),
                            f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return found.withColumnRenamed("key", key)


def planted(documents: DataFrame) -> DataFrame:
    """doc_id, text of ``documents``; a tenth of them, by crc32 of the decimal doc_id, becomes periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    d = documents.select("doc_id", "text", words.alias("words"), F.floor(h / 10).alias("g"))
    d = d.withColumn("n", F.size("words"))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    d = d.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    word = lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    changed = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), word), " ")
    return d.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def document_runs(documents: DataFrame) -> DataFrame:
    """The runs of ``documents`` (doc_id, text) after planting: counts, the run of greatest exponent and digests."""
    found = find_runs(planted(documents))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(
        r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))  # ties: the earlier one
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
