"""Cost-balanced packing of tokenised documents into sequences.

A document costs LINEAR * tokens + QUADRATIC * tokens**2 (the attention within it). Inside a task, documents are gathered into
blocks; a block of T tokens gets T // capacity full sequences and, for the remaining tokens, sequences of the powers of two that
add up to it, so that nothing needs padding. Whole sequences are cut off documents longer than the capacity first. The rest goes, in
descending size, to the sequence of lowest cost that has room for it; a document that fits nowhere is cut to fill the
sequence of lowest cost with any room left, and what remains of it goes on. A block's tokens never leave their task.

Tokens: white space always separates the tokenizer's words, and in plain chunks (see plain_parts) so does a change between letters and
other characters, so a task tokenises the distinct parts once and gathers the documents' ids from those.

Defined results: a null or empty text is its end token alone; rows that share a doc_id are packed separately, each as its own
document; an empty table gives an empty result; texts of any length are tokenised whole.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .textcore import LOWER, SPACE, Lookup, text_slices, word_hashes, word_spans

CAPACITY = 2048
END = 1
LINEAR = 1.0
QUADRATIC = 1.0 / 4096
#: Tokens of a block: what is packed together, and held by a task at once.
BLOCK_TOKENS = 4 << 20
TOKENIZER = "word_bpe_49k.json"
PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
         "sequence_length long")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True


def plain_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, ends and number before each document of parts that the tokenizer treats alone.

    A chunk between white space is plain if it consists of ASCII and of the letters U+00C0 to U+00FF and holds neither an apostrophe
    (contractions) nor '<' (special tokens). There nothing combines with its neighbours: A-Z can be lowered beforehand, and the
    pre-tokenizer always splits between letters and other characters. Other chunks stay whole and as they are.
    """
    starts, ends, first = word_spans(data, offsets)
    after = np.zeros(len(data), bool)  # second byte of a letter U+00C0 to U+00FF
    after[1:] = data[:-1] == 0xC3
    odd = (data >= 0x80) & (data != 0xC3) & ~after | (data == 0x27) | (data == 0x3C) | after & ((data == 0x97) | (data == 0xB7))
    n_odd = np.concatenate([[0], np.cumsum(odd)])
    plain = np.repeat(n_odd[ends] == n_odd[starts], ends - starts)
    at = np.flatnonzero(~SPACE[data])  # the bytes of all chunks
    letter = _LETTER[data] | after
    here = letter[at]
    turn = np.zeros(len(at), bool)
    turn[1:] = (here[1:] != here[:-1]) & plain[1:] & (at[1:] == at[:-1] + 1)
    new = at[turn]
    out = data.copy()
    out[at[plain]] = LOWER[data[at[plain]]]
    starts, ends = np.sort(np.concatenate([starts, new])), np.sort(np.concatenate([ends, new]))
    return out, starts, ends, np.searchsorted(starts, offsets)


class ChunkTokenizer:
    """Token ids of whole texts, with the ids of every part (see plain_parts) looked up by its hash.

    Known chunks are kept while they have at most ``keep`` ids in all; then the table starts anew.
    """

    def __init__(self, path: str, keep: int = 8 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep = keep
        self._clear()

    def _clear(self) -> None:
        self.bounds = np.zeros(1 << 16, np.int64)  # ids of chunk i: bounds[i] to bounds[i + 1]
        self.ids = np.zeros(1 << 18, np.uint32)
        self.table = Lookup()

    def _learn(self, keys: np.ndarray, chunks: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        lists = [x.ids for x in found]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        first = self.table.size
        start = self.bounds[first]
        end = start + int(n.sum())
        while first + len(n) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.bounds[first + 1:first + 1 + len(n)] = start + np.cumsum(n)
        self.ids[start:end] = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, end - start)
        self.table.add(keys)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of documents, and the number of ids before each document."""
        data, starts, ends, first = plain_parts(data, offsets)
        h = word_hashes(data, starts, ends)
        if self.bounds[self.table.size] > self.keep:
            self._clear()
        row = self.table.find(h)
        missing = np.flatnonzero(row < 0)
        if len(missing):
            keys, where = np.unique(h[missing], return_index=True)
            at = missing[where]
            raw = data.tobytes()
            self._learn(keys, [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[at], ends[at])])
            row = self.table.find(h)
        n = self.bounds[row + 1] - self.bounds[row]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.bounds[row] - total[:-1], n) + np.arange(total[-1])]
        return ids, total[first]


def piece_cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


class _Sequences:
    """Open sequences by free room, to find the one of lowest cost among those with at least a given room."""

    def __init__(self, capacities: list[int], capacity: int):
        self.size = 1 << (capacity + 1 - 1).bit_length()
        self.tree: list[tuple] = [(float("inf"), -1)] * (2 * self.size)
        self.heaps: dict[int, list] = {}
        self.cost = [0.0] * len(capacities)
        self.free = list(capacities)
        self.full = [0] * len(capacities)  # tokens placed so far
        for i, c in enumerate(capacities):
            self.heaps.setdefault(c, []).append((0.0, i))
        for c in self.heaps:
            heapq.heapify(self.heaps[c])
            self._up(c)

    def _up(self, room: int) -> None:
        heap = self.heaps.get(room)
        i = self.size + room
        tree = self.tree
        tree[i] = heap[0] if heap else (float("inf"), -1)
        i >>= 1
        while i:
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
            i >>= 1

    def lowest(self, room: int) -> int:
        """The open sequence of lowest cost with at least ``room`` (from 1) free; -1 if there is none."""
        lo, hi, best = room + self.size, 2 * self.size, (float("inf"), -1)
        tree = self.tree
        while lo < hi:
            if lo & 1:
                best = min(best, tree[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = min(best, tree[hi])
            lo >>= 1
            hi >>= 1
        return best[1]

    def put(self, i: int, n: int) -> int:
        """Place ``n`` tokens in sequence ``i``, the head of its heap; returns their offset."""
        room, at = self.free[i], self.full[i]
        heapq.heappop(self.heaps[room])
        self._up(room)
        self.cost[i] += piece_cost(n)
        self.free[i] -= n
        self.full[i] += n
        if self.free[i]:
            heapq.heappush(self.heaps.setdefault(self.free[i], []), (self.cost[i], i))
            self._up(self.free[i])
        return at


def sequence_lengths(tokens: int, capacity: int) -> list[int]:
    """Full sequences, then the powers of two that the rest adds up to."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_block(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, list[int]]:
    """Pieces (document, start, length, sequence, offset) of a block of documents, and its sequences' lengths."""
    total = int(lengths.sum())
    sequences = sequence_lengths(total, capacity)
    pieces, rest, used = [], [], 0
    for doc in range(len(lengths)):
        n, start = int(lengths[doc]), 0
        while n - start >= capacity:
            pieces.append((doc, start, capacity, used, 0))
            used += 1
            start += capacity
        if start < n:
            rest.append((n - start, doc, start))
    rest.sort(key=lambda x: (-x[0], x[1]))
    open_ = _Sequences(sequences[used:], capacity)
    for n, doc, start in rest:
        while n:
            i = open_.lowest(n)
            take = n
            if i < 0:
                i = open_.lowest(1)
                take = open_.free[i]
            pieces.append((doc, start, take, used + i, open_.put(i, take)))
            start += take
            n -= take
    return np.array(pieces, np.int64).reshape(-1, 5), sequences


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def _pack(path: str, capacity: int, block_tokens: int, with_ids: bool):
    def block(ids: list, docs: list, number: int) -> tuple[pa.RecordBatch, int]:
        flat = np.concatenate(ids).astype("<u4", copy=False)
        ids.clear()  # one copy of a block's ids is enough
        lengths = np.concatenate([n for _, n in docs])
        before = np.concatenate([[0], np.cumsum(lengths)])
        pieces, sequences = pack_block(lengths, capacity)
        doc, start, n, seq, offset = pieces.T
        raw, at = memoryview(flat).cast("B"), before[doc] + start
        crc = np.fromiter((zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at, at + n)), np.int64, len(n))
        columns = [pa.concat_arrays([x for x, _ in docs]).take(pa.array(doc)), pa.array(start), pa.array(n), pa.array(crc),
                   pa.array(lengths[doc]), pa.array(seq + number), pa.array(offset),
                   pa.array(np.array(sequences, np.int64)[seq])]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"]
        if with_ids:
            columns.append(pa.array([flat[a:b].view(np.int32) for a, b in zip(at, at + n)], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names), len(sequences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = ChunkTokenizer(path)
        encode = _TOKENIZERS[path].encode
        number = TaskContext.get().partitionId() << 36  # the task's own range of sequence numbers
        ids, docs, held = [], [], 0
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(1)):
                tokens, bounds = encode(data, offsets)
                ids.append(np.insert(tokens, bounds[1:], END))
                lengths = np.diff(bounds) + 1
                docs.append((batch.column(0).slice(row, len(lengths)), lengths))
                held += int(lengths.sum())
                if held >= block_tokens:
                    out, n = block(ids, docs, number)
                    yield out
                    number += n
                    ids, docs, held = [], [], 0
        if docs:
            yield block(ids, docs, number)[0]

    return run


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS,
         with_ids: bool = False) -> DataFrame:
    """One row per piece of a document (see PIECE; with ``ids`` on request); ``path`` names the tokenizer file."""
    schema = PIECE + (", ids array<int>" if with_ids else "")
    return documents.select("doc_id", "text").mapInArrow(
        _pack(path or tokenizer_path(), capacity, block_tokens, with_ids), schema)
