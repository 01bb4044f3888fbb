"""The operators of the training-data subpackage against brute force, round trips and held-out accuracy."""

import base64
import collections
import gzip
import glob
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from conftest import SF_SMALL
from cohortforge.llm import embeddings, language, lm, minhash, mixing, packing, quality, sharding, topk, warc
from cohortforge.llm.common import read, scratch_path

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Nulls in every column, empty and blank texts, one very long text, repeated rows, rows that differ in doc_id only.
ODD = [(1, "One two three four five six", "en", "a", 27), (2, None, None, None, None), (3, "", "en", "a", 0),
       (4, " \t\n ", "de", None, 4), (5, "one TWO three four five six", "en", "b", 27), (5, "one TWO three four five six", "en", "b", 27),
       (None, "no id here at all", "en", "b", 17), (7, "wort " * 40_000 + "ende", "de", "b", 200_004), (8, "!!! ???", None, "c", 7),
       (9, "x", "en", "c", 1), (10, "é ß ñ", "fr", "c", 5)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, SF_SMALL, "documents")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def fold(doc_id, n):
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


# --- sharding ---

def brute_shards(data, n):
    sized = sorted((-1 if i is None else i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in data)
    total, at, out, seen = sum(s for *_, s in sized), 0, [], collections.Counter()
    for i, crc, s in sized:
        shard = min(n - 1, (2 * at + s) * n // (2 * total))
        out.append((i, s, crc, shard, seen[shard]))
        seen[shard] += 1
        at += s
    return sorted(out)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_shards_match_brute_force(which, request):
    df = request.getfixturevalue(which)
    got = sharding.shard_documents(df).collect()
    assert {r["law"] for r in got} == {"bytes"}
    mine = sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got)
    assert mine == brute_shards([(r.doc_id, r.text) for r in df.collect()], 24)


def test_shards_of_equal_and_empty_rows(spark, empty):
    assert sharding.shard_documents(empty).count() == 0
    same = spark.createDataFrame([(1, "x" * 92, "k", 0)] * 240, "doc_id long, text string, size string, shard int")
    got = sharding.shard_documents(same).collect()
    assert collections.Counter(r["shard"] for r in got) == {i: 10 for i in range(24)}
    assert sorted((r["shard"], r["slot"]) for r in got) == [(i, j) for i in range(24) for j in range(10)]


# --- quality ---

def test_quality_on_held_out_rows(spark, docs):
    labels = read(spark, SF_SMALL, "labels")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (fold(r.doc_id, 4) == 2)
               for r in got.values())
    big = {r.doc_id: r for r in quality.classify(
        read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")).collect()}
    known = [(big[r.doc_id].score, r.quality) for r in read(spark, "/root/testdata/sf0.01", "labels").collect()
             if fold(r.doc_id, 4) == 2 and r.doc_id in big]
    good, bad = [s for s, q in known if q == 1], [s for s, q in known if q == 0]
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.95


def brute_statistics(text):
    data = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    low = [w.lower() for w in words]
    pairs = list(zip(low, low[1:]))
    lines = data.split(b"\n")
    lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    symbol = {c for c in range(128) if not chr(c).isalnum() and c not in b" \t\n\v\f\r"}
    size, n = max(1, len(data)), max(1, len(words))
    share = lambda test: sum(map(test, data)) / size
    of = lambda test: sum(map(test, words)) / n
    upper = range(65, 91)
    return [
        math.log1p(len(data)), math.log1p(len(words)), sum(map(len, words)) / n, share(lambda c: c in upper), share(lambda c: c in range(48, 58)),
        share(lambda c: c in symbol), share(lambda c: c >= 128), share(lambda c: c in b" \t\n\v\f\r"), share(lambda c: c == 10),
        -sum(m / size * math.log2(m / size) for m in collections.Counter(data).values()), len(set(low)) / n,
        max(collections.Counter(low).values(), default=0) / n, len(set(pairs)) / max(1, len(words) - 1), max(map(len, words), default=0),
        of(lambda w: w[-1] in symbol and w[-1] not in b".,;:?"), of(lambda w: len(w) == 1), 1 - len(set(lines)) / max(1, len(lines)),
        of(lambda w: 2 * sum(c in upper for c in w) > len(w)), of(lambda w: w[-1] in b"!.?"), of(lambda w: all(c in symbol for c in w))]


def test_statistics_match_brute_force(rows):
    texts = [r.text for r in rows[:80]] + ["", "  ", "\n", "a\na\n", "a\nb\na", "One one ONE two", "!!! ??? x.", "é ß É", "NASA Was here!\n\n\n", "x" * 700_000 + " y"]
    got = quality.statistics_of(pa.array(texts))
    for text, mine in zip(texts, got):
        want = brute_statistics(text)
        assert [f for f, a, b in zip(quality.FEATURES, mine, want) if not math.isclose(a, b, abs_tol=1e-9)] == [], (text[:80], mine, want)


def test_one_tree_of_one_level_is_the_best_newton_split():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (300, len(quality.FEATURES))).astype(float)
    y = ((x[:, 5] > 6) ^ (rng.random(300) < 0.1)).astype(float)
    forest = quality.fit_forest(x, y, trees=1, depth=1)
    share = (y.sum() + 0.5) / (len(y) + 1)
    g, h = y - share, np.full(len(y), share * (1 - share))

    def gain(side):
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.SMOOTH)
        return part(side) + part(~side) if min(h[side].sum(), h[~side].sum()) >= 1 else 0

    best = max(gain(x[:, f] > t) for f in range(x.shape[1]) for t in range(12))
    side = x[:, forest.feature[0, 0]] > forest.threshold[0, 0]
    assert math.isclose(gain(side), best)
    for m, leaf in ((~side, forest.leaf[0, 0]), (side, forest.leaf[0, 1])):
        assert math.isclose(leaf, quality.RATE * g[m].sum() / (h[m].sum() + quality.SMOOTH))


def test_forest_equals_walking_the_trees():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 3] ** 2 > 0.5).astype(float)
    forest = quality.fit_forest(x, y, trees=10)
    for row, score in zip(x[:50], forest.score(x[:50])):
        margin = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            margin += leaf[node - len(f)]
        assert math.isclose(score, 1 / (1 + math.exp(-margin)))
    assert ((forest.score(x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (9, None, None), (None, 1, 1), (77, 1, 0), (1, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    assert quality.classify(odd, labels).count() == len(ODD)
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0
    extra = odd.selectExpr("*", "1 as score", "2 as quality", "3 as predicted")
    kept = quality.keep_good(extra, labels, threshold=0.0)
    assert kept.columns == extra.columns and kept.count() == len(ODD)


# --- WARC ---

def brute_warc(pages):
    top = {}
    for i, html in pages:
        if i is not None:
            top[html or ""] = max(top.get(html or "", i), i)
    out = []
    for i, html in pages:
        data = (html or "").encode()
        first = top.get(html or "")
        lead = first is None or first == i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if lead else "revisit",
                    None if lead else first))
    return sorted(out, key=str)


def test_warc_round_trip(spark):
    pages = [(i, f"http://x/ü {i}\n", "<p>é" + "lorem " * (i % 7) + "</p>") for i in range(300)]
    pages += [(1000, None, None), (1001, "u", ""), (1002, "u", "z" * 300_000), (1002, "u", "z" * 300_000), (None, "v", "alone"),
              (None, "v", "alone"), (None, "w", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    path = scratch_path(spark, "warc-test")
    warc.write_warc(df, path)
    for range_bytes in (4 << 20, 97):
        back = warc.read_warc(spark, path, range_bytes).collect()
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str)
        assert got == brute_warc([(i, h) for i, _, h in pages])
    payload = {r.page_id: bytes(r.payload).decode() for r in back if r.record_type == "response"}
    assert all(payload[r.refers_to if r.record_type == "revisit" else r.page_id] == (h or "")
               for i, _, h in pages if i is not None for r in back if r.page_id == i)
    raw = [gzip.open(f).read() for f in glob.glob(path.removeprefix("file:") + "/part-*")]
    assert sum(x.count(b"WARC/1.1\r\n") for x in raw) == len(pages)
    assert warc.archive_pages(df.limit(0)).count() == 0


# --- language model ---

def brute_ctw(train, texts, order):
    counts = collections.defaultdict(lambda: [0, 0])
    children = collections.defaultdict(set)

    def steps(text):
        data = bytes(order) + " ".join(tokens(text)).encode() + b"\0"
        for i in range(order, len(data)):
            for bit in range(8):
                prefix = (1 << bit) | (data[i] >> (8 - bit))
                yield [(data[i - d:i], prefix) for d in range(order + 1)], data[i] >> (7 - bit) & 1

    for text in train:
        for path, bit in steps(text):
            for d, node in enumerate(path):
                counts[node][bit] += 1
                if d:
                    children[path[d - 1]].add(node)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def pw(node):
        if node not in memo:
            own = kt(*counts[node])
            if len(node[0]) < order:
                own = np.logaddexp(own, sum(pw(c) for c in children[node])) - math.log(2)
            memo[node] = own
        return memo[node]

    out = []
    for text in texts:
        total = 0.0
        for path, bit in steps(text):
            p = None
            for node in reversed(path):
                n = counts.get(node, [0, 0])
                here = (n[bit] + 0.5) / (sum(n) + 1)
                if p is not None and len(node[0]) < order:
                    w = 1 / (1 + math.exp(min(700, sum(pw(c) for c in children[node]) - kt(*n))))
                    p = w * here + (1 - w) * p
                else:
                    p = here
                if not sum(n):
                    p = None
            total += math.log10(p if p is not None else 0.5)
        out.append(total)
    return out


def check_lm(data, got, order=lm.ORDER):
    train = [t for i, t in data if fold(i, 5) != 1]
    count = collections.Counter(w for t in train for w in tokens(t))
    n, v = sum(count.values()) + len(train), len(count) + bool(train)
    want = []
    for (i, t), score in zip(data, brute_ctw(train, [t for _, t in data], order)):
        c = [count[w] for w in tokens(t)] + [len(train)]
        want.append((str(i), fold(i, 5) == 1, len(c), sum(x > 0 for x in c), n,
                     sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c), score))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]
    for a, b in zip(sorted(want), sorted(got)):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9)


@pytest.mark.parametrize("top", [(lm.TOP_WORDS, lm.TOP_STRINGS), (4, 9)])
def test_language_model_matches_brute_force(spark, rows, top):
    """With all values broadcast and with nearly all of them joined."""
    data = [(r.doc_id, r.text[:300]) for r in rows[:40]] + [(901, None), (902, ""), (903, "One\x0bONE é"), (903, "One\x0bONE é"), (None, "zz")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    check_lm(data, lm.score_documents(df, top_words=top[0], top_strings=top[1]).collect())


def test_language_model_beats_the_words(spark, docs, odd, empty):
    got = [r for r in lm.score_documents(read(spark, "/root/testdata/sf0.1", "documents")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert lm.score_documents(empty).count() == 0
    assert lm.score_documents(odd.selectExpr("*", "1 as uid", "2 as score")).count() == len(ODD)
    assert lm.score_documents(odd.where("doc_id is null").selectExpr("cast(4 as long) doc_id", "text")).count() == 1


# --- top-k search ---

def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 16)) * 0.3
    x[100:140] = x[50]
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    data += [(950, None), (1000, [1.0, None] + [0.0] * 14), (1050, [float("nan")] * 16), (1100, [float("inf")] * 16), (1150, []),
             (None, [1.0] * 16), (1200, [0.5, 0.25]), (50, data[50][1]), (100, data[7][1]), (7, data[300][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as x").repartition(4)
    rows = [(i, np.pad(np.floor(256 * np.asarray(v, np.float32).astype(float)), (0, 16 - len(v))).astype(int))
            for i, v in data if i is not None and v and i not in (1000, 1050, 1100)]
    want = []
    for own, (i, v) in enumerate(rows):
        if i % 50 == 0:
            best = sorted((-int(v @ x), j) for other, (j, x) in enumerate(rows) if other != own)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    for block in (4096, 128, 3):
        got = topk.top_inner_products(df, block=block).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_inner_products(df.limit(0)).count() == 0


# --- mixing ---

def brute_mix(data):
    size = [len(tokens(t)) for _, t, _ in data]
    names = sorted({s for *_, s in data}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, (*_, x) in zip(size, data) if x == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(size), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        for s in over or open_:
            target[s] = 2.0 * total[s] if over else share[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    return names, total, target


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mix_meets_its_targets(which, request):
    df = request.getfixturevalue(which)
    data = [(r.doc_id, r.text, r.source) for r in df.collect()]
    names, total, target = brute_mix(data)
    narrow = df.select("doc_id", "source", mixing.word_count().alias("w"))
    got = mixing.mix(narrow, narrow["w"], block_rows=4).collect()
    assert len(got) == len(data)
    taken, draws = collections.Counter(), collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == total[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-9)
        assert r.taken == sum(d.words for d in r.draws) and len({d.epoch for d in r.draws}) == len(r.draws)
        taken[r.source] += r.taken
        for d in r.draws:
            draws[d.shard] += 1
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in names)
    assert set(draws) <= set(range(8))
    again = mixing.mix(narrow.repartition(5), narrow["w"], block_rows=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_tree_splits_evenly(spark):
    units = spark.range(1001).selectExpr("cast(id % 2 as string) s", "id b", "0 epoch")
    got = mixing.split_tree(units, 8, "t", ["s", "b", "epoch"]).groupBy("shard").pivot("s", ["0", "1"]).count().collect()
    assert len(got) == 8 and all(125 <= r["0"] + r["1"] <= 126 and 35 <= r["0"] <= 90 for r in got)


def test_mixed_documents(spark, odd, empty):
    assert mixing.mix_documents(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    extra = odd.selectExpr("*", "1 as size", "2 as draws", "3 as u", "4 as target")
    out = mixing.mixed_documents(extra)
    assert out.columns == extra.columns
    per = collections.Counter(r.doc_id for r in out.collect())
    assert max(per[i] for i in per if i != 5) <= 2 and 3 not in per and 2 not in per


# --- packing ---

def check_pack(data, got, capacity=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = collections.Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in data)
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i in {i for i, _ in data}:
        texts = [ids for (j, ids), n in want.items() if j == i for _ in range(n)]
        pieces = sorted(by_doc[i], key=lambda r: (r.start, r.ids))
        assert sum(r.length for r in pieces) == sum(map(len, texts))
        for ids in texts:
            at = 0
            while at < len(ids):
                p = next(r for r in pieces if r.start == at and r.doc_tokens == len(ids) and tuple(r.ids) == ids[at:at + r.length])
                pieces.remove(p)
                at += p.length
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].sequence_length <= capacity and at & (at - 1) == 0


def test_packing(spark, docs, rows, odd, empty):
    check_pack([(r.doc_id, r.text) for r in rows], packing.pack(docs, with_ids=True).collect())
    special = spark.createDataFrame([(1, "A<|endoftext|>b it's 12 é ＡＢ c d İ\tZ's"), (2, "n" * 5000), (2, "m o " * 9000),
                                     (3, "J\u030Cab, \u00c9\u00d7\u00c9. don't A\u030A, <|ENDOFTEXT|> \u00d7\u00f7 \u00df1a2,B \u00c3b\u2014, 'S <B>")],
                                    "doc_id long, text string")
    check_pack([tuple(r) for r in special.collect()], packing.pack(special, with_ids=True, block_tokens=2000).collect())
    check_pack([(r[0], r[1]) for r in ODD], packing.pack(odd.selectExpr("*", "1 as ids", "2 as start"), with_ids=True).collect())
    assert packing.pack(empty).count() == 0


def test_packing_balances_cost():
    rng = np.random.default_rng(5)
    lengths = np.minimum(rng.lognormal(5.5, 1, 3000).astype(np.int64) + 1, 6000)
    pieces, sequences = packing.pack_block(lengths)
    cost = np.zeros(len(sequences))
    for _, _, n, s, _ in pieces:
        cost[s] += packing.piece_cost(int(n))
    whole = np.bincount(pieces[:, 3])[:len(sequences)] > 1
    arrival = np.zeros(len(sequences))
    at = 0
    for n in lengths:  # the same documents one after another
        while n:
            take = min(n, 2048 - at % 2048)
            arrival[min(at // 2048, len(sequences) - 1)] += packing.piece_cost(int(take))
            at, n = at + take, n - take
    full = [i for i, s in enumerate(sequences) if s == 2048]
    assert cost[full][whole[full]].std() < arrival[full].std()


# --- vectors ---

def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((500, 24))
    for i in range(60, 200):
        x[i] = x[i % 20] + 0.02 * rng.standard_normal(24)
    x[200:230] = x[3]
    x[230:240] = 2 * x[4]
    data = [(i + 5, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    data += [(2000, None), (2001, [0.0] * 24), (2002, [None] * 24), (2003, [float("nan")] * 24), (2004, []), (2005, [1.0, 2.0]),
             (2006, [2.0, 4.0]), (None, data[0][1]), (7, data[2][1]), (6, data[100][1]), (300, data[4][1]), (65, data[499][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 as rep", "2 as raw").repartition(4)
    good = [(i, np.asarray(v, float)) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    link = [[j for j, (_, w) in enumerate(good) if j != i and len(v) == len(w) and
             v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95] for i, (_, v) in enumerate(good)]
    root = [k for k, _ in good]  # rows, not ids, are linked
    for _ in range(20):
        for i in range(len(good)):
            for j in link[i]:
                root[i] = root[j] = min(root[i], root[j])
    want = [(k, len(link[i]), root[i], root[i] == k) for i, (k, _) in enumerate(good)]
    want += [(i, 0, i, True) for i in (2000, 2001, 2002, 2003, 2004)] + [(None, 0, None, True)]
    for chunk in (embeddings.CHUNK, 16):
        embeddings.CHUNK, old = chunk, embeddings.CHUNK
        got = embeddings.near_duplicate_vectors(df).collect()
        embeddings.CHUNK = old
        assert sorted(map(str, want)) == sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got)
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_tables_keep_the_miss_rate():
    for n in (100, 10_000, 10**9):
        width, k, tables = embeddings.plan_tables(n)
        near = embeddings.agreement(width / math.sqrt(0.1)) ** k
        assert (1 - near) ** tables <= embeddings.MISS
        assert n * embeddings.agreement(width / math.sqrt(2)) ** k <= embeddings.BUCKET


# --- near-duplicates ---

def brute_sets(data, k):
    out = []
    for _, t in data:
        w = tokens(t)
        out.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    return out


def brute_near(data, k=4):
    sets, root = brute_sets(data, k), [i for i, _ in data]  # rows, not ids, are linked
    links = [(a, b) for a in range(len(data)) for b in range(a) if sets[a] and sets[b] and data[a][0] is not None and
             data[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(len(data)):
        before = list(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    return sorted(str((i, len(s), r if s else i, i is None or not s or r == i)) for (i, _), s, r in zip(data, sets, root))


@pytest.mark.parametrize("chunk, size", [(minhash.CHUNK, minhash.CHUNK_BYTES), (4, minhash.CHUNK_BYTES), (minhash.CHUNK, 4096)])
def test_near_duplicates_match_brute_force(spark, rows, chunk, size, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    monkeypatch.setattr(minhash, "CHUNK_BYTES", size)
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(900)]
    data = [(r.doc_id, r.text[:900]) for r in rows[:60]]
    for group in range(12):  # groups whose members are edited again and again, so that similarities lie on both sides of 0.8
        base = list(rng.choice(vocabulary, 120))
        for j in range(14):
            data.append((1000 + 100 * group + j, " ".join(base)))
            base[int(rng.integers(0, 120))] = "Edit%d" % j
    passage = list(rng.choice(vocabulary, 40))
    for j in range(40):
        data.append((5000 + j, " ".join([*rng.choice(vocabulary, 60), *passage])))
    data += [(9000, None), (9001, " "), (9002, "two words"), (9003, "TWO\twords"), (None, "two words"), (9004, "a b c d"), (9004, "a b c d")]
    data += [(1003, "quite another text under an id that is used"), (5001, data[70][1]), (9005, data[90][1])]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as rep", "2 as item", "3 as sig").repartition(5)
    got = minhash.near_duplicates(df).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in got) == brute_near(data)


def test_sets_meet_by_bits_and_pair_by_pair(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (1, 40, 200, 260, 90)]
    i, j = map(np.array, zip(*[(a, b) for a in range(5) for b in range(a)]))
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j)]
    assert minhash._common(sets, minhash._bit_sets(sets), i, j).tolist() == want
    monkeypatch.setattr(minhash, "BIT_BYTES", 64)
    assert minhash._bit_sets(sets) is None and minhash._common(sets, None, i, j).tolist() == want


def test_lists_are_cut_by_bytes(monkeypatch):
    monkeypatch.setattr(minhash, "HELD_BYTES", 1 << 12)
    item = np.repeat(np.arange(30), 7)
    sig = pa.ListArray.from_arrays(pa.array(np.arange(211, dtype=np.int32) * 2), pa.array(np.arange(420, dtype=np.int32)))
    table = pa.table({"item": item, "set": pa.array([bytes(100)] * 210, pa.binary()), "sig": sig})
    got = list(minhash._lists(iter(table.to_batches(max_chunksize=25)), 1))
    assert len(got) > 3 and np.concatenate([cols[0] for _, cols, _ in got]).tolist() == item.tolist()
    assert all(np.bincount(number).tolist() == [7] * (number[-1] + 1) for number, _, _ in got)


def test_one_of_each_group_stays(spark, odd, empty):
    assert minhash.near_duplicates(empty).count() == 0 and minhash.drop_near_duplicates(empty).count() == 0
    extra = odd.selectExpr("*", "1 as kept_id", "2 as rows", "3 as k")
    out = minhash.drop_near_duplicates(extra)
    assert out.columns == extra.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(i) for i in (1, 2, 3, 4, None, 7, 8, 9, 10))


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    data = [(1, long), (1, other), (1, other), (2, long + " end"), (None, other), (None, "only here and without an id"), (None, long), (3, ""), (3, ""),
            (None, "a text b text c text d"), (None, "a text b text c text d")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as odd_id", "2 as digest").repartition(3)
    got = minhash.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(str(x) for x in [
        (1, long), (1, other), (None, "only here and without an id"), (3, ""), (3, ""), (None, "a text b text c text d")])


# --- languages ---

def test_code_lengths_match_brute_force():
    order, texts = 2, {"aa": ["abracadabra", "abab"], "bb": ["xyzzy abra", "zz"]}
    ngrams = collections.Counter()
    for x, lang in enumerate(texts):
        for t in texts[lang]:
            data = np.frombuffer(t.encode(), np.uint8)
            for g in language.grams(data, np.array([0, len(data)]), order):
                ngrams[x, int(g)] += 1
    keys = list(ngrams)
    trees = language.ContextTrees(list(texts), order, np.array([k[0] for k in keys]), np.array([k[1] for k in keys], np.uint64),
                                  np.array([ngrams[k] for k in keys]))
    for probe in ("abra zz", "q", "xyzab"):
        want = []
        for lang in texts:
            seen = collections.defaultdict(collections.Counter)
            for t in texts[lang]:
                data = bytes(order) + t.encode()
                for i in range(order, len(data)):
                    for d in range(order + 1):
                        seen[data[i - d:i]][data[i]] += 1
            bits, data = 0.0, bytes(order) + probe.encode()
            for i in range(order, len(data)):
                p = 1.0
                for d in range(order, -1, -1):
                    c = seen.get(data[i - d:i])
                    if c is None:
                        continue
                    n, u = sum(c.values()), len(c)
                    if data[i] in c:
                        p *= c[data[i]] / (n + u)
                        break
                    p *= u / (n + u)
                else:
                    p /= 256
                bits -= math.log2(p)
            want.append(bits)
        data = np.frombuffer(probe.encode(), np.uint8)
        assert np.allclose(trees.bits(data, np.array([0, len(data)]))[0], want, rtol=1e-5)


def test_languages_of_held_out_rows(spark, odd, empty):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in language.identify(docs).collect() if r.held_out]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95
    got = {(r.doc_id, r.lang_pred, r.score) for r in language.identify(odd).collect()}
    assert {(i, "und", 0.0) for i in (2, 3, 4, 8)} <= got and len(got) == len(ODD) - 1
    assert language.identify(empty).count() == 0
    unlabelled = odd.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {(r.lang_pred, r.score) for r in language.identify(unlabelled).collect()} == {("und", 0.0)}
    extra = odd.selectExpr("*", "1 as lettered", "2 as score")
    kept = language.keep_identified(extra)
    assert kept.columns == extra.columns and kept.count() < len(ODD)


def test_many_languages_cost_the_same_in_lists():
    rng = np.random.default_rng(7)
    gram = language.grams(rng.integers(97, 103, 3000).astype(np.uint8), np.array([0, 1000, 3000]), 3)
    lang, gram = np.divmod(np.unique(np.arange(3000, dtype=np.uint64) % 5 << np.uint64(32) | gram), np.uint64(1 << 32))
    count = rng.integers(1, 9, len(gram))
    args = (list("abcde"), 3, lang.astype(np.int64), gram, count)
    data = np.frombuffer(b"abcabd fade" + bytes([200, 1]) + b"aq", np.uint8)
    offsets = np.array([0, 5, 5, len(data)])
    assert np.allclose(language.ContextTrees(*args).bits(data, offsets), language.SparseTrees(*args).bits(data, offsets), rtol=1e-5)


def test_water_level_reshares_what_small_languages_leave():
    assert language.level(np.array([10, 1000, 1, 1000]), 511) == 250
    assert language.level(np.array([10, 20]), 511) == 20
    assert language.level(np.array([], np.int64), 511) == 0


def test_a_language_of_few_very_long_documents_has_a_tree(spark):
    word = {"aa": "lorem ipsum dolor ", "bb": "grumpf zwitsch klang ", "cc": "ukubona abantu ", "dd": "ystod hwyr ddydd "}
    rows = [(10 * i + j, w * 20_000, x, "s", 0) for i, (x, w) in enumerate(word.items()) for j in range(10)]
    out = language.identify(spark.createDataFrame(rows, DOCS), train_bytes=1 << 13).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] for r in out) and len(out) == len(rows)


def test_long_documents_train_by_windows_beyond_their_beginnings(spark):
    word = {"aa": "lorem ipsum dolor ", "bb": "grumpf zwitsch klang "}
    header = "all rights reserved " * 2000
    rows = [(10 * i + j, header + w * 20_000, x, "s", 0) for i, (x, w) in enumerate(word.items()) for j in range(10)]
    short = [(100 + i, w * 3, None, "s", 0) for i, w in enumerate(word.values())]
    out = language.identify(spark.createDataFrame(rows + short, DOCS), train_bytes=1 << 13).collect()
    assert [r.lang_pred for r in sorted(out, key=lambda r: r.doc_id) if r.doc_id >= 100] == list(word)


def test_thousands_of_lang_values_leave_no_language_without_a_tree(spark):
    rng = np.random.default_rng(3)
    junk = [(i, "".join(map(chr, rng.integers(0x400, 0x450, 30))), f"junk{i}", "s", 0) for i in range(2500)]
    word = {"aa": "lorem ipsum dolor ", "bb": "grumpf zwitsch klang "}
    real = [(10_000 + 2 * j + i, w * 400, x, "s", 0) for j in range(40) for i, (x, w) in enumerate(word.items())]
    nameless = [(None, "keine nummer hier " * 9, "cc", "s", 0)]
    docs = spark.createDataFrame(junk + real + nameless, DOCS)
    trees = language.train(docs, train_bytes=1 << 18)
    trained = {r[2] for r in junk if fold(r[0], 4) != 2} | {"aa", "bb", "cc"}
    assert set(trees.languages) == trained
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, train_bytes=1 << 18).collect()}
    assert all(got[r[0]] == r[2] for r in real) and got[None] == "cc"
    assert all(got[r[0]] == r[2] for r in junk if fold(r[0], 4) != 2)
