"""Periodic runs against a plain quadratic version."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from cohortforge.llm import runs
from cohortforge.llm.common import read

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t, least=6, exponent=4):
    out = []
    for q in range(1, len(t) // 2 + 1):
        i = 0
        while i + q < len(t):
            s = i
            while i + q < len(t) and t[i] == t[i + q]:
                i += 1
            n = i - s + q
            if i > s and n >= max(least, exponent * q):
                w = t[s:s + n]
                if not any(w[p:] == w[:-p] for p in range(1, q)):
                    out.append((s, n, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def row(doc_id, text):
    w = WORD.findall(text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if w and h is not None and h % 10 == 0:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = brute(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def answer(df):
    return sorted((tuple(r) for r in runs.document_runs(df).collect()), key=str)


def periodic(word, repeats, rest):
    return word * repeats + rest


texts = st.lists(st.one_of(
    st.lists(st.integers(1, 2), max_size=50), st.lists(st.integers(1, 4), max_size=50),
    st.builds(periodic, st.lists(st.integers(1, 3), min_size=1, max_size=7), st.integers(1, 9), st.lists(st.integers(1, 3), max_size=12))),
    max_size=5)


@settings(max_examples=400, deadline=None)
@given(texts, st.sampled_from([(6, 4), (4, 2), (2, 2), (6, 3), (9, 5)]))
def test_runs_equal_brute_force(found, rule):
    assert runs.runs_of([np.array(t, np.int64) for t in found], *rule) == [brute(t, *rule) for t in found]


def test_documents(spark):
    docs = read(spark, SF_SMALL, "documents")
    want = sorted((row(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 20_000), key=str)
    got = answer(docs.where("length(text) < 20000"))
    assert got == want and any(r[1] for r in got)


ODD = [(None, "a b " * 8), (1, None), (2, ""), (3, " \t\n"), (4, "x"), (5, "a a a a a"), (6, "a a a a a a"), (7, "a b a b a b a b c c c c c c c"),
       (7, "a b a b a b a b c c c c c c c"), (7, "another text"), (8, "é é é é " * 6), (9, "z\x0by\x0cz y\nz\ty\rz y"), (29, "k l m n " * 30),
       (30, "A a A a A a A a")] + [(i, "p q r s t u v w x y z " * 2) for i in range(100, 160)]


def test_odd_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in ODD], "doc_id long, text string, key string, runs int").repartition(3)
    got = answer(df)
    assert got == sorted((row(d, t) for d, t in ODD), key=str) and sum(r[1] for r in got) > 10
    assert runs.document_runs(df.limit(0)).count() == 0


@pytest.mark.parametrize("period", [1, 3, 5000])
def test_a_very_long_text(spark, monkeypatch, period):
    monkeypatch.setattr(runs, "CHUNK_BYTES", 1000)
    word = [f"w{i}" for i in range(period)]
    text = " ".join(["head", *(word * (60_000 // period)), "tail"])
    got = runs.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in got.runs] == [(1, 60_000 // period * period, period)]
    assert got.collapsed == " ".join(["head", *word, "tail"]) and got.n_words == 60_000 // period * period + 2
