"""Benchmark decontamination against a plain Python version."""

import hashlib
import re

import pytest

from conftest import SF_SMALL
from cohortforge.llm import decontam
from cohortforge.llm.common import read

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEN = "one two three four five six seven eight nine ten"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


DOCS = [(1, f"Before, {TEN.upper()} after."), (1, f"Before, {TEN.upper()} after."), (1, "another text under one id: short item"), (2, None), (3, ""),
        (4, "!!! ... \t"), (None, f"no id -- {TEN}; {TEN}"), (5, "SHORT item"), (6, "short item short-item short"), (7, "É é ñandú ÑANDÚ 1,2"),
        (8, "a " * 30_000 + TEN), (9, "a a a a a a a a a a a"), (10, "two three four five six seven eight nine ten eleven twelve"),
        (11, "one two three four five six seven eight nine"), (12, "x" * 100_000)]
ITEMS = [(1, TEN + " eleven"), (2, "Short item"), (3, None), (4, "?!"), (5, "ñandú ÑANDÚ"), (20, TEN), (20, "a b"), (None, "é ñandú"),
         (6, "a " * 12), (7, "x" * 100_000), (30, TEN)]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame([(d, t, d, "words", 1) for d, t in DOCS], "doc_id long, text string, n long, words string, hits int")
    items = spark.createDataFrame([(i, t, "keys") for i, t in ITEMS], "item_id long, text string, `keys` string")
    return docs.repartition(3), items.repartition(2)


def test_matches_brute_force_on_odd_rows(odd):
    got = sorted((tuple(r) for r in decontam.contamination(*odd).collect()), key=str)
    assert got == expected(DOCS, ITEMS)


def test_slices_and_other_sizes_give_the_same(odd):
    for size in (1, 3, 7):
        got = sorted((tuple(r) for r in decontam.contamination(*odd, size=size, slice_rows=3).collect()), key=str)
        assert got == expected(DOCS, ITEMS, size)


def test_matches_brute_force_on_documents(spark):
    docs, items = read(spark, SF_SMALL, "documents"), read(spark, SF_SMALL, "benchmark")
    got = sorted((tuple(r) for r in decontam.contamination(docs, items).collect()), key=str)
    want = expected([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want and any(r[5] for r in got) and not all(r[5] for r in got)


def test_a_passage_of_many_documents_and_items(spark):
    docs = [(i, f"w{i} {TEN} v{i}") for i in range(300)] + [(i, f"clean {i} text") for i in range(300, 400)]
    items = [(i, f"{TEN} q{i}") for i in range(50)]
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(docs, items)


def test_empty_tables(spark, odd):
    none, no_items = odd[0].limit(0), odd[1].limit(0)
    assert decontam.contamination(none, odd[1]).count() == 0
    got = decontam.contamination(odd[0], no_items).collect()
    assert len(got) == len(DOCS) and not any(r.contaminated or r.n_hit or r.n_items for r in got)
    assert {r.items_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}


def test_removal(odd):
    docs, items = odd
    bad = {d for d, *_, c in expected(DOCS, ITEMS) if c}
    left = decontam.remove_documents(docs, items)
    assert left.columns == docs.columns
    clean = [(d, t) for d, t in DOCS if not expected([(d, t)], ITEMS)[0][5]]
    assert sorted([(r.doc_id, r.text) for r in left.collect()], key=str) == sorted(clean, key=str) and bad
    cut = decontam.remove_spans(docs, items)
    assert cut.columns == docs.columns
    got = {(r.doc_id, r.text) for r in cut.collect()}
    assert {(d, t) for d, t in clean} <= got
    assert (1, "Before, after.") in got and (6, "short") in got and (None, "no id -- ") in got
    after = expected(list(got), ITEMS)
    assert not any(r[5] for r in after if r[0] in (1, None))
