"""The stages of the corpus pipeline against the operators they call, and at the edges."""

import collections

import pytest

import corpus_pipeline as cp
from conftest import SF_SMALL
from cohortforge.llm import language, minhash, mixing, packing, quality
from cohortforge.llm.common import read
from test_operators import DOCS, ODD


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, SF_SMALL, "documents")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_are_the_dealt_ones():
    assert [f.__name__ for _, f in cp.STAGES] == [
        "quality_filter", "language_filter", "near_dedup", "source_mix", "packed_sequences"]
    assert cp.ORACLE_SQL is None


def test_each_stage_does_what_its_operator_says(spark, docs):
    labels = read(spark, SF_SMALL, "labels")
    good = cp.quality_filter(spark, docs, SF_SMALL)
    assert good.columns == docs.columns
    assert ids(good) == sorted(r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted == 1)
    known = cp.language_filter(spark, docs, SF_SMALL)
    assert known.columns == docs.columns
    assert ids(known) == sorted(r.doc_id for r in language.identify(docs).collect() if r.lang_pred != "und" and r.score >= 0.5)
    unique = cp.near_dedup(spark, docs, SF_SMALL)
    assert unique.columns == docs.columns
    assert ids(unique) == sorted(r.doc_id for r in minhash.near_duplicates(docs, k=5).collect() if r.kept)
    mixed = cp.source_mix(spark, docs, SF_SMALL)
    assert mixed.columns == docs.columns
    copies = collections.Counter(ids(mixed))
    size = {r.doc_id: (r.size, r.taken) for r in mixing.mix_documents(docs).collect()}
    assert all(abs(copies[i] * n - taken) <= n / 2 for i, (n, taken) in size.items() if n)
    packed = cp.packed_sequences(spark, docs, SF_SMALL).collect()
    whole = packing.pack(docs).collect()
    assert sum(r.length for r in packed) == sum(r.length for r in whole) and all(len(r.ids) == r.length for r in packed)


def test_run_hands_each_result_on(spark, docs):
    out = cp.run(spark, SF_SMALL).collect()
    assert out and {r.doc_id for r in out} <= set(ids(docs))
    full = [r for r in out if r.sequence_length == 2048]
    assert sum(r.length for r in out) >= 2048 * len({r.sequence_id for r in full})


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_and_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as size", "2 as score", "3 as kept", "4 as shard")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, df, SF_SMALL)
        assert out.columns == df.columns and out.count() <= 2 * len(rows)
    assert cp.packed_sequences(spark, df, SF_SMALL).count() >= len(rows)
