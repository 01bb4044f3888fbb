"""A training corpus from raw documents: quality filter, language filter, near-dedup, source mix, packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result as Parquet into the shared checkpoint
folder and hands what it reads back to the next. All but the last return the columns of documents.

Defined results: stages accept nulls in any column, empty texts, repeated rows, empty tables and extra columns, as their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortforge.llm import language, minhash, mixing, packing, quality
from cohortforge.llm.common import read, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.7 or more)."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: not ``und``, and more likely than all other languages together."""
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of their five-word shingles."""
    return minhash.drop_near_duplicates(docs, k=5, num=80, den=100)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the target weights, one row per drawn copy."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the drawn documents in their sequences, with token ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality_filter),
    ("language ID", language_filter),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mix),
    ("packing", packed_sequences),
]

#: The models of the first two stages and the tokenizer of the last are beyond SQL: tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
