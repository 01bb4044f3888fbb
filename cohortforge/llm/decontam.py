"""Benchmark decontamination by a broadcast hash set of normalised test n-grams (DataFrame functions only).

Words are runs of digits, letters a to z (upper case lowered) and non-ASCII characters. A test item's windows are its runs of SIZE consecutive
words; a shorter item is one window. The distinct windows are stored with a 64-bit key, the SHA-256 of their words and the number of
the set of items that have them: rows of fixed size, however long the words. They are broadcast in slices of SLICE rows, so that what is
sent is bounded whatever the benchmark's size; almost always there is one slice.

Documents are scanned once per slice. The keys of all windows of a document come from its words' hashes by doubling (two windows of 2 give one of
4, and so on), array by array. Each window probes the hash set; a hit is verified by the SHA-256 of its words. Only hits and one row per document leave
the task, combined per document before and after the shuffle. Item lists are put together once per distinct set of windows, not
per document, so that a passage which a third of all documents share costs one list.

Defined results: a null or empty text, or one without words, has no words and no hits; an empty item has no window; rows of ``benchmark`` with one
item_id are one item with the windows of each; rows without item_id are one item, named by the empty string; repeated rows of documents each give a
row; with no benchmark nothing is hit. Only the id and the text are read, so that extra columns cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted_broadcast, written

SIZE = 10
SLICE = 1 << 19
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The words of the contract, before A-Z are lowered.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Key of the row that every document meets; ``at`` 0 tells it from windows.
_EVERY = 0


def _lowered(word: Column) -> Column:
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _with_words(df: DataFrame, text: str) -> DataFrame:
    words = F.coalesce(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    return df.withColumn("words", words).withColumn("n", F.size("words"))


def _with_keys(df: DataFrame, lengths: list[int]) -> DataFrame:
    """``df`` (words, n) with a column k<L> for each of ``lengths``: the keys of all windows of L words, in order."""
    have = {1}
    df = df.withColumn("k1", F.transform("words", lambda w: F.xxhash64(_lowered(w))))

    def joined(df: DataFrame, a: int, b: int) -> DataFrame:
        size = F.greatest(F.lit(0), F.col("n") - (a + b - 1))
        return df.withColumn(f"k{a + b}", F.zip_with(F.slice(f"k{a}", F.lit(1), size), F.slice(f"k{b}", F.lit(a + 1), size),
                                                     lambda x, y: F.xxhash64(x, y)))

    def build(df: DataFrame, length: int) -> DataFrame:
        if length in have:
            return df
        top = 1 << (length.bit_length() - 1)
        a, b = (top, length - top) if length > top else (top // 2, top // 2)
        df = joined(build(build(df, a), b), a, b)
        have.add(length)
        return df

    return reduce(build, lengths, df)


def _digest(words: str, start: Column, length: Column) -> Column:
    """SHA-256 of the lowered words from ``start`` (1 is the first) on, joined by spaces. Without a lambda, so that the join that
    verifies hits with it is compiled together with the explode: else every window would carry a copy of all words."""
    return F.unhex(F.sha2(F.translate(F.array_join(F.slice(words, start, length), " "), UPPER, LOWER), 256))


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame, list[int]]:
    """(windows: key, digest, length, items_key; items: items_key, items; the window lengths there are), both stored."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    items = _with_words(items, "text").withColumn("length", F.least("n", F.lit(size)))
    lengths = sorted(r.length for r in items.where("n > 0").select("length").distinct().collect())  # ``size`` rows at most
    every = []
    for length in lengths:
        some = _with_keys(items.where(F.col("length") == length), [length]).select("item", "words", F.posexplode_outer(f"k{length}").alias("p", "key"))
        every.append(some.select("item", "key", _digest("words", F.col("p") + 1, F.lit(length)).alias("digest"), F.lit(length).alias("length")))
    spark = benchmark.sparkSession
    found = reduce(DataFrame.union, every) if every else spark.createDataFrame([], "item string, key long, digest binary, length int")
    sets = found.groupBy("key", "digest", "length").agg(F.array_sort(F.collect_set("item")).alias("items"))
    sets = written(sets.withColumn("items_key", F.unhex(F.sha2(F.to_json("items"), 256))), "windows")
    return (sets.select("key", "digest", "length", "items_key"),
            sets.groupBy("items_key").agg(F.min("items").alias("items")), lengths)


def _hits(documents: DataFrame, ids: list[str], windows: DataFrame, lengths: list[int], slice_rows: int) -> DataFrame:
    """One stored row per distinct document row (``ids`` and text): its number of copies and words, hits (p, length) and items_keys."""
    docs = documents.select(*ids, F.unhex(F.sha2(F.coalesce("text", F.lit("\x00null")), 256)).alias("text_key"), "text")
    docs = _with_keys(_with_words(docs, "text"), lengths)
    docs = docs.withColumn("keys", F.concat(F.array(F.lit(_EVERY).cast("long")), *[F.col(f"k{x}") for x in lengths]))
    # outer, though no array is empty: a plain explode has its array computed once more to filter empty ones beforehand
    probes = docs.select(*ids, "text_key", "words", "n", F.posexplode_outer("keys").alias("at", "key"))
    start, before = F.lit(0), F.lit(0)  # where in ``keys`` the windows of the row's length begin
    for x in lengths:
        start = F.when(F.col("length") == x, before).otherwise(start)
        before = before + F.greatest(F.lit(0), F.col("n") - (x - 1))
    p = F.col("at") - start
    slices = -(-windows.count() // slice_rows) or 1
    found = []
    for i in range(slices):
        part = windows.where(F.pmod("key", F.lit(slices)) == i)
        if not i:
            part = part.union(windows.sparkSession.sql(
                f"select {_EVERY}L, cast(null as binary), 0, cast(null as binary)"))
        same = F.when(F.col("at") == 0, F.col("length") == 0).when(
            (F.col("length") > 0) & (p >= 1) & (p <= F.col("n") - F.col("length") + 1),
            _digest("words", p, F.col("length")) == F.col("digest")).otherwise(False)
        part = part.withColumnRenamed("key", "w_key")
        met = probes.join(F.broadcast(part), (F.col("key") == F.col("w_key")) & same)  # slice_rows rows of fixed size at most
        hit = F.when(F.col("length") > 0, F.struct(p.alias("p"), F.col("length")))
        found.append(met.select(*ids, "text_key", "n", (F.col("length") == 0).cast("long").alias("row"), hit.alias("hit"), "items_key"))
    rows = reduce(DataFrame.union, found).groupBy(*ids, "text_key").agg(
        F.sum("row").alias("copies"), F.max("n").alias("n"), F.collect_set("hit").alias("hits"), F.collect_set("items_key").alias("sets"))
    return written(rows, "hits")


def _covered(hits: str) -> Column:
    """Words in the union of the hit windows."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def more(acc, h):
        end = h["p"] + h["length"]
        return F.struct(F.greatest(acc["end"], end).alias("end"),
                        (acc["total"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], h["p"]))).alias("total"))

    return F.aggregate(F.array_sort(hits), zero, more, lambda acc: acc["total"])


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = SIZE, slice_rows: int = SLICE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``documents`` (doc_id, text)."""
    windows, items, lengths = benchmark_windows(benchmark, size)
    rows = _hits(documents, ["doc_id"], windows, lengths, slice_rows)
    rows = rows.withColumn("set_key", F.when(F.size("sets") > 0, F.sha2(F.array_join(F.array_sort(F.transform("sets", F.hex)), ""), 256)))
    hit = rows.where("set_key is not null")
    sets = hit.groupBy("set_key").agg(F.min("sets").alias("sets"))
    lists = (sets.select("set_key", F.explode("sets").alias("items_key")).join(items, "items_key")
             .groupBy("set_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    lists = written(lists.select("set_key", F.size("items").cast("long").alias("n_items"),
                                 F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "item-lists")
    nothing = rows.where("set_key is null").select("*", F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"))
    out = hit.join(counted_broadcast(lists, 1 << 18), "set_key").select(nothing.columns).union(nothing)
    out = out.select("doc_id", F.col("n").cast("long").alias("n_words"), _covered("hits").alias("n_hit"), "n_items", "items_sha256",
                     (F.col("n_items") > 0).alias("contaminated"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")


def _hit_texts(documents: DataFrame, benchmark: DataFrame, size: int, slice_rows: int) -> DataFrame:
    """text_key and hits of every distinct text that holds a window of ``benchmark``, stored."""
    windows, _, lengths = benchmark_windows(benchmark, size)
    return written(_hits(documents, [], windows, lengths, slice_rows).where("size(hits) > 0").select(
        F.col("text_key").alias("_hit_key"), F.col("hits").alias("_hit_spans")), "hit-texts")


def _key() -> Column:
    return F.unhex(F.sha2("text", 256))


def remove_documents(documents: DataFrame, benchmark: DataFrame, size: int = SIZE, slice_rows: int = SLICE) -> DataFrame:
    """``documents`` without those that hold a window of ``benchmark``; all columns stay, a null text stays."""
    hit = _hit_texts(documents, benchmark, size, slice_rows).select("_hit_key")
    return documents.join(counted_broadcast(hit, SLICE), _key() == F.col("_hit_key"), "left_anti")


def remove_spans(documents: DataFrame, benchmark: DataFrame, size: int = SIZE, slice_rows: int = SLICE) -> DataFrame:
    """``documents`` with the words of all windows of ``benchmark`` cut out of the texts, each with what follows up to the next word."""
    hit = _hit_texts(documents, benchmark, size, slice_rows)
    joined = documents.join(hit, _key() == F.col("_hit_key"), "left")
    gone = F.flatten(F.transform("_hit_spans", lambda h: F.sequence(h["p"], h["p"] + h["length"] - 1)))
    words, gaps = F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.split("text", WORD, -1)
    joined = joined.withColumn("_words", F.when(F.col("_hit_key").isNotNull(), words)).withColumn(
        "_gaps", F.when(F.col("_hit_key").isNotNull(), gaps))
    kept = F.array_except(F.sequence(F.lit(1), F.size("_words")), gone)
    text = F.concat(F.get("_gaps", F.lit(0)), F.array_join(
        F.transform(kept, lambda i: F.concat(F.get("_words", i - 1), F.get("_gaps", i))), ""))
    cut = F.when(F.col("_hit_key").isNotNull(), text).otherwise(F.col("text"))
    return joined.select(*[cut.alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns])
