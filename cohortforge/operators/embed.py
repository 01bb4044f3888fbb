"""Embedding-similarity labelling: a vector per label, either the mean of the label's rows or learned by softmax regression, and
the top-k labels of every row by inner product.

Label vectors are a table (label, vector). Scoring takes it in blocks of at most BLOCK_VALUES numbers: each block is one pass
over the rows in Arrow batches that keeps k candidates a row, and passes merge by rank, so any number of labels works. A null
vector, or one with a null entry, gets no label.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .rowindex import k_smallest_per_group, with_row_index

#: Numbers of the label vectors that one scoring pass holds (and that learning may hold), 8 bytes each.
BLOCK_VALUES = 1 << 21


def _complete(df: DataFrame, vec: str) -> DataFrame:
    return df.where(F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull()))


def label_centroids(df: DataFrame, vec: str, label: str) -> DataFrame:
    """(label, vector): mean vector of each label."""
    entries = df.where(F.col(label).isNotNull()).select(label, F.posexplode(vec).alias("_pos", "_v"))
    c = entries.groupBy(label, "_pos").agg(F.avg(F.col("_v").cast("double")).alias("_c"))
    per = c.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("_pos", "_c"))).alias("_cs"))
    return per.select(F.col(label).alias("label"), F.transform("_cs", lambda s: s["_c"]).alias("vector"))


def learned_label_vectors(df: DataFrame, vec: str, label: str, rounds: int = 30, rate: float = 1.0, decay: float = 1e-3) -> DataFrame:
    """(label, vector): weights of a softmax regression of the label on the vector, by full-batch gradient descent from zero.

    A round is one pass: each batch gives a gradient row per label, added up by label and entry; the weights (labels x
    entries, at most BLOCK_VALUES, checked from counts before anything is read) are on the driver. Rows without a label or with
    an incomplete vector are left out.
    """
    rows = cut_lineage(_complete(df, vec).where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(vec).alias("vector")))
    n, n_labels, dims = rows.agg(F.count("*"), F.count_distinct("label"), F.max(F.size("vector"))).first()
    if not n:
        return rows.select("label", F.col("vector").cast("array<double>").alias("vector"))
    if n_labels * dims > BLOCK_VALUES:
        raise ValueError(f"{n_labels} labels of {dims} entries are more than learning holds ({BLOCK_VALUES}); use label_centroids")
    labels = [r[0] for r in rows.select("label").distinct().orderBy("label").collect()]
    number = {x: i for i, x in enumerate(labels)}
    w = np.zeros((n_labels, dims))

    def gradients(weights: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(weights)
            for b in batches:
                x = np.stack(b["vector"].to_numpy()).astype(np.float64)
                z = x @ weights.T
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(x)), b["label"].map(number).to_numpy()] -= 1
                total += p.T @ x
            yield pd.DataFrame({"i": np.arange(len(total)), "g": list(total)})
        return run

    for _ in range(rounds):
        parts = rows.mapInPandas(gradients(w), "i int, g array<double>").select("i", F.posexplode("g").alias("d", "x"))
        g = np.zeros_like(w)
        for r in parts.groupBy("i", "d").agg(F.sum("x").alias("x")).toPandas().itertuples(index=False):
            g[r.i, r.d] = r.x
        w = w - rate * (g / n + decay * w)
    fitted = [(x, [float(v) for v in w[i]]) for i, x in enumerate(labels)]
    return df.sparkSession.createDataFrame(fitted, f"label {rows.schema['label'].dataType.simpleString()}, vector array<double>")


def _best(df: DataFrame, id_col: str, vec: str, labels: Sequence[object], matrix: np.ndarray, k: int, label_type: str) -> DataFrame:
    """The k best labels of one block for every row: (_row, id, neg, label); labels are in ascending order."""
    names = pd.Series(list(labels))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, (1 << 22) // len(matrix))
        for b in batches:
            for s in range(0, len(b), step):
                part = b.iloc[s:s + step]
                neg = -(np.stack(part["vector"].to_numpy()).astype(np.float64) @ matrix.T)
                kk = min(k, neg.shape[1])
                limit = np.partition(neg, kk - 1, axis=1)[:, kk - 1]
                r, c = np.nonzero(neg <= limit[:, None])
                order = np.lexsort((c, neg[r, c], r))
                r, c = r[order], c[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r, side="left") < kk
                r, c = r[keep], c[keep]
                yield pd.DataFrame({"_row": part["_row"].to_numpy()[r], "_id": part["_id"].to_numpy()[r], "_neg": neg[r, c],
                                    "_label": names.iloc[c].to_numpy()})

    id_type = df.schema[id_col].dataType.simpleString()
    rows = _complete(df, vec).select("_row", F.col(id_col).alias("_id"), F.col(vec).alias("vector"))
    return rows.mapInPandas(run, f"_row bigint, _id {id_type}, _neg double, _label {label_type}")


def top_k_long(df: DataFrame, id_col: str, vec: str, vectors: DataFrame, k: int = 3, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(id, RANK, LABEL): the k labels with the largest inner products, ties to the smaller label."""
    stored = cut_lineage(vectors.select("label", "vector"))
    n, dims = stored.agg(F.count("*"), F.max(F.size("vector"))).first()
    label_type = stored.schema["label"].dataType.simpleString()
    if not n:
        return df.limit(0).select(id_col, F.lit(0).alias("RANK"), F.lit(None).cast(label_type).alias("LABEL"))
    per_block = max(1, block_values // dims)
    rows = cut_lineage(df.select(id_col, vec).withColumn("_row", F.monotonically_increasing_id()))
    numbered = stored.withColumn("_block", F.lit(0)) if n <= per_block else cut_lineage(
        with_row_index(stored, "label").withColumn("_block", F.floor(F.col("_idx") / per_block)))
    passes = []
    for b in range(-(-n // per_block)):  # one pass over the rows per block of the label vectors
        block = numbered.where(F.col("_block") == b).orderBy("label").select("label", "vector").collect()
        passes.append(_best(rows, id_col, vec, [r["label"] for r in block], np.array([r["vector"] for r in block]), k, label_type))
    found = reduce(DataFrame.unionByName, passes)
    ranked = k_smallest_per_group(found, ["_row"], ["_neg", "_label"], k, "_row", salts=1, out="RANK")
    return ranked.select(F.col("_id").alias(id_col), F.col("RANK").cast("int").alias("RANK"), F.col("_label").alias("LABEL"))


def score_top_k(df: DataFrame, id_col: str, vec: str, vectors: DataFrame, k: int = 3) -> DataFrame:
    """(id, TOP1, TOP3): the best label and the k best as text, one row per id; ids name rows."""
    best = F.transform(F.sort_array(F.collect_list(F.struct("RANK", "LABEL"))), lambda s: s["LABEL"])
    per = top_k_long(df, id_col, vec, vectors, k).groupBy(id_col).agg(best.alias("_l"))
    return per.select(id_col, F.col("_l")[0].alias("TOP1"), F.array_join(F.transform("_l", lambda x: x.cast("string")), "|").alias("TOP3"))
