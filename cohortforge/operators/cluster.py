"""Density clustering: DBSCAN on distinct vectors with multiplicities, without a graph of all pairs within eps.

Vectors lie in the cells of the neighbour search and are replicated to every cell whose box lies within eps, so each cell (cut
into units of bounded size) sees all pairs of its own vectors. A unit sends out one row per vector, never one per pair: partial
densities, then links of its core vectors to the smallest one of their group inside the unit (breadth-first search), then the
smallest adjacent cluster of its border vectors. Core vectors have at least `min_samples` rows within eps (itself included);
clusters are the connected components of core vectors (star contraction of the units' links until nothing changes, so a chain
of any length is one cluster); border vectors join the smallest-labelled adjacent cluster; labels are the smallest row id of
the cluster's core rows; noise, and rows with a null feature, are -1.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import connected_components
from .neighbors import DEFAULT_BLOCK, radius_visits, units, within_radius

#: Cells of the distance table that one step of a unit holds.
TILE = 1 << 20


def _near(v: np.ndarray, h: np.ndarray, eps: float) -> np.ndarray:
    """Boolean table: visitor i lies within eps of home vector j; distances are computed in tiles."""
    near = np.empty((len(v), len(h)), dtype=bool)
    step = max(1, TILE // max(1, h.size))
    for s in range(0, len(v), step):
        near[s:s + step] = ((v[s:s + step, None, :] - h[None, :, :]) ** 2).sum(axis=2) <= within_radius(eps)
    return near


def local_links(near: np.ndarray, visitor: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its group) for the groups of ids that `near` connects; each row and column is looked at once."""
    open_v, open_h = np.ones(len(visitor), dtype=bool), np.ones(len(home), dtype=bool)
    ids, reps = [], []
    for start in range(len(home)):
        if not open_h[start]:
            continue
        open_h[start] = False
        group, front = [home[start:start + 1]], np.array([start])
        while len(front):
            new_v = np.flatnonzero(open_v & near[:, front].any(axis=1))
            open_v[new_v] = False
            front = np.flatnonzero(open_h & near[new_v].any(axis=0))
            open_h[front] = False
            group += [visitor[new_v], home[front]]
        members = np.unique(np.concatenate(group))
        ids.append(members[1:])
        reps.append(np.full(len(members) - 1, members[0]))
    return (np.concatenate(ids), np.concatenate(reps)) if ids else (np.empty(0, dtype=np.int64),) * 2


def dbscan(df: DataFrame, feats: Sequence[str], id_col: str, eps: float, min_samples: int, block_rows: int = DEFAULT_BLOCK) -> DataFrame:
    feats = list(feats)
    x = df.select(id_col, *[F.col(f).cast("double").alias(f) for f in feats])
    vectors = cut_lineage(x.dropna(subset=feats).groupBy(*feats).agg(
        F.min(F.col(id_col).cast("bigint")).alias("_pid"), F.count("*").alias("_pmult")))  # vector id = smallest row id
    placed, visits = radius_visits(vectors, feats, eps, block_rows)

    def by_unit(visitors: DataFrame, homes: DataFrame, unit: Callable[[np.ndarray, pd.DataFrame, pd.DataFrame], pd.DataFrame],
                schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]

        def run(v: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
            if v.empty or h.empty:
                return pd.DataFrame({c: [] for c in names})
            return unit(_near(v[feats].to_numpy(), h[feats].to_numpy(), eps), v, h)

        vs, hs = units(visitors, homes, feats, block_rows)
        key = ["_cell", "_pc", "_qc"]
        return vs.groupBy(*key).cogroup(hs.groupBy(*key)).applyInPandas(run, schema)

    def density(near, v, h):
        return pd.DataFrame({"_pid": v["_pid"], "_n": near @ h["_pmult"].to_numpy()})

    def links(near, v, h):
        a, b = local_links(near, v["_pid"].to_numpy(), h["_pid"].to_numpy())
        return pd.DataFrame({"a": a, "b": b})

    def smallest(near, v, h):
        least = np.where(near, h["_lab"].to_numpy()[None, :], np.iinfo(np.int64).max).min(axis=1)
        found = near.any(axis=1)
        return pd.DataFrame({"_pid": v["_pid"].to_numpy()[found], "_lab": least[found]})

    dense = by_unit(visits, placed, density, "_pid bigint, _n bigint").groupBy("_pid").agg(F.sum("_n").alias("_n"))
    core = cut_lineage(dense.where(F.col("_n") >= min_samples).select("_pid"))
    homes = placed.join(core, "_pid", "left_semi")
    merged = connected_components(by_unit(visits.join(core, "_pid", "left_semi"), homes, links, "a bigint, b bigint").distinct())
    labels = cut_lineage(core.join(merged.select(F.col("node").alias("_pid"), "component"), "_pid", "left")
                         .select("_pid", F.coalesce("component", "_pid").alias("_lab")))
    # border vectors: not core, with a core vector within eps
    border = by_unit(visits.join(core, "_pid", "left_anti"), placed.join(labels, "_pid"), smallest,
                     "_pid bigint, _lab bigint").groupBy("_pid").agg(F.min("_lab").alias("_lab"))
    of_vector = vectors.join(labels.unionByName(border), "_pid").select(*feats, "_lab")
    return x.join(of_vector, feats, "left").select(id_col, F.coalesce(F.col("_lab"), F.lit(-1)).cast("bigint").alias("CLUSTER"))
