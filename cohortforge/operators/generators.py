"""Synthetic generators: IPF raking, Monte-Carlo draws, conditional and
autoregressive categorical samplers, label assignment.

Sampling is always "join the row to its context's distribution, then an inverse-CDF draw with a
portable uniform": contexts are equi-join keys, distributions are (sorted categories, integer
cumulative weights) arrays per context, and rows without a context fall back to a global
distribution through a binned equi-join lookup. No per-row driver loop, no range join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import inverse_cdf, uniform, uniform_int
from ..session import bounded_broadcast, cut_lineage
from .joins import draw_from_counts

# ------------------------------------------------------------------------------------------------
# IPF
# ------------------------------------------------------------------------------------------------


#: Cells that raking holds as arrays on the driver; more are raked by distributed passes.
HELD_CELLS = 1 << 20


def cells(df: DataFrame, features: Sequence[str], count: str = "N") -> DataFrame:
    """Collapse rows to distinct feature combinations with their row counts (weights are per cell)."""
    return df.groupBy(*features).agg(F.count("*").alias(count))


def ipf_fit(cell_df: DataFrame, features: Sequence[str], targets: DataFrame, count: str = "N",
            max_iter: int = 100, tol: float = 1e-5, held: int | None = None) -> tuple[DataFrame, int, bool]:
    """Raking on a cell table: per iteration and feature f, w *= target[f=c] / sum(count*w over f=c).

    A cell's weight is the product of one factor per feature, so only the factor tables (one row per category) change:
    a half-step joins the stored cells with the factors, sums by f and scales f's factors, which are stored; the plan has
    the same size at every step and no task gathers the cells of a category. `targets` is long: (FEATURE, CATEGORY
    string, TARGET double); a category without a target gets a null weight, one whose cells sum to zero a null factor.
    Up to HELD_CELLS cells (counted first; their number is bounded by the categories, not by the rows) are coded as arrays once and raked as
    bincounts, without a job per half-step; beyond that every half-step is a distributed pass. Stops when all |w - w_old| <= tol + tol*|w_old| (numpy allclose) or after max_iter. Returns (cells with W,
    iterations run, converged).
    """
    features = list(features)
    keys = [f"_k{i}" for i in range(len(features))]
    held = HELD_CELLS if held is None else held
    cells_ = cut_lineage(cell_df.select("*", *[F.col(f).cast("string").alias(k) for f, k in zip(features, keys)]))
    goal = {f: targets.where(F.col("FEATURE") == f).select(F.col("CATEGORY").alias("_c"), F.col("TARGET").alias("_t"))
            for f in features}
    factor = [cut_lineage(cells_.select(k).distinct().withColumn("_f", F.lit(1.0))) for k in keys]

    def weighted(tables, name):
        out, parts = cells_, []
        for i, (k, t) in enumerate(zip(keys, tables)):
            out = out.join(bounded_broadcast(t.select(F.col(k).alias(f"_j{i}"), F.col("_f").alias(f"_f{i}"))),
                           F.col(k).eqNullSafe(F.col(f"_j{i}")), "left").drop(f"_j{i}")
            parts.append(F.col(f"_f{i}"))
        product = parts[0]
        for p in parts[1:]:
            product = product * p
        return out.withColumn(name, product).drop(*[f"_f{i}" for i in range(len(keys))])

    it, converged = 0, False
    if cells_.count() <= held:
        rows = [r[:] for r in cells_.select(*keys, count).collect()]
        tables, it, converged = _rake(rows, [{r._c: r._t for r in goal[f].collect()} for f in features], max_iter, tol)
        spark = cells_.sparkSession
        factor = [spark.createDataFrame(list(t.items()), f"{k} string, _f double") for k, t in zip(keys, tables)]
        return weighted(factor, "W").drop(*keys), it, converged
    while it < max_iter and not converged:
        it += 1
        old = list(factor)
        for i, (f, k) in enumerate(zip(features, keys)):
            now = weighted(factor, "W").groupBy(k).agg(F.sum(F.col(count) * F.col("W")).alias("_s"))
            now = now.join(bounded_broadcast(goal[f]), F.col(k) == F.col("_c"), "left")
            scale = now.select(F.col(k).alias("_j"), F.try_divide(F.col("_t"), F.col("_s")).alias("_x"))
            factor[i] = cut_lineage(factor[i].join(bounded_broadcast(scale), F.col(k).eqNullSafe(F.col("_j")), "left")
                                    .select(k, (F.col("_f") * F.col("_x")).alias("_f")))
        both = weighted(factor, "W").select(*keys, "W")
        both = both.join(weighted(old, "_W0").select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], "_W0"),
                         [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate(keys)])
        near = F.abs(F.col("W") - F.col("_W0")) <= F.lit(tol) + F.lit(tol) * F.abs(F.col("_W0"))
        moved = both.where(~F.coalesce(near, F.col("W").isNull() & F.col("_W0").isNull()))
        converged = moved.isEmpty()
    return weighted(factor, "W").drop(*keys), it, converged


def _coded(values: list) -> tuple[list, np.ndarray]:
    """The distinct values (a null is one) and each value's place among them."""
    place: dict = {}
    codes = np.array([place.setdefault(v, len(place)) for v in values], np.int64)
    return list(place), codes


def _rake(rows: list, targets: list[dict], max_iter: int, tol: float) -> tuple[list[dict], int, bool]:
    """ipf_fit's rule on cells (categories..., count) held as arrays; a nan stands for a null. Returns a factor per category and feature."""
    rows = sorted(rows, key=lambda r: [(v is not None, v or "") for v in r[:-1]])  # sums in one order, however the cells arrive
    n = np.array([r[-1] for r in rows], float)
    coded = [_coded([r[i] for r in rows]) for i in range(len(targets))]
    goal = [np.array([np.nan if v is None or t.get(v) is None else t[v] for v in values], float) for (values, _), t in zip(coded, targets)]
    factor = [np.ones(len(values)) for values, _ in coded]

    def weights() -> np.ndarray:
        out = factor[0][coded[0][1]]
        for f, (_, at) in zip(factor[1:], coded[1:]):
            out = out * f[at]
        return out

    it, converged, now = 0, False, weights()
    while it < max_iter and not converged:
        it, old = it + 1, now
        for i, (values, at) in enumerate(coded):
            part = n * weights()
            known = ~np.isnan(part)
            total = np.bincount(at[known], part[known], len(values)).astype(float)
            total[(np.bincount(at[known], minlength=len(values)) == 0) | (total == 0)] = np.nan
            factor[i] = factor[i] * (goal[i] / total)
        now = weights()
        with np.errstate(invalid="ignore"):
            near = np.abs(now - old) <= tol + tol * np.abs(old)
        converged = bool((near | (np.isnan(now) & np.isnan(old))).all())
    return [{v: None if np.isnan(x) else float(x) for v, x in zip(values, f)} for (values, _), f in zip(coded, factor)], it, converged


def marginal_targets(df: DataFrame, features: Sequence[str], scale: float = 1.0) -> DataFrame:
    """Long (FEATURE, CATEGORY, TARGET) counts of each feature in df, times `scale`."""
    parts = None
    for f in features:
        p = (df.where(F.col(f).isNotNull()).groupBy(F.col(f).cast("string").alias("CATEGORY"))
             .agg((F.count("*") * F.lit(scale)).alias("TARGET")).withColumn("FEATURE", F.lit(f)))
        parts = p if parts is None else parts.unionByName(p)
    return parts.select("FEATURE", "CATEGORY", "TARGET")


def ipf_seed(cell_df: DataFrame, key_cols: Sequence[str], targets: DataFrame, tag: str = "seed") -> DataFrame:
    """Random integer seed in [floor(0.5*avg), floor(1.5*avg)) for every cell of the two features' grid, observed or not; avg is the
    mean over all categories' targets of both features."""
    from .aggregates import crosstab_long
    avg = targets.agg(F.avg("TARGET")).first()[0] or 0.0
    lo, hi = int(0.5 * avg), max(int(1.5 * avg), int(0.5 * avg) + 1)
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])
    grid = crosstab_long(cell_df, *key_cols).select(*key_cols)
    return grid.withColumn("SEED", F.floor(F.lit(lo) + uniform(tag, key) * F.lit(hi - lo)).cast("bigint"))


def ipf_matrix(seed: DataFrame, row: str, col: str, targets: DataFrame, value: str = "SEED", max_iter: int = 1000,
               tol: float = 1e-6, held: int | None = None) -> tuple[DataFrame, int, bool]:
    """Fit the seed matrix to its row and column targets: rows, then columns, until the Frobenius norm of the change is below tol.
    The matrix has one row per pair of categories; up to HELD_CELLS of them (counted first) are fitted as arrays, beyond that each half-step
    is a grouped sum joined back and the result is stored. A null category has no row in the result."""
    m = cut_lineage(seed.select(row, col, F.col(value).cast("double").alias("W")))
    it, converged = 0, False
    if m.count() <= (HELD_CELLS if held is None else held):
        pairs = m.where(F.col(row).isNotNull() & F.col(col).isNotNull())
        cells_ = [r[:] for r in pairs.select(F.col(row).cast("string"), F.col(col).cast("string"), "W").collect()]
        goal = [{r.CATEGORY: r.TARGET for r in targets.where(F.col("FEATURE") == f).collect()} for f in (row, col)]
        tables, it, converged = _fit_matrix(cells_, goal, max_iter, tol)
        out = pairs
        for i, (f, t) in enumerate(zip((row, col), tables)):
            side = m.sparkSession.createDataFrame(list(t.items()), f"_g{i} string, _x{i} double")
            out = out.join(bounded_broadcast(side), F.col(f).cast("string") == F.col(f"_g{i}"))
        return out.select(row, col, (F.col("W") * F.col("_x0") * F.col("_x1")).alias("W")), it, converged
    while it < max_iter and not converged:
        it += 1
        new = m.withColumn("_W0", F.col("W"))
        for f in (row, col):
            goal = targets.where(F.col("FEATURE") == f).select(F.col("CATEGORY").alias("_c"), F.col("TARGET").alias("_t"))
            s = new.groupBy(F.col(f).alias("_g")).agg(F.sum("W").alias("_s"))
            s = s.join(bounded_broadcast(goal), F.col("_g").cast("string") == F.col("_c"), "left")
            s = s.select("_g", F.coalesce(F.try_divide("_t", "_s"), F.lit(0.0)).alias("_x"))
            new = cut_lineage(new.join(bounded_broadcast(s), F.col(f) == F.col("_g")).withColumn("W", F.col("W") * F.col("_x"))
                              .drop("_g", "_x"))
        change = new.agg(F.sqrt(F.sum((F.col("W") - F.col("_W0")) ** 2))).first()[0]
        converged = change is None or change < tol
        m = new.drop("_W0")
    return m, it, converged


def _fit_matrix(cells_: list, targets: list[dict], max_iter: int, tol: float) -> tuple[list[dict], int, bool]:
    """ipf_matrix's rule on (row, column, seed) held as arrays: a factor per row category and column category."""
    cells_ = sorted(cells_)
    start = np.array([np.nan if c[2] is None else c[2] for c in cells_], float)
    coded = [_coded([c[i] for c in cells_]) for i in (0, 1)]
    goal = [np.array([t.get(v) or 0.0 for v in values], float) for (values, _), t in zip(coded, targets)]
    factor = [np.ones(len(values)) for values, _ in coded]
    it, converged, now = 0, False, start
    while it < max_iter and not converged:
        it, old = it + 1, now
        for i, (values, at) in enumerate(coded):
            total = np.bincount(at, np.nan_to_num(now), len(values)).astype(float)
            scale = np.divide(goal[i], total, out=np.zeros(len(values)), where=total != 0)
            factor[i], now = factor[i] * scale, now * scale[at]
        change = float(np.sqrt(np.nansum((now - old) ** 2)))
        converged = not len(cells_) or change < tol
    return [dict(zip(values, f.tolist())) for (values, _), f in zip(coded, factor)], it, converged


def weight_units(w: F.Column, scale: float = 1e6) -> F.Column:
    """Integer weight units (so running sums are exact and draws reproducible across engines)."""
    return F.round(w * F.lit(scale)).cast("bigint")


def ipf_population(rows: DataFrame, weighted_cells: DataFrame, features: Sequence[str], n: int | None = None,
                   id_col: str = "RECORD_ID", drop: Sequence[str] = ()) -> DataFrame:
    """IPF weights joined back to rows, then a weighted draw with replacement of min(n, len) rows."""
    from .sampling import sample_weighted_replace
    wc = weighted_cells.select(*features, weight_units(F.col("W")).alias("_wu"))
    r = rows.join(wc, list(features), "left")
    out = sample_weighted_replace(r, "_wu", n, id_col=id_col).drop("_wu")
    return out.drop(*[c for c in drop if c in out.columns])


# ------------------------------------------------------------------------------------------------
# Categorical draws
# ------------------------------------------------------------------------------------------------


def weighted_distribution(counts: DataFrame, keys: Sequence[str], label: str, weight: str) -> DataFrame:
    """Per context: categories sorted ascending and cumulative integer weights, as arrays.
    The window is over the (context x category) count table; arrays hold one entry per category."""
    keys = list(keys)
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(label) \
        .rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumn("_c", F.sum(weight).over(w))
    g = c.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(label), F.col("_c")))).alias("_d"))
    return g.select(*keys, F.transform("_d", lambda s: s[label]).alias("_cats"), F.transform("_d", lambda s: s["_c"]).alias("_cum"))


def contextual_draw(rows: DataFrame, train: DataFrame, keys: Sequence[str], label: str, out: str, tag: str,
                    id_col: str, alpha: int = 0, global_fallback: bool = True, row_keys: Sequence[str] | None = None) -> DataFrame:
    """Draw `out` for each row from the training distribution of `label` in the row's context
    (`row_keys` of the row matched to `keys` of train). Weights are count + alpha over categories
    observed in that context. Unseen contexts use the global distribution (same smoothing)."""
    keys = list(keys)
    row_keys = list(row_keys or keys)
    t = train.where(F.col(label).isNotNull())
    if not keys:
        gcounts = t.groupBy(label).agg((F.count("*") + F.lit(alpha)).alias("n"))
        return draw_from_counts(rows, gcounts, label, uniform(tag, id_col), out)
    counts = t.groupBy(*keys, label).agg((F.count("*") + F.lit(alpha)).alias("_wt"))
    dist = weighted_distribution(counts, keys, label, "_wt")
    dist = dist.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_cats", "_cum")
    cond = [F.col(rk) == F.col(f"_k{i}") for i, rk in enumerate(row_keys)]
    j = rows.join(bounded_broadcast(dist), cond, "left")
    j = j.withColumn("_local", inverse_cdf(F.col("_cats"), F.col("_cum"), uniform(tag, id_col)))
    j = j.drop("_cats", "_cum", *[f"_k{i}" for i in range(len(keys))])
    if not global_fallback:
        return j.withColumnRenamed("_local", out)
    gcounts = t.groupBy(label).agg((F.count("*") + F.lit(alpha)).alias("n"))
    j = draw_from_counts(j, gcounts, label, uniform(tag, id_col), "_global")
    return j.withColumn(out, F.coalesce(F.col("_local"), F.col("_global"))).drop("_local", "_global")


def conditional_independent(train: DataFrame, requests: DataFrame, output: str, features: Sequence[str],
                            id_col: str = "RECORD_ID", tag: str = "cond") -> DataFrame:
    """P(feature | output) per feature independently (raw frequencies), global fallback when the
    output value was not seen; one generated row per request row."""
    out = requests.select(id_col, output)
    for f in features:
        out = contextual_draw(out, train, [output], f, f, f"{tag}_{f}", id_col, alpha=0)
    return out


def autoregressive_fit(train: DataFrame, output: str, features: Sequence[str], alpha: int = 1,
                       max_parents: int | None = None) -> DataFrame:
    """Long table of smoothed conditionals: OUTPUT, FEATURE, CONTEXT ('|'-joined parent values),
    CATEGORY, P = (c + alpha) / (n + alpha*K) over categories observed in the context."""
    parts = None
    for i, f in enumerate(features):
        parents = list(features[:i])
        if max_parents is not None:
            parents = parents[-max_parents:] if max_parents > 0 else []
        ctx = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parents]) if parents else F.lit("")
        c = (train.where(F.col(output).isNotNull() & F.col(f).isNotNull())
             .groupBy(F.col(output).alias("OUTPUT"), ctx.alias("CONTEXT"), F.col(f).cast("string").alias("CATEGORY"))
             .agg(F.count("*").alias("_c")))
        w = Window.partitionBy("OUTPUT", "CONTEXT")
        p = (F.col("_c") + alpha) / (F.sum("_c").over(w) + F.lit(alpha) * F.count("*").over(w))
        part = c.select("OUTPUT", F.lit(f).alias("FEATURE"), "CONTEXT", "CATEGORY", p.alias("P"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def autoregressive_generate(train: DataFrame, requests: DataFrame, output: str, features: Sequence[str],
                            id_col: str = "RECORD_ID", alpha: int = 1, max_parents: int | None = None,
                            tag: str = "ar", checkpoint_every: int = 3) -> DataFrame:
    """Sequential sampling: feature i is drawn from P(f_i | output, generated parents) with Laplace
    smoothing; unseen contexts fall back to the global smoothed distribution of f_i. One equi join
    per feature; lineage is cut every few features."""
    out = requests.select(id_col, output)
    for i, f in enumerate(features):
        parents = list(features[:i])
        if max_parents is not None:
            parents = parents[-max_parents:] if max_parents > 0 else []
        out = contextual_draw(out, train, [output, *parents], f, f, f"{tag}_{f}", id_col, alpha=alpha)
        if checkpoint_every and (i + 1) % checkpoint_every == 0 and i + 1 < len(features):
            out = cut_lineage(out)
    return out


def subset_entropies(train: DataFrame, features: Sequence[str], size: int) -> tuple[dict, int]:
    """Entropy (nats) and number of states of every set of up to `size` features, from one table of counts, and the number of
    rows. Rows with a null feature are left out. Rows collapse to distinct combinations before they are listed under each
    set; the driver reads one row per set."""
    feats = sorted(features)
    cells = cut_lineage(train.dropna(subset=feats).groupBy(*feats).agg(F.count("*").alias("_n")))
    n = int(cells.agg(F.sum("_n")).first()[0] or 0)
    sets = [s for k in range(1, min(size, len(feats)) + 1) for s in combinations(feats, k)]
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.to_json(F.array(*[F.col(f).cast("string") for f in s])).alias("v"))
                                 for i, s in enumerate(sets)]))
    counts = cells.select("_n", listed.alias("_s")).groupBy("_s.i", "_s.v").agg(F.sum("_n").alias("_n"))
    share = F.col("_n") / F.lit(float(n or 1))
    rows = counts.groupBy("i").agg(F.sum(-share * F.log(share)).alias("h"), F.count("*").alias("states")).collect()
    return {frozenset(sets[r["i"]]): (r["h"], r["states"]) for r in rows}, n


def network_structure(train: DataFrame, features: Sequence[str], max_parents: int = 2) -> list[tuple[str, tuple[str, ...]]]:
    """A Bayesian network, grown greedily: [(feature, parents)], parents first.

    The first feature has the largest total information with the others; then the (feature, parent set) with the best score
    among all sets of up to `max_parents` placed features follows: n x information of feature and parents, less
    ln(n) / 2 per free parameter (BIC), so that a parent must be worth its table. Ties: fewer parents, then by name.
    """
    feats = sorted(features)
    of, n = subset_entropies(train, feats, max_parents + 1)
    if not n:
        return [(f, ()) for f in feats]

    def score(f: str, parents: tuple[str, ...]) -> float:
        if not parents:
            return 0.0
        (hf, kf), (hp, kp), (hj, _) = of[frozenset([f])], of[frozenset(parents)], of[frozenset([f, *parents])]
        return round(n * (hf + hp - hj) - np.log(n) / 2 * (kf - 1) * (kp - 1), 6)

    shared = {f: sum(of[frozenset([f])][0] + of[frozenset([g])][0] - of[frozenset([f, g])][0] for g in feats if g != f) for f in feats}
    order = [(min(feats, key=lambda f: (-round(shared[f], 9), f)), ())]
    while len(order) < len(feats):
        placed = sorted(f for f, _ in order)
        choices = [(f, p) for f in feats if f not in placed for k in range(min(max_parents, len(placed)) + 1)
                   for p in combinations(placed, k)]
        order.append(min(choices, key=lambda c: (-score(*c), len(c[1]), c)))
    return order


def tabular_synth_fit(train: DataFrame, features: Sequence[str], max_parents: int = 2):
    """Re-aim of the neural table generators: a Bayesian network of discrete columns; the fitted
    state is the network (tiny) plus the training frame used for smoothed conditionals."""
    return {"order": network_structure(train, features, max_parents), "train": train}


def tabular_synth_sample(model, n: int, spark, tag: str = "tsyn", alpha: int = 1) -> DataFrame:
    """n rows: each feature from P(feature | parents), smoothed over the categories seen with them; parent values that never
    occur together give way to the marginal."""
    rows = spark.range(n).withColumnRenamed("id", "ROW_ID")
    for feat, parents in model["order"]:
        rows = contextual_draw(rows, model["train"], parents, feat, feat, f"{tag}_{feat}", "ROW_ID", alpha=alpha)
    return rows


def age_from_group(group_col: str, id_col, tag: str = "age") -> F.Column:
    """'18-64' -> U[18,64]; '0-17' -> U[0,17]; otherwise U[65,99] (integers)."""
    u = uniform(tag, id_col)
    g = F.col(group_col)
    return (F.when(g == "18-64", uniform_int(u, 18, 64)).when(g == "0-17", uniform_int(u, 0, 17))
            .otherwise(uniform_int(u, 65, 99)))


def label_by_group_pool(df: DataFrame, lists: DataFrame, group: str, sample_col: str = "SAMPLE", out: str = "LABEL",
                        id_col: str = "RECORD_ID", tag: str = "gpool", sep: str = "|") -> DataFrame:
    """Random choice from the group's short list ('|'-joined), else 'UNKNOWN'."""
    j = df.join(bounded_broadcast(lists.select(group, sample_col)), group, "left")
    arr = F.split(F.col(sample_col), "\\|")
    pick = F.element_at(arr, (F.floor(uniform(tag, id_col) * F.size(arr)) + 1).cast("int"))
    return j.withColumn(out, F.coalesce(F.when(F.col(sample_col).isNotNull(), pick), F.lit("UNKNOWN"))).drop(sample_col)


def label_by_probability(pred: DataFrame, prob_col: str, labels: Sequence, out: str, id_col: str, tag: str = "lbp") -> DataFrame:
    """Draw a label from a per-row class-probability array: the running sums (one pass), then an inverse-CDF draw."""
    cum = F.aggregate(F.col(prob_col), F.array().cast("array<double>"),
                      lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x)))
    p = pred.withColumn("_cum", cum)
    u = uniform(tag, id_col) * F.element_at("_cum", -1)
    idx = F.size(F.filter("_cum", lambda c: c <= u)) + 1
    lab = F.element_at(F.array(*[F.lit(x) for x in labels]), F.least(idx, F.size("_cum")).cast("int"))
    return p.withColumn(out, lab).drop("_cum")
