"""Divergence and association statistics as aggregations over count tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from ..functions.divergence import kl_term, r6
from ..session import bounded_broadcast, cut_lineage


def shares(df: DataFrame, col: str, name: str) -> DataFrame:
    c = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n"))
    return c.select(F.col(col).cast("string").alias("CATEGORY"), (F.col("_n") / F.sum("_n").over(Window.partitionBy())).alias(name))


def target_vs_observed(target: DataFrame, observed: DataFrame, col: str) -> DataFrame:
    """Normalized target and observed shares side by side over the union of categories."""
    j = shares(target, col, "TARGET").join(shares(observed, col, "OBSERVED"), "CATEGORY", "full")
    return j.na.fill(0.0, subset=["TARGET", "OBSERVED"])


def kl_divergence(target: DataFrame, observed: DataFrame, col: str) -> DataFrame:
    """KL(target || observed) = sum p ln(p/q) over categories (inf if q = 0 < p), one row."""
    t = target_vs_observed(target, observed, col)
    return t.agg(F.sum(kl_term(F.col("TARGET"), F.col("OBSERVED"))).alias("KL"))


def chi_square_gof(expected_from: DataFrame, observed: DataFrame, col: str) -> DataFrame:
    """Goodness of fit of observed counts against expected counts = reference shares x observed total.
    A category that only the observed side has makes the statistic infinite. One row (STATISTIC, DOF)."""
    obs = observed.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("O"))
    ref = shares(expected_from, col, "P").withColumnRenamed("CATEGORY", col)
    o = obs.withColumn(col, F.col(col).cast("string"))
    j = ref.join(o, col, "full").na.fill(0, subset=["O"]).na.fill(0.0, subset=["P"])
    tot = F.sum("O").over(Window.partitionBy())
    j = j.withColumn("E", F.col("P") * tot)
    term = F.when(F.col("E") > 0, F.try_divide((F.col("O") - F.col("E")) ** 2, F.col("E"))).when(
        F.col("O") > 0, F.lit(float("inf"))).otherwise(0.0)
    return j.agg(F.sum(term).alias("STATISTIC"), (F.count("*") - 1).alias("DOF"))


def chi2_sf(x: float, dof: int) -> float:
    """Survival function of the chi-square distribution (regularized upper incomplete gamma)."""
    if x is None or dof <= 0:
        return float("nan")
    if math.isinf(x):
        return 0.0
    a, z = dof / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    if z < a + 1:  # series for the lower gamma
        term = total = 1.0 / a
        k = a
        for _ in range(10000):
            k += 1
            term *= z / k
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        else:
            raise ArithmeticError(f"the chi-square series did not settle for x={x}, dof={dof}")
        return max(0.0, 1.0 - total * math.exp(-z + a * math.log(z) - math.lgamma(a)))
    # continued fraction for the upper gamma (Lentz)
    tiny = 1e-300
    b = z + 1 - a
    c = 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    else:
        raise ArithmeticError(f"the chi-square fraction did not settle for x={x}, dof={dof}")
    return math.exp(-z + a * math.log(z) - math.lgamma(a)) * h


def contingency_chi2(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence chi-square over the full (a, b) grid: expected = row total x col total / N.
    Computed on observed cells only: sum over observed cells of (O-E)^2/E plus, for the empty cells,
    the remaining expected mass N - sum(E). One row (STATISTIC, DOF)."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("O"))
    j, n, ka, kb = _with_margins(c, a, b, "O")
    e = F.col("_ra") * F.col("_cb") / F.lit(float(n or 1))
    return j.agg(r6(F.sum((F.col("O") - e) ** 2 / e) + F.lit(float(n)) - F.sum(e)).alias("STATISTIC"),
                 F.lit((ka - 1) * (kb - 1)).alias("DOF"))


def _with_margins(cells: DataFrame, a: str, b: str, n: str) -> tuple[DataFrame, int, int, int]:
    """Cells with their row and column totals (_ra, _cb), the grand total and the number of rows and columns.
    Grouped sums joined back: no window gathers all cells of a category."""
    cells = cut_lineage(cells)
    ra, cb = cells.groupBy(a).agg(F.sum(n).alias("_ra")), cells.groupBy(b).agg(F.sum(n).alias("_cb"))
    total, ka = ra.agg(F.sum("_ra"), F.count("*")).first()
    j = cells.join(bounded_broadcast(ra), a).join(bounded_broadcast(cb), b)
    return j, int(total or 0), int(ka), cb.count()


def _chi2_sf_batch(x, k):
    import pandas as pd
    return pd.Series([chi2_sf(float(xx), int(kk)) for xx, kk in zip(x, k)])


def with_chi2_pvalue(stat_df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Add P_VALUE (chi-square survival function, a small Arrow-batched helper) and a verdict."""
    _sf = F.pandas_udf(_chi2_sf_batch, "double", PandasUDFType.SCALAR)

    out = stat_df.withColumn("P_VALUE", r6(_sf(F.col("STATISTIC"), F.col("DOF"))))
    return out.withColumn("VERDICT", F.when(F.col("P_VALUE") < alpha, "Poor match").otherwise("Good match"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """I(A;B) = sum p_ab ln(p_ab / (p_a p_b)) in nats, one row."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    j, tot, _, _ = _with_margins(c, a, b, "n")
    pab = F.col("n") / F.lit(float(tot or 1))
    term = pab * F.log(F.col("n") * F.lit(float(tot)) / (F.col("_ra") * F.col("_cb")))
    return j.agg(r6(F.sum(term)).alias("MI"))


def pairwise_information(df: DataFrame, features) -> DataFrame:
    """(A, B, MI) for every pair of features: one unpivot to pairs, one grouped count, margins as grouped sums joined back."""
    feats = list(features)
    pairs = [F.struct(F.lit(a).alias("A"), F.lit(b).alias("B"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y"))
             for i, a in enumerate(feats) for b in feats[i + 1:]]
    cells = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").dropna(subset=["x", "y"])
    cells = cut_lineage(cells.groupBy("A", "B", "x", "y").agg(F.count("*").alias("n")))
    total = cells.groupBy("A", "B").agg(F.sum("n").cast("double").alias("_total"))
    j = (cells.join(cells.groupBy("A", "B", "x").agg(F.sum("n").alias("nx")), ["A", "B", "x"])
         .join(cells.groupBy("A", "B", "y").agg(F.sum("n").alias("ny")), ["A", "B", "y"])
         .join(bounded_broadcast(total), ["A", "B"]))
    return j.groupBy("A", "B").agg(r6(F.sum(F.col("n") / F.col("_total") * F.log(F.col("n") * F.col("_total") / (F.col("nx") * F.col("ny")))))
                                   .alias("MI"))
