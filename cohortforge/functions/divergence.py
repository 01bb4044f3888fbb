"""Column expressions for divergence measures (JVM-side, codegen-friendly)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: similarity floor of (1 - JS distance) * 100 for disjoint supports, natural log.
JS_DISJOINT_SIMILARITY = (1.0 - math.sqrt(math.log(2.0))) * 100.0


def xlogy_half(p: Column, q: Column) -> Column:
    """0.5 * p * ln(2p / (p+q)), defined as 0 when p = 0 (rel_entr convention)."""
    return F.when(p > 0, F.lit(0.5) * p * F.log(F.lit(2.0) * p / (p + q))).otherwise(F.lit(0.0))


def js_term(p: Column, q: Column) -> Column:
    """Per-category contribution to the squared Jensen-Shannon distance (base e)."""
    return xlogy_half(p, q) + xlogy_half(q, p)


def kl_term(p: Column, q: Column) -> Column:
    """p ln(p/q); +inf when q = 0 < p; 0 when p = 0."""
    return (F.when(p <= 0, F.lit(0.0))
            .when(q <= 0, F.lit(float("inf")))
            .otherwise(p * F.log(p / q)))


def similarity_from_distance(js: Column) -> Column:
    return (F.lit(1.0) - js) * F.lit(100.0)


def r6(c: Column) -> Column:
    return F.round(c, 6)


# DuckDB text of the same expressions (oracle side).
def duck_js_term(p: str, q: str) -> str:
    return (f"(case when ({p}) > 0 then 0.5*({p})*ln(2*({p})/(({p})+({q}))) else 0 end + "
            f"case when ({q}) > 0 then 0.5*({q})*ln(2*({q})/(({p})+({q}))) else 0 end)")
