"""Portable pseudo-random draws.

Every random choice in the library is a pure function of (tag, row key): the first 52 bits of
md5("tag|key") scaled to [0, 1). Results therefore do not depend on partitioning, task retries or
executor loss, and an independent SQL engine can recompute every draw.  ``fast=True`` switches to
xxhash64 (cheaper, JVM-native) for runs that do not need an external oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 52 bits fill a double's mantissa, so floor(u * N) can reach every row of any table below 2^52 rows
TWO_POW_52 = 4503599627370496.0


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def uniform(tag, key, fast: bool = False) -> Column:
    """u(tag, key) in [0, 1). ``tag`` is a literal string or a Column; ``key`` a column name or Column."""
    tag_col = tag if isinstance(tag, Column) else F.lit(str(tag))
    key_col = _as_col(key).cast("string")
    if fast:
        h = F.xxhash64(tag_col, key_col)
        return F.pmod(h, F.lit(1 << 52).cast("bigint")).cast("double") / F.lit(TWO_POW_52)
    digest = F.md5(F.concat(tag_col, F.lit("|"), key_col))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(TWO_POW_52)


def duck_uniform(tag_sql: str, key_sql: str) -> str:
    """The same draw as DuckDB SQL text (tag_sql is a SQL string literal or expression)."""
    return f"(('0x'||substr(md5({tag_sql}||'|'||cast({key_sql} as varchar)),1,13))::bigint/4503599627370496.0::double)"


def inverse_cdf(cats: Column, cum: Column, u: Column) -> Column:
    """Pick from sorted categories given integer cumulative counts (last element = total n).

    k = floor(u*n) in [0, n); the chosen category is the first whose cumulative count exceeds k.
    Array form avoids a range join (which Spark plans as a nested loop): one equi join brings the
    (cats, cum) row to each draw, then a binary search counts the passed boundaries. The draw is an
    element of an array, so that it is computed once a row and not for each boundary.
    """
    n = F.element_at(cum, -1)
    k = F.floor(u * n)
    steps = F.array(*[F.lit(1 << b) for b in range(30, -1, -1)])

    def passed(s: Column) -> Column:
        ends = lambda at, step: (at + step <= F.size(s["c"])) & (F.get(s["c"], at + step - 1) <= s["k"])
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(step > F.size(s["c"]), at).when(ends(at, step), at + step).otherwise(at))

    idx = F.element_at(F.transform(F.array(F.struct(cum.alias("c"), k.alias("k"))), passed), 1) + 1
    return F.element_at(cats, idx.cast("int"))


def uniform_int(u: Column, lo: Column | int, hi: Column | int) -> Column:
    """Integer uniformly in [lo, hi] (inclusive) from a uniform u."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return (lo_c + F.floor(u * (hi_c - lo_c + 1))).cast("int")


def py_uniform(tag, key) -> float:
    """The same draw computed in Python (for scalar parameters such as a systematic offset)."""
    import hashlib
    return int(hashlib.md5(f"{tag}|{key}".encode()).hexdigest()[:13], 16) / TWO_POW_52
