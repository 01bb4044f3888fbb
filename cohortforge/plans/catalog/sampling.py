"""Splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.random import duck_uniform, py_uniform
from ...operators import sampling as smp
from .. import fixtures as fx
from ..registry import register

P = fx.duck_prefix


def U(tag, key="RECORD_ID"):
    return duck_uniform(repr(tag), key)


@register("split_random", P("encounters") +
          f"select RECORD_ID, case when {U('split')} < 0.8 then 'train' else 'test' end SPLIT from encounters")
def q_split_random(spark, d):
    tr, te = smp.split_random(fx.encounters(spark, d).select("RECORD_ID"), 0.8)
    return tr.withColumn("SPLIT", F.lit("train")).unionByName(te.withColumn("SPLIT", F.lit("test")))


@register("split_stratified", P("encounters") +
          f"""select RECORD_ID, APR_MDC, case when rn <= round(0.25 * n) then 'test' else 'train' end SPLIT from (
          select RECORD_ID, APR_MDC, row_number() over (partition by APR_MDC order by {U('strat')}, RECORD_ID) rn,
                 count(*) over (partition by APR_MDC) n from encounters)""")
def q_split_stratified(spark, d):
    e = fx.encounters(spark, d).select("RECORD_ID", "APR_MDC")
    tr, te = smp.split_stratified(e, "APR_MDC", 0.25)
    return tr.withColumn("SPLIT", F.lit("train")).unionByName(te.withColumn("SPLIT", F.lit("test")))


@register("sample_stratified_n", P("encounters") +
          f""", x as (select RECORD_ID, APR_MDC, {U('stratn')} u from encounters),
          s as (select APR_MDC, count(*) ny from x group by 1),
          e as (select APR_MDC, ny, ny * 1000 / sum(ny) over () ex from s),
          f as (select APR_MDC, ny, floor(ex) fl, ex - floor(ex) rem from e),
          q as (select APR_MDC, fl + case when row_number() over (order by rem desc, APR_MDC nulls last) <= 1000 - sum(fl) over () then 1 else 0 end quota from f)
          select RECORD_ID, x.APR_MDC from (select x.*, row_number() over (partition by x.APR_MDC order by u, RECORD_ID) rn from x) x
          join q on x.APR_MDC is not distinct from q.APR_MDC where rn <= quota""")
def q_sample_stratified_n(spark, d):
    e = fx.encounters(spark, d).select("RECORD_ID", "APR_MDC")
    return smp.sample_stratified_n(e, "APR_MDC", 1000)


@register("sample_n", P("real_train") +
          f"select RECORD_ID, SEX_CODE from real_train order by {U('sample')}, RECORD_ID limit 1000")
def q_sample_n(spark, d):
    return smp.sample_n(fx.real_train(spark, d).select("RECORD_ID", "SEX_CODE"), 1000)


@register("sample_frac", P("encounters") + f"select RECORD_ID, SEX_CODE from encounters where {U('frac')} < 0.5")
def q_sample_frac(spark, d):
    return smp.sample_frac(fx.encounters(spark, d).select("RECORD_ID", "SEX_CODE"), 0.5)


@register("sample_weighted_replace", P("encounters") +
          f""", c as (select RECORD_ID, coalesce(cast(LENGTH_OF_STAY as double), 0.0) w,
                 sum(coalesce(cast(LENGTH_OF_STAY as double), 0.0)) over (order by RECORD_ID rows unbounded preceding) cum,
                 count(*) over () n, sum(coalesce(cast(LENGTH_OF_STAY as double), 0.0)) over () tot from encounters),
          k as (select RECORD_ID, cast(least(floor(n * cum / tot + {py_uniform('systematic', 0)!r}), n)
                 - least(floor(n * (cum - w) / tot + {py_uniform('systematic', 0)!r}), n) as int) k from c)
          select RECORD_ID, cast(unnest(generate_series(1, k)) as int) DRAW from k where k > 0""")
def q_sample_weighted_replace(spark, d):
    e = fx.encounters(spark, d).select("RECORD_ID", "LENGTH_OF_STAY")
    return smp.sample_weighted_replace(e, "LENGTH_OF_STAY").select("RECORD_ID", "DRAW")


@register("sample_replace", P("real_train") +
          f""", idx as (select RECORD_ID, row_number() over (order by RECORD_ID) - 1 pos, count(*) over () n from real_train)
          select g.DRAW, i.RECORD_ID from (select range DRAW from range((select count(*) from real_train))) g
          join idx i on i.pos = cast(floor({duck_uniform(repr('replace'), 'g.DRAW')} * i.n) as bigint)""")
def q_sample_replace(spark, d):
    tr = fx.real_train(spark, d).select("RECORD_ID")
    n = tr.count()
    return smp.sample_replace(tr, n).select("DRAW", "RECORD_ID")
