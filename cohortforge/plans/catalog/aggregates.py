"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.random import duck_uniform, uniform
from ...operators import aggregates as agg
from .. import fixtures as fx
from ..registry import register

P = fx.duck_prefix
#: The codes that the fixture's view gives RACE, for the oracle's fixed columns only.
RACES = ["1", "2", "3", "4", "5", "`"]
RACE_NAMES = ["R1", "R2", "R3", "R4", "R5", "R_UNK"]


@register("value_counts", P("encounters") +
          "select APR_MDC, count(*) as count from encounters where APR_MDC is not null group by 1")
def q_value_counts(spark, d):
    return agg.value_counts(fx.encounters(spark, d), "APR_MDC")


@register("value_shares", P("encounters") +
          "select PAT_AGE, count(*) as count, round(count(*)::double / sum(count(*)) over (), 6) share "
          "from encounters where PAT_AGE is not null group by 1")
def q_value_shares(spark, d):
    return agg.value_shares(fx.encounters(spark, d), "PAT_AGE")


@register("partial_final_counts", P("real_train", "synth") +
          "select PAT_COUNTY, count(*) as count from (select PAT_COUNTY from real_train union all "
          "select PAT_COUNTY from synth) where PAT_COUNTY is not null group by 1")
def q_partial_final_counts(spark, d):
    u = fx.real_train(spark, d).select("PAT_COUNTY").unionByName(fx.synth(spark, d).select("PAT_COUNTY"))
    return agg.value_counts(u, "PAT_COUNTY")


@register("group_weight_sum", P("encounters") +
          f"select SEX_CODE, round(sum({duck_uniform(repr('w'), 'RECORD_ID')}), 6) weight from encounters group by 1")
def q_group_weight_sum(spark, d):
    e = fx.encounters(spark, d).withColumn("weight", uniform("w", "RECORD_ID"))
    return agg.group_weight_sum(e, "SEX_CODE", "weight")


@register("dup_keys", "select cast(sum(n) as bigint) N_ROWS, count(*) N_DISTINCT, cast(sum(n) - count(*) as bigint) N_DUPLICATED "
          "from (select l_orderkey, l_linenumber, count(*) n from lineitem group by all)")
def q_dup_keys(spark, d):
    return agg.dup_keys(fx.read_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


_NU = ["PAT_ZIP", "PAT_COUNTY", "RACE", "APR_MDC", "PRINC_DIAG_CODE"]


@register("distinct_values", P("encounters") + " union all ".join(
    f"select '{c}' as COLUMN, count(distinct {c}) NUNIQUE from encounters" for c in _NU))
def q_distinct_values(spark, d):
    return agg.nunique(fx.encounters(spark, d), _NU)


def _duck_grid(view: str, row: str, col: str) -> str:
    return f"""select r.{row}, c.{col}, coalesce(n, 0) n from (select distinct {row} from {view} where {row} is not null) r
    cross join (select distinct {col} from {view} where {col} is not null) c
    left join (select {row}, {col}, count(*) n from {view} group by all) x on x.{row} = r.{row} and x.{col} = c.{col}"""


@register("crosstab_rownorm", P("encounters") +
          f"select SEX_CODE, RACE, n, round(case when sum(n) over (partition by SEX_CODE) > 0 then "
          f"n::double / sum(n) over (partition by SEX_CODE) end, 6) share from ({_duck_grid('encounters', 'SEX_CODE', 'RACE')})")
def q_crosstab_rownorm(spark, d):
    return agg.crosstab_rownorm(fx.encounters(spark, d), "SEX_CODE", "RACE")


@register("crosstab_truncate", P("encounters") +
          f"""select SEX_CODE, RACE, n, share from (select *, dense_rank() over (order by SEX_CODE) r, dense_rank() over (order by RACE) c
          from (select SEX_CODE, RACE, n, round(n::double / sum(n) over (partition by SEX_CODE), 6) share
                from ({_duck_grid('encounters', 'SEX_CODE', 'RACE')}))) where r <= 1 and c <= 2""")
def q_crosstab_truncate(spark, d):
    ct = agg.crosstab_rownorm(fx.encounters(spark, d), "SEX_CODE", "RACE")
    # keep first two columns, drop the last row (two sexes -> first row only)
    return agg.crosstab_truncate(ct, "SEX_CODE", "RACE", keep_rows=1, keep_cols=2)


@register("pivot_matrix", P("encounters") +
          "select SEX_CODE, " + ", ".join(f"count(*) filter (where RACE = '{r}') {n}" for r, n in zip(RACES, RACE_NAMES)) +
          " from encounters group by 1")
def q_pivot_matrix(spark, d):
    c = fx.encounters(spark, d).groupBy("SEX_CODE", "RACE").agg(F.count("*").alias("n"))
    wide = agg.pivot_matrix(c, "SEX_CODE", "RACE", "n", lambda v: "R_UNK" if v == "`" else f"R{v}")
    return wide.na.fill(0, subset=wide.columns[1:])


@register("group_totals_pct", P("real_train", "synth") +
          """select PAT_COUNTY, count(*) filter (where s) N_real, count(*) filter (where not s) N_synth, count(*) TOTAL,
          round(count(*)::double / sum(count(*)) over (), 6) PERCENTAGE from
          (select PAT_COUNTY, true s from real_train union all select PAT_COUNTY, false from synth) where PAT_COUNTY is not null group by 1""")
def q_group_totals_pct(spark, d):
    from pyspark.sql import Window
    from ...operators.joins import outer_align
    al = outer_align(fx.real_train(spark, d), fx.synth(spark, d), "PAT_COUNTY")
    tot = F.col("N_A") + F.col("N_B")
    return al.select("PAT_COUNTY", F.col("N_A").alias("N_real"), F.col("N_B").alias("N_synth"), tot.alias("TOTAL"),
                     F.round(tot / F.sum(tot).over(Window.partitionBy()), 6).alias("PERCENTAGE"))


@register("mean_percentile", P("encounters") +
          "select SEX_CODE, round(avg(LENGTH_OF_STAY), 6) MEAN, round(quantile_cont(LENGTH_OF_STAY, 0.05), 6) P05, "
          "round(avg(cast(EMERGENCY_DEPT_FLAG = 'Y' as double)), 6) FLAG_RATE from encounters group by 1")
def q_mean_percentile(spark, d):
    e = fx.encounters(spark, d).withColumn("_flag", F.col("EMERGENCY_DEPT_FLAG") == "Y")
    return agg.mean_percentile(e, ["SEX_CODE"], "LENGTH_OF_STAY", "_flag")


@register("min_count_classes", P("real_test", "synth") +
          """select a.APR_DRG, a.n N_A, b.n N_B from (select APR_DRG, count(*) n from real_test where APR_DRG is not null group by 1 having count(*) >= 2) a
          join (select APR_DRG, count(*) n from synth where APR_DRG is not null group by 1 having count(*) >= 2) b using (APR_DRG)""")
def q_min_count_classes(spark, d):
    return agg.min_count_classes(fx.real_test(spark, d), fx.synth(spark, d), "APR_DRG", 2)


_CUM_DUCK = """select APR_DRG, n, round(share, 6) share, round(cum_share, 6) cum_share from (
  select APR_DRG, n, n::double / sum(n) over () share, sum(n::double / tot) over (order by n desc, APR_DRG rows unbounded preceding) cum_share
  from (select APR_DRG, count(*) n, sum(count(*)) over () tot from encounters where APR_DRG is not null group by 1))"""


@register("cum_coverage_classes", P("encounters") + f"select * from ({_CUM_DUCK}) where cum_share - share < 0.7 - 1e-12")
def q_cum_coverage_classes(spark, d):
    r = agg.cum_coverage_classes(fx.encounters(spark, d), "APR_DRG", 0.7)
    return r.select("APR_DRG", "n", F.round("share", 6).alias("share"), F.round("cum_share", 6).alias("cum_share"))


@register("null_counts", P("encounters") + " union all ".join(
    f"select '{c}' as COLUMN, count(*) filter (where {c} is null) N_NULL from encounters" for c in fx.ENCOUNTER_COLUMNS))
def q_null_counts(spark, d):
    return agg.null_counts(fx.encounters(spark, d))


@register("label_coverage", P("real_train", "real_test") +
          """, tl as (select distinct PRINC_DIAG_CODE l from real_test where PRINC_DIAG_CODE is not null),
          un as (select l from tl where l not in (select PRINC_DIAG_CODE from real_train where PRINC_DIAG_CODE is not null))
          select (select count(*) from un) N_UNSEEN, (select count(*) from tl) N_TEST_LABELS,
                 round((select count(*) from un)::double / (select count(*) from tl), 6) FRACTION,
                 (select string_agg(l, ',' order by l) from (select l from un order by l limit 20)) EXAMPLES""")
def q_label_coverage(spark, d):
    return agg.label_coverage(fx.real_train(spark, d), fx.real_test(spark, d), "PRINC_DIAG_CODE", 20)


@register("group_sample_list", P("encounters") +
          f"""select APR_MDC, string_agg(PRINC_DIAG_CODE, '|' order by PRINC_DIAG_CODE) SAMPLE from (
          select APR_MDC, PRINC_DIAG_CODE, row_number() over (partition by APR_MDC order by {duck_uniform(repr('gsl'), 'RECORD_ID')}, RECORD_ID) rn
          from encounters where PRINC_DIAG_CODE is not null and APR_MDC is not null) where rn <= 5 group by 1""")
def q_group_sample_list(spark, d):
    return agg.group_sample_list(fx.encounters(spark, d), "APR_MDC", "PRINC_DIAG_CODE", 5)


@register("bincount_smoothed", P("real_test", "synth") +
          """select APR_MDC, round(a / sum(a) over (), 6) P_A, round(b / sum(b) over (), 6) P_B from (
          select APR_MDC, count(*) filter (where s) + 1e-9 a, count(*) filter (where not s) + 1e-9 b from
          (select APR_MDC, true s from real_test union all select APR_MDC, false from synth) where APR_MDC is not null group by 1)""")
def q_bincount_smoothed(spark, d):
    r = agg.bincount_smoothed(fx.real_test(spark, d), fx.synth(spark, d), "APR_MDC")
    return r.select("APR_MDC", F.round("P_A", 6).alias("P_A"), F.round("P_B", 6).alias("P_B"))


@register("histogram_density", """, s as (select min(o_totalprice) lo, max(o_totalprice) hi, count(o_totalprice) n from orders),
          b as (select cast(least(floor((o_totalprice - lo) / ((hi - lo) / 30)), 29) as int) BIN, lo, (hi - lo) / 30 w, n
                from orders, s where o_totalprice is not null)
          select BIN, count(*) N, round(any_value(lo) + BIN * any_value(w), 6) "LEFT", round(count(*) / (any_value(n) * any_value(w)), 6) DENSITY
          from b group by BIN""".replace(", s as", "with s as", 1))
def q_histogram_density(spark, d):
    return agg.histogram_density(fx.read_table(spark, d, "orders"), "o_totalprice", 30)


@register("state_counts", "select cast(ts as date) STEP_DAY, event_type, count(*) N from events group by all")
def q_state_counts(spark, d):
    e = fx.read_table(spark, d, "events").withColumn("STEP_DAY", F.col("ts").cast("date"))
    return agg.state_counts(e, "STEP_DAY", "event_type")
