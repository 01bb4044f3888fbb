"""Distribution similarity and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.divergence import duck_js_term
from ...operators import similarity as sim
from ...operators.aggregates import combine_rows
from .. import fixtures as fx
from ..registry import register


def duck_js_by_group(real: str, synth: str, keys: list[str], cat: str, views: list[str]) -> str:
    k = ", ".join(keys)
    knn = " and ".join(f"{x} is not null" for x in keys)
    on = " and ".join(f"c.{x} = t.{x}" for x in keys)
    p = "(c.nr::double / t.R)"
    q = "(c.ns::double / t.S)"
    return fx.duck_prefix(*views) + f""",
tagged as (select {k}, {cat} as cat, true as is_real from {real} where {knn}
           union all select {k}, {cat}, false from {synth} where {knn}),
c as (select {k}, cat, count(*) filter (where is_real) nr, count(*) filter (where not is_real) ns
      from tagged group by all),
t as (select {k}, sum(case when cat is not null then nr end) R, sum(case when cat is not null then ns end) S,
             sum(nr) NR, sum(ns) NS from c group by all),
j as (select {", ".join("t." + x for x in keys)}, t.R, t.S, t.NR, t.NS,
             sum(case when c.cat is not null then {duck_js_term(p, q)} end) js2
      from c join t on {on} group by all),
g as (select {k}, case when R > 0 and S > 0 then sqrt(greatest(js2, 0)) end js,
             cast(NR as bigint) N_real, cast(NS as bigint) N_synth, cast(NR + NS as bigint) TOTAL
      from j where NR > 0 and NS > 0)
select {k}, round((1 - js) * 100, 6) JS_similarity, round(js, 6) JS_divergence, N_real, N_synth, TOTAL,
       round(TOTAL::double / sum(TOTAL) over (), 6) PERCENTAGE
from g"""


@register("js_by_group", duck_js_by_group("real_train", "synth", ["PAT_COUNTY"], "APR_MDC",
                                          ["real_train", "synth"]))
def q_js_by_group(spark, d):
    return sim.js_by_group(fx.real_train(spark, d), fx.synth(spark, d), "PAT_COUNTY", "APR_MDC")


# ------------------------------------------------------------------------------------------------
from ...functions.random import duck_uniform, uniform  # noqa: E402
from ...operators import mining, stats  # noqa: E402

JS_COLS = ["SEX_CODE", "PAT_AGE", "RACE", "ETHNICITY", "APR_MDC"]


def duck_js_report(real: str, synth: str, cols: list[str], views: list[str]) -> str:
    stack_a = " union all ".join(f"select '{c}' FEATURE, cast({c} as varchar) CATEGORY from {real}" for c in cols)
    stack_b = " union all ".join(f"select '{c}' FEATURE, cast({c} as varchar) CATEGORY from {synth}" for c in cols)
    views_sql = fx.duck_prefix(*views)
    inner = duck_js_by_group("sa", "sb", ["FEATURE"], "CATEGORY", []).split(",\ntagged as", 1)[1]
    return views_sql + f""", sa as ({stack_a}), sb as ({stack_b}),
tagged as""" + inner.replace(
        "select FEATURE, round((1 - js) * 100, 6) JS_similarity, round(js, 6) JS_divergence, N_real, N_synth, TOTAL,\n"
        "       round(TOTAL::double / sum(TOTAL) over (), 6) PERCENTAGE\nfrom g",
        "select FEATURE as Feature, round((1 - js) * 100, 6) Similarity from g")


@register("js_report", duck_js_report("real_train", "synth", JS_COLS, ["real_train", "synth"]))
def q_js_report(spark, d):
    return sim.js_report(fx.real_train(spark, d), fx.synth(spark, d), JS_COLS)


@register("js_similarity", duck_js_report("real_train", "synth", ["APR_MDC"], ["real_train", "synth"]))
def q_js_similarity(spark, d):
    return sim.js_similarity(fx.real_train(spark, d), fx.synth(spark, d), "APR_MDC")


@register("js_two_columns", duck_js_report("real_train", "synth", ["PAT_AGE", "SEX_CODE"], ["real_train", "synth"]))
def q_js_two_columns(spark, d):
    return sim.js_report(fx.real_train(spark, d), fx.synth(spark, d), ["PAT_AGE", "SEX_CODE"])


@register("js_by_two_groups", duck_js_by_group("real_train", "synth", ["SEX_CODE", "RACE"], "PAT_AGE", ["real_train", "synth"]))
def q_js_by_two_groups(spark, d):
    return sim.js_by_group(fx.real_train(spark, d), fx.synth(spark, d), ["SEX_CODE", "RACE"], "PAT_AGE")


def _duck_rownorm(view: str) -> str:
    return f"""select r.SEX_CODE, c.RACE, coalesce(n, 0)::double / sum(coalesce(n, 0)) over (partition by r.SEX_CODE) share
    from (select distinct SEX_CODE from {view}) r cross join (select distinct RACE from {view} where RACE is not null) c
    left join (select SEX_CODE, RACE, count(*) n from {view} group by all) x on x.SEX_CODE = r.SEX_CODE and x.RACE = c.RACE"""


@register("js_cell_matrix", fx.duck_prefix("real_train", "synth") + f""", a as ({_duck_rownorm('real_train')}),
b as ({_duck_rownorm('synth')}),
j as (select coalesce(a.SEX_CODE, b.SEX_CODE) SEX_CODE, coalesce(a.RACE, b.RACE) RACE, coalesce(round(a.share, 6), 0) p0,
             coalesce(round(b.share, 6), 0) q0, coalesce(a.share, 0) p, coalesce(b.share, 0) q
      from a full join b on a.SEX_CODE = b.SEX_CODE and a.RACE = b.RACE)
select SEX_CODE, RACE, p0 P, q0 Q, round((1 - sqrt({duck_js_term('p', 'q')} + {duck_js_term('1 - p', '1 - q')})) * 100, 6) JS_SIMILARITY from j""")
def q_js_cell_matrix(spark, d):
    return sim.js_cell_matrix(fx.real_train(spark, d), fx.synth(spark, d), "SEX_CODE", "RACE")


@register("js_smoothed", fx.duck_prefix("real_test", "synth") + f""",
c as (select APR_MDC, count(*) filter (where s) + 1e-9 a, count(*) filter (where not s) + 1e-9 b from
      (select APR_MDC, true s from real_test union all select APR_MDC, false from synth) where APR_MDC is not null group by 1),
p as (select a / sum(a) over () pa, b / sum(b) over () pb from c)
select round(1 - sqrt(sum({duck_js_term('pa', 'pb')})), 6) SIMILARITY from p""")
def q_js_smoothed(spark, d):
    return sim.js_smoothed(fx.real_test(spark, d), fx.synth(spark, d), "APR_MDC")


@register("js_positional", fx.duck_prefix("real_test", "synth") + f""",
ra as (select row_number() over (order by n desc, APR_DRG) RANK, n::double / sum(n) over () p from
       (select APR_DRG, count(*) n from real_test where APR_DRG is not null group by 1)),
rb as (select row_number() over (order by n desc, APR_DRG) RANK, n::double / sum(n) over () q from
       (select APR_DRG, count(*) n from synth where APR_DRG is not null group by 1)),
j as (select coalesce(p, 0) p, coalesce(q, 0) q from ra full join rb using (RANK))
select round((1 - sqrt(sum({duck_js_term('p', 'q')}))) * 100, 6) Similarity from j""")
def q_js_positional(spark, d):
    return sim.js_positional(fx.real_test(spark, d), fx.synth(spark, d), "APR_DRG")


def _duck_shares(view: str, col: str, name: str) -> str:
    return (f"select cast({col} as varchar) CATEGORY, count(*)::double / sum(count(*)) over () {name} "
            f"from {view} where {col} is not null group by 1")


def _duck_tvo(col: str) -> str:
    return (f"select coalesce(t.CATEGORY, o.CATEGORY) CATEGORY, coalesce(TARGET, 0) TARGET, coalesce(OBSERVED, 0) OBSERVED "
            f"from ({_duck_shares('real_train', col, 'TARGET')}) t full join ({_duck_shares('synth', col, 'OBSERVED')}) o "
            f"on t.CATEGORY = o.CATEGORY")


def _duck_kl(col: str) -> str:
    return (f"(select sum(case when TARGET <= 0 then 0 when OBSERVED <= 0 then 'inf'::double "
            f"else TARGET * ln(TARGET / OBSERVED) end) from ({_duck_tvo(col)}))")


@register("target_vs_observed", fx.duck_prefix("real_train", "synth") +
          f"select CATEGORY, round(TARGET, 6) TARGET, round(OBSERVED, 6) OBSERVED from ({_duck_tvo('PAT_AGE')})")
def q_target_vs_observed(spark, d):
    t = stats.target_vs_observed(fx.real_train(spark, d), fx.synth(spark, d), "PAT_AGE")
    return t.select("CATEGORY", F.round("TARGET", 6).alias("TARGET"), F.round("OBSERVED", 6).alias("OBSERVED"))


@register("kl_divergence", fx.duck_prefix("real_train", "synth") +
          f"select round({_duck_kl('PAT_AGE')}, 6) KL_AGE, round({_duck_kl('SEX_CODE')}, 6) KL_SEX, "
          f"case when {_duck_kl('PAT_AGE')} > 0.1 and {_duck_kl('SEX_CODE')} > 0.1 then 'Poor match' else 'Good match' end VERDICT")
def q_kl_divergence(spark, d):
    tr, sy = fx.real_train(spark, d), fx.synth(spark, d)
    age = stats.kl_divergence(tr, sy, "PAT_AGE").withColumnRenamed("KL", "KL_AGE")
    sex = stats.kl_divergence(tr, sy, "SEX_CODE").withColumnRenamed("KL", "KL_SEX")
    j = combine_rows(age, sex)  # two one-row aggregates
    verdict = F.when((F.col("KL_AGE") > 0.1) & (F.col("KL_SEX") > 0.1), "Poor match").otherwise("Good match")
    return j.select(F.round("KL_AGE", 6).alias("KL_AGE"), F.round("KL_SEX", 6).alias("KL_SEX"), verdict.alias("VERDICT"))


@register("chi_square_gof", fx.duck_prefix("real_train", "synth") + """,
ref as (select cast(PAT_AGE as varchar) PAT_AGE, count(*)::double / sum(count(*)) over () P from real_train where PAT_AGE is not null group by 1),
obs as (select cast(PAT_AGE as varchar) PAT_AGE, count(*) O from synth where PAT_AGE is not null group by 1),
j as (select coalesce(P, 0) P, coalesce(O, 0) O, coalesce(P, 0) * sum(coalesce(O, 0)) over () E from ref full join obs using (PAT_AGE))
select round(sum(case when E > 0 then (O - E) * (O - E) / E when O > 0 then 'inf'::double else 0 end), 6) STATISTIC,
  cast(count(*) - 1 as int) DOF from j""")
def q_chi_square_gof(spark, d):
    r = stats.chi_square_gof(fx.real_train(spark, d), fx.synth(spark, d), "PAT_AGE")
    return r.select(F.round("STATISTIC", 6).alias("STATISTIC"), F.col("DOF").cast("int").alias("DOF"))


@register("chi_square_gof_pvalue")
def q_chi_square_gof_pvalue(spark, d):
    return stats.with_chi2_pvalue(q_chi_square_gof(spark, d))


_CT_DUCK = """, c as (select SEX_CODE a, RACE b, count(*) O from real_train group by all),
j as (select O, sum(O) over (partition by a) RA, sum(O) over (partition by b) CB, sum(O) over () N, a, b from c),
e as (select *, RA * CB / N E from j)
select round(sum((O - E) * (O - E) / E) + max(N) - sum(E), 6) STATISTIC, cast((count(distinct a) - 1) * (count(distinct b) - 1) as int) DOF from e"""


@register("contingency_chi2", fx.duck_prefix("real_train") + _CT_DUCK)
def q_contingency_chi2(spark, d):
    return stats.contingency_chi2(fx.real_train(spark, d), "SEX_CODE", "RACE")


@register("contingency_chi2_pvalue")
def q_contingency_chi2_pvalue(spark, d):
    return stats.with_chi2_pvalue(q_contingency_chi2(spark, d))


@register("mutual_information", fx.duck_prefix("real_train") + """,
c as (select SEX_CODE a, APR_MDC b, count(*) n from real_train where APR_MDC is not null group by all),
j as (select n, sum(n) over (partition by a) na, sum(n) over (partition by b) nb, sum(n) over () tot from c)
select round(sum(n / tot * ln(n * tot / (na * nb))), 6) MI from j""")
def q_mutual_information(spark, d):
    return stats.mutual_information(fx.real_train(spark, d), "SEX_CODE", "APR_MDC")


# --- baskets: brands per order ------------------------------------------------------------------
MIN_SUPPORT = 0.02
MIN_CONF = 0.1


def _basket_rows(spark, d):
    li = fx.read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    part = fx.read_table(spark, d, "part").select("p_partkey", "p_brand")
    return li.join(part, li.l_partkey == part.p_partkey).select("l_orderkey", "p_brand")


_DUCK_BASKET = """, bi as (select distinct l_orderkey o, p_brand i from lineitem join part on l_partkey = p_partkey),
nb as (select count(distinct o) n from bi),
s1 as (select i a, count(*) f from bi group by 1 having count(*) >= (select n from nb) * {ms}),
s2 as (select x.i a, y.i b, count(*) f from bi x join bi y on x.o = y.o and x.i < y.i
       where x.i in (select a from s1) and y.i in (select a from s1) group by all having count(*) >= (select n from nb) * {ms}),
s3 as (select x.i a, y.i b, z.i c, count(*) f from bi x join bi y on x.o = y.o and x.i < y.i join bi z on z.o = x.o and y.i < z.i
       where (x.i, y.i) in (select (a, b) from s2) group by all having count(*) >= (select n from nb) * {ms})
""".format(ms=MIN_SUPPORT)


@register("freq_itemsets", _DUCK_BASKET.replace(", bi as", "with bi as", 1) +
          """select a ITEMS, 1 SIZE, f FREQ from s1 union all select a || '|' || b, 2, f from s2
          union all select a || '|' || b || '|' || c, 3, f from s3""")
def q_freq_itemsets(spark, d):
    its, _ = mining.freq_itemsets(mining.baskets(_basket_rows(spark, d), "l_orderkey", "p_brand"), MIN_SUPPORT, MIN_CONF)
    return mining.itemsets_report(its).select("ITEMS", F.col("SIZE").cast("int").alias("SIZE"), "FREQ")


@register("assoc_rules", _DUCK_BASKET.replace(", bi as", "with bi as", 1) + """,
r as (select s2.a ant, s2.b con, s2.f f, s1.f fa from s2 join s1 on s1.a = s2.a
      union all select s2.b, s2.a, s2.f, s1.f from s2 join s1 on s1.a = s2.b)
select ant ANTECEDENT, con CONSEQUENT, round(f::double / fa, 6) CONFIDENCE,
       round((f::double / fa) / ((select f from s1 where s1.a = con)::double / (select n from nb)), 6) LIFT,
       round(f::double / (select n from nb), 6) SUPPORT
from r where f::double / fa >= """ + str(MIN_CONF))
def q_assoc_rules(spark, d):
    _, rules = mining.freq_itemsets(mining.baskets(_basket_rows(spark, d), "l_orderkey", "p_brand"), MIN_SUPPORT, MIN_CONF)
    return mining.rules_report(rules)


@register("markov_transitions", """select FROM_STATE, TO_STATE, N, round(N::double / sum(N) over (partition by FROM_STATE), 6) P from (
select FROM_STATE, TO_STATE, count(*) N
from (select event_type FROM_STATE, lead(event_type) over (partition by user_id order by ts, event_id) TO_STATE from events where event_type is not null)
where TO_STATE is not null group by all)""")
def q_markov_transitions(spark, d):
    return mining.markov_transitions(fx.read_table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


def _duck_side_pairs(name: str, cond: str) -> str:
    return f"""{name}_bi as (select distinct l_orderkey o, p_brand i from lineitem join part on l_partkey = p_partkey where {cond}),
{name}_n as (select count(distinct o) n from {name}_bi),
{name}_s2 as (select x.i || '|' || y.i ITEMS, count(*) f, count(*)::double / (select n from {name}_n) s from {name}_bi x
   join {name}_bi y on x.o = y.o and x.i < y.i group by 1)"""


_COMORB = ("with " + _duck_side_pairs("r", duck_uniform("'split'", "l_orderkey") + " < 0.8") + ",\n" +
           _duck_side_pairs("s", duck_uniform("'synth'", "l_orderkey") + " < 0.5") + """,
j as (select coalesce(r_s2.ITEMS, s_s2.ITEMS) ITEMS, coalesce(r_s2.s, 0) S_REAL, coalesce(s_s2.s, 0) S_SYNTH
      from r_s2 full join s_s2 on r_s2.ITEMS = s_s2.ITEMS
      where r_s2.f >= (select n from r_n) * """ + str(MIN_SUPPORT) + " or s_s2.f >= (select n from s_n) * " + str(MIN_SUPPORT) + """)
""")


def _comorb(spark, d):
    rows = _basket_rows(spark, d)
    real = mining.baskets(rows.where(uniform("split", "l_orderkey") < 0.8), "l_orderkey", "p_brand")
    syn = mining.baskets(rows.where(uniform("synth", "l_orderkey") < 0.5), "l_orderkey", "p_brand")
    return mining.comorbidity_compare(real, syn, "l_orderkey", MIN_SUPPORT)


@register("comorbidity_compare", _COMORB + "select ITEMS, round(S_REAL, 6) S_REAL, round(S_SYNTH, 6) S_SYNTH, "
          "round(S_SYNTH - S_REAL, 6) DIFF from j")
def q_comorbidity_compare(spark, d):
    return _comorb(spark, d)[0]


@register("comorbidity_similarity", _COMORB + f""", p as (select S_REAL / sum(S_REAL) over () p, S_SYNTH / sum(S_SYNTH) over () q from j)
select round((1 - sqrt(sum({duck_js_term('p', 'q')}))) * 100, 6) JS_SIMILARITY from p""")
def q_comorbidity_similarity(spark, d):
    return _comorb(spark, d)[1]
