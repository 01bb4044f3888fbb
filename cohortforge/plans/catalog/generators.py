"""Synthetic generators and label assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.random import duck_uniform, py_uniform, uniform
from ...operators import aggregates as agg
from ...operators import generators as gen
from ...operators.joins import draw_from_counts
from .. import fixtures as fx
from ..registry import register

P = fx.duck_prefix
IPF_FEATURES = ["SEX_CODE", "RACE", "PAT_AGE"]
GEN_FEATURES = ["SEX_CODE", "RACE", "PAT_AGE"]
# The oracle unrolls this many steps and keeps the weights once the stop rule holds; the Spark side stops by the rule itself.
IPF_UNROLLED = 12


def U(tag, key):
    return duck_uniform(repr(tag), key)


def duck_draw(name: str, prev: str, train: str, keys: list[str], label: str, out: str, alpha: int, tag: str,
              id_col: str = "RECORD_ID") -> str:
    """CTEs drawing `out` for each row of `prev` from train's (keys -> label) counts + alpha,
    falling back to the global counts; defines CTE `name` = prev + out."""
    u = U(tag, f"p.{id_col}")
    g = f"""{name}_g as (select {label} lab, count(*) + {alpha} w from {train} where {label} is not null group by 1),
{name}_gd as (select lab, w, sum(w) over (order by lab rows unbounded preceding) cum, sum(w) over () tot from {name}_g)"""
    if not keys:
        return g + f""",
{name} as (select p.*, gd.lab {out} from {prev} p left join {name}_gd gd on floor({u} * gd.tot) >= gd.cum - gd.w and floor({u} * gd.tot) < gd.cum)"""
    kk = ", ".join(keys)
    on = " and ".join(f"p.{k} = d.{k}" for k in keys)
    return g + f""",
{name}_c as (select {kk}, {label} lab, count(*) + {alpha} w from {train} where {label} is not null group by all),
{name}_d as (select *, sum(w) over (partition by {kk} order by lab rows unbounded preceding) cum, sum(w) over (partition by {kk}) tot from {name}_c),
{name}_hit as (select p.{id_col}, d.lab from {prev} p join {name}_d d on {on}
               where floor({u} * d.tot) >= d.cum - d.w and floor({u} * d.tot) < d.cum),
{name}_fb as (select p.{id_col}, gd.lab from {prev} p join {name}_gd gd on floor({u} * gd.tot) >= gd.cum - gd.w and floor({u} * gd.tot) < gd.cum
              where p.{id_col} not in (select {id_col} from {name}_hit)),
{name} as (select p.*, coalesce(h.lab, f.lab) {out} from {prev} p left join {name}_hit h on h.{id_col} = p.{id_col}
           left join {name}_fb f on f.{id_col} = p.{id_col})"""


# --- IPF ----------------------------------------------------------------------------------------

def _ipf_spark(spark, d):
    tr, sy = fx.real_train(spark, d), fx.synth(spark, d)
    scale = tr.count() / sy.count()
    c = gen.cells(tr, IPF_FEATURES)
    return gen.ipf_fit(c, IPF_FEATURES, gen.marginal_targets(sy, IPF_FEATURES, scale))


def duck_ipf(features: list[str], cells_sql: str, target_view: str, scale_sql: str) -> str:
    """Raking with numpy's allclose rule (tol 1e-5): once a step changes nothing by more, later steps keep the weights."""
    tsel = ", ".join(f"t{i}.TARGET _T{i}" for i in range(len(features)))
    tjoin = " ".join(
        f"left join (select cast({f} as varchar) c, count(*) * ({scale_sql}) TARGET from {target_view} where {f} is not null group by 1) "
        f"t{i} on t{i}.c = cast(x.{f} as varchar)" for i, f in enumerate(features))
    parts = [f"ipf_c as ({cells_sql})",
             f"ipf_s0 as materialized (select x.*, 1.0::double W, false done, {tsel} from ipf_c x {tjoin})"]
    for it in range(IPF_UNROLLED):
        prev = f"ipf_s{it}"
        for i, f in enumerate(features):
            name = f"ipf_s{it}_{i}"
            raked = f"W * _T{i} / sum(N * W) over (partition by {f})"
            parts.append(f"{name} as (select * replace ({raked} as W){', W _W0' if i == 0 else ''} from {prev})")
            prev = name
        near = "coalesce(abs(W - _W0) <= 1e-5 + 1e-5 * abs(_W0), W is null and _W0 is null)"
        parts.append(f"ipf_s{it + 1} as materialized (select * exclude (W, _W0, done), case when done then _W0 else W end W, "
                     f"done or bool_and({near}) over () done from {prev})")
    return ",\n".join(parts) + f",\nipf_w as (select * from ipf_s{IPF_UNROLLED})\n"


_IPF_DUCK = duck_ipf(IPF_FEATURES, f"select {', '.join(IPF_FEATURES)}, count(*) N from real_train group by all", "synth",
                     "(select count(*) from real_train)::double / (select count(*) from synth)")


@register("ipf_weights", P("real_train", "synth") + ", " + _IPF_DUCK +
          f"select {', '.join(IPF_FEATURES)}, N, round(W, 6) W from ipf_w")
def q_ipf_weights(spark, d):
    w, _, _ = _ipf_spark(spark, d)
    return w.select(*IPF_FEATURES, "N", F.round("W", 6).alias("W"))


@register("ipf_convergence", P("real_train", "synth") + ", " + _IPF_DUCK + "select bool_and(done) CONVERGED from ipf_w")
def q_ipf_convergence(spark, d):
    """Whether the raking met its stop rule."""
    return spark.range(1).select(F.lit(_ipf_spark(spark, d)[2]).alias("CONVERGED"))


def _age_group_spark(df):
    a = F.col("PAT_AGE")
    return df.withColumn("AGE_GROUP", F.when(a < "05", "0-17").when(a < "17", "18-64").otherwise("65+"))


_AGE_GROUP_DUCK = "case when PAT_AGE < '05' then '0-17' when PAT_AGE < '17' then '18-64' else '65+' end"
MAT = ["AGE_GROUP", "SEX_CODE"]
MATRIX_UNROLLED = 40
_MAT_TARGETS = f"""ag as (select AGE_GROUP, SEX_CODE from (select {_AGE_GROUP_DUCK} AGE_GROUP, SEX_CODE from synth)),
mt as (select 'AGE_GROUP' f, AGE_GROUP c, count(*) * any_value(sc) T from ag, ms group by AGE_GROUP union all
       select 'SEX_CODE', SEX_CODE, count(*) * any_value(sc) from ag, ms where SEX_CODE is not null group by SEX_CODE)"""


def _duck_matrix() -> str:
    """The seed grid, then rows and columns in turn until the Frobenius norm of the change is below 1e-6."""
    parts = ["ms as (select (select count(*) from real_train)::double / (select count(*) from synth) sc)", _MAT_TARGETS,
             "mb as (select floor(0.5 * avg(T)) lo, greatest(floor(1.5 * avg(T)), floor(0.5 * avg(T)) + 1) hi from mt)",
             f"""grid as (select distinct a.AGE_GROUP, s.SEX_CODE from (select distinct {_AGE_GROUP_DUCK} AGE_GROUP from real_train) a,
  (select distinct SEX_CODE from real_train where SEX_CODE is not null) s)""",
             f"""seed as materialized (select AGE_GROUP, SEX_CODE, cast(floor(lo + {U('seed', "AGE_GROUP || '|' || SEX_CODE")} * (hi - lo)) as bigint) SEED
  from grid, mb)""",
             """m0 as materialized (select AGE_GROUP, SEX_CODE, SEED::double W, false done, ra.T Ta, rs.T Ts from seed
  left join mt ra on ra.f = 'AGE_GROUP' and ra.c = AGE_GROUP left join mt rs on rs.f = 'SEX_CODE' and rs.c = SEX_CODE)"""]
    for i in range(MATRIX_UNROLLED):
        parts.append(f"m{i}a as (select * replace (coalesce(W * Ta / nullif(sum(W) over (partition by AGE_GROUP), 0), 0) as W), W _W0 from m{i})")
        parts.append(f"m{i}b as (select * replace (coalesce(W * Ts / nullif(sum(W) over (partition by SEX_CODE), 0), 0) as W) from m{i}a)")
        parts.append(f"m{i + 1} as materialized (select * exclude (W, _W0, done), case when done then _W0 else W end W, "
                     f"done or sqrt(sum((W - _W0) * (W - _W0)) over ()) < 1e-6 done from m{i}b)")
    return ",\n".join(parts) + f",\nipf_m as (select AGE_GROUP, SEX_CODE, W, done from m{MATRIX_UNROLLED})\n"


_MAT_DUCK = _duck_matrix()


def _matrix_targets(spark, d):
    tr, sy = _age_group_spark(fx.real_train(spark, d)), _age_group_spark(fx.synth(spark, d))
    return gen.cells(tr, MAT), gen.marginal_targets(sy, MAT, tr.count() / sy.count())


def _matrix_spark(spark, d):
    c, targets = _matrix_targets(spark, d)
    return gen.ipf_matrix(gen.ipf_seed(c, MAT, targets), *MAT, targets)[0]


@register("ipf_matrix", P("real_train", "synth") + ", " + _MAT_DUCK + "select AGE_GROUP, SEX_CODE, round(W, 6) W from ipf_m")
def q_ipf_matrix(spark, d):
    return _matrix_spark(spark, d).select(*MAT, F.round("W", 6).alias("W"))


@register("ipf_seed", P("real_train", "synth") + ", " + _MAT_DUCK + "select AGE_GROUP, SEX_CODE, SEED from seed")
def q_ipf_seed(spark, d):
    c, targets = _matrix_targets(spark, d)
    return gen.ipf_seed(c, MAT, targets)


def _duck_systematic(rows_sql: str, tag: str = "systematic") -> str:
    u0 = py_uniform(tag, 0)
    return f""", sw as (select RECORD_ID, coalesce(cast(wu as double), 0.0) w from ({rows_sql})),
sc as (select RECORD_ID, w, sum(w) over (order by RECORD_ID rows unbounded preceding) cum, count(*) over () n, sum(w) over () tot from sw),
sk as (select RECORD_ID, cast(least(floor(n * cum / tot + {u0!r}), n) - least(floor(n * (cum - w) / tot + {u0!r}), n) as int) k from sc)
select RECORD_ID, cast(unnest(generate_series(1, k)) as int) DRAW from sk where k > 0"""


@register("ipf_population", P("real_train", "synth") + ", " + _IPF_DUCK + _duck_systematic(
    f"select r.RECORD_ID, cast(round(w.W * 1e6) as bigint) wu from real_train r left join ipf_w w using ({', '.join(IPF_FEATURES)})"))
def q_ipf_population(spark, d):
    w, _, _ = _ipf_spark(spark, d)
    rows = fx.real_train(spark, d).select("RECORD_ID", *IPF_FEATURES)
    return gen.ipf_population(rows, w, IPF_FEATURES).select("RECORD_ID", "DRAW")


def _cells_draw_spark(spark, d, cells_df, weight_col, tag):
    n = fx.real_test(spark, d).count()
    counts = cells_df.select(F.concat_ws("|", *MAT).alias("CELL"), F.col(weight_col).alias("n"))
    draws = draw_from_counts(spark.range(n).withColumnRenamed("id", "DRAW_ID"), counts, "CELL", uniform(tag, "DRAW_ID"), "CELL")
    parts = F.split("CELL", "\\|")
    return draws.select("DRAW_ID", parts[0].alias("AGE_GROUP"), parts[1].alias("SEX_CODE"))


def _duck_cells_draw(cells_sql: str, tag: str) -> str:
    return f""", cc as (select AGE_GROUP || '|' || SEX_CODE lab, wt w from ({cells_sql})),
cd as (select lab, w, sum(w) over (order by lab rows unbounded preceding) cum, sum(w) over () tot from cc),
ids as (select range DRAW_ID from range((select count(*) from real_test)))
select DRAW_ID, split_part(lab, '|', 1) AGE_GROUP, split_part(lab, '|', 2) SEX_CODE from ids join cd
 on floor({U(tag, 'DRAW_ID')} * cd.tot) >= cd.cum - cd.w and floor({U(tag, 'DRAW_ID')} * cd.tot) < cd.cum"""


@register("ipf_table_sample", P("real_train", "synth", "real_test") + ", " + _MAT_DUCK +
          _duck_cells_draw("select AGE_GROUP, SEX_CODE, cast(round(W * 1e6) as bigint) wt from ipf_m", "ipft"))
def q_ipf_table_sample(spark, d):
    w = _matrix_spark(spark, d).withColumn("_wu", gen.weight_units(F.col("W")))
    return _cells_draw_spark(spark, d, w, "_wu", "ipft")


@register("joint_sample", P("real_train", "real_test") +
          _duck_cells_draw(f"select {_AGE_GROUP_DUCK} AGE_GROUP, SEX_CODE, count(*) wt from real_train group by all", "joint"))
def q_joint_sample(spark, d):
    c = gen.cells(_age_group_spark(fx.real_train(spark, d)), MAT)
    return _cells_draw_spark(spark, d, c, "N", "joint")


def _age_duck(group: str, tag: str, key: str) -> str:
    u = U(tag, key)
    return (f"case when {group} = '18-64' then cast(18 + floor({u} * 47) as int) when {group} = '0-17' then "
            f"cast(0 + floor({u} * 18) as int) else cast(65 + floor({u} * 35) as int) end")


@register("age_from_group", P("real_train") + f"select RECORD_ID, AGE_GROUP, {_age_duck('AGE_GROUP', 'age', 'RECORD_ID')} AGE "
          f"from (select RECORD_ID, {_AGE_GROUP_DUCK} AGE_GROUP from real_train)")
def q_age_from_group(spark, d):
    r = _age_group_spark(fx.real_train(spark, d)).select("RECORD_ID", "AGE_GROUP")
    return r.withColumn("AGE", gen.age_from_group("AGE_GROUP", "RECORD_ID"))


@register("mc_sample", P("real_train", "real_test") + f""",
ag as (select {_AGE_GROUP_DUCK} lab, count(*) w from real_train group by 1),
agd as (select lab, w, sum(w) over (order by lab rows unbounded preceding) cum, sum(w) over () tot from ag),
sx as (select SEX_CODE lab, count(*) w from real_train where SEX_CODE is not null group by 1),
sxd as (select lab, w, sum(w) over (order by lab rows unbounded preceding) cum, sum(w) over () tot from sx),
ids as (select range DRAW_ID from range((select count(*) from real_test))),
a as (select DRAW_ID, lab AGE_GROUP from ids join agd on floor({U('mc_age', 'DRAW_ID')} * tot) >= cum - w and floor({U('mc_age', 'DRAW_ID')} * tot) < cum),
s as (select DRAW_ID, lab SEX_CODE from ids join sxd on floor({U('mc_sex', 'DRAW_ID')} * tot) >= cum - w and floor({U('mc_sex', 'DRAW_ID')} * tot) < cum)
select DRAW_ID, AGE_GROUP, SEX_CODE, {_age_duck('AGE_GROUP', 'age', 'DRAW_ID')} AGE from a join s using (DRAW_ID)""")
def q_mc_sample(spark, d):
    tr = _age_group_spark(fx.real_train(spark, d))
    n = fx.real_test(spark, d).count()
    ids = spark.range(n).withColumnRenamed("id", "DRAW_ID")
    ag = tr.groupBy(F.col("AGE_GROUP")).agg(F.count("*").alias("n"))
    sx = tr.where(F.col("SEX_CODE").isNotNull()).groupBy("SEX_CODE").agg(F.count("*").alias("n"))
    r = draw_from_counts(ids, ag, "AGE_GROUP", uniform("mc_age", "DRAW_ID"), "AGE_GROUP")
    r = draw_from_counts(r, sx, "SEX_CODE", uniform("mc_sex", "DRAW_ID"), "SEX_CODE")
    return r.withColumn("AGE", gen.age_from_group("AGE_GROUP", "DRAW_ID"))


# --- conditional / autoregressive -----------------------------------------------------------------

def _duck_chain(alpha: int, tag: str, parents: bool) -> str:
    sql = P("real_train", "synth") + ", req as (select RECORD_ID, APR_MDC from synth)"
    prev = "req"
    for i, f in enumerate(GEN_FEATURES):
        keys = ["APR_MDC"] + (GEN_FEATURES[:i] if parents else [])
        sql += ",\n" + duck_draw(f"st{i}", prev, "real_train", keys, f, f, alpha, f"{tag}_{f}")
        prev = f"st{i}"
    return sql + f"\nselect RECORD_ID, APR_MDC, {', '.join(GEN_FEATURES)} from {prev}"


@register("conditional_independent", _duck_chain(0, "cond", False))
def q_conditional_independent(spark, d):
    return gen.conditional_independent(fx.real_train(spark, d), fx.synth(spark, d), "APR_MDC", GEN_FEATURES)


@register("autoregressive_generate", _duck_chain(1, "ar", True))
def q_autoregressive_generate(spark, d):
    return gen.autoregressive_generate(fx.real_train(spark, d), fx.synth(spark, d), "APR_MDC", GEN_FEATURES)


def _duck_arfit() -> str:
    parts = []
    for i, f in enumerate(GEN_FEATURES):
        ps = GEN_FEATURES[:i]
        ctx = " || '|' || ".join(f"coalesce(cast({p} as varchar), '')" for p in ps) if ps else "''"
        parts.append(f"""select OUTPUT, '{f}' FEATURE, CONTEXT, CATEGORY,
  round((c + 1) / (sum(c) over (partition by OUTPUT, CONTEXT) + count(*) over (partition by OUTPUT, CONTEXT)), 6) P
  from (select APR_MDC OUTPUT, {ctx} CONTEXT, cast({f} as varchar) CATEGORY, count(*) c from real_train
        where APR_MDC is not null and {f} is not null group by all)""")
    return P("real_train") + " union all ".join(parts)


@register("autoregressive_fit", _duck_arfit())
def q_autoregressive_fit(spark, d):
    t = gen.autoregressive_fit(fx.real_train(spark, d), "APR_MDC", GEN_FEATURES, alpha=1)
    return t.withColumn("P", F.round("P", 6))


@register("tabular_synth")
def q_tabular_synth(spark, d):
    tr = fx.real_train(spark, d)
    model = gen.tabular_synth_fit(tr, ["SEX_CODE", "RACE", "PAT_AGE", "ETHNICITY", "APR_MDC"])
    return gen.tabular_synth_sample(model, tr.count(), spark)


@register("label_by_probability", P("real_train", "synth") + ", req as (select RECORD_ID, SEX_CODE, RACE, PAT_COUNTY from synth),\n" +
          duck_draw("lbp", "req", "real_train", ["SEX_CODE", "RACE", "PAT_COUNTY"], "APR_MDC", "APR_MDC", 0, "lbp") +
          "\nselect RECORD_ID, SEX_CODE, RACE, PAT_COUNTY, APR_MDC from lbp")
def q_label_by_probability(spark, d):
    req = fx.synth(spark, d).select("RECORD_ID", "SEX_CODE", "RACE", "PAT_COUNTY")
    return gen.contextual_draw(req, fx.real_train(spark, d), ["SEX_CODE", "RACE", "PAT_COUNTY"], "APR_MDC", "APR_MDC",
                               "lbp", "RECORD_ID", alpha=0)


@register("label_by_group_pool", P("real_train", "synth") + f""",
lists as (select APR_MDC, string_agg(PRINC_DIAG_CODE, '|' order by PRINC_DIAG_CODE) SAMPLE from (
  select APR_MDC, PRINC_DIAG_CODE, row_number() over (partition by APR_MDC order by {U('gsl', 'RECORD_ID')}, RECORD_ID) rn
  from real_train where PRINC_DIAG_CODE is not null and APR_MDC is not null) where rn <= 5 group by 1)
select s.RECORD_ID, s.APR_MDC, coalesce(case when l.SAMPLE is not null then
  string_split(l.SAMPLE, '|')[cast(floor({U('gpool', 's.RECORD_ID')} * len(string_split(l.SAMPLE, '|'))) + 1 as int)] end, 'UNKNOWN') LABEL
from synth s left join lists l on l.APR_MDC = s.APR_MDC""")
def q_label_by_group_pool(spark, d):
    lists = agg.group_sample_list(fx.real_train(spark, d), "APR_MDC", "PRINC_DIAG_CODE", 5)
    return gen.label_by_group_pool(fx.synth(spark, d).select("RECORD_ID", "APR_MDC"), lists, "APR_MDC")


@register("gen_chain")
def q_gen_chain(spark, d):
    """Demographics (IPF population) -> APR_MDC -> APR_DRG -> ICD3, each stage a contextual draw."""
    from ...operators.clean import icd3_extract
    tr = icd3_extract(fx.real_train(spark, d), drop_source=False)
    w, _, _ = _ipf_spark(spark, d)
    demo_rows = fx.real_train(spark, d).select("RECORD_ID", *fx.DEMOGRAPHICS)
    pop = gen.ipf_population(demo_rows, w, IPF_FEATURES)
    # the drawn row and the number of its draw name a synthetic row without collisions
    pop = pop.withColumn("SYN_ID", F.concat_ws("-", "RECORD_ID", "DRAW")).drop("RECORD_ID", "DRAW")
    s1 = gen.contextual_draw(pop, tr, ["SEX_CODE", "PAT_AGE", "RACE"], "APR_MDC", "APR_MDC", "chain_mdc", "SYN_ID")
    s2 = gen.contextual_draw(s1, tr, ["APR_MDC"], "APR_DRG", "APR_DRG", "chain_drg", "SYN_ID")
    return gen.contextual_draw(s2, tr, ["APR_DRG"], "ICD3", "ICD3", "chain_icd3", "SYN_ID")


# --- embedding-similarity labelling -----------------------------------------------------------------
from ...operators import embed  # noqa: E402

_EMB_DUCK = """with e as (select vec_id, label, unnest(embedding) v, generate_subscripts(embedding, 1) pos from embeddings),
c as (select label, pos, avg(v) c from e group by all),
s as (select e.vec_id, c.label cl, sum(e.v * c.c) sc from e join c using (pos) group by all),
r as (select *, row_number() over (partition by vec_id order by sc desc, cl) rk from s)
"""


@register("label_by_similarity", _EMB_DUCK + """select vec_id, max(case when rk = 1 then cl end) TOP1,
  string_agg(cast(cl as varchar), '|' order by rk) filter (where rk <= 3) TOP3 from r group by 1""")
def q_label_by_similarity(spark, d):
    e = fx.read_table(spark, d, "embeddings")
    cents = embed.label_centroids(e, "embedding", "label")
    return embed.score_top_k(e, "vec_id", "embedding", cents, k=3).select("vec_id", "TOP1", "TOP3")


@register("topk_labels", _EMB_DUCK + "select vec_id, cast(rk as int) RANK, cl LABEL from r where rk <= 3")
def q_topk_labels(spark, d):
    e = fx.read_table(spark, d, "embeddings")
    cents = embed.label_centroids(e, "embedding", "label")
    return embed.top_k_long(e, "vec_id", "embedding", cents, k=3)


@register("label_by_learned_vectors")
def q_label_by_learned_vectors(spark, d):
    e = fx.read_table(spark, d, "embeddings")
    return embed.score_top_k(e, "vec_id", "embedding", embed.learned_label_vectors(e, "embedding", "label"), k=3)
