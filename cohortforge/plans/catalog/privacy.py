"""Nearest-neighbour joins, k-distance, privacy metrics and density clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.divergence import r6
from ...operators import cluster, neighbors, privacy
from ...operators.aggregates import combine_rows
from .. import fixtures as fx
from ..registry import register

P = fx.duck_prefix
NN = ["F_SEX", "F_AGE", "F_RACE", "F_ETH", "F_CTY"]


def nn_features(df):
    return df.select(
        "*",
        F.when(F.col("SEX_CODE") == "F", 0).otherwise(1).alias("F_SEX"),
        F.col("PAT_AGE").cast("int").alias("F_AGE"),
        F.when(F.col("RACE") == "`", 0).otherwise(F.col("RACE").cast("int")).alias("F_RACE"),
        F.col("ETHNICITY").cast("int").alias("F_ETH"),
        F.col("PAT_COUNTY").alias("F_CTY"),
    )


def _duck_f(view: str) -> str:
    return (f"select *, case when SEX_CODE = 'F' then 0 else 1 end F_SEX, cast(PAT_AGE as int) F_AGE, "
            f"case when RACE = '`' then 0 else cast(RACE as int) end F_RACE, cast(ETHNICITY as int) F_ETH, PAT_COUNTY F_CTY from {view}")


def _d2(a: str, b: str, feats=NN) -> str:
    return " + ".join(f"({a}.{f} - {b}.{f}) * ({a}.{f} - {b}.{f})" for f in feats)


_NNF = ", ".join(NN)
_QJ = " and ".join(f"s.{f} = b.{f}" for f in NN)


@register("nn_join_1", P("real_train", "synth") + f""", sf as ({_duck_f('synth')}), tf as ({_duck_f('real_train')}),
q as (select distinct {_NNF} from sf), p as (select {_NNF}, min(RECORD_ID) pid from tf group by all),
pr as (select q.*, p.pid, {_d2('q', 'p')} d2 from q cross join p),
b as (select * from (select *, row_number() over (partition by {_NNF} order by d2, pid) rn from pr) where rn = 1)
select s.RECORD_ID, b.pid NN_ID, round(sqrt(b.d2), 6) NN_DIST, cast(t.APR_DRG as varchar) NN_LABEL
from sf s join b on {_QJ} join real_train t on t.RECORD_ID = b.pid""")
def q_nn_join_1(spark, d):
    s, t = nn_features(fx.synth(spark, d)), nn_features(fx.real_train(spark, d))
    r = neighbors.nn_label_1(s, t, NN, "RECORD_ID", "RECORD_ID", "APR_DRG")
    return r.select("RECORD_ID", "NN_ID", r6(F.col("NN_DIST")).alias("NN_DIST"), "NN_LABEL")


@register("nn_join_k", P("real_train", "synth") + f""", sf as ({_duck_f('synth')}), tf as ({_duck_f('real_train')}),
q as (select distinct {_NNF} from sf),
p as (select {_NNF}, RECORD_ID pid, cast(APR_DRG as varchar) lab from
      (select *, row_number() over (partition by {_NNF} order by RECORD_ID) r from tf where APR_DRG is not null) where r <= 3),
pr as (select q.*, p.pid, p.lab, {_d2('q', 'p')} d2 from q cross join p),
b as (select * from (select *, row_number() over (partition by {_NNF} order by d2, pid) rn from pr) where rn <= 3),
w as (select *, max(case when d2 = 0 then 1 else 0 end) over (partition by {_NNF}) h0 from b),
v as (select {_NNF}, lab, sum(case when h0 = 1 then (case when d2 = 0 then 1.0 else 0.0 end) else 1.0 / sqrt(d2) end) sc from w group by all),
vb as (select * from (select *, row_number() over (partition by {_NNF} order by sc desc, lab) r from v) where r = 1)
select s.RECORD_ID, b.lab PRED, round(b.sc, 6) SCORE from sf s join vb b on {_QJ}""")
def q_nn_join_k(spark, d):
    s, t = nn_features(fx.synth(spark, d)), nn_features(fx.real_train(spark, d))
    return neighbors.nn_vote_k(s, t, NN, "RECORD_ID", "RECORD_ID", "APR_DRG", k=3)


@register("train_knn", P("real_train", "real_test") + f""", sf as ({_duck_f('real_test')}), tf as ({_duck_f('real_train')}),
q as (select distinct {_NNF} from sf),
p as (select {_NNF}, RECORD_ID pid, cast(APR_MDC as varchar) lab from
      (select *, row_number() over (partition by {_NNF} order by RECORD_ID) r from tf where APR_MDC is not null) where r <= 3),
pr as (select q.*, p.pid, p.lab, {_d2('q', 'p')} d2 from q cross join p),
b as (select * from (select *, row_number() over (partition by {_NNF} order by d2, pid) rn from pr) where rn <= 3),
w as (select *, max(case when d2 = 0 then 1 else 0 end) over (partition by {_NNF}) h0 from b),
v as (select {_NNF}, lab, sum(case when h0 = 1 then (case when d2 = 0 then 1.0 else 0.0 end) else 1.0 / sqrt(d2) end) sc from w group by all),
vb as (select * from (select *, row_number() over (partition by {_NNF} order by sc desc, lab) r from v) where r = 1)
select s.RECORD_ID, b.lab PRED, round(b.sc, 6) SCORE from sf s join vb b on {_QJ}""")
def q_train_knn(spark, d):
    te, tr = nn_features(fx.real_test(spark, d)), nn_features(fx.real_train(spark, d)).where(F.col("APR_MDC").isNotNull())
    return neighbors.nn_vote_k(te, tr, NN, "RECORD_ID", "RECORD_ID", "APR_MDC", k=3)


@register("kdist_sort", P("real_train") + f""", tf as ({_duck_f('real_train')}),
v as (select {_NNF}, count(*) m, min(RECORD_ID) pid from tf group by all),
pr as (select a.{', a.'.join(NN)}, b.pid, b.m, {_d2('a', 'b')} d2 from v a cross join v b),
c as (select *, sum(m) over (partition by {', '.join(NN)} order by d2, pid rows unbounded preceding) cum from pr),
b as (select {_NNF}, min(d2) kd2 from c where cum >= 4 group by all)
select s.RECORD_ID, round(sqrt(b.kd2), 6) KDIST from tf s join b on {_QJ}""")
def q_kdist_sort(spark, d):
    t = nn_features(fx.real_train(spark, d))
    r = neighbors.k_distance(t, NN, "RECORD_ID", 4)
    return r.select("RECORD_ID", r6(F.col("KDIST")).alias("KDIST")).orderBy(F.col("KDIST").desc(), "RECORD_ID")


GOWER_NUM, GOWER_CAT = ["F_AGE", "F_CTY"], ["F_SEX", "F_RACE", "F_ETH"]


@register("gower_pairs", P("real_train", "synth") + f""", sf as ({_duck_f('synth')}), tf as ({_duck_f('real_train')}),
rg as (select (max(F_AGE) - min(F_AGE))::double ra, (max(F_CTY) - min(F_CTY))::double rc from tf),
q as (select distinct {_NNF} from sf), p as (select distinct {_NNF} from tf),
pr as (select q.*, ((abs(q.F_AGE - p.F_AGE) / case when ra > 0 then ra else 1 end) + (abs(q.F_CTY - p.F_CTY) / case when rc > 0 then rc else 1 end)
        + cast(q.F_SEX <> p.F_SEX as int) + cast(q.F_RACE <> p.F_RACE as int) + cast(q.F_ETH <> p.F_ETH as int)) / 5.0 g from q cross join p, rg),
b as (select {_NNF}, min(g) g from pr group by all)
select s.RECORD_ID, round(b.g, 6) GOWER_DIST from sf s join b on {_QJ}""")
def q_gower_pairs(spark, d):
    # re-aimed: Gower distance of each synthetic row to its closest real row (no all-pairs matrix)
    s, t = nn_features(fx.synth(spark, d)), nn_features(fx.real_train(spark, d))
    r = neighbors.gower_nearest(s, t, GOWER_NUM, GOWER_CAT, "RECORD_ID", "RECORD_ID")
    return r.select("RECORD_ID", r6(F.col("GOWER_DIST")).alias("GOWER_DIST"))


# --- privacy ---------------------------------------------------------------------------------------

def _duck_std() -> str:
    stats = ", ".join(f"avg({f}) m_{f}, case when stddev_pop({f}) is null or stddev_pop({f}) = 0 then 1 else stddev_pop({f}) end s_{f}"
                      for f in NN)
    def z(view):
        return f"select RECORD_ID, " + ", ".join(f"({f} - m_{f}) / s_{f} {f}" for f in NN) + f" from ({_duck_f(view)}), st"
    return f""", st as (select {stats} from ({_duck_f('real_train')})),
ztr as ({z('real_train')}), zsy as ({z('synth')}), zte as ({z('real_test')})"""


def _duck_nnd(qv: str, pv: str, name: str) -> str:
    return f""", {name}_q as (select distinct {_NNF} from {qv}), {name}_p as (select distinct {_NNF} from {pv}),
{name}_b as (select q.{', q.'.join(NN)}, min({_d2('q', 'p')}) d2 from {name}_q q cross join {name}_p p group by all),
{name} as (select s.RECORD_ID, round(sqrt(b.d2), 9) D from {qv} s join {name}_b b on {_QJ})"""


_PRIV_BASE = P("real_train", "real_test", "synth") + _duck_std() + _duck_nnd("zsy", "ztr", "dsy") + _duck_nnd("zte", "ztr", "dte")
_LEAK = """, thr as (select quantile_cont(D, 0.05) t from dte),
lk as (select round(avg(cast(D < (select t from thr) as double)), 6) LEAK_RATE, round((select t from thr), 6) THRESHOLD from dsy)"""
_MIA = f""", mem as (select * from ztr order by {fx.duck_uniform("'member'", 'RECORD_ID')}, RECORD_ID limit (select least(count(*), (select count(*) from zte)) from ztr)),
non as (select * from zte order by {fx.duck_uniform("'nonmember'", 'RECORD_ID')}, RECORD_ID limit (select least(count(*), (select count(*) from ztr)) from zte)),
both_ as (select *, 1 lab from mem union all select *, 0 from non)""" + _duck_nnd("both_", "zsy", "dmia") + """,
mia as (select * from """ + """(with s as (select -D sc, lab from dmia join both_ using (RECORD_ID)),
 r as (select lab, rank() over (order by sc) + (count(*) over (partition by sc) - 1) / 2.0 ar from s)
 select round((sum(case when lab = 1 then ar end) - sum(lab) * (sum(lab) + 1) / 2.0) / (sum(lab) * (count(*) - sum(lab))), 6) AUC,
        cast(sum(lab) as bigint) N_POS, cast(count(*) - sum(lab) as bigint) N_NEG from r))"""


def _std_frames(spark, d):
    from ...operators.encode import standardize
    tr, sy, te = (nn_features(fx.real_train(spark, d)), nn_features(fx.synth(spark, d)), nn_features(fx.real_test(spark, d)))
    return standardize(tr.select("RECORD_ID", *NN), [sy.select("RECORD_ID", *NN), te.select("RECORD_ID", *NN)], NN)


@register("nnd", _PRIV_BASE + " select round((select avg(D) from dsy), 6) mean_nnd, round((select avg(D) from dte), 6) real_nnd")
def q_nnd(spark, d):
    tr, sy, te = _std_frames(spark, d)
    sd = privacy.nn_distances(sy, tr, NN, "RECORD_ID", "RECORD_ID")
    rd = privacy.nn_distances(te, tr, NN, "RECORD_ID", "RECORD_ID")
    return combine_rows(sd.agg(r6(F.avg("D")).alias("mean_nnd")), rd.agg(r6(F.avg("D")).alias("real_nnd")))


@register("leak_rate", _PRIV_BASE + _LEAK + " select * from lk")
def q_leak_rate(spark, d):
    tr, sy, te = _std_frames(spark, d)
    sd = privacy.nn_distances(sy, tr, NN, "RECORD_ID", "RECORD_ID")
    rd = privacy.nn_distances(te, tr, NN, "RECORD_ID", "RECORD_ID")
    return privacy.leak_rate(sd, rd)


@register("mia_auc", _PRIV_BASE + _MIA + " select * from mia")
def q_mia_auc(spark, d):
    tr, sy, te = _std_frames(spark, d)
    return privacy.mia_distance_auc(tr, te, sy, NN)


_REPORT = _PRIV_BASE + _LEAK + _MIA + """,
row_ as (select (select avg(D) from dsy) mean_nnd, (select avg(D) from dte) real_nnd, (select LEAK_RATE from lk) leak_rate,
                (select AUC from mia) mia_auc),
sc as (select *, greatest(0, 1 - 2 * abs(mia_auc - 0.5)) P_MIA, mean_nnd / (mean_nnd + 1) P_NND, 1 - leak_rate P_LEAKAGE from row_)
select round(P_MIA, 6) P_MIA, round(P_NND, 6) P_NND, round(P_LEAKAGE, 6) P_LEAKAGE, round((P_MIA + P_NND + P_LEAKAGE) / 3 * 100, 6) privacy_score,
       round(mean_nnd, 6) mean_nnd, round(real_nnd, 6) real_nnd, leak_rate, mia_auc from sc"""


@register("privacy_report", _REPORT)
def q_privacy_report(spark, d):
    tr, sy, te = (nn_features(fx.real_train(spark, d)), nn_features(fx.synth(spark, d)), nn_features(fx.real_test(spark, d)))
    return privacy.privacy_report(tr, sy, te, NN)


@register("privacy_score", _REPORT.rsplit("select round(P_MIA", 1)[0] +
          "select round((P_MIA + P_NND + P_LEAKAGE) / 3 * 100, 6) privacy_score from sc")
def q_privacy_score(spark, d):
    return q_privacy_report(spark, d).select("privacy_score")


@register("dbscan", P("real_train") + f""", tf as ({_duck_f('real_train')}),
v as (select {_NNF}, count(*) m, min(RECORD_ID) vid from tf group by all),
e as (select a.vid a, b.vid b, b.m m from v a join v b on {_d2('a', 'b')} <= 1.0 + 1e-12),
core as (select a vid from e group by a having sum(m) >= 10),
ce as (select a, b from e where a in (select vid from core) and b in (select vid from core)),
cc as (select vid, min(lab) lab from (
  with recursive r(vid, lab) as (select vid, vid from core union select ce.b, r.lab from r join ce on ce.a = r.vid) select * from r) group by 1),
bd as (select e.a vid, min(cc.lab) lab from e join cc on cc.vid = e.b where e.a not in (select vid from core) group by 1),
lab as (select * from cc union all select * from bd)
select t.RECORD_ID, cast(coalesce(lab.lab, -1) as bigint) CLUSTER from tf t join v using ({_NNF}) left join lab on lab.vid = v.vid""")
def q_dbscan(spark, d):
    t = nn_features(fx.real_train(spark, d))
    return cluster.dbscan(t, NN, "RECORD_ID", eps=1.0, min_samples=10)
