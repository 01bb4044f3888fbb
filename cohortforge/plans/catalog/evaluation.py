"""Evaluation of predictions over the frequency-classifier predictions fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.random import duck_uniform, uniform
from ...operators import aggregates as agg
from ...operators import encode, metrics
from .. import fixtures as fx
from ..registry import register

P = fx.duck_prefix
CTX = fx.PRED_CONTEXT


@register("frequency_classifier", P("predictions") + "select id, y, pred from predictions")
def q_frequency_classifier(spark, d):
    return fx.predictions(spark, d).select("id", "y", "pred")


@register("confusion_counts", P("predictions") + "select y, pred, count(*) n from predictions group by all")
def q_confusion_counts(spark, d):
    return metrics.confusion_counts(fx.predictions(spark, d))


@register("accuracy", P("predictions") + "select round(avg(cast(y = pred as double)), 6) ACCURACY from predictions")
def q_accuracy(spark, d):
    return metrics.accuracy(fx.predictions(spark, d))


def duck_per_class(view: str) -> str:
    return f"""pcc as (select y, pred, count(*) n from {view} group by all),
pcs as (select CLASS, sum(tp) TP, sum(fp) FP, sum(fn) FN, sum(sup) SUPPORT from (
   select y CLASS, case when y = pred then n else 0 end tp, 0 fp, case when y <> pred then n else 0 end fn, n sup from pcc
   union all select pred, 0, n, 0, 0 from pcc where y <> pred) where CLASS is not null group by 1),
pcp as (select *, case when TP + FP > 0 then TP::double / (TP + FP) else 0 end PREC,
                  case when TP + FN > 0 then TP::double / (TP + FN) else 0 end RECALL from pcs),
pc as (select *, case when PREC + RECALL > 0 then 2 * PREC * RECALL / (PREC + RECALL) else 0 end F1 from pcp)"""


@register("f1_scores", P("predictions") + ", " + duck_per_class("predictions") +
          " select round(avg(F1), 6) F1_MACRO, round(sum(F1 * SUPPORT) / sum(SUPPORT), 6) F1_WEIGHTED from pc")
def q_f1_scores(spark, d):
    return metrics.f1_scores(fx.predictions(spark, d))


@register("classification_report", P("predictions") + ", " + duck_per_class("predictions") + """
select CLASS, round(PREC, 6) "PRECISION", round(RECALL, 6) RECALL, round(F1, 6) F1, cast(SUPPORT as bigint) SUPPORT from pc
union all select 'macro avg', round(avg(PREC), 6), round(avg(RECALL), 6), round(avg(F1), 6), cast(sum(SUPPORT) as bigint) from pc
union all select 'weighted avg', round(sum(PREC * SUPPORT) / sum(SUPPORT), 6), round(sum(RECALL * SUPPORT) / sum(SUPPORT), 6),
  round(sum(F1 * SUPPORT) / sum(SUPPORT), 6), cast(sum(SUPPORT) as bigint) from pc""")
def q_classification_report(spark, d):
    return metrics.classification_report(fx.predictions(spark, d))


@register("topk_accuracy", P("predictions") +
          "select round(avg(cast(list_contains(string_split(topk, '|'), y) as double)), 6) TOPK_ACCURACY from predictions")
def q_topk_accuracy(spark, d):
    return metrics.topk_accuracy(fx.predictions(spark, d))


@register("log_loss", P("predictions") +
          "select round(-avg(ln(least(greatest(p_true, 1e-15), 1 - 1e-15))), 6) LOG_LOSS from predictions")
def q_log_loss(spark, d):
    return metrics.log_loss(fx.predictions(spark, d))


def duck_auc(scored_sql: str) -> str:
    return f"""(with s as ({scored_sql}), r as (select lab, rank() over (order by sc) + (count(*) over (partition by sc) - 1) / 2.0 ar from s)
select round((sum(case when lab = 1 then ar end) - sum(lab) * (sum(lab) + 1) / 2.0) / (sum(lab) * (count(*) - sum(lab))), 6) AUC,
       cast(sum(lab) as bigint) N_POS, cast(count(*) - sum(lab) as bigint) N_NEG from r)"""


@register("roc_auc", P("predictions") + "select * from " +
          duck_auc("select p_true sc, cast(y = pred as int) lab from predictions"))
def q_roc_auc(spark, d):
    p = fx.predictions(spark, d).select("p_true", (F.col("y") == F.col("pred")).cast("int").alias("hit"))
    return metrics.roc_auc(p, "p_true", "hit")


@register("prediction_frame", P("predictions", "real_test") +
          f"select p.id, p.y, p.pred, {', '.join('t.' + c for c in CTX)} from predictions p join real_test t on t.RECORD_ID = p.id")
def q_prediction_frame(spark, d):
    p = fx.predictions(spark, d).select("id", "y", "pred")
    t = fx.real_test(spark, d).select(F.col("RECORD_ID").alias("id"), *CTX)
    return p.join(t, "id", "inner")


@register("unseen_target_filter", P("real_train", "real_test") + """,
vocab as (select PRINC_DIAG_CODE, cast(dense_rank() over (order by PRINC_DIAG_CODE) - 1 as int) CODE
          from (select distinct PRINC_DIAG_CODE from real_train where PRINC_DIAG_CODE is not null))
select t.RECORD_ID, t.PRINC_DIAG_CODE, v.CODE from real_test t join vocab v using (PRINC_DIAG_CODE)""")
def q_unseen_target_filter(spark, d):
    from ...operators.ordering import dense_label_codes
    vocab = dense_label_codes(fx.real_train(spark, d), "PRINC_DIAG_CODE")
    return fx.real_test(spark, d).select("RECORD_ID", "PRINC_DIAG_CODE").join(vocab, "PRINC_DIAG_CODE", "inner")


@register("label_by_argmax", P("real_train", "synth") + f""",
fc as (select {', '.join(CTX)}, APR_MDC lab, count(*) n from real_train where APR_MDC is not null group by all),
md as (select {', '.join(CTX)}, arg_max(lab, (n, -lab)) md from fc group by all),
g as (select APR_MDC lab from real_train where APR_MDC is not null group by 1 order by count(*) desc, lab limit 1)
select s.RECORD_ID, coalesce(md.md, (select lab from g)) APR_MDC_PRED from synth s left join md using ({', '.join(CTX)})""")
def q_label_by_argmax(spark, d):
    model = metrics.frequency_classifier_fit(fx.real_train(spark, d), CTX, "APR_MDC")
    s = fx.synth(spark, d).select("RECORD_ID", *CTX)
    return metrics.frequency_classifier_label(model, s, CTX, "APR_MDC", "APR_MDC_PRED").select("RECORD_ID", "APR_MDC_PRED")


# --- TSTR and utility grid with the frequency classifier (oracle-checkable) -----------------------

def _common(train, test, label, min_count=2):
    keep = agg.min_count_classes(train, test, label, min_count).select(label)
    return train.join(keep, label, "left_semi"), test.join(keep, label, "left_semi")


def _fit_eval(train, test, label):
    model = metrics.frequency_classifier_fit(train, CTX, label)
    pred = metrics.frequency_classifier_predict(model, test, CTX, label)
    return agg.combine_rows(metrics.accuracy(pred), metrics.f1_scores(pred))


@register("tstr", P("synth", "real_test") + """,
k as (select a.APR_DRG from (select APR_DRG from synth where APR_DRG is not null group by 1 having count(*) >= 2) a
      join (select APR_DRG from real_test where APR_DRG is not null group by 1 having count(*) >= 2) b using (APR_DRG)),
tr as (select * from synth where APR_DRG in (select APR_DRG from k)),
te as (select * from real_test where APR_DRG in (select APR_DRG from k)),
pr as """ + fx.duck_frequency_predictions("tr", "te", CTX, "APR_DRG") + ", " + duck_per_class("pr") + """
select (select round(avg(cast(y = pred as double)), 6) from pr) ACCURACY, round(avg(F1), 6) F1_MACRO,
       round(sum(F1 * SUPPORT) / sum(SUPPORT), 6) F1_WEIGHTED from pc""")
def q_tstr(spark, d):
    tr, te = _common(fx.synth(spark, d), fx.real_test(spark, d), "APR_DRG")
    return _fit_eval(tr, te, "APR_DRG")


def _duck_grid_row(name: str, train: str, test: str) -> str:
    return (f"select '{name}' SCENARIO, (select round(avg(cast(y = pred as double)), 6) from {name}_p) ACCURACY, "
            f"round(sum(F1 * SUPPORT) / sum(SUPPORT), 6) F1_WEIGHTED from {name}_pc")


def _duck_utility() -> str:
    s = P("real_train", "real_test", "synth") + f""",
syn_tr as (select * from synth where {duck_uniform("'split'", 'RECORD_ID')} < 0.8),
syn_te as (select * from synth where {duck_uniform("'split'", 'RECORD_ID')} >= 0.8)"""
    rows = []
    for name, tr, te in [("real_real", "real_train", "real_test"), ("synth_real", "syn_tr", "real_test"), ("synth_synth", "syn_tr", "syn_te")]:
        s += f",\n{name}_p as " + fx.duck_frequency_predictions(tr, te, CTX, "APR_MDC") + ",\n" + \
            duck_per_class(f"{name}_p").replace("pcc", f"{name}_pcc").replace("pcs", f"{name}_pcs").replace("pcp", f"{name}_pcp") \
            .replace("pc as", f"{name}_pc as")
        rows.append(_duck_grid_row(name, tr, te))
    return s + "\n" + " union all ".join(rows)


@register("utility_grid", _duck_utility())
def q_utility_grid(spark, d):
    sy = fx.synth(spark, d)
    s_tr, s_te = sy.where(uniform("split", "RECORD_ID") < 0.8), sy.where(uniform("split", "RECORD_ID") >= 0.8)
    out = None
    for name, tr, te in [("real_real", fx.real_train(spark, d), fx.real_test(spark, d)), ("synth_real", s_tr, fx.real_test(spark, d)),
                         ("synth_synth", s_tr, s_te)]:
        model = metrics.frequency_classifier_fit(tr, CTX, "APR_MDC")
        pred = metrics.frequency_classifier_predict(model, te, CTX, "APR_MDC")
        row = agg.combine_rows(metrics.accuracy(pred), metrics.f1_scores(pred).select("F1_WEIGHTED")) \
            .select(F.lit(name).alias("SCENARIO"), "ACCURACY", "F1_WEIGHTED")
        out = row if out is None else out.unionByName(row)
    return out
