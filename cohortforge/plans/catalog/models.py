"""Models and model-based privacy attack. Models cannot be expressed in SQL: the keys are checked on rows only, the learners against
brute-force versions in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import metrics, models
from ...operators.aggregates import combine_rows
from ...session import scratch_path
from .. import fixtures as fx
from ..registry import register

FEATS = ["SEX_CODE", "PAT_AGE", "RACE", "ETHNICITY", "PAT_ZIP", "PAT_COUNTY", "PUBLIC_HEALTH_REGION"]
#: Sizes of the reference: generate_ml_drg.py and train.py; generate_Ml_Icd3.py; train_sep.py (columns drawn per tree).
RF = {"numTrees": 200, "maxDepth": 20}
RF_ICD3 = {"numTrees": 300, "maxDepth": 20}
#: train_icd.py: the second stage's booster, all rows and columns.
STAGE_2 = {"maxIter": 300, "maxDepth": 8, "stepSize": 0.05}
BOOSTED = {"maxIter": 300, "maxDepth": 8, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}


@register("train_random_forest")
def q_train_random_forest(spark, d):
    _, pred, _ = models.fit_predict("random_forest", fx.real_train(spark, d), fx.real_test(spark, d), FEATS, "APR_MDC", chances=False, **RF)
    return pred


@register("train_logistic")
def q_train_logistic(spark, d):
    _, pred, _ = models.fit_predict("logistic", fx.real_train(spark, d), fx.real_test(spark, d), FEATS, "APR_MDC", regParam=0.01)
    return pred.drop("prob")


@register("train_boosted")
def q_train_boosted(spark, d):
    _, pred, _ = models.fit_predict("boosted", fx.real_train(spark, d), fx.real_test(spark, d), FEATS, "APR_MDC", chances=False, **BOOSTED)
    return pred


@register("model_select")
def q_model_select(spark, d):
    """Every grid point of the three families with its cross-validated weighted F1; the best one is marked."""
    res, _, _ = models.model_select(fx.real_train(spark, d), FEATS, "APR_MDC", refit=False)
    rows = [(k, ", ".join(f"{a}={v}" for a, v in p.items()), round(m, 6), i == 0) for i, (k, p, m) in enumerate(res)]
    return spark.createDataFrame(rows, "MODEL string, PARAMS string, CV_F1 double, BEST boolean")


@register("evaluate_models")
def q_evaluate_models(spark, d):
    out = None
    for kind, params in [("logistic", {"regParam": 0.01}), ("random_forest", RF)]:
        _, pred, _ = models.fit_predict(kind, fx.real_train(spark, d), fx.real_test(spark, d), FEATS, "APR_MDC", chances=False, **params)
        row = combine_rows(metrics.accuracy(pred), metrics.f1_scores(pred)).select(F.lit(kind).alias("MODEL"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@register("two_stage_model")
def q_two_stage_model(spark, d):
    """Stage 1 predicts APR_MDC; its prediction is a feature of the stage-2 PRINC_DIAG_CODE model.
    Stage-1 predictions for the training rows are out-of-fold (2 hash folds) to avoid leakage."""
    from ...functions.random import uniform
    tr, te = fx.real_train(spark, d), fx.real_test(spark, d)
    fold = uniform("fold", "RECORD_ID") < 0.5
    parts = []
    for a, b in [(tr.where(fold), tr.where(~fold)), (tr.where(~fold), tr.where(fold))]:
        _, p, _ = models.fit_predict("random_forest", a, b, FEATS, "APR_MDC", **RF)
        parts.append(p.select(F.col("id").alias("RECORD_ID"), F.col("pred").alias("MDC_HAT")))
    oof = parts[0].unionByName(parts[1])
    _, p_te, _ = models.fit_predict("random_forest", tr, te, FEATS, "APR_MDC", **RF)
    tr2 = tr.join(oof, "RECORD_ID", "inner")
    te2 = te.join(p_te.select(F.col("id").alias("RECORD_ID"), F.col("pred").alias("MDC_HAT")), "RECORD_ID", "inner")
    # stage 2 has thousands of diagnosis codes: boosted over the codes' first letters and inside each letter
    _, pred, _ = models.fit_predict("boosted", tr2, te2, FEATS + ["MDC_HAT"], "PRINC_DIAG_CODE", group=lambda c: F.substring(c, 1, 1),
                                   chances=False, **STAGE_2)
    return pred.drop("prob")


@register("feature_importance")
def q_feature_importance(spark, d):
    model, _, prep = models.fit_predict("random_forest", fx.real_train(spark, d), fx.real_test(spark, d), FEATS, "APR_MDC", chances=False, **RF)
    return models.feature_importance(model, prep.features, spark, 15)


def _bundle(spark, d) -> str:
    model, _, prep = models.fit_predict("random_forest", fx.real_train(spark, d), fx.real_test(spark, d), FEATS, "APR_MDC", chances=False, **RF)
    path = scratch_path(spark, "bundle")
    models.save_bundle(model, prep, path)
    return path


@register("save_bundle")
def q_save_bundle(spark, d):
    return spark.read.parquet(f"{_bundle(spark, d)}/manifest")


@register("load_bundle")
def q_load_bundle(spark, d):
    """The test rows scored by a stored bundle, from the bundle alone."""
    return models.score_bundle(spark, _bundle(spark, d), fx.real_test(spark, d), chances=False)


@register("label_by_model_probability")
def q_label_by_model_probability(spark, d):
    """APR_MDC of the synthetic rows drawn from a fitted forest's class probabilities."""
    from ...operators.generators import label_by_probability
    tr, sy = fx.real_train(spark, d), fx.synth(spark, d)
    _, pred, prep = models.fit_predict("random_forest", tr, sy, FEATS, "APR_MDC", **RF)
    labels = [r["APR_MDC"] for r in prep.codes.orderBy("_y").collect()]  # the classes, as the model holds them
    return label_by_probability(pred, "prob", labels, "DRAWN", "id").select("id", "DRAWN")


@register("label_by_model_argmax")
def q_label_by_model_argmax(spark, d):
    """ICD3 (a string label) of the synthetic rows as a fitted model's most likely class."""
    from ...operators.clean import icd3_extract
    tr = icd3_extract(fx.real_train(spark, d), drop_source=False)
    sy = icd3_extract(fx.synth(spark, d), drop_source=False)
    _, pred, _ = models.fit_predict("random_forest", tr, sy, FEATS + ["APR_MDC"], "ICD3", chances=False, **RF_ICD3)
    return pred.select("id", F.col("pred").alias("ICD3_PRED"))


@register("mia_auc_model")
def q_mia_auc_model(spark, d):
    """Attack model: RF on member (train) vs non-member (test) rows, 70/30 hash split, AUC."""
    from ...functions.random import uniform
    from ...operators.sampling import sample_n
    tr, te = fx.real_train(spark, d), fx.real_test(spark, d)
    n = min(tr.count(), te.count())
    both = (sample_n(tr, n, tag="member").withColumn("MEMBER", F.lit("1"))
            .unionByName(sample_n(te, n, tag="nonmember").withColumn("MEMBER", F.lit("0"))))
    fit_part = both.where(uniform("attack", "RECORD_ID") < 0.7)
    eval_part = both.where(uniform("attack", "RECORD_ID") >= 0.7)
    _, pred, prep = models.fit_predict("random_forest", fit_part, eval_part, FEATS, "MEMBER", numTrees=100, maxDepth=10)
    # probability of class "1": position of label "1" in the dense code table
    pos = prep.codes.where(F.col("MEMBER") == "1").first()["_y"]
    scored = pred.select(F.col("prob")[int(pos)].alias("score"), F.col("y").cast("int").alias("lab"))
    return metrics.roc_auc(scored, "score", "lab")
