"""Encoders and feature preparation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ...operators import encode
from .. import fixtures as fx
from ..registry import register

P = fx.duck_prefix
LE_COLS = ["SEX_CODE", "RACE", "PAT_ZIP", "PRINC_DIAG_CODE"]


def _duck_vocab(views: list[str], cols: list[str], null_token: str | None = "nan") -> str:
    parts = []
    for v in views:
        for c in cols:
            cat = f"coalesce(cast({c} as varchar), '{null_token}')" if null_token is not None else f"cast({c} as varchar)"
            parts.append(f"select '{c}' as FEAT, {cat} as CATEGORY from {v}")
    return (f"vocab as (select FEAT, CATEGORY, cast(dense_rank() over (partition by FEAT order by CATEGORY) - 1 as int) CODE "
            f"from (select distinct * from ({' union all '.join(parts)}) where CATEGORY is not null))")


def _duck_apply(view: str, cols: list[str], keep: list[str], unseen: int | None, null_token: str | None = "nan") -> str:
    sel, joins = [], []
    for i, c in enumerate(cols):
        cat = f"coalesce(cast(t.{c} as varchar), '{null_token}')" if null_token is not None else f"cast(t.{c} as varchar)"
        joins.append(f"left join vocab v{i} on v{i}.FEAT = '{c}' and v{i}.CATEGORY = {cat}")
        code = f"coalesce(v{i}.CODE, {unseen})" if unseen is not None else f"v{i}.CODE"
        sel.append(f"cast({code} as int) {c}")
    return f"select {', '.join('t.' + k for k in keep)}, {', '.join(sel)} from {view} t {' '.join(joins)}"


@register("label_encode", P("encounters") + ", " + _duck_vocab(["encounters"], LE_COLS) + " " +
          _duck_apply("encounters", LE_COLS, ["RECORD_ID"], -1))
def q_label_encode(spark, d):
    e = fx.encounters(spark, d).select("RECORD_ID", *LE_COLS)
    return encode.label_encode(e, LE_COLS)


U_COLS = ["PRINC_DIAG_CODE", "PAT_ZIP"]


@register("encode_unseen_minus1", P("real_train", "real_test") + ", " + _duck_vocab(["real_train"], U_COLS) + " " +
          _duck_apply("real_test", U_COLS, ["RECORD_ID"], -1))
def q_encode_unseen_minus1(spark, d):
    vocab = encode.fit_vocabulary(fx.real_train(spark, d), U_COLS)
    return encode.apply_vocabulary(fx.real_test(spark, d).select("RECORD_ID", *U_COLS), vocab, U_COLS, unseen=-1)


@register("encode_unseen_first", P("real_train", "real_test") + ", " + _duck_vocab(["real_train"], U_COLS) + " " +
          _duck_apply("real_test", U_COLS, ["RECORD_ID"], 0))
def q_encode_unseen_first(spark, d):
    vocab = encode.fit_vocabulary(fx.real_train(spark, d), U_COLS)
    return encode.apply_vocabulary(fx.real_test(spark, d).select("RECORD_ID", *U_COLS), vocab, U_COLS, unseen=0)


@register("encode_shared_vocab", P("real_train", "real_test", "synth") + ", " +
          _duck_vocab(["real_train", "real_test", "synth"], U_COLS) + " " + _duck_apply("synth", U_COLS, ["RECORD_ID"], -1))
def q_encode_shared_vocab(spark, d):
    tr, te, sy = fx.real_train(spark, d), fx.real_test(spark, d), fx.synth(spark, d)
    vocab = encode.fit_vocabulary([tr, te, sy], U_COLS)
    return encode.apply_vocabulary(sy.select("RECORD_ID", *U_COLS), vocab, U_COLS, unseen=-1)


_BASE_STR = ["DISCHARGE", "EMERGENCY_DEPT_FLAG", "TYPE_OF_ADMISSION", "SOURCE_OF_ADMISSION", "PAT_ZIP", "PAT_STATUS",
             "SEX_CODE", "RACE", "ETHNICITY", "PAT_AGE", "FIRST_PAYMENT_SRC", "PRINC_DIAG_CODE"]
_BASE_NUM = ["RECORD_ID", "PAT_COUNTY", "PUBLIC_HEALTH_REGION", "ADMIT_WEEKDAY", "LENGTH_OF_STAY"]


@register("category_codes", P("base") + ", " + _duck_vocab(["base"], _BASE_STR, None) + " " +
          _duck_apply("base", _BASE_STR, _BASE_NUM, -1, None))
def q_category_codes(spark, d):
    return encode.category_codes(fx.base(spark, d))


_PL = ["DISCHARGE", "PAT_STATUS"]


@register("partition_local_codes", P("base") + ", " + _duck_vocab(["base"], _PL) + " " + _duck_apply("base", _PL, ["RECORD_ID"], -1))
def q_partition_local_codes(spark, d):
    # re-aimed: one global vocabulary instead of per-partition codes
    return encode.label_encode(fx.base(spark, d).select("RECORD_ID", *_PL), _PL)


_ST = ["LENGTH_OF_STAY", "ADMIT_WEEKDAY", "PAT_COUNTY"]


@register("standardize", P("real_train", "real_test") +
          ", s as (select " + ", ".join(f"avg({c}) m_{c}, stddev_pop({c}) s_{c}" for c in _ST) + " from real_train) " +
          "select RECORD_ID, " + ", ".join(
              f"round(({c} - m_{c}) / (case when s_{c} is null or s_{c} = 0 then 1 else s_{c} end), 6) {c}" for c in _ST) +
          " from real_test, s")
def q_standardize(spark, d):
    tr = fx.real_train(spark, d).select("RECORD_ID", *_ST)
    te = fx.real_test(spark, d).select("RECORD_ID", *_ST)
    _, te_s = encode.standardize(tr, [te], _ST)
    return te_s.select("RECORD_ID", *[F.round(c, 6).alias(c) for c in _ST])


_AS = ["PAT_COUNTY", "LENGTH_OF_STAY", "APR_MDC"]


@register("assemble", P("encounters") + "select RECORD_ID, " +
          ", ".join(f"coalesce(cast({c} as double), -1.0) F{i}" for i, c in enumerate(_AS)) + " from encounters")
def q_assemble(spark, d):
    a = encode.assemble(fx.encounters(spark, d).select("RECORD_ID", *_AS), _AS, "features")
    arr = vector_to_array("features")
    return a.select("RECORD_ID", *[arr[i].alias(f"F{i}") for i in range(len(_AS))])


_PCA = ["PAT_COUNTY", "PUBLIC_HEALTH_REGION", "ADMIT_WEEKDAY", "LENGTH_OF_STAY", "APR_MDC", "APR_DRG", "ILLNESS_SEVERITY",
        "AGE"]


@register("pca_project")
def q_pca_project(spark, d):
    e = fx.encounters(spark, d).withColumn("AGE", F.col("PAT_AGE").cast("int")).na.drop(subset=_PCA)
    proj, _ratios = encode.pca_project(e.select("RECORD_ID", *[F.col(c).cast("double").alias(c) for c in _PCA]), _PCA, k=7)
    return proj


@register("pca_explained_variance")
def q_pca_explained_variance(spark, d):
    """Share of the variance per component (model state: k numbers)."""
    e = fx.encounters(spark, d).withColumn("AGE", F.col("PAT_AGE").cast("int")).na.drop(subset=_PCA)
    _, ratios = encode.pca_project(e.select("RECORD_ID", *[F.col(c).cast("double").alias(c) for c in _PCA]), _PCA, k=7)
    return spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(ratios)], "COMPONENT int, RATIO double")
