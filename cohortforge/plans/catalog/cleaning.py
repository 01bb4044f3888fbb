"""Projections, filters and cleaning over the encounter views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.divergence import r6
from ...functions.random import duck_uniform, uniform
from ...operators import clean
from ...session import bounded_broadcast
from .. import fixtures as fx
from ..registry import register

ENC = fx.ENCOUNTER_COLUMNS
STRING_COLS = ["DISCHARGE", "EMERGENCY_DEPT_FLAG", "TYPE_OF_ADMISSION", "SOURCE_OF_ADMISSION", "PAT_ZIP", "PAT_STATUS",
               "SEX_CODE", "RACE", "ETHNICITY", "PAT_AGE", "FIRST_PAYMENT_SRC", "PRINC_DIAG_CODE"]


def P(*views):
    return fx.duck_prefix(*views)


def _case_map(col: str, mapping: dict, default: str | None) -> str:
    whens = " ".join(f"when {col} = {repr(k) if isinstance(k, str) else k} then '{v}'" for k, v in mapping.items())
    return f"(case {whens} else {repr(default) if default is not None else 'null'} end)"


@register("select_columns", P("encounters") + "select RECORD_ID, SEX_CODE, APR_MDC from encounters")
def q_select_columns(spark, d):
    return clean.select_columns(fx.encounters(spark, d), ["RECORD_ID", "SEX_CODE", "NOT_A_COLUMN", "APR_MDC"])


@register("drop_columns", P("encounters") + "select * exclude (PRINC_DIAG_CODE, ILLNESS_SEVERITY) from encounters")
def q_drop_columns(spark, d):
    return clean.drop_columns(fx.encounters(spark, d), ["PRINC_DIAG_CODE", "ILLNESS_SEVERITY", "NOT_A_COLUMN"])


@register("require_columns", P("encounters") + f"select RECORD_ID, {', '.join(fx.DEMOGRAPHICS)} from encounters")
def q_require_columns(spark, d):
    df = clean.require_columns(fx.encounters(spark, d), fx.DEMOGRAPHICS)
    return df.select("RECORD_ID", *fx.DEMOGRAPHICS)


@register("conform_columns", P("base") + "select RECORD_ID, SEX_CODE, PAT_AGE, 'UNKNOWN' as APR_MDC from base")
def q_conform_columns(spark, d):
    return clean.conform_columns(fx.base(spark, d), ["RECORD_ID", "SEX_CODE", "PAT_AGE", "APR_MDC"], "UNKNOWN")


_ALIGNED = sorted(set(fx.DEMOGRAPHICS + ["RECORD_ID", "PRINC_DIAG_CODE"]) - {"PRINC_DIAG_CODE"})


@register("align_features", P("synth") + f"select {', '.join(_ALIGNED)} from synth")
def q_align_features(spark, d):
    pool, train = fx.pool(spark, d), fx.real_train(spark, d)
    cols = clean.align_features(train, pool, exclude=["PRINC_DIAG_CODE"])
    return fx.synth(spark, d).select(*cols)


def _sentinel_sql() -> str:
    sel = ", ".join(f"case when {c} in ('`', '') then null else {c} end as {c}" if c in STRING_COLS else c for c in ENC)
    notnull = " and ".join(f"{c} is not null" for c in ENC)
    return P("encounters") + f"select * from (select {sel} from encounters) where {notnull}"


@register("sentinel_to_null", _sentinel_sql())
def q_sentinel_to_null(spark, d):
    return clean.sentinel_to_null(fx.encounters(spark, d))


@register("drop_sentinel_group", P("encounters") + "select * from encounters where RACE is distinct from '`'")
def q_drop_sentinel_group(spark, d):
    return clean.drop_sentinel_group(fx.encounters(spark, d), "RACE")


@register("dropna_subset", P("encounters") +
          "select * from encounters where APR_MDC is not null and PRINC_DIAG_CODE is not null")
def q_dropna_subset(spark, d):
    return clean.dropna_subset(fx.encounters(spark, d), ["APR_MDC", "PRINC_DIAG_CODE"])


@register("clean_target", P("encounters") +
          "select * replace (upper(trim(PRINC_DIAG_CODE)) as PRINC_DIAG_CODE) from encounters "
          "where PRINC_DIAG_CODE is not null and upper(trim(PRINC_DIAG_CODE)) <> 'UNKNOWN'")
def q_clean_target(spark, d):
    return clean.clean_target(fx.encounters(spark, d), "PRINC_DIAG_CODE", upper=True)


# Age bands with a separator, e.g. '07-11', and 'unknown' for the sentinel race rows.
def _band_spark(df):
    return df.withColumn("AGE_BAND", F.when(F.col("RACE") == "`", F.lit("unknown")).otherwise(
        F.concat(F.col("PAT_AGE"), F.lit("-"), (F.col("PAT_AGE").cast("int") + 4).cast("string"))))


_BAND_DUCK = "case when RACE = '`' then 'unknown' else PAT_AGE || '-' || cast(cast(PAT_AGE as int) + 4 as varchar) end"


@register("parse_age_digits", P("encounters") +
          f"select RECORD_ID, AGE_BAND, try_cast(nullif(regexp_replace(AGE_BAND, '[^0-9]', '', 'g'), '') as bigint) AGE "
          f"from (select RECORD_ID, {_BAND_DUCK} AGE_BAND from encounters)")
def q_parse_age_digits(spark, d):
    e = _band_spark(fx.encounters(spark, d))
    return e.select("RECORD_ID", "AGE_BAND", clean.parse_age_digits("AGE_BAND").alias("AGE"))


@register("parse_age_first", P("encounters") +
          f"select RECORD_ID, AGE_BAND, try_cast(nullif(regexp_extract(AGE_BAND, '([0-9]+)', 1), '') as bigint) AGE "
          f"from (select RECORD_ID, {_BAND_DUCK} AGE_BAND from encounters)")
def q_parse_age_first(spark, d):
    e = _band_spark(fx.encounters(spark, d))
    return e.select("RECORD_ID", "AGE_BAND", clean.parse_age_first("AGE_BAND").alias("AGE"))


@register("age_default_zero", P("encounters") +
          f"select RECORD_ID, coalesce(try_cast(nullif(regexp_replace(AGE_BAND, '[^0-9]', '', 'g'), '') as bigint), 0) AGE "
          f"from (select RECORD_ID, {_BAND_DUCK} AGE_BAND from encounters)")
def q_age_default_zero(spark, d):
    e = _band_spark(fx.encounters(spark, d))
    return e.select("RECORD_ID", clean.age_default_zero("AGE_BAND").alias("AGE"))


@register("to_numeric_coerce", P("encounters") +
          "select RECORD_ID, try_cast(PAT_ZIP as double) ZIP_NUM, try_cast(FIRST_PAYMENT_SRC as double) PAY_NUM, "
          "try_cast(PAT_AGE as double) AGE_NUM from encounters")
def q_to_numeric_coerce(spark, d):
    e = fx.encounters(spark, d)
    return e.select("RECORD_ID", clean.to_numeric_coerce("PAT_ZIP").alias("ZIP_NUM"),
                    clean.to_numeric_coerce("FIRST_PAYMENT_SRC").alias("PAY_NUM"),
                    clean.to_numeric_coerce("PAT_AGE").alias("AGE_NUM"))


@register("to_numeric_whole_column", P("base") +
          "select RECORD_ID, cast(PAT_ZIP as double) PAT_ZIP, cast(PAT_AGE as double) PAT_AGE, "
          "cast(SOURCE_OF_ADMISSION as double) SOURCE_OF_ADMISSION, FIRST_PAYMENT_SRC, PRINC_DIAG_CODE from base")
def q_to_numeric_whole_column(spark, d):
    b = fx.base(spark, d).select("RECORD_ID", "PAT_ZIP", "PAT_AGE", "SOURCE_OF_ADMISSION", "FIRST_PAYMENT_SRC",
                                 "PRINC_DIAG_CODE")
    return clean.to_numeric_whole_column(b)


@register("fill_constant", P("encounters") +
          "select * replace (coalesce(APR_MDC, -1) as APR_MDC, coalesce(APR_DRG, -1) as APR_DRG, "
          "coalesce(ILLNESS_SEVERITY, -1) as ILLNESS_SEVERITY, coalesce(PRINC_DIAG_CODE, 'UNK') as PRINC_DIAG_CODE) "
          "from encounters")
def q_fill_constant(spark, d):
    e = clean.fill_constant(fx.encounters(spark, d), -1, ["APR_MDC", "APR_DRG", "ILLNESS_SEVERITY"])
    return clean.fill_constant(e, "UNK", ["PRINC_DIAG_CODE"])


@register("fill_mode", P("real_train", "real_test") +
          "select * replace (coalesce(APR_MDC, (select APR_MDC from real_train where APR_MDC is not null "
          "group by APR_MDC order by count(*) desc, APR_MDC limit 1)) as APR_MDC) from real_test")
def q_fill_mode(spark, d):
    return clean.fill_mode(fx.real_test(spark, d), "APR_MDC", ref=fx.real_train(spark, d))


@register("icd3_extract", P("encounters") +
          "select * exclude (PRINC_DIAG_CODE), nullif(regexp_extract(upper(trim(PRINC_DIAG_CODE)), "
          "'([A-Z][0-9]{2})', 1), '') ICD3 from encounters")
def q_icd3_extract(spark, d):
    return clean.icd3_extract(fx.encounters(spark, d))


_ETH = {str(k): v for k, v in clean.ETHNICITY_NAMES.items()}


@register("map_codes", P("encounters") +
          f"select RECORD_ID, APR_MDC, {_case_map('APR_MDC', clean.MDC_NAMES, clean.UNKNOWN_LABEL)} MDC_NAME, "
          f"{_case_map('RACE', clean.RACE_NAMES, clean.UNKNOWN_LABEL)} RACE_NAME, "
          f"{_case_map('ETHNICITY', _ETH, clean.UNKNOWN_LABEL)} ETHNICITY_NAME from encounters")
def q_map_codes(spark, d):
    e = fx.encounters(spark, d)
    return e.select("RECORD_ID", "APR_MDC", clean.map_codes("APR_MDC", clean.MDC_NAMES).alias("MDC_NAME"),
                    clean.map_codes("RACE", clean.RACE_NAMES).alias("RACE_NAME"),
                    clean.map_codes("ETHNICITY", _ETH).alias("ETHNICITY_NAME"))


@register("equality_filter", P("encounters") +
          "select * from encounters where ILLNESS_SEVERITY = 2 and APR_MDC in (5, 12)")
def q_equality_filter(spark, d):
    return fx.encounters(spark, d).where((F.col("ILLNESS_SEVERITY") == 2) & F.col("APR_MDC").isin(5, 12))


@register("isin_filter", P("real_test", "synth") +
          "select * from real_test where APR_DRG in (select APR_DRG from synth)")
def q_isin_filter(spark, d):
    return clean.isin_filter(fx.real_test(spark, d), "APR_DRG", fx.synth(spark, d))


@register("literal_provenance", P("pool") + "select *, 'CTGAN' as ICD_SOURCE from pool")
def q_literal_provenance(spark, d):
    return clean.literal_provenance(fx.pool(spark, d), "CTGAN")


@register("normalize_dash", P("encounters") +
          "select RECORD_ID, translate(trim(' ' || PAT_AGE || (case when APR_MDC % 2 = 0 then '–' else '—' end) "
          "|| cast(cast(PAT_AGE as int) + 4 as varchar) || ' '), '–—', '--') AGE_BAND from encounters")
def q_normalize_dash(spark, d):
    e = fx.encounters(spark, d)
    raw = F.concat(F.lit(" "), F.col("PAT_AGE"), F.when(F.col("APR_MDC") % 2 == 0, F.lit("–")).otherwise(F.lit("—")),
                   (F.col("PAT_AGE").cast("int") + 4).cast("string"), F.lit(" "))
    return e.select("RECORD_ID", clean.normalize_dash(raw).alias("AGE_BAND"))


@register("rename_relabel", P("encounters") +
          f"select RECORD_ID, SEX_CODE as SEX, coalesce({_case_map('RACE', clean.RACE_NAMES, None)}, RACE) RACE "
          f"from encounters")
def q_rename_relabel(spark, d):
    e = fx.encounters(spark, d).select("RECORD_ID", "SEX_CODE", "RACE")
    return clean.rename_relabel(e, {"SEX_CODE": "SEX"}, {"RACE": clean.RACE_NAMES})


def _risk_duck(policy: str) -> str:
    """Baseline probabilities: the shares of outpatient and inpatient rows (emergency flag Y / N) of the row's county."""
    flag = "coalesce(AGE > 65 or ILLNESS_SEVERITY >= 3, false)"
    if policy == "high_risk":
        out = f"case when {flag} then least(po + 0.3, 0.95) else po end"
        inp = f"case when {flag} then greatest(pi - 0.1, 0.01) else pi end"
    else:
        out, inp = "least(po + 0.2, 0.9)", "pi"
    return (P("encounters") + f"select RECORD_ID, cast({flag} as int) HIGH_RISK, round({out}, 6) P_OUT_ADJ, round({inp}, 6) P_IN_ADJ from "
            f"(select RECORD_ID, ILLNESS_SEVERITY, cast(PAT_AGE as int) * 4 AGE, "
            f"avg(cast(EMERGENCY_DEPT_FLAG = 'Y' as double)) over (partition by PAT_COUNTY) po, "
            f"avg(cast(EMERGENCY_DEPT_FLAG = 'N' as double)) over (partition by PAT_COUNTY) pi from encounters)")


def _risk_spark(spark, d, policy):
    e = fx.encounters(spark, d).select("RECORD_ID", "ILLNESS_SEVERITY", (F.col("PAT_AGE").cast("int") * 4).alias("AGE"),
                                       "PAT_COUNTY", "EMERGENCY_DEPT_FLAG")
    base = e.groupBy("PAT_COUNTY").agg(*[F.avg((F.col("EMERGENCY_DEPT_FLAG") == f).cast("double")).alias(p)
                                         for f, p in (("Y", "P_OUT"), ("N", "P_IN"))])
    e = e.join(bounded_broadcast(base), "PAT_COUNTY")
    out = clean.high_risk_cohort(e, "AGE", "ILLNESS_SEVERITY", "P_OUT", "P_IN", policy)
    return out.select("RECORD_ID", F.col("HIGH_RISK").cast("int").alias("HIGH_RISK"), r6(F.col("P_OUT_ADJ")).alias("P_OUT_ADJ"),
                      r6(F.col("P_IN_ADJ")).alias("P_IN_ADJ"))


@register("high_risk_cohort", _risk_duck("high_risk"))
def q_high_risk_cohort(spark, d):
    return _risk_spark(spark, d, "high_risk")


@register("high_risk_cohort_early", _risk_duck("early"))
def q_high_risk_cohort_early(spark, d):
    return _risk_spark(spark, d, "early")


@register("scalar_math", P("encounters") +
          "select PAT_AGE, n, round(n::double / sum(n) over (), 6) SHARE, round(100.0 * n / sum(n) over (), 6) PCT, "
          "round(sqrt(n::double / sum(n) over ()), 6) SQRT_SHARE "
          "from (select PAT_AGE, count(*) n from encounters group by PAT_AGE)")
def q_scalar_math(spark, d):
    from pyspark.sql import Window
    c = fx.encounters(spark, d).groupBy("PAT_AGE").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # per-category table: domain-bounded
    return c.select("PAT_AGE", "n", r6(share).alias("SHARE"), r6(share * 100).alias("PCT"),
                    r6(F.sqrt(share)).alias("SQRT_SHARE"))
