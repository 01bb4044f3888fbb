"""Projections, filters and cleaning. Pure column expressions; no shuffles except
where a statistic of another frame is needed (mode fill, whole-column numeric check)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar

MISSING_TOKENS = ("`", "")

# APR MDC code -> name, race code -> label, ethnicity code -> label; default label.
MDC_NAMES = {
    1: "Nervous System", 2: "Eye", 3: "Ear, Nose, Mouth, Throat", 4: "Respiratory System",
    5: "Circulatory System", 6: "Digestive System", 7: "Hepatobiliary System & Pancreas",
    8: "Musculoskeletal System & Connective Tissue", 9: "Skin, Subcutaneous Tissue & Breast",
    10: "Endocrine, Nutritional & Metabolic", 11: "Kidney & Urinary Tract", 12: "Male Reproductive System",
    13: "Female Reproductive System", 14: "Pregnancy, Childbirth & Puerperium", 15: "Newborn & Other Neonates",
    16: "Blood & Blood Forming Organs, Immunological", 17: "Myeloproliferative Diseases & Neoplasms",
    18: "Infectious & Parasitic Diseases", 19: "Mental Diseases & Disorders",
    20: "Alcohol/Drug Use & Mental Disorders", 21: "Injuries, Poisonings, Toxic Effects", 22: "Burns",
    23: "Other Factors Influencing Health Status", 24: "Multiple Significant Trauma",
    25: "Human Immunodeficiency Virus Infections",
}
RACE_NAMES = {"4": "White", "3": "Black", "2": "Asian or Pacific Islander", "1": "American Indian/Eskimo/Aleut",
              "5": "Other"}
ETHNICITY_NAMES = {1: "Hispanic", 2: "Non-Hispanic"}
UNKNOWN_LABEL = "Unknown/Other"


def select_columns(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    present = set(df.columns)
    return df.select(*[c for c in keep if c in present])


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"missing required columns: {missing}")
    return df


def conform_columns(df: DataFrame, cols: Sequence[str], fill="UNKNOWN") -> DataFrame:
    """Reindex to `cols` in order; absent columns are added as the fill value."""
    present = set(df.columns)
    return df.select(*[F.col(c) if c in present else F.lit(fill).alias(c) for c in cols])


def align_features(a: DataFrame, b: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return sorted((set(a.columns) & set(b.columns)) - ex)


def normalize_headers(df: DataFrame, upper: bool = True) -> DataFrame:
    names = [c.strip().upper() if upper else c.strip() for c in df.columns]
    return df.toDF(*names)


def sentinel_to_null(df: DataFrame, cols: Sequence[str] | None = None, tokens=MISSING_TOKENS,
                     drop_rows: bool = True) -> DataFrame:
    """Sentinel strings -> null in string columns, then (optionally) drop rows with any null."""
    str_cols = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    targets = [c for c in (cols or df.columns) if c in str_cols]
    out = df.select(*[F.when(F.col(c).isin(list(tokens)), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
                      if c in targets else F.col(c) for c in df.columns])
    return out.na.drop(how="any") if drop_rows else out


def drop_sentinel_group(df: DataFrame, col: str, sentinel: str = "`") -> DataFrame:
    return df.where(~F.col(col).eqNullSafe(F.lit(sentinel)))


def dropna_subset(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(how="any", subset=list(cols))


def clean_target(df: DataFrame, target: str, upper: bool = False, unknown: str = "UNKNOWN") -> DataFrame:
    """Target not null, trimmed (and upper-cased), not the unknown token."""
    t = F.trim(F.col(target).cast("string"))
    if upper:
        t = F.upper(t)
    return df.withColumn(target, t).where(F.col(target).isNotNull() & (F.col(target) != F.lit(unknown)))


def to_numeric_whole_column(df: DataFrame, cols: Sequence[str] | None = None, to: str = "double") -> DataFrame:
    """Cast a string column only if every non-null value parses (one aggregation pass for all columns)."""
    cands = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and (cols is None or f.name in cols)]
    if not cands:
        return df
    bad = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(to).isNull()).alias(c) for c in cands]).first()
    ok = {c for c in cands if bad[c] == 0}
    return df.select(*[F.col(c).cast(to).alias(c) if c in ok else F.col(c) for c in df.columns])


def fill_constant(df: DataFrame, value, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill(value, subset=list(cols) if cols else None)


def fill_mode(df: DataFrame, col: str, ref: DataFrame | None = None) -> DataFrame:
    """Null -> the most frequent value of the reference frame (ties: smallest)."""
    ref = df if ref is None else ref
    top = (ref.where(F.col(col).isNotNull()).groupBy(col).count()
           .orderBy(F.col("count").desc(), F.col(col).asc()).limit(1).first())
    if top is None:
        return df
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(top[0]).cast(df.schema[col].dataType)))


def map_codes(col, mapping: Mapping, default: str | None = UNKNOWN_LABEL) -> Column:
    """Code -> label through a literal map (the vocabulary is a fixed table); unknown -> default."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    m = F.create_map(*pairs)
    c = F.col(col) if isinstance(col, str) else col
    looked = m[c]
    return looked if default is None else F.coalesce(looked, F.lit(default))


def map_codes_strict(df: DataFrame, col: str, mapping: Mapping, out: str) -> DataFrame:
    """Strict variant: fail (at execution) when a non-null code has no label."""
    looked = map_codes(col, mapping, default=None)
    checked = F.when(F.col(col).isNull() | looked.isNotNull(), looked).otherwise(
        F.raise_error(F.concat(F.lit("unmapped code: "), F.col(col).cast("string"))))
    return df.withColumn(out, checked)


def isin_filter(df: DataFrame, col: str, allowed: DataFrame, allowed_col: str | None = None) -> DataFrame:
    """Keep rows whose value appears in another frame (semi join; the set stays distributed)."""
    a = allowed.select(F.col(allowed_col or col).alias(col)).distinct()
    return df.join(a, on=col, how="left_semi")


def literal_provenance(df: DataFrame, source: str, col: str = "ICD_SOURCE") -> DataFrame:
    return df.withColumn(col, F.lit(source))


def rename_relabel(df: DataFrame, renames: Mapping[str, str] | None = None,
                   relabel: Mapping[str, Mapping] | None = None) -> DataFrame:
    out = df.withColumnsRenamed(dict(renames or {}))
    for c, mapping in (relabel or {}).items():
        out = out.withColumn(c, F.coalesce(map_codes(c, mapping, default=None), F.col(c).cast("string")))
    return out


def high_risk_cohort(df: DataFrame, age: str, score: str, outpatient: str, inpatient: str, policy: str = "high_risk") -> DataFrame:
    """Policy adjustment of a row's outpatient and inpatient probabilities, with the high-risk flag (age > 65 or score >= 3).

    early: every row's outpatient probability rises by .2 (cap .9). high_risk: of flagged rows, the outpatient probability rises
    by .3 (cap .95) and the inpatient probability falls by .1 (floor .01); other rows stay as they are."""
    flag = F.coalesce((F.col(age) > 65) | (F.col(score) >= 3), F.lit(False))
    out, inp = F.col(outpatient), F.col(inpatient)
    if policy == "high_risk":
        new_out = F.when(flag, F.least(out + 0.3, F.lit(0.95))).otherwise(out)
        new_in = F.when(flag, F.greatest(inp - 0.1, F.lit(0.01))).otherwise(inp)
    elif policy == "early":
        new_out, new_in = F.least(out + 0.2, F.lit(0.9)), inp
    else:
        raise ValueError(policy)
    return df.withColumn("HIGH_RISK", flag).withColumn(f"{outpatient}_ADJ", new_out).withColumn(f"{inpatient}_ADJ", new_in)


# Re-exports of scalar expressions for callers of this module.
parse_age_digits = scalar.parse_age_digits
parse_age_first = scalar.parse_age_first
age_default_zero = scalar.age_default_zero
to_numeric_coerce = scalar.to_double_or_null
icd3_extract_col = scalar.icd3
normalize_dash = scalar.normalize_dash


def icd3_extract(df: DataFrame, source: str = "PRINC_DIAG_CODE", out: str = "ICD3", drop_source: bool = True) -> DataFrame:
    """Add ICD3 from the source code (existing ICD3 kept); error when the source is missing."""
    if out in df.columns:
        return df
    require_columns(df, [source])
    res = df.withColumn(out, scalar.icd3(source))
    return res.drop(source) if drop_source else res
