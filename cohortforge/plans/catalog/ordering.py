"""Window, sort, limit and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import aggregates as agg
from ...operators import ordering as od
from .. import fixtures as fx
from ..registry import register
from .aggregates import _CUM_DUCK

P = fx.duck_prefix


@register("cumulative_share", P("encounters") + _CUM_DUCK)
def q_cumulative_share(spark, d):
    r = agg.cumulative_share(fx.encounters(spark, d), "APR_DRG")
    return r.select("APR_DRG", "n", F.round("share", 6).alias("share"), F.round("cum_share", 6).alias("cum_share"))


@register("dense_label_codes", P("encounters") +
          "select PRINC_DIAG_CODE, cast(dense_rank() over (order by PRINC_DIAG_CODE) - 1 as int) CODE from "
          "(select distinct PRINC_DIAG_CODE from encounters where PRINC_DIAG_CODE is not null)")
def q_dense_label_codes(spark, d):
    return od.dense_label_codes(fx.encounters(spark, d), "PRINC_DIAG_CODE")


@register("first_seen_codes", P("encounters") +
          "select PAT_ZIP, cast(row_number() over (order by f, PAT_ZIP) - 1 as int) CODE from "
          "(select PAT_ZIP, min(RECORD_ID) f from encounters where PAT_ZIP is not null group by 1)")
def q_first_seen_codes(spark, d):
    return od.first_seen_codes(fx.encounters(spark, d), "PAT_ZIP", "RECORD_ID")


@register("head_tail_classes", P("encounters") +
          """select 'HEAD' PART, * from (select APR_DRG, count(*) n from encounters where APR_DRG is not null group by 1
                                         order by n desc, APR_DRG limit 15)
          union all select 'TAIL', * from (select APR_DRG, count(*) n from encounters where APR_DRG is not null group by 1
                                         order by n asc, APR_DRG desc limit 7)""")
def q_head_tail_classes(spark, d):
    e = fx.encounters(spark, d)
    return (od.head_classes(e, "APR_DRG", 15).withColumn("PART", F.lit("HEAD"))
            .unionByName(od.tail_classes(e, "APR_DRG", 7).withColumn("PART", F.lit("TAIL"))))


@register("sort_report", P("encounters") +
          "select PAT_COUNTY, SEX_CODE, count(*) n from encounters group by all")
def q_sort_report(spark, d):
    c = fx.encounters(spark, d).groupBy("PAT_COUNTY", "SEX_CODE").agg(F.count("*").alias("n"))
    return od.sort_report(c, ["n", "PAT_COUNTY", "SEX_CODE"], [False, True, True])


@register("union_all", P("real_test", "synth") +
          "select RECORD_ID, SEX_CODE, APR_MDC, null::varchar SOURCE from real_test union all "
          "select RECORD_ID, SEX_CODE, APR_MDC, 'synthetic' from synth")
def q_union_all(spark, d):
    a = fx.real_test(spark, d).select("RECORD_ID", "SEX_CODE", "APR_MDC")
    b = fx.synth(spark, d).select("RECORD_ID", "SEX_CODE", "APR_MDC", F.lit("synthetic").alias("SOURCE"))
    return od.union_all(a, b)


@register("intersect_labels", P("real_test", "synth") +
          "select PRINC_DIAG_CODE from real_test where PRINC_DIAG_CODE is not null intersect select PRINC_DIAG_CODE from synth")
def q_intersect_labels(spark, d):
    return od.intersect_labels(fx.real_test(spark, d), fx.synth(spark, d), "PRINC_DIAG_CODE")


@register("except_labels", P("real_test", "real_train") +
          "select PRINC_DIAG_CODE from real_test where PRINC_DIAG_CODE is not null except select PRINC_DIAG_CODE from real_train")
def q_except_labels(spark, d):
    return od.except_labels(fx.real_test(spark, d), fx.real_train(spark, d), "PRINC_DIAG_CODE")


@register("union_domain", P("real_test", "synth") +
          "select distinct APR_DRG from (select APR_DRG from real_test union all select APR_DRG from synth) where APR_DRG is not null")
def q_union_domain(spark, d):
    return od.union_domain(fx.real_test(spark, d), fx.synth(spark, d), "APR_DRG")
