"""Sources and sinks: file round trips through the shared scratch folder (inside the
session's checkpoint directory), reading back what Spark wrote from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import clean
from ...session import scratch_path
from ...sources import files, sinks
from .. import fixtures as fx
from ..registry import register
from .evaluation import duck_per_class

P = fx.duck_prefix
DATASETS = ["inpatient", "outpatient"]
_DS_DUCK = "case when EMERGENCY_DEPT_FLAG = 'N' then 'inpatient' else 'outpatient' end"


def _move_parts(spark, src: str, dst_dir: str, prefix: str) -> None:
    """Give Spark's part files the extract's naming (metadata-only renames)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    sp = jvm.org.apache.hadoop.fs.Path(src)
    fs = sp.getFileSystem(conf)
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(dst_dir))
    parts = sorted(st.getPath().toString() for st in fs.listStatus(sp) if st.getPath().getName().startswith("part-"))
    for i, p in enumerate(parts):
        fs.rename(jvm.org.apache.hadoop.fs.Path(p), jvm.org.apache.hadoop.fs.Path(f"{dst_dir}/{prefix}_{i}.txt"))


_RAW: dict[tuple, str] = {}


def raw_layout(spark, d) -> str:
    """Base and grouper rows as tab-separated extracts, written once per application and input version: inpatient files named
    IP_ED_BASE_DATA_1_* / IP_ED_GROUPER_*, outpatient files OUTPATIENT_BASE_* / OUTPATIENT_GROUPER_* with their columns in
    another order and one more of them, a base file whose lines are all one (empty) field too long, and a file that the
    name rules must ignore."""
    key = (spark.sparkContext.applicationId, fx._input_signature(spark, d))
    if key in _RAW:
        return _RAW[key]
    root = scratch_path(spark, "raw")
    b, g = fx.base(spark, d), fx.grouper(spark, d)
    for ds, flag in [("inpatient", "N"), ("outpatient", "Y")]:
        part = b.where(F.col("EMERGENCY_DEPT_FLAG") == flag)
        grp = g.join(part.select("RECORD_ID"), "RECORD_ID", "left_semi")
        names = ("IP_ED_BASE_DATA_1", "IP_ED_GROUPER") if ds == "inpatient" else ("OUTPATIENT_BASE", "OUTPATIENT_GROUPER")
        for frame, prefix in [(part, names[0]), (grp, names[1])]:
            if ds == "outpatient":
                frame = frame.select(*reversed(frame.columns)).withColumn("EXTRA", F.lit("x"))
            tmp = f"{root}/_tmp/{ds}/{prefix}"
            sinks.write_csv(frame, tmp, sep="\t")
            _move_parts(spark, tmp, f"{root}/{ds}", prefix)
    spark.createDataFrame([("ignore me",)], "x string").coalesce(1).write.mode("overwrite").text(f"{root}/_tmp/notes")
    _move_parts(spark, f"{root}/_tmp/notes", f"{root}/inpatient", "README")
    head = spark.range(1).select(F.lit("\t".join(fx.BASE_COLUMNS)).alias("value"))
    long_lines = fx.read_table(spark, d, "nation").select(
        F.concat(F.col("n_name"), F.lit("\t" * len(fx.BASE_COLUMNS))).alias("value"))
    lines = head.union(long_lines).coalesce(1)  # 26 lines
    lines.write.mode("overwrite").text(f"{root}/_tmp/long")
    _move_parts(spark, f"{root}/_tmp/long", f"{root}/inpatient", "IP_ED_BASE_DATA_1_LONG")
    _RAW[key] = root
    return root


def _scan_base(spark, d):
    root = raw_layout(spark, d)
    found = files.discover_files(spark, root, DATASETS + ["missing_dir"])
    paths = [p for ds in found.values() for p in ds["BASE"]]
    df = files.scan_tsv(spark, paths, fx.BASE_COLUMNS, with_path=True)
    return files.tag_dataset(df), found


_TSV_ORACLE = P("base") + "select " + ", ".join(f"cast({c} as varchar) {c}" for c in fx.BASE_COLUMNS) + \
    f", {_DS_DUCK} DATASET_TYPE from base"


@register("scan_tsv", _TSV_ORACLE)
def q_scan_tsv(spark, d):
    return _scan_base(spark, d)[0]


@register("tag_dataset", P("base") + f"select {_DS_DUCK} DATASET_TYPE, count(*) N from base group by 1")
def q_tag_dataset(spark, d):
    return _scan_base(spark, d)[0].groupBy("DATASET_TYPE").agg(F.count("*").alias("N"))


@register("bad_lines", "select 'IP_ED_BASE_DATA_1_LONG_0.txt' FILE_NAME, count(*) N_BAD from nation")
def q_bad_lines(spark, d):
    found = files.discover_files(spark, raw_layout(spark, d), DATASETS)
    bad = files.bad_lines(spark, [p for ds in found.values() for p in ds["BASE"]])
    return bad.select(F.regexp_extract("_file_path", "[^/]+$", 0).alias("FILE_NAME"), "N_BAD")


@register("discover_files")
def q_discover_files(spark, d):
    _, found = _scan_base(spark, d)
    rows = [(ds, kind, p.rsplit("/", 1)[-1]) for ds, kinds in found.items() for kind, ps in kinds.items() for p in ps]
    return spark.createDataFrame(rows, "DATASET_TYPE string, KIND string, FILE_NAME string")


@register("join_outer_tsv", P("base", "grouper") + "select " + ", ".join(f"cast(b.{c} as varchar) {c}" for c in fx.BASE_COLUMNS) +
          ", cast(g.APR_MDC as varchar) APR_MDC, cast(g.APR_DRG as varchar) APR_DRG, cast(g.ILLNESS_SEVERITY as varchar) ILLNESS_SEVERITY "
          "from base b left join grouper g using (RECORD_ID)")
def q_join_outer_tsv(spark, d):
    """Raw extracts end to end: discover, scan base and grouper, left join on RECORD_ID."""
    root = raw_layout(spark, d)
    found = files.discover_files(spark, root, DATASETS)
    bp = [p for v in found.values() for p in v["BASE"]]
    gp = [p for v in found.values() for p in v["GROUPER"]]
    b = files.scan_tsv(spark, bp, fx.BASE_COLUMNS)
    g = files.scan_tsv(spark, gp, fx.GROUPER_COLUMNS)
    return b.join(g, "RECORD_ID", "left")


_RT_SCHEMA = ", ".join(f"{c} {t}" for c, t in [
    ("RECORD_ID", "bigint"), ("DISCHARGE", "string"), ("EMERGENCY_DEPT_FLAG", "string"), ("TYPE_OF_ADMISSION", "string"),
    ("SOURCE_OF_ADMISSION", "string"), ("PAT_ZIP", "string"), ("PAT_COUNTY", "int"), ("PUBLIC_HEALTH_REGION", "int"),
    ("PAT_STATUS", "string"), ("SEX_CODE", "string"), ("RACE", "string"), ("ETHNICITY", "string"), ("ADMIT_WEEKDAY", "int"),
    ("LENGTH_OF_STAY", "int"), ("PAT_AGE", "string"), ("FIRST_PAYMENT_SRC", "string"), ("PRINC_DIAG_CODE", "string"),
    ("APR_MDC", "int"), ("APR_DRG", "int"), ("ILLNESS_SEVERITY", "int")])


@register("scan_csv", P("encounters") + "select * from encounters")
def q_scan_csv(spark, d):
    path = scratch_path(spark, "csv")
    sinks.write_csv(fx.encounters(spark, d), path)
    return files.scan_csv(spark, path, _RT_SCHEMA)


@register("write_csv", P("encounters") + "select * from encounters")
def q_write_csv(spark, d):
    path = scratch_path(spark, "csv")
    sinks.write_csv(fx.encounters(spark, d), path)
    return files.scan_csv(spark, path, _RT_SCHEMA)


@register("write_parquet", P("encounters") + "select * from encounters")
def q_write_parquet(spark, d):
    path = scratch_path(spark, "parquet")
    sinks.write_parquet(fx.encounters(spark, d), path)
    return spark.read.parquet(path)


@register("scan_parquet_projected", P("base") + "select * from base")
def q_scan_parquet_projected(spark, d):
    root = scratch_path(spark, "gold")
    b = fx.encounters(spark, d)
    sinks.write_parquet(b.toDF(*[c.lower() for c in b.columns]), f"{root}/df_base_1")
    return files.scan_parquet_projected(spark, f"{root}/df_base_1", fx.BASE_COLUMNS)


@register("scan_parquet_lazy", P("base") + "select * from base")
def q_scan_parquet_lazy(spark, d):
    root = scratch_path(spark, "gold")
    b = fx.base(spark, d)
    for ds, flag in [("inpatient", "N"), ("outpatient", "Y")]:
        sinks.write_parquet(b.where(F.col("EMERGENCY_DEPT_FLAG") == flag), f"{root}/{ds}")
    return files.scan_parquet_projected(spark, [f"{root}/{ds}" for ds in DATASETS], fx.BASE_COLUMNS)


@register("write_report", P("predictions") + ", " + duck_per_class("predictions") + """
select CLASS, round(PREC, 6) "PRECISION", round(RECALL, 6) RECALL, round(F1, 6) F1, cast(SUPPORT as bigint) SUPPORT from pc
union all select 'macro avg', round(avg(PREC), 6), round(avg(RECALL), 6), round(avg(F1), 6), cast(sum(SUPPORT) as bigint) from pc
union all select 'weighted avg', round(sum(PREC * SUPPORT) / sum(SUPPORT), 6), round(sum(RECALL * SUPPORT) / sum(SUPPORT), 6),
  round(sum(F1 * SUPPORT) / sum(SUPPORT), 6), cast(sum(SUPPORT) as bigint) from pc""")
def q_write_report(spark, d):
    from ...operators import metrics
    rep = metrics.classification_report(fx.predictions(spark, d))
    path = scratch_path(spark, "report")
    sinks.write_report(rep, path)
    return files.scan_csv(spark, path, "CLASS string, PRECISION double, RECALL double, F1 double, SUPPORT bigint")


@register("audit_removed", P("real_test", "synth") +
          "select RECORD_ID, APR_DRG, 'label not in training data' reason from real_test "
          "where APR_DRG is null or APR_DRG not in (select APR_DRG from synth where APR_DRG is not null)")
def q_audit_removed(spark, d):
    kept = fx.synth(spark, d).where(F.col("APR_DRG").isNotNull())
    t = fx.real_test(spark, d).select("RECORD_ID", "APR_DRG")
    return sinks.audit_removed(t, kept, "APR_DRG", "label not in training data")


@register("audit_top_removed", P("real_test", "synth") +
          "select APR_DRG, count(*) n from real_test where APR_DRG is not null and APR_DRG not in "
          "(select APR_DRG from synth where APR_DRG is not null) group by 1 order by n desc, APR_DRG limit 15")
def q_audit_top_removed(spark, d):
    from ...operators.ordering import head_classes
    kept = fx.synth(spark, d).where(F.col("APR_DRG").isNotNull())
    removed = sinks.audit_removed(fx.real_test(spark, d).select("RECORD_ID", "APR_DRG"), kept, "APR_DRG", "x")
    return head_classes(removed, "APR_DRG", 15)


@register("normalize_headers", P("encounters") + "select cast(RECORD_ID as varchar) RECORD_ID, SEX_CODE, PAT_AGE from encounters")
def q_normalize_headers(spark, d):
    path = scratch_path(spark, "messy")
    t = fx.encounters(spark, d).select(F.col("RECORD_ID").alias(" record_id "), F.col("SEX_CODE").alias("Sex_Code "),
                                      F.col("PAT_AGE").alias("  pat_age"))
    sinks.write_csv(t, path)
    raw = spark.read.option("header", True).csv(path)  # no inference: every column a string
    return clean.normalize_headers(raw)


@register("profile_counts", P("base", "grouper") + "select (select count(*) from base) N_BASE, (select count(*) from grouper) N_GROUPER, "
          "(select count(*) from base b left join grouper g using (RECORD_ID)) N_JOINED")
def q_profile_counts(spark, d):
    b, ob = sinks.profile_counts(fx.base(spark, d), "base")
    g, og = sinks.profile_counts(fx.grouper(spark, d), "grouper")
    n = b.join(g, "RECORD_ID", "left").count()  # one pass: the observations ride along
    return spark.createDataFrame([(int(ob.get["rows"]), int(og.get["rows"]), int(n))], "N_BASE bigint, N_GROUPER bigint, N_JOINED bigint")


def county_dim(spark, d):
    """County dimension from the nation table: state code '48' for two regions, FIPS-like county code."""
    n = fx.read_table(spark, d, "nation")
    return n.select(F.when(F.col("n_regionkey").isin(1, 3), "48").otherwise("12").alias("STATEFP"),
                    F.lpad((F.col("n_nationkey") * 2 + 1).cast("string"), 3, "0").alias("COUNTYFP"), F.col("n_name").alias("NAME"))


def _county_oracle() -> str:
    from .similarity import duck_js_by_group
    rep = duck_js_by_group("real_train", "synth", ["PAT_COUNTY"], "APR_MDC", ["real_train", "synth"])
    return (f"select r.PAT_COUNTY, d.NAME, r.JS_similarity from ({rep}) r join "
            "(select cast(lpad(cast(n_nationkey * 2 + 1 as varchar), 3, '0') as int) PAT_COUNTY, n_name NAME from nation "
            "where (case when n_regionkey in (1, 3) then '48' else '12' end) = '48') d on d.PAT_COUNTY = r.PAT_COUNTY")


@register("county_dim_join", _county_oracle())
def q_county_dim_join(spark, d):
    from ...operators.similarity import js_by_group
    rep = js_by_group(fx.real_train(spark, d), fx.synth(spark, d), "PAT_COUNTY", "APR_MDC")
    dim = county_dim(spark, d).where(F.col("STATEFP") == "48").select(F.col("COUNTYFP").cast("int").alias("PAT_COUNTY"), "NAME")
    # the dimension has one row per nation (25)
    return rep.join(F.broadcast(dim), "PAT_COUNTY", "inner").select("PAT_COUNTY", "NAME", "JS_similarity")


@register("chunked_scan", P("base") + "select " + ", ".join(f"cast({c} as varchar) {c}" for c in fx.BASE_COLUMNS) + " from base")
def q_chunked_scan(spark, d):
    """Raw base extracts ingested a file per micro-batch by a file stream, appended to Parquet."""
    from ...streaming.ingest import chunked_ingest
    root = raw_layout(spark, d)
    out, ckpt = scratch_path(spark, "chunked_out"), scratch_path(spark, "chunked_ckpt")
    chunked_ingest(spark, f"{root}/*", fx.BASE_COLUMNS, out, ckpt, name_glob="*BASE*", files_per_batch=2)
    return spark.read.parquet(out).select(*fx.BASE_COLUMNS)
