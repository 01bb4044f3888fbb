"""File sources: raw tab-separated extracts, CSV, projected Parquet scans.

Scans use explicit schemas (never inference), so leading zeros and string codes survive and no
extra pass over the data is spent on sampling types. File discovery lists metadata only.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt_record"
ENCODING = "ISO-8859-1"


def _files(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """The data files under paths, folders or globs (metadata only); names that start with _ or . are no data."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in [paths] if isinstance(paths, str) else paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        for found in fs.globStatus(p) or []:
            it = fs.listFiles(found.getPath(), True)
            while it.hasNext():
                f = it.next()
                if f.getLen() and f.getPath().getName()[0] not in "_.":
                    out.append(f.getPath().toString())
    return sorted(out)


def read_header(spark: SparkSession, path: str, encoding: str = ENCODING) -> str:
    """First line of a file."""
    io = spark.sparkContext._jvm.java.io
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = io.BufferedReader(io.InputStreamReader(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p), encoding))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def files_by_header(spark: SparkSession, paths: str | Sequence[str], encoding: str = ENCODING) -> dict[str, list[str]]:
    """Files grouped by their header line, so that columns are found by name in each."""
    groups: dict[str, list[str]] = {}
    for f in _files(spark, paths):
        groups.setdefault(read_header(spark, f, encoding), []).append(f)
    return groups


def header_names(header: str, sep: str = "\t") -> list[str]:
    return [x.strip() for x in next(csv.reader([header], delimiter=sep))]


def positional_schema(names: Sequence[str]) -> StructType:
    """A string column per header field plus the whole line where the number of fields differs."""
    return StructType([StructField(f"_c{i}", StringType(), True) for i in range(len(names))]
                      + [StructField(CORRUPT, StringType(), True)])


def by_name(names: Sequence[str], columns: Sequence[str]) -> list[Column]:
    """The asked columns, found by header name; a column the file lacks is null."""
    return [(F.col(f"_c{names.index(c)}") if c in names else F.lit(None).cast("string")).alias(c) for c in columns]


def too_long(n_fields: int, sep: str = "\t") -> Column:
    """Lines with more fields than the header, empty ones included (short lines are filled with nulls and kept)."""
    line = F.col(CORRUPT)
    tabs = F.length(line) - F.length(F.replace(line, F.lit(sep), F.lit("")))
    # the reader refuses queries on the corrupt-record column alone (a bare count), so a field is always read with it
    return line.isNotNull() & (tabs >= n_fields) & (F.coalesce(F.length("_c0"), F.lit(0)) >= 0)


def _tsv_groups(spark: SparkSession, paths: str | Sequence[str], encoding: str):
    for header, files in files_by_header(spark, paths, encoding).items():
        names = header_names(header)
        reader = (spark.read.schema(positional_schema(names)).option("sep", "\t").option("header", True)
                  .option("encoding", encoding).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
                  .option("columnPruning", False))  # a pruned parser does not see how many fields a line has
        yield names, reader.csv(files)


def scan_tsv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], encoding: str = ENCODING,
             with_path: bool = False) -> DataFrame:
    """Tab-separated files with a header, every column a string, Latin-1.

    Columns are found by the name in each file's own header: files may order them differently, hold others besides or lack some
    (null). A line with more fields than its header is a bad line and dropped (see bad_lines), a short one is filled with nulls.
    """
    out = None
    for names, df in _tsv_groups(spark, paths, encoding):
        cols = by_name(names, columns)
        if with_path:
            cols.append(F.col("_metadata.file_path").alias("_file_path"))
        part = df.where(~too_long(len(names))).select(*cols)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [*columns, *["_file_path"] * with_path]))
    return out


def bad_lines(spark: SparkSession, paths: str | Sequence[str], encoding: str = ENCODING) -> DataFrame:
    """(_file_path, N_BAD): how many lines scan_tsv drops per file that has some."""
    out = spark.createDataFrame([], "_file_path string, N_BAD bigint")
    for names, df in _tsv_groups(spark, paths, encoding):
        bad = df.where(too_long(len(names))).select(F.col("_metadata.file_path").alias("_file_path"))
        out = out.union(bad.groupBy("_file_path").agg(F.count(F.lit(1)).alias("N_BAD")))
    return out


def list_files(spark: SparkSession, root: str, suffix: str = ".txt") -> list[str]:
    """Recursive listing through the Hadoop FileSystem API (metadata only, driver side)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    it = fs.listFiles(path, True)
    out = []
    while it.hasNext():
        p = it.next().getPath().toString()
        if p.endswith(suffix):
            out.append(p)
    return sorted(out)


def discover_files(spark: SparkSession, root: str, datasets: Sequence[str]) -> dict[str, dict[str, list[str]]]:
    """Per dataset directory: BASE and GROUPER files by name. Outpatient folders accept any name
    containing BASE / GROUPER; the others need IP_ED_BASE_DATA_1 / IP_ED_GROUPER. A missing folder
    or one without files is skipped; nothing found at all is an error."""
    found: dict[str, dict[str, list[str]]] = {}
    for ds in datasets:
        files = list_files(spark, f"{root.rstrip('/')}/{ds}")
        if not files:
            continue
        names = [(f, f.rsplit("/", 1)[-1]) for f in files]
        if "OUTPATIENT" in ds.upper():
            base = [f for f, n in names if "BASE" in n]
            grouper = [f for f, n in names if "GROUPER" in n]
        else:
            base = [f for f, n in names if "IP_ED_BASE_DATA_1" in n]
            grouper = [f for f, n in names if "IP_ED_GROUPER" in n]
        if base or grouper:
            found[ds] = {"BASE": base, "GROUPER": grouper}
    if not found:
        raise FileNotFoundError(f"no input files under {root}")
    return found


def tag_dataset(df: DataFrame, path_col: str = "_file_path", out: str = "DATASET_TYPE") -> DataFrame:
    """DATASET_TYPE = name of the folder holding each row's file."""
    return df.withColumn(out, F.regexp_extract(F.col(path_col), r"/([^/]+)/[^/]+$", 1)).drop(path_col)


def scan_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def scan_parquet_projected(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Parquet scan keeping a fixed column list (pruned at the scan) with upper-cased names."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else list(paths)))
    lookup = {c.strip().upper(): c for c in df.columns}
    return df.select(*[F.col(lookup[c.upper()]).alias(c.upper()) for c in columns if c.upper() in lookup])
