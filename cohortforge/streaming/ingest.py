"""Chunked (incremental) ingestion of raw extracts with Structured Streaming.

The reference appends raw rows chunk by chunk; here the file stream source takes a bounded number
of new files per micro-batch and appends them to a Parquet sink. Progress lives in a checkpoint
under the shared checkpoint folder, so a restarted or failed job resumes exactly where it stopped
(file source + file sink are exactly-once). `availableNow` processes what is there and stops.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from fnmatch import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.files import CORRUPT, ENCODING, by_name, files_by_header, header_names, positional_schema, too_long


def chunked_ingest(spark: SparkSession, root_glob: str, columns: Sequence[str], out: str, checkpoint: str,
                   name_glob: str = "*BASE*", files_per_batch: int = 1, encoding: str = ENCODING) -> int:
    """Stream tab-separated extracts matching `name_glob` under `root_glob` into Parquet at `out`. As in scan_tsv, columns are
    found by each file's header, long lines are dropped and short ones null-padded. Returns the number of micro-batches run."""
    headers = {h: [f for f in fs if fnmatch(os.path.basename(f), name_glob)] for h, fs in
               files_by_header(spark, root_glob, encoding).items()}
    headers = [(h, fs) for h, fs in headers.items() if fs]
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    of_file = spark.createDataFrame([(f, i) for i, (_, fs) in enumerate(headers) for f in fs], "f string, _h int")
    of_file = of_file.select(plain("f").alias("_f"), "_h")
    lines = (
        spark.readStream.format("text").option("pathGlobFilter", name_glob).option("maxFilesPerTrigger", files_per_batch)
        .load(root_glob)
        .select(F.decode(F.col("value").cast("binary"), encoding).alias("line"),
                F.col("_metadata.file_path").alias("SOURCE_FILE"))
        .join(of_file, plain("SOURCE_FILE") == F.col("_f"))
    )
    rows = None
    for i, (header, _) in enumerate(headers):
        names = header_names(header)
        parsed = F.from_csv("line", positional_schema(names).toDDL(),
                            {"sep": "\t", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
        part = lines.where((F.col("_h") == i) & (F.col("line") != header) & (F.col("line") != "")).select(
            parsed.alias("_r"), "SOURCE_FILE").select("_r.*", "SOURCE_FILE")
        part = part.where(~too_long(len(names))).select(*by_name(names, columns), "SOURCE_FILE")
        rows = part if rows is None else rows.unionByName(part)
    q = (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return (q.lastProgress["batchId"] + 1) if q.lastProgress else 0
