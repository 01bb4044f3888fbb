"""Session helpers: builder defaults, checkpoint folder, scratch paths, size-checked broadcast.

Nothing here starts a server: the UI stays off. On a cluster the session is created by the
platform and these helpers only read it; `get_session` is for tests, the bench and scripts.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Broadcast hints are placed only when the optimizer's size estimate of the side is below this.
# The estimate counts a file scan by its stored size and does not see rows multiplied by explode, so it is no
# proof: callers pass aggregates or stored tables; anything larger is left to sort-merge join and AQE's runtime switch.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def get_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "cohortforge") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor, so give it the memory
            builder = builder.config("spark.driver.memory", os.environ.get("COHORTFORGE_DRIVER_MEMORY", "16g"))
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    The cluster names it in ``spark.checkpoint.dir``; only a local master without that setting (tests)
    gets a fresh folder under the system temp dir. Elsewhere executors could not see such a folder: an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="cohortforge-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder for intermediate tables and file round trips."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df`` (a BigInt, which arrives as Python's integer). Long chains of joins multiply estimates to
    thousands of digits, which Python refuses to read; that is more than any limit."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    try:
        return int(stats.sizeInBytes())
    except ValueError:
        return 1 << 62


def bounded_broadcast(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only behind a size check; otherwise the plain side (SMJ or AQE decides at run time)."""
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss; never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def released(spark: SparkSession) -> None:
    """Have the shuffle files and checkpoints of frames that are gone removed now; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
