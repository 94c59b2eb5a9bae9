"""Session helpers: a tuned local session for tests/bench and lineage cutting.

Library code never invents storage locations on a cluster: lineage is cut
with ``DataFrame.checkpoint()`` into the folder the cluster names in
``spark.checkpoint.dir``.  Only test / bench sessions set that folder, and
only when it is unset.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, partitions: int | None = None,
                  app: str = "somnolyt") -> SparkSession:
    """Session for tests and the bench (local mode, UI off, AQE on)."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    partitions = partitions or cpus
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.default.parallelism", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SOMNOLYT_DRIVER_MEM", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the session, if any."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return spark.sparkContext.getCheckpointDir()
    return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the session's checkpoint folder; create a scratch one only when
    none is configured (local tests and bench)."""
    d = checkpoint_dir(spark)
    if d:
        return d
    master = spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    scratch = tempfile.mkdtemp(prefix="somnolyt-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(scratch)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, reliable: bool = True) -> DataFrame:
    """Cut lineage of an expensive intermediate.

    With a checkpoint folder the rows are written there (survives executor
    loss without recomputing the upstream); otherwise the frame is persisted
    to memory and disk, so a lost block is recomputed from lineage.
    """
    spark = df.sparkSession
    if reliable and checkpoint_dir(spark):
        out = df.checkpoint(eager=True)
    else:
        out = df.persist(StorageLevel.MEMORY_AND_DISK)
    out._somnolyt_materialized = True
    return out


def is_materialized(df: DataFrame) -> bool:
    """True for a frame that ``materialize`` returned (no second copy needed)."""
    return getattr(df, "_somnolyt_materialized", False)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A location for intermediate tables: under ``somnolyt.output.dir`` or
    the checkpoint folder (both shared on a cluster)."""
    root = spark.conf.get("somnolyt.output.dir", None) or ensure_checkpoint_dir(spark)
    root = root.rstrip("/")
    return f"{root}/{name}"
