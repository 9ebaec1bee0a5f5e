"""Session construction and shared-storage locations.

Library code never builds its own session; it receives one. ``build_session``
is for tests, ``bench.py`` and command-line use.

Intermediate tables (lineage cuts in iterative jobs, CSV round trips) are
written below the folder the cluster names in ``spark.checkpoint.dir``. That
folder is read from the session; a private temporary one is set only in local mode.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "postpulse", cpus: int | None = None,
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("POSTPULSE_DRIVER_MEMORY", default_heap()))
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide checkpoint folder.

    Unset, it is an error on a cluster (each executor would write to its own disk) and a
    temp folder in local mode, where there is one machine.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session has no SparkContext here
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            return configured.rstrip("/")
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        # setCheckpointDir appends a per-application subfolder; use its parent
        return current.rstrip("/").rsplit("/", 1)[0]
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="postpulse-ckpt-")
    sc.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh, never-reused location below the shared folder."""
    path = f"{shared_dir(spark)}/postpulse-scratch/{tag}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def stored(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Written below the shared folder and read back: computed once, survives lost executors."""
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The same rows dealt evenly over the tasks of a shuffle, for costly work per row.

    A scan has one task per row group and a multi-line text file is one task, however many
    rows they hold.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


_scratch: list[str] = []


def release_scratch(spark: SparkSession) -> int:
    """Delete every scratch copy made so far in this process; the number deleted.

    For callers that are done with all results built on them.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def default_heap() -> str:
    """Half of the machine's memory, 16 GB at most."""
    total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    return f"{max(1, min(16, total // 2**31))}g"
