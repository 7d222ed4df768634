"""Session helpers: time zone, cluster defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "fairlead", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Shuffle partitions stay adaptive: the initial number is an upper bound that
    AQE coalesces, so the same code runs on a laptop and on a large cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Row limits per group are applied before the shuffle up to this limit.
        "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Naive timestamps in source tables are UTC; pin the session to it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder the cluster shares for checkpoints.

    The folder comes from ``spark.checkpoint.dir``.  Only a local session may
    fall back to a temporary folder: on a cluster that would be machine-local.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="fairlead-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df, label: str):
    """Write an intermediate result once to the shared folder and read it back.

    Used where several branches need the same expensive rows: the table survives
    lost executors, cuts the lineage and is read column by column.  Shuffle files of the
    write go when it has ended: nothing reads them again.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def release(*tables) -> None:
    """Remove tables that ``stage`` wrote, once nothing reads them any more; others are left alone.

    Only for tables that no returned DataFrame still reads: those are lazy.
    """
    for table in tables:
        path = getattr(table, "written_at", None)
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(df):
    """Spread the rows of a small input over all cores before expensive per-row work.

    A landing file with one row group is decoded by one task, however many cores
    there are.  Inputs with at least one split per core are left as they are.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df
