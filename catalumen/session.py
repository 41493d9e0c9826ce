"""Session helpers: a tuned builder and the shared checkpoint folder."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "catalumen", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are written for.

    On a cluster the caller's own session is used instead; nothing in the
    library depends on these values for correctness.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Array and vector aggregates keep hashing for up to a few thousand classes.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A session without that setting uses a folder below ``spark.sql.warehouse.dir``
    if that is in a shared store, or if driver and executors are one machine.
    Otherwise it stops: executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if root is None:
        root = context.getCheckpointDir()
    if root is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        scheme = urlparse(warehouse).scheme or urlparse(context._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:/").scheme
        refuse_local_folder(scheme, context.master)
        root = warehouse + "/_scratch"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def refuse_local_folder(scheme: str, master: str) -> None:
    """Only ``local[...]`` runs all tasks where a ``file:`` folder of the driver is."""
    if scheme == "file" and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share; "
                           "spark.sql.warehouse.dir is on the driver's own disk")


def cut_lineage(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Write a frame to the shared folder and go on from the written table.

    Later plans read it column by column instead of repeating the work, and a
    lost executor only costs the tasks that read from the table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared root."""
    return f"{shared_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
