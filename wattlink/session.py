"""Session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators count on. They are only filled in where the session has
# no explicit value, so a cluster's own tuning always wins.
RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot key is split even where splitting costs one more shuffle downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3.0",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply `RUNTIME_DEFAULTS` to a session without overriding explicit settings, and ship the package."""
    explicit = {key for key, _ in spark.sparkContext.getConf().getAll()}
    for key, value in RUNTIME_DEFAULTS.items():
        if key not in explicit:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per Spark application, so that Python stages find it
    wherever the session was started from."""
    context = spark.sparkContext
    if getattr(context, "_wattlink_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="wattlink-package-")  # on the driver, which serves the file
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "wattlink.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for top, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(top, name)
                    z.write(file, os.path.join("wattlink", os.path.relpath(file, here)))
    context.addPyFile(archive)
    context._wattlink_shipped = True


def build_session(app: str = "wattlink", master: str | None = None, **conf: str) -> SparkSession:
    # checkpoints of finished loops are removed once nothing refers to them
    builder = SparkSession.builder.appName(app).config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return os.path.dirname(current.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="wattlink-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a table written by a job."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition by distinct-ish columns over all tasks of a shuffle. Adaptive execution sizes
    partitions by bytes, which leaves few rows with much work each in too few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as Parquet below the shared folder and continue from the copy, where later steps
    prune columns, filter or need the size of what was written."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """Write `df` to reliable storage once and continue from the written copy.

    Used where a later step must see exactly the same rows and partitions again (row numbers,
    iterative loops); it survives the loss of executors.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
