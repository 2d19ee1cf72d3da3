"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, app: str = "formline", legacy_charsets: bool = False) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Sizes are those of compressed files; rows in memory are several times larger.
        .config("spark.sql.autoBroadcastJoinThreshold", "3m")
        .config("spark.sql.session.timeZone", "UTC")
        # Call sites for error messages cost several JVM calls per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FORMLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if legacy_charsets:
        # Needed to read windows-31j files; kept out of the default session.
        builder = builder.config("spark.sql.legacy.javaCharsets", "true")
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None) and not session.sparkContext.getCheckpointDir():
        # Driver and executors are one process here.
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="formline-"))
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of frames that nothing refers to any more: Spark removes them when the driver's collector
    finds that out, which may be long after they fill the disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut_lineage(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write the frame to the shared folder, in folders `by` these columns, and read it back: survives lost executors."""
    path = scratch_path(df.sparkSession, "stage")
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns] if by else "*")
