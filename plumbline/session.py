"""Session construction and the shared folder used for cut points in iterative jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every operator assumes: UTC, ANSI, AQE with skew splitting."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder visible to every executor, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: there, driver and executors are
    one process, so the folder is shared by construction.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured:
        configured = context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="plumbline-")
        context.setCheckpointDir(configured)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def work_path(spark: SparkSession, *parts: str) -> str:
    """Path below :func:`shared_dir`, unique per call."""
    return "/".join([shared_dir(spark).rstrip("/"), "plumbline", uuid.uuid4().hex, *parts])


def cut_lineage(df):
    """Reliable checkpoint: the plan restarts from files in the shared folder that outlive any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame) -> DataFrame:
    """The same rows dealt to four tasks a core: a small file, or one that can't be split, holds rows enough to keep one task busy for long."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes files or folders with all they hold, on whatever file system their paths name; missing ones are passed over."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, without a failed read in the log."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
