"""Session helpers: sensible defaults, checkpoint folder, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "corpuskit", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CORPUSKIT_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting gets a temporary one; on a cluster a
    missing setting is an error, because a machine-local folder would not survive a
    lost executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the checkpoint folder and read it back: lineage ends, columns can be pruned."""
    path = f"{checkpoint_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialised(df: DataFrame, *keys: str) -> DataFrame:
    """A compact table that several later steps read, evenly spread by ``keys``."""
    return checkpointed(df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys))


def small_or_shuffled(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Mark ``df`` for broadcast only when a bounded count proves it small.

    ``limit(max_rows + 1)`` stops the count early, so a large table costs no
    more than ``max_rows`` rows; beyond the bound both sides are shuffled for a
    merge join, which adaptive execution splits on hot keys.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a small input one partition per core; a big input is left as it is.

    Small compute-heavy tables (a vocabulary, one Parquet row group) would
    otherwise run in a single task.  Hashing on ``keys`` keeps retries stable.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
