"""Session plumbing shared by all jobs: table access, shared scratch storage and code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Compressed bytes of a shuffle that adaptive execution gives to one task.
SHARE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
ROOT = str(Path(__file__).resolve().parent.parent)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep Arrow batches small enough for very long texts.

    On a cluster the package is installed on the executors or sent with ``--py-files``; the path set here is for
    executors that see the same checkout.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def freed_shuffles(spark: SparkSession) -> SparkSession:
    """Let shuffle files go as soon as the action that made them has ended, not when the driver happens to collect its garbage.

    For loops that write each round: what a round shuffled isn't read again. An action that does need it makes it anew.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def measured_joins(spark: SparkSession) -> SparkSession:
    """Let joins broadcast a side only by its measured size, not by the planner's estimate.

    The estimate takes a compressed file's bytes for its rows' and leaves out what explode adds, so that sides of gigabytes
    passed as small ones and were gathered on the driver. Adaptive execution knows a side's size once it is shuffled. A task's
    share of a shuffle is a quarter of Spark's own, unless the session sets one: its rows take many times the compressed bytes.
    """
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if most != "-1":
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", most)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    if spark.conf.get(SHARE, None) is None:
        spark.conf.set(SHARE, "16m")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables: what ``spark.checkpoint.dir`` names, or a temporary one on a local master.

    On a cluster without that setting there is no folder that all machines see, which is an error.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="terrane-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: later jobs scan columns of it instead of recomputing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
