"""Session helpers: table access and reliable checkpoints."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, a temporary one only where that is unset (local tests)."""
    context = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="oxbow-checkpoint-"))
    return context.getCheckpointDir()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared storage."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def collect_garbage(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage now: the heap shrinks, and Spark drops shuffles, broadcasts and checkpoints that nothing refers to.

    Stages leave blocks of broadcasts on the driver's heap; many short stages let it grow towards its limit before the collector ends a round by itself.
    """
    spark._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint in the shared folder; lost executors don't lose it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
