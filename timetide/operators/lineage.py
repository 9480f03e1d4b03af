"""Cutting lineage where every executor can read the result again."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> None:
    """Make sure that a checkpoint folder is set: the session's own (spark.checkpoint.dir).

    Only a local master, where all tasks share this machine's folders, gets a temporary one if none is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        told = spark.conf.get("spark.checkpoint.dir", None)
        if told is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            told = tempfile.mkdtemp(prefix="timetide-checkpoints-")
            atexit.register(shutil.rmtree, told, True)
        context.setCheckpointDir(told)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark can reach; none is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
