"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The checkpoint folder: the session's own, its setting spark.checkpoint.dir, or in local mode a temporary one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        path = context.getConf().get("spark.checkpoint.dir")
        if not path and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and kept when executors are lost; Spark deletes it once nothing refers to it, if the session says so
    (spark.cleaner.referenceTracking.cleanCheckpoints)."""
    folder(df.sparkSession)
    return df.checkpoint()


def tabled(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written once as a table to the checkpoint folder, and the table's path.

    A table's estimated size is that of its files; a checkpoint would pass its plan's on, which a join in every round of a loop squares.
    """
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table that tabled() wrote."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
