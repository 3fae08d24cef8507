"""Cuts of a plan: what several later steps read is written once to the checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_folder(spark: SparkSession) -> None:
    """The session's checkpoint folder; on a single machine, as in tests, one below /tmp if none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "/tmp/engram-checkpoints"
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    ensure_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet beside the checkpoints: later reads take the columns they need."""
    ensure_folder(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
