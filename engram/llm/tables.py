"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a folder below /tmp on a single machine, as in tests, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "/tmp/engram-checkpoints"
    return folder.rstrip("/")


#: Bytes that Spark sends to a Python worker at once: texts are long, and both sides hold a batch in memory.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != str(BATCH_BYTES):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stage(df: DataFrame, name: str, compression: str = "none") -> DataFrame:
    """df, written once to the shared folder and read again: a lost executor costs no recomputation before it.

    Hashes don't compress, and codecs hold memory outside the heap; so nothing is compressed unless asked for.
    """
    path = f"{shared_folder(df.sparkSession)}/engram-{name}-{uuid.uuid4().hex}"
    small_batches(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Deletes staged tables; for those that only tables staged since then were made from."""
    for df in staged:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(df._staged_at)
        at.getFileSystem(conf).delete(at, True)


def unused(columns: list[str], name: str) -> str:
    """name with as many underscores before it as make it no column's name."""
    lower = {c.lower() for c in columns}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
