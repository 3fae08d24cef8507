"""Online learning: a stream of episode files, each micro-batch learned into versioned state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engram.config import MemoryConfig
from engram.operators.cuts import cut
from engram.operators.learning import learn, retain
from engram.schema import EPISODES


def read_episodes(spark: SparkSession, folder: str, schema: str = EPISODES, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def learned_so_far(spark: SparkSession, state: str, number: int, schema: str) -> DataFrame:
    """The episodes of the batches before this one."""
    log = spark.read.schema(f"{schema}, batch long").parquet(f"{state}/episodes")
    return log.where(F.col("batch") < number).drop("batch")


def learn_online(episodes: DataFrame, state: str, checkpoint: str, cfg: MemoryConfig = MemoryConfig()) -> StreamingQuery:
    """Learn every micro-batch into {state}/edges/v{batch} and {state}/triggers/v{batch}; its episodes go to {state}/episodes.

    Version 0 of edges and triggers must be there.  A batch does all that learn() does: promotion, learned triggers
    from the contexts of the episodes before, decay cycles between ticks, those between two batches too, and the cap.  So
    episodes in the order of their numbers give the state that learn() gives of all at once, however they fall into
    batches.  A batch reads the version before it and writes its own anew, so one that is repeated after a failure
    gives the same result.
    """
    spark = episodes.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in episodes.schema)

    def fold(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/episodes/batch={number}")
        own = spark.read.schema(batch.schema).parquet(f"{state}/episodes/batch={number}")
        before = learned_so_far(spark, state, number, schema)
        last = before.agg(F.max("episode_seq")).first()[0]
        edges, triggers = spark.read.parquet(f"{state}/edges/v{number}"), spark.read.parquet(f"{state}/triggers/v{number}")
        edges, triggers = learn(edges, triggers, own, cut, cfg, None, retain(before, cfg), last)
        edges.write.mode("overwrite").parquet(f"{state}/edges/v{number + 1}")
        triggers.write.mode("overwrite").parquet(f"{state}/triggers/v{number + 1}")

    return episodes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
