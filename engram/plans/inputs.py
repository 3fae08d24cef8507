"""The engine's inputs, made from the registered tables: sections, queries, triggers, episodes, texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.config import MemoryConfig
from engram.operators import graph, pivots
from engram.operators.cuts import cut
from engram.operators.search import similarities
from engram.operators.similarity_graph import SimilarityGraph, TriggerIndex

#: Every EVERY-th vector is a query, against all.
EVERY = 50
CFG = MemoryConfig()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent_id, embedding: every vector is a section, its label the parent."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("parent_id"), "embedding")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text, embedding."""
    s = sections(spark, sf_dir).where(F.col("id") % EVERY == 0)
    return s.select(F.col("id").alias("query_id"), F.concat(F.lit("about label"), "parent_id").alias("text"), "embedding")


def section_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trigger on each section: its label as keyword, its vector as pattern."""
    return sections(spark, sf_dir).select("id", F.array(F.concat(F.lit("label"), "parent_id")).alias("pattern"), "embedding", F.col("id").alias("node_id"), F.lit(1.0).alias("confidence"))


def semantic(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return pivots.nearest(queries(spark, sf_dir), sections(spark, sf_dir), k, exclude_self=True)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.similarity_edges(sections(spark, sf_dir), CFG)


def similarity_graph(spark: SparkSession, sf_dir: str) -> SimilarityGraph:
    """edges(), for passes that need not write them."""
    return SimilarityGraph(sections(spark, sf_dir), CFG)


def trigger_index(spark: SparkSession, sf_dir: str) -> TriggerIndex:
    return TriggerIndex(section_triggers(spark, sf_dir), sections(spark, sf_dir), CFG)


def counted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity edges with co-activation counts, as if learning had begun: a fixed function of the ends."""
    return counted(edges(spark, sf_dir))


def counted(edges: DataFrame) -> DataFrame:
    return edges.withColumn("co_activation_count", F.pmod(F.col("source_id") + F.col("target_id"), F.lit(20)).cast("int"))


def counts(source: int, targets: np.ndarray) -> np.ndarray:
    """The counts of counted() for the edges of a source."""
    return (source + targets) % 20


def named(spark: SparkSession, sf_dir: str, *lists: str) -> tuple[DataFrame, DataFrame]:
    """id of the nodes that these lists of the episodes name, and of the others: learning leaves the edges out of those alone."""
    ids = cut(episodes(spark, sf_dir).select(F.explode(F.array_union(lists[0], lists[-1])).alias("id")).distinct())
    return ids, sections(spark, sf_dir).select("id").join(ids, "id", "left_anti")


def pair_sims(pairs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, id, sim of given pairs only."""
    return similarities(pairs, queries(spark, sf_dir), sections(spark, sf_dir))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly episodes of the events: nodes are the property k, useful those bought or signed up for."""
    e = table(spark, sf_dir, "events").select((F.unix_timestamp("ts") / 3600).cast("long").alias("episode_seq"), F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type", "event_id")
    useful = F.when(F.col("event_type").isin("purchase", "signup"), F.col("k"))
    clicked = F.when(F.col("event_type").isin("click", "purchase"), F.col("k"))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), " ")
    return e.groupBy("episode_seq").agg(words.alias("context"), F.array_sort(F.collect_set("k")).alias("retrieved_ids"), F.array_sort(F.collect_set(clicked)).alias("triggered_ids"), F.array_sort(F.collect_set(useful)).alias("useful_ids"))


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, content: the documents with every third line made a heading."""
    lines = F.transform(F.split("text", "\n", -1), lambda s, i: F.when(i % 3 == 0, F.concat(F.lit("## "), s)).otherwise(s))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(lines, "\n").alias("content"))
