"""Schemas of the state tables, and their enumerated values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE_TYPES = ("hard", "soft", "diffuse")
NODE_TYPES = ("document", "section")
TRIGGER_ORIGINS = ("explicit", "inferred", "hebbian")

NODES = "id STRING, title STRING, content STRING, node_type STRING, parent_id STRING, embedding ARRAY<FLOAT>, access_count INT, last_accessed TIMESTAMP, created_at TIMESTAMP, seq BIGINT"
EDGES = "source_id STRING, target_id STRING, weight DOUBLE, edge_type STRING, co_activation_count INT, last_strengthened TIMESTAMP"
TRIGGERS = "id STRING, pattern ARRAY<STRING>, pattern_embedding ARRAY<FLOAT>, associated_node_id STRING, confidence DOUBLE, fire_count INT, useful_count INT, origin STRING, created_at TIMESTAMP"
EPISODES = "episode_seq BIGINT, context STRING, context_embedding ARRAY<FLOAT>, retrieved_ids ARRAY<STRING>, triggered_ids ARRAY<STRING>, useful_ids ARRAY<STRING>, ts TIMESTAMP"
DOCUMENT = "STRUCT<id: STRING, title: STRING, text: STRING, is_supporting: BOOLEAN>"
EXAMPLES = f"id STRING, benchmark STRING, query STRING, answer STRING, answer_aliases ARRAY<STRING>, documents ARRAY<{DOCUMENT}>, supporting_doc_ids ARRAY<STRING>, reasoning_chain ARRAY<STRUCT<question: STRING, answer: STRING, supporting_doc_id: STRING>>, category STRING, metadata MAP<STRING, STRING>"


def valid_id(c: Column) -> Column:
    """Ids have 1 to 256 characters and no NUL."""
    return c.isNotNull() & F.length(c).between(1, 256) & ~F.contains(c, F.lit("\x00"))


def require_valid_ids(df: DataFrame, *columns: str) -> DataFrame:
    """df, failing at run time on a row with an id that isn't valid."""
    for c in columns:
        df = df.withColumn(c, F.when(valid_id(F.col(c)), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"invalid {c}: "), F.coalesce(F.col(c), F.lit("null"))))))
    return df


def usefulness(useful: Column, fired: Column) -> Column:
    return F.when(fired > 0, useful / fired).otherwise(F.lit(0.0))
