"""A memory: its state tables as Parquet snapshots, and the calls that index, retrieve, learn and consolidate.

Each call that changes the state reads the newest version below the folder and writes the next, so one
that fails half way is repeated without harm; older versions stay until they are deleted.  Tables lie in
hash buckets (sources/buckets.py), and a version shares those that a call doesn't change with the one before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.config import MemoryConfig
from engram.functions.text import document_text
from engram.operators import gate, graph, ingest, learning, search, vector_index
from engram.operators.vector_cache import VectorCache
from engram.schema import require_valid_ids
from engram.sources.buckets import Buckets, Change, differing

TABLES = {
    "nodes": "id string, title string, content string, node_type string, parent_id string, embedding array<double>, access_count int",
    "edges": "source_id string, target_id string, weight double, edge_type string, co_activation_count int",
    "explicit": "id string, pattern array<string>, pattern_embedding array<double>, associated_node_id string, confidence double, origin string",
    "triggers": "id string, pattern array<string>, pattern_embedding array<double>, associated_node_id string, confidence double, fire_count int, useful_count int, origin string",
    "episodes": "episode_seq bigint, context string, context_embedding array<double>, retrieved_ids array<string>, triggered_ids array<string>, useful_ids array<string>",
    "consolidated": "episode_seq bigint",
    "cells": vector_index.SCHEMA,
}
KEYS = {"nodes": ["id"], "edges": ["source_id", "target_id"], "explicit": ["id"], "triggers": ["id"], "episodes": ["episode_seq"], "consolidated": ["episode_seq"], "cells": ["generation"]}
#: A count that no edge reaches: promotion switched off.
NEVER = 1 << 30


def _as_text(text: Column) -> Column:
    """In place of an embedding: the text, which _vectors() turns into one."""
    return text


class Memory:
    """level "section": documents are split, and sections retrieved; "document": whole documents.

    version: the snapshot to open; by default a new, empty memory is made.  embed: a column function from
    text to a vector.  gate: a function over guarded candidates (query_id, id, score), used if cfg enables it; or ask: a
    model that answers a batch of the gate's prompts.  cache: a folder for vectors by text, so that over all calls, and all
    memories with the same embed that share it, each text is encoded once; worth it where embed is a model.
    """

    def __init__(self, spark: SparkSession, folder: str, level: str = "section", cfg: MemoryConfig = MemoryConfig(), embed: Callable[[Column], Column] = ingest.hashed_embedding, gate: Callable[[DataFrame], DataFrame] | None = None, version: int | None = None, ask: Callable[[pd.Series], pd.Series] | None = None, cache: str | None = None) -> None:
        if level not in ("section", "document"):
            raise ValueError("level must be section or document")
        self.spark, self.folder, self.level, self.cfg, self.embed, self.gate, self.ask = spark, folder, level, cfg, embed, gate, ask
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(f"{folder}/cuts")
        self.cache = VectorCache(spark, cache, embed) if cache else None
        self.state = Buckets(spark, folder, TABLES, KEYS)
        self.version = 0 if version is None else version
        if version is None:
            self.reset()

    def reset(self) -> None:
        """Forget everything: an empty version follows."""
        self._write({n: self.spark.createDataFrame([], s) for n, s in TABLES.items()})

    def table(self, name: str, keys: DataFrame | None = None) -> DataFrame:
        """A table of the state; keys: only rows whose first key column is among these, read from their buckets."""
        return self.state.table(name, self.version, keys)

    def _write(self, changed: dict[str, DataFrame | Change]) -> None:
        """The next version: changed tables by name, whole or as changes, the others as they are; columns by the schemas above."""
        self.version = self.state.write(self.version, changed)

    def _vectors(self, df: DataFrame, column: str) -> DataFrame:
        """df with the vectors of a column's texts in their place."""
        return self.cache.vectors(df, column) if self.cache else df.withColumn(column, self.embed(F.col(column)))

    def _asked(self, docs: DataFrame) -> DataFrame:
        """Explicit triggers of docs (id, content)."""
        return self._vectors(ingest.explicit_triggers(docs, _as_text), "pattern_embedding")

    def index(self, docs: DataFrame, rebuild: bool = False, replace: bool = False) -> None:
        """Add documents (id, title, text), ids distinct.

        Sections: sections of known documents are replaced by id; those that a document no longer has stay, unless
        replace is set: then they go, with the edges and triggers that they had.  Documents: known ones are
        skipped; rebuild makes the edges of all pairs anew, which wipes what these have learned.
        """
        docs = require_valid_ids(docs.select(F.col("id").cast("string"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")), "id")
        (self._index_sections if self.level == "section" else self._index_documents)(docs, replace if self.level == "section" else rebuild)

    def _index_sections(self, docs: DataFrame, replace: bool) -> None:
        docs = docs.withColumnRenamed("text", "content")
        sections = self._vectors(ingest.sections(docs, _as_text), "embedding").checkpoint()
        nodes, known_edges, explicit, triggers = (self.table(x) for x in ("nodes", "edges", "explicit", "triggers"))
        gone = None
        if replace:
            own = nodes.where("node_type = 'section'").join(docs.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
            gone = own.join(sections.select("id"), "id", "left_anti").select("id").checkpoint()
            without = lambda df, c: df.join(gone.withColumnRenamed("id", c), c, "left_anti").select(*df.columns)
            nodes, known_edges = without(nodes, "id"), without(without(known_edges, "source_id"), "target_id")
            explicit, triggers = without(explicit, "associated_node_id"), without(triggers, "associated_node_id")
            # explicit triggers of a section's former text
            explicit = explicit.join(sections.select(F.col("id").alias("associated_node_id")), "associated_node_id", "left_anti").select(*explicit.columns)
        rest = nodes.where("node_type = 'section'").join(sections.select("id"), "id", "left_anti")
        new = sections.unionByName(ingest.containers(docs)).withColumn("access_count", F.lit(0))
        index = vector_index.VectorIndex.opened(self.spark, f"{self.folder}/vectors", self.table("cells"))
        replaced = not nodes.where("node_type = 'section'").join(sections.select("id"), "id", "left_semi").isEmpty() or (gone is not None and not gone.isEmpty())
        near = index.link(sections, rest, self.cfg.cross_threshold, "parent_id", replaced)
        edges = graph.containment_edges(sections)
        for made in (graph.sibling_edges(sections, self.cfg), graph.cross_of_pairs(near, self.cfg)):
            edges = edges.unionByName(made)
        titled = sections.select("id", F.concat_ws("\n", "title", "content").alias("content"))
        edges, asked = edges.withColumn("co_activation_count", F.lit(0)), self._asked(titled)
        if gone is None:
            self._write({"cells": index.row(), "nodes": Change(new), "edges": Change(edges), "explicit": Change(asked)})
            return
        self._write({
            "cells": index.row(),
            "nodes": learning.upsert(nodes, new, ["id"]),
            "triggers": triggers,
            "edges": learning.upsert(known_edges, edges, ["source_id", "target_id"]),
            "explicit": learning.upsert(explicit, asked, ["id"]),
        })

    def _index_documents(self, docs: DataFrame, rebuild: bool) -> None:
        nodes = self.table("nodes")
        docs = docs.join(nodes.select("id"), "id", "left_anti")
        vector = document_text(F.col("title"), F.col("text"))
        new = self._vectors(docs.select("id", "title", F.col("text").alias("content"), F.lit("document").alias("node_type"), F.lit(None).cast("string").alias("parent_id"), vector.alias("embedding"), F.lit(0).alias("access_count")), "embedding").checkpoint()
        every = nodes.unionByName(new)
        edges = graph.similarity_edges(every if rebuild else new, self.cfg)
        if not rebuild:
            edges = edges.unionByName(graph.similarity_edges(new, self.cfg, others=nodes))
        content = new.select("id", F.concat("title", F.lit("\n\n"), "content").alias("content"))
        self._write({"nodes": Change(new), "edges": Change(edges.withColumn("co_activation_count", F.lit(0))), "explicit": Change(self._asked(content))})

    def queries(self, queries: DataFrame) -> DataFrame:
        """queries (query_id, text) with their vectors, each made once and checkpointed, as plans use them many times."""
        return self._vectors(queries.withColumn("embedding", F.coalesce("text", F.lit(""))), "embedding").checkpoint()

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The k best nodes for each of queries (query_id, text), with id, score, rank, and is_triggered or channel."""
        columns = ["id", "pattern", "pattern_embedding", "associated_node_id", "confidence"]
        triggers = self.table("explicit").select(*columns).unionByName(self.table("triggers").select(*columns))
        nodes, edges, q = self.table("nodes"), self.table("edges"), self.queries(queries)
        if self.level == "document":
            return search.retrieve_documents(q, nodes, edges, triggers, k, self.cfg)
        own = self.gate if self.gate or not self.ask else gate.model_gate(self.ask, q, nodes)
        return search.retrieve_sections(q, nodes, edges, triggers, k, self.cfg, own)

    def update(self, episodes: DataFrame) -> None:
        """Learn from episodes (episode_seq, context, retrieved_ids, triggered_ids, useful_ids), numbered on from those before."""
        e = self._vectors(episodes.withColumn("context_embedding", F.coalesce("context", F.lit(""))), "context_embedding").checkpoint()
        cfg = self.cfg if self.cfg.enable_hebbian else replace(self.cfg, promote_soft=NEVER, promote_hard=NEVER, promote_trigger=NEVER)
        nodes, before, triggers = self.table("nodes"), self.table("episodes"), self.table("triggers")
        after = before.agg(F.max("episode_seq")).first()[0]
        done, until = learning.due(e, after, cfg)
        # a decay cycle changes all edges; between two, only those of the episodes' nodes can change
        own = e.select(F.explode(F.array_union("retrieved_ids", "useful_ids"))).distinct().where("col IS NOT NULL").checkpoint()
        edges, learned = learning.learn(self.table("edges", own if done == until else None), triggers, e, lambda df: df.checkpoint(), cfg, nodes, before, after)
        counts = learning.access_counts(e)
        uses = self.table("nodes", counts.select("id")).join(counts, "id").withColumn("access_count", (F.col("access_count") + F.col("accesses")).cast("int"))
        log = learning.retain(before.unionByName(e.select(*before.columns)), cfg)
        self._write({"nodes": Change(uses.drop("accesses")), "edges": Change(edges) if done == until else edges, "triggers": Change(differing(learned, triggers, "id")), "episodes": log})

    def consolidate(self) -> None:
        """The offline pass over episodes since the last one: decay, replay, promotion, bridges, mining."""
        e = self.table("episodes")
        since = self.table("consolidated").agg(F.max("episode_seq")).first()[0]
        edges, triggers = learning.consolidate(self.table("edges"), self.table("triggers"), e, lambda df: df.checkpoint(), -1 if since is None else since, self.cfg)
        self._write({"edges": edges, "triggers": triggers, "consolidated": e.agg(F.max("episode_seq").alias("episode_seq"))})
