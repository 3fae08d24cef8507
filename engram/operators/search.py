"""Whole retrievals, each for all queries at once: documents by graph passes and injection, sections by fused channels.

With a scope (a column of queries, nodes and triggers) every query sees the nodes of its own scope
only, so many small memories are searched in one job.  What several later steps read is checkpointed: plans
that repeat a graph pass in each of its uses take longer to plan than to run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.config import MemoryConfig
from engram.functions.vector import blocks, bucket_count, cosine_to_matrix, vector_topk
from engram.operators import graph, pivots, retrieval
from engram.operators.cuts import cut
from engram.operators.similarity_graph import SimilarityGraph, TriggerIndex


def similarities(pairs: DataFrame, queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, id, sim of the given pairs only."""
    q = queries.select("query_id", F.col("embedding").alias("qv"))
    s = nodes.select("id", F.col("embedding").alias("sv"))
    df = pairs.select("query_id", "id").distinct().join(q, "query_id").join(s, "id")
    return df.select("query_id", "id", F.round(cosine_to_matrix(F.col("qv"), F.col("sv")), 6).alias("sim"))


def scannable(triggers: DataFrame) -> DataFrame:
    """Rows of the trigger table as fire_triggers() takes them."""
    return triggers.withColumnsRenamed({"pattern_embedding": "embedding", "associated_node_id": "node_id"})


def nearest(queries: DataFrame, nodes: DataFrame, k: int, scope: str | None = None) -> DataFrame:
    """query_id, id, score, rank of the k most similar nodes."""
    if not scope:
        return pivots.nearest(queries, nodes, k)
    n = bucket_count(nodes)
    return vector_topk(blocks(queries, "query_id", "embedding", scope, buckets=n), blocks(nodes, "id", "embedding", scope, buckets=n), k, exclude_self=False, same_part=True)


def retrieve_documents(queries: DataFrame, docs: DataFrame, edges: DataFrame | SimilarityGraph, triggers: DataFrame, k: int, cfg: MemoryConfig = MemoryConfig(), scope: str | None = None) -> DataFrame:
    """query_id, id, score, rank, is_triggered: k documents a query at most, by the parts that cfg switches on.

    queries: query_id, text, embedding; docs: id, embedding, access_count; edges: source_id, target_id, weight;
    triggers: rows of the trigger table.  Without the graph the base is plain similarity.  edges may be a SimilarityGraph
    over all docs, if nothing is scoped or walked at random: then no edges are written.
    """
    implicit = isinstance(edges, SimilarityGraph)
    if implicit and (scope or (cfg.enable_graph and cfg.enable_diffuse)):
        raise ValueError("scopes and random walks need edges as rows")
    if cfg.enable_graph and implicit:
        entries = cut(nearest(queries, docs, cfg.focused_top_k).select("query_id", "id", "score", "rank"))
        base = edges.merged(queries, entries, k)
    elif cfg.enable_graph:
        entries = cut(nearest(queries, docs, cfg.focused_top_k, scope).select("query_id", "id", "score", "rank"))
        focused, diffuse = cut(graph.focused_bfs(entries, edges, cfg)), None
        found = focused.select("query_id", "id")
        if cfg.enable_diffuse:
            diffuse = cut(graph.diffuse_walk(entries.select("query_id", "id"), edges, entries.select("query_id", "id").unionByName(found), docs.select("id", "access_count"), cfg))
            found = found.unionByName(diffuse)
        base = retrieval.merge_graph(entries, focused, similarities(found, queries, docs), k, diffuse, cfg)
    else:
        base = nearest(queries, docs, k, scope)
    if not cfg.enable_triggers:
        return base.select("query_id", "id", "score", "rank", F.lit(False).alias("is_triggered"))
    if implicit:
        found = TriggerIndex(scannable(triggers), docs, cfg).best(queries, cfg.trigger_max_injections)
        return retrieval.inject(found, base, k, cfg).select("query_id", "id", "score", "rank", "is_triggered")
    fired = retrieval.fire_triggers(queries, scannable(triggers), cfg, scope).groupBy("query_id", F.col("node_id").alias("id")).agg(F.max("score").alias("score"))
    return retrieval.inject(fired.join(docs.select("id"), "id", "left_semi"), base, k, cfg).select("query_id", "id", "score", "rank", "is_triggered")


def retrieve_sections(queries: DataFrame, nodes: DataFrame, edges: DataFrame | SimilarityGraph, triggers: DataFrame, k: int, cfg: MemoryConfig = MemoryConfig(), gate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, id, score, rank, channel: k sections a query at most, of three channels (semantic, trigger, graph).

    edges may be a SimilarityGraph over the sections: then no edges are written.
    """
    sections = nodes.where((F.col("node_type") == "section") & F.col("embedding").isNotNull())
    if isinstance(edges, SimilarityGraph):
        semantic = cut(nearest(queries, sections, k))
        triggered = semantic.select("query_id", "id").where(F.lit(False))
        if cfg.enable_triggers:
            index = TriggerIndex(scannable(triggers), sections, cfg)
            triggered = cut(index.guarded(queries, semantic, edges, sections.count(), gate if cfg.enable_gate else None))
        return fused(queries, semantic, triggered, edges, k, cfg)
    inner = edges.join(sections.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    semantic = cut(nearest(queries, sections, k))
    none = semantic.select("query_id", "id").where(F.lit(False))
    triggered, hops = none, none.withColumn("path", F.lit(0.0))
    if cfg.enable_triggers:
        fired = retrieval.fire_triggers(queries, scannable(triggers), cfg).join(sections.select(F.col("id").alias("node_id")), "node_id", "left_semi")
        triggered = cut(retrieval.guard_triggers(fired, semantic, inner, sections.count(), cfg, gate if cfg.enable_gate else None))
    if cfg.enable_graph:
        hops = cut(retrieval.section_graph(semantic, triggered, inner, cfg))
    return retrieval.fuse(semantic, triggered, hops, similarities(hops, queries, sections), k, cfg)


def fused(queries: DataFrame, semantic: DataFrame, triggered: DataFrame, graph: SimilarityGraph, k: int, cfg: MemoryConfig = MemoryConfig()) -> DataFrame:
    """The last step of retrieve_sections(): the three channels as one ranking."""
    none = triggered.select("query_id", "id").where(F.lit(False)).withColumns({"path": F.lit(0.0), "sim": F.lit(0.0)})
    hops = cut(graph.fused_hops(queries, semantic, triggered, k)) if cfg.enable_graph else none
    return retrieval.fuse(semantic, triggered, hops.drop("sim"), hops.drop("path"), k, cfg)


def channel_counts(results: DataFrame) -> DataFrame:
    """query_id, n_results, and by channel the number and the ids, in order of rank, of what retrieve_sections() found."""
    own = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("channel") == c, F.struct("rank", "id")))), lambda x: x["id"])
    lists = results.groupBy("query_id").agg(F.count("*").alias("n_results"), *[own(c).alias(f"{c}_ids") for c in retrieval.CHANNELS])
    return lists.select("query_id", "n_results", *[x for c in retrieval.CHANNELS for x in (F.size(f"{c}_ids").alias(f"n_{c}"), F.col(f"{c}_ids"))])
