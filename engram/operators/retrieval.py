"""Retrieval: merging of graph passes, trigger firing with guards, injection, and fusion of channels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.config import MemoryConfig
from engram.functions.text import raw_tokens
from engram.functions.vector import blocks, bucket_count, cosine_to_matrix, vector_join
from engram.operators.graph import two_hop
from engram.operators.similarity_graph import SimilarityGraph, fired


#: Channels of retrieved sections, in order of precedence.
CHANNELS = ("trigger", "graph", "semantic")


def top_k(scores: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """The k best rows of each key by score, ties by id, with their rank."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merge_graph(entries: DataFrame, focused: DataFrame, sims: DataFrame, k: int, diffuse: DataFrame | None = None, cfg: MemoryConfig = MemoryConfig()) -> DataFrame:
    """Entries keep their similarity; nodes of the focused pass add a bonus by path, those of the diffuse pass a fixed one.

    entries: query_id, id, score; focused: query_id, id, path; sims: query_id, id, sim of whatever may be found.
    """
    best = entries.groupBy("query_id").agg(F.max("score").alias("best"))
    near = focused.join(sims, ["query_id", "id"]).join(best, "query_id").where(F.col("sim") >= cfg.sim_floor)
    near = near.select("query_id", "id", F.greatest(F.lit(0.0), F.col("sim") + F.col("path") * F.col("best") * cfg.path_bonus).alias("score"))
    rows = entries.select("query_id", "id", "score").unionByName(near)
    if diffuse is not None:
        rows = rows.unionByName(diffuse.join(sims, ["query_id", "id"]).select("query_id", "id", F.greatest(F.lit(0.0), F.col("sim") + cfg.diffuse_bonus).alias("score")))
    merged = rows.groupBy("query_id", "id").agg(F.round(F.max("score"), 6).alias("score"))
    return top_k(merged, k)


def keyword_scores(queries: DataFrame, triggers: DataFrame, scope: str | None = None) -> DataFrame:
    """query_id, trigger_id, kw: share of a trigger's pattern among the query's tokens; pairs without any are left out."""
    own = [scope] if scope else []
    words = queries.select("query_id", *own, F.explode(F.array_distinct(raw_tokens(F.lower("text")))).alias("w"))
    pattern = triggers.select(F.col("id").alias("trigger_id"), *own, F.size("pattern").alias("n"), F.explode(F.array_distinct("pattern")).alias("w"))
    return words.join(pattern, ["w", *own]).groupBy("query_id", "trigger_id", "n").agg((F.count("*") / F.col("n")).alias("kw")).drop("n")


def fire_triggers(queries: DataFrame, triggers: DataFrame, cfg: MemoryConfig = MemoryConfig(), scope: str | None = None) -> DataFrame:
    """query_id, trigger_id, node_id, score of the triggers whose combined score reaches the threshold.

    queries: query_id, text, embedding; triggers: id, pattern, embedding, node_id, confidence.  A pair
    without a shared word needs threshold / semantic_weight of cosine, so only such pairs and those with a word are scored.
    scope: a column of both; triggers of other scopes don't fire.  Without one, queries meet triggers in blocks, and no
    pair is joined.
    """
    if not scope:
        return fired(queries, triggers, cfg)
    live = triggers.where(F.col("confidence") >= cfg.confidence_floor)
    kw = keyword_scores(queries, live, scope)
    floor = cfg.trigger_threshold / cfg.semantic_weight
    n = bucket_count(live)
    near = vector_join(blocks(queries, "query_id", "embedding", scope, buckets=n), blocks(live, "id", "embedding", scope, buckets=n), round(floor, 6), ("query_id", "trigger_id"), same_part=True)
    joined = kw.join(near, ["query_id", "trigger_id"], "full")
    vectors = joined.where("sim IS NULL").join(queries.select("query_id", F.col("embedding").alias("qv")), "query_id").join(live.select(F.col("id").alias("trigger_id"), F.col("embedding").alias("tv")), "trigger_id")
    far = vectors.select("query_id", "trigger_id", "kw", F.coalesce(F.round(cosine_to_matrix(F.col("qv"), F.col("tv")), 6), F.lit(0.0)).alias("sim"))
    scored = joined.where("sim IS NOT NULL").select("query_id", "trigger_id", F.coalesce("kw", F.lit(0.0)).alias("kw"), "sim").unionByName(far)
    scored = scored.join(live.select(F.col("id").alias("trigger_id"), "node_id", "confidence"), "trigger_id")
    score = F.round((F.col("kw") * cfg.keyword_weight + F.col("sim") * cfg.semantic_weight) * F.col("confidence"), 6)
    return scored.withColumn("score", score).where(F.col("score") >= cfg.trigger_threshold).select("query_id", "trigger_id", "node_id", "score")


def guard_triggers(fired: DataFrame, semantic: DataFrame, edges: DataFrame, n_sections: Column | int, cfg: MemoryConfig = MemoryConfig(), gate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, id, score of nodes that pass the guards: one score a node, no generic query, no long tail, support by another channel, a gate.

    semantic: query_id, id, score, rank.  A node is supported by its similarity or by an edge from one of the first entries.
    """
    once = fired.groupBy("query_id", F.col("node_id").alias("id")).agg(F.max("score").alias("score"))
    own = Window.partitionBy("query_id")
    kept = once.withColumns({"n": F.count("*").over(own), "top": F.max("score").over(own)})
    share = (n_sections if isinstance(n_sections, Column) else F.lit(n_sections)) * cfg.generic_share
    kept = kept.where((F.col("n") <= share) & (F.col("score") >= F.col("top") * cfg.score_gap)).select("query_id", "id", "score")
    by_meaning = semantic.where(F.col("score") >= cfg.min_semantic_support).select("query_id", "id")
    first = semantic.where(F.col("rank") <= cfg.entry_nodes).select("query_id", F.col("id").alias("source_id"))
    by_edge = first.join(edges.select("source_id", F.col("target_id").alias("id")), "source_id").select("query_id", "id")
    kept = kept.join(by_meaning.unionByName(by_edge), ["query_id", "id"], "left_semi")
    kept = gate(kept) if gate else kept
    return top_k(kept, cfg.trigger_max_injections)


def inject(triggered: DataFrame, base: DataFrame, k: int, cfg: MemoryConfig = MemoryConfig()) -> DataFrame:
    """Triggered nodes first, then the base ranking (asked for k less the injected, one at least), each id once, k at most."""
    first = top_k(triggered.select("query_id", "id", "score"), cfg.trigger_max_injections)
    n = first.groupBy("query_id").agg(F.count("*").alias("n"))
    rest = base.join(n, "query_id", "left").where(F.col("rank") <= F.greatest(F.lit(1), k - F.coalesce("n", F.lit(0))))
    rows = first.select("query_id", "id", "rank", "score", F.lit(0).alias("block")).unionByName(rest.select("query_id", "id", "rank", "score", F.lit(1).alias("block")))
    once = rows.groupBy("query_id", "id").agg(F.min(F.struct("block", "rank", "score")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at")
    return once.select("query_id", "id", F.col("at.score").alias("score"), (F.col("at.block") == 0).alias("is_triggered"), F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def fuse(semantic: DataFrame, triggered: DataFrame, graph: DataFrame, sims: DataFrame, k: int, cfg: MemoryConfig = MemoryConfig()) -> DataFrame:
    """query_id, id, score, rank and the channels (semantic, trigger, graph) of a section: boosts are capped by the best similarity.

    semantic: query_id, id, score, rank; triggered: query_id, id; graph: query_id, id, path; sims: query_id, id, sim.
    """
    best = semantic.groupBy("query_id").agg(F.max("score").alias("best"))
    flag = lambda c: F.lit(c)
    none = F.lit(None).cast("double")
    rows = semantic.select("query_id", "id", F.col("score").alias("sem"), none.alias("path"), F.lit(False).alias("trig"))
    rows = rows.unionByName(triggered.select("query_id", "id", none.alias("sem"), none.alias("path"), F.lit(True).alias("trig")))
    rows = rows.unionByName(graph.select("query_id", "id", none.alias("sem"), "path", F.lit(False).alias("trig")))
    one = rows.groupBy("query_id", "id").agg(F.max("sem").alias("sem"), F.max("path").alias("path"), F.max("trig").alias("trig"))
    one = one.join(best, "query_id", "left").withColumn("best", F.coalesce("best", F.lit(0.3)))
    one = one.join(sims, ["query_id", "id"], "left")
    base = F.coalesce("sem", F.lit(0.0))
    by_trigger = F.when(F.col("trig"), F.greatest(base, F.least(base + cfg.trigger_bonus, F.col("best") + cfg.trigger_margin)))
    by_graph = F.when(F.col("path").isNotNull(), F.greatest(F.lit(0.0), F.least(F.coalesce("sim", F.lit(0.0)) + F.col("path") * cfg.graph_factor, F.col("best"))))
    score = F.round(F.greatest(F.col("sem"), by_trigger, by_graph), 6)
    channel = F.when(F.col("trig"), flag("trigger")).when(F.col("path").isNotNull(), flag("graph")).otherwise(flag("semantic"))
    return top_k(one.select("query_id", "id", score.alias("score"), channel.alias("channel")), k)


def section_graph(semantic: DataFrame, triggered: DataFrame, edges: DataFrame | SimilarityGraph, cfg: MemoryConfig = MemoryConfig(), marks: DataFrame | None = None, mark: DataFrame | None = None) -> DataFrame:
    """The graph channel: two hops from the first entries and the triggered sections; marks and mark as in SimilarityGraph.two_hop()."""
    entries = semantic.where(F.col("rank") <= cfg.entry_nodes).select("query_id", "id").unionByName(triggered.select("query_id", "id"))
    if isinstance(edges, SimilarityGraph):
        return edges.two_hop(entries, marks, mark)
    hops = two_hop(entries, edges, cfg)
    return hops if marks is None else hops.join(marks, "query_id").join(mark, ["id", "mark"]).select("query_id", "id", "path")
