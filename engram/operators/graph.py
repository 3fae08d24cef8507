"""Graph operators: similarity, sibling and cross edges, neighbour scans, breadth-first passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.config import MemoryConfig
from engram.functions.vector import blocks, bucket_count, kinds_of, sibling_pairs, vector_join
from engram.operators import pivots
from engram.operators.cuts import stored


def both_ways(pairs: DataFrame) -> DataFrame:
    """Directed edges from pairs (a, b, weight, edge_type)."""
    ends = F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("t")), F.struct(F.col("b").alias("s"), F.col("a").alias("t")))
    return pairs.withColumn("e", F.explode(ends)).select(F.col("e.s").alias("source_id"), F.col("e.t").alias("target_id"), "weight", "edge_type")


def graded(sim: Column, soft: float, hard: float | None = None) -> Column:
    grade = F.when(sim >= soft, "soft").otherwise("diffuse")
    return grade if hard is None else F.when(sim >= hard, "hard").otherwise(grade)


def similarity_edges(nodes: DataFrame, cfg: MemoryConfig = MemoryConfig(), id_col: str = "id", others: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Edges of all pairs of nodes (of nodes and others, if given) whose cosine reaches the threshold; by: only within its values."""
    if by:
        n = bucket_count(nodes if others is None else others)
        b = blocks(nodes, id_col, "embedding", by, buckets=n)
        pairs = vector_join(b, b if others is None else blocks(others, id_col, "embedding", by, buckets=n), cfg.doc_threshold, same_part=True, ordered=others is None)
    else:
        pairs = pivots.similar_pairs(nodes, cfg.doc_threshold, id_col, others)
    return both_ways(pairs.select("a", "b", F.col("sim").alias("weight"), graded(F.col("sim"), cfg.doc_soft, cfg.doc_hard).alias("edge_type")))


def sibling_edges(sections: DataFrame, cfg: MemoryConfig = MemoryConfig(), id_col: str = "id") -> DataFrame:
    """Edges between all sections of one parent; the weight has a floor."""
    n = bucket_count(sections)
    b = stored(blocks(sections, id_col, "embedding", "parent_id", buckets=n).withColumn("block", F.monotonically_increasing_id()), "blocks")
    # a large parent has many blocks: pairs of blocks are dealt to tiles, so they are not one task's work
    at = b.select("cell", F.col("block").alias("la")).join(b.select("cell", F.col("block").alias("lb")), "cell").where("la <= lb").select("la", "lb")
    pairs = sibling_pairs(pivots.fetched(at, b, b), kinds_of(b, b))
    return pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.greatest("sim", F.lit(cfg.sibling_min_weight)).alias("weight"), graded(F.col("sim"), cfg.sibling_soft).alias("edge_type"))


def cross_edges(sections: DataFrame, cfg: MemoryConfig = MemoryConfig(), id_col: str = "id", new: DataFrame | None = None) -> DataFrame:
    """Edges between sections of different parents (of new ones and these, if given)."""
    if new is None:
        pairs = pivots.similar_pairs(sections, cfg.cross_threshold, id_col, mark="parent_id")
    else:
        pairs = pivots.similar_pairs(new, cfg.cross_threshold, id_col, sections, "parent_id")
    return cross_of_pairs(pairs, cfg)


def cross_of_pairs(pairs: DataFrame, cfg: MemoryConfig = MemoryConfig()) -> DataFrame:
    """Edges of pairs (a, b, sim) of different parents."""
    return both_ways(pairs.select("a", "b", F.col("sim").alias("weight"), graded(F.col("sim"), cfg.cross_soft).alias("edge_type")))


def containment_edges(sections: DataFrame) -> DataFrame:
    """One edge from each parent to its section."""
    return sections.select(F.col("parent_id").alias("source_id"), F.col("id").alias("target_id"), F.lit(1.0).alias("weight"), F.lit("hard").alias("edge_type"))


def neighbors(edges: DataFrame, min_weight: float = 0.0, edge_type: str | None = None) -> DataFrame:
    """Edges from min_weight on, ranked in each source by weight, then target."""
    out = edges.where(F.col("weight") >= min_weight)
    out = out.where(F.col("edge_type") == edge_type) if edge_type else out
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("weight"), "target_id")))


def focused_bfs(entries: DataFrame, edges: DataFrame, cfg: MemoryConfig = MemoryConfig()) -> DataFrame:
    """query_id, id, depth, path: what is reached from the entries (query_id, id, rank), each at its first visit.

    A hop follows the frontier in its order and each node's edges by weight; path is the product of weights.
    Frontiers over the cap go on with their best nodes; the others stay visited and found.
    """
    edges = edges.where(F.col("weight") >= cfg.bfs_min_weight).select(F.col("source_id").alias("id"), F.col("target_id").alias("next"), "weight")
    frontier = entries.select("query_id", "id", F.col("rank").alias("at"), F.lit(1.0).alias("path"))
    visited = entries.select("query_id", "id")
    out = entries.where(F.lit(False)).select("query_id", "id", F.lit(0).alias("depth"), F.lit(1.0).alias("path"))
    for depth in range(1, cfg.focused_max_depth + 1):
        first = Window.partitionBy("query_id", "next").orderBy("at", F.desc("weight"))
        hop = frontier.join(edges, "id").withColumn("n", F.row_number().over(first)).where("n = 1")
        hop = hop.select("query_id", F.col("next").alias("id"), "at", "weight", (F.col("path") * F.col("weight")).alias("path"))
        hop = hop.join(visited, ["query_id", "id"], "left_anti")
        found = hop.select("query_id", "id", F.lit(depth).alias("depth"), "path")
        out = out.unionByName(found)
        visited = visited.unionByName(hop.select("query_id", "id"))
        own = Window.partitionBy("query_id")
        by_visit, by_path = own.orderBy("at", F.desc("weight"), "id"), own.orderBy(F.desc(F.round("path", 9)), "id")
        ranked = hop.select("query_id", "id", "path", F.count("*").over(own).alias("n"), F.row_number().over(by_visit).alias("v"), F.row_number().over(by_path).alias("p"))
        ranked = ranked.where((F.col("n") <= cfg.frontier_cap) | (F.col("p") <= cfg.frontier_cap))
        frontier = ranked.select("query_id", "id", F.when(F.col("n") <= cfg.frontier_cap, F.col("v")).otherwise(F.col("p")).alias("at"), "path")
    return out


def two_hop(entries: DataFrame, edges: DataFrame, cfg: MemoryConfig = MemoryConfig()) -> DataFrame:
    """query_id, id, path within two hops of the entries (query_id, id); of several ways the heaviest."""
    e = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("next"), "weight")
    entries = entries.select("query_id", "id").distinct()
    one = entries.join(e.where(F.col("weight") >= cfg.hop1_min_weight), "id").groupBy("query_id", F.col("next").alias("id")).agg(F.max("weight").alias("path"))
    one = one.join(entries, ["query_id", "id"], "left_anti")
    two = one.join(e.where(F.col("weight") >= cfg.hop2_min_weight), "id").groupBy("query_id", F.col("next").alias("id")).agg(F.max(F.col("path") * F.col("weight")).alias("path"))
    seen = entries.unionByName(one.select("query_id", "id"))
    return one.unionByName(two.join(seen, ["query_id", "id"], "left_anti"))


def diffuse_walk(entries: DataFrame, edges: DataFrame, visited: DataFrame, access: DataFrame | None = None, cfg: MemoryConfig = MemoryConfig()) -> DataFrame:
    """query_id, id: nodes met by seeded random walks of two or three steps over nodes not visited yet.

    A step goes to a neighbour with probability proportional to weight ** (1 / temperature) / (1 + novelty * accesses);
    the draw is the largest of log(u) / w over hashed uniforms u, so a run can be repeated.
    """
    if cfg.diffuse_top_k == 0:
        return entries.select("query_id", "id").where(F.lit(False))
    weight = F.pow("weight", F.lit(1 / cfg.diffuse_temperature))
    e = edges.where(F.col("weight") > 0)
    if access is not None:
        e = e.join(access.select(F.col("id").alias("target_id"), "access_count"), "target_id", "left")
        weight = weight / (1 + F.coalesce("access_count", F.lit(0)) * cfg.novelty_penalty)
    e = e.select(F.col("source_id").alias("id"), F.col("target_id").alias("next"), weight.alias("w"))
    at, out = walk_starts(entries, cfg), None
    for step in range(1, 4):
        ways = at.where(F.col("steps") >= step).join(e, "id").join(visited.select("query_id", F.col("id").alias("next")), ["query_id", "next"], "left_anti")
        draw = Window.partitionBy("query_id", "walk").orderBy(F.desc(F.ln(_uniform(cfg, "query_id", "walk", "next", F.lit(step))) / F.col("w")), "next")
        at = ways.withColumn("n", F.row_number().over(draw)).where("n = 1").select("query_id", "walk", F.col("next").alias("id"), "steps")
        met = at.select("query_id", "id", F.lit(step).alias("step"), "walk")
        out = met if out is None else out.unionByName(met)
    return first_met(out, cfg)


def _uniform(cfg: MemoryConfig, *c: Column | str) -> Column:
    return (F.pmod(F.xxhash64(*c, F.lit(cfg.seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)


def walk_starts(entries: DataFrame, cfg: MemoryConfig) -> DataFrame:
    """query_id, walk, id, steps: the entry that each walk of a query starts from, and how many steps it takes."""
    at = entries.withColumn("walk", F.explode(F.sequence(F.lit(1), F.lit(3 * cfg.diffuse_top_k))))
    start = Window.partitionBy("query_id", "walk").orderBy(_uniform(cfg, "query_id", "walk", "id"))
    return at.withColumn("n", F.row_number().over(start)).where("n = 1").select("query_id", "walk", "id", (2 + (_uniform(cfg, "query_id", "walk") >= 0.5).cast("int")).alias("steps"))


def first_met(out: DataFrame, cfg: MemoryConfig) -> DataFrame:
    """query_id, id: the first nodes of those that walks met (query_id, id, step, walk), as many as are kept."""
    best = Window.partitionBy("query_id").orderBy("walk", "step", "id")
    once = out.groupBy("query_id", "id").agg(F.min("walk").alias("walk"), F.min("step").alias("step"))
    return once.withColumn("n", F.row_number().over(best)).where(F.col("n") <= cfg.diffuse_top_k).select("query_id", "id")


def edge_type_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n_edges"), F.round(F.avg("weight"), 6).alias("mean_weight"))
