"""Groups that meet all blocks in one task, against the operators over written edges."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from engram.config import MemoryConfig
from engram.operators import graph, learning, retrieval, search, similarity_graph
from engram.operators.cuts import cut


def rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def forbid(monkeypatch, module, *names):
    def none(*_, **__):
        raise AssertionError("rows of all edges or fired pairs")

    for name in names:
        monkeypatch.setattr(module, name, none)


@pytest.fixture(params=["string", "bigint"])
def nodes(request, spark, monkeypatch):
    """Clustered vectors in small blocks, with copies and one null."""
    monkeypatch.setattr(similarity_graph, "BLOCK", 48)
    monkeypatch.setattr(similarity_graph, "SOURCES", 30)
    monkeypatch.setattr(similarity_graph, "HOPS", 4)
    monkeypatch.setattr(similarity_graph, "OUT", 500)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(6, 24))[rng.integers(0, 6, 200)] + 2.2 * rng.normal(size=(200, 24))
    m[150:160] = m[3]
    rows_ = [(i, [float(np.float32(x)) for x in v] if i != 77 else None) for i, v in enumerate(m)]
    ids = F.col("i").cast("string" if request.param == "string" else "long")
    return cut(spark.createDataFrame(rows_, "i long, embedding array<double>").select(ids.alias("id"), "embedding", (F.col("i") % 3).alias("parent_id"), F.col("i")))


CFG = MemoryConfig(doc_threshold=0.35)


def test_two_hops(nodes):
    edges = cut(graph.similarity_edges(nodes, CFG))
    similar = similarity_graph.SimilarityGraph(nodes, CFG)
    queries = nodes.where("i % 7 = 0 AND embedding IS NOT NULL").select(F.col("id").alias("query_id"), "embedding", F.col("parent_id").alias("mark"))
    entries = cut(search.nearest(queries, nodes, 3).select("query_id", "id"))
    want = cut(graph.two_hop(entries, edges, CFG))
    assert want.count() > 100 and rows(similar.two_hop(entries)) == rows(want)
    mark = nodes.select("id", F.col("parent_id").alias("mark"))
    own = want.join(queries.select("query_id", "mark"), "query_id").join(mark, ["id", "mark"]).select("query_id", "id", "path")
    assert rows(similar.two_hop(entries, queries.select("query_id", "mark"), mark)) == rows(own)


def test_channels_of_all_ends_without_rows_of_hops(nodes, monkeypatch):
    from engram.operators import evaluation

    edges = cut(graph.similarity_edges(nodes, CFG))
    queries = nodes.where("i % 7 = 0").select(F.col("id").alias("query_id"), "embedding", F.col("parent_id").alias("mark"))
    sem = cut(search.nearest(queries.where("embedding IS NOT NULL"), nodes, 6))
    trig = cut(sem.where("rank IN (1, 6)").select("query_id", "id"))
    ends = nodes.select("id", F.col("parent_id").alias("mark"))
    gold = queries.select("query_id", "mark").join(ends, "mark").where("id <> query_id").select("query_id", "id")
    want = evaluation.attribution(gold, trig, cut(retrieval.section_graph(sem, trig, edges, CFG)), sem)
    monkeypatch.setattr(similarity_graph.SimilarityGraph, "two_hop", None)
    got = rows(evaluation.by_channel(similarity_graph.SimilarityGraph(nodes, CFG).channels(queries.select("query_id", "mark"), ends, sem, trig)))
    assert {r[2] for r in got} == {"trigger", "graph", "semantic", "MISS"} and got == rows(want)


def test_edges_of_sources(nodes):
    edges = cut(graph.similarity_edges(nodes, CFG))
    similar = similarity_graph.SimilarityGraph(nodes, CFG)
    some = nodes.where("i % 5 = 0").select("id")
    assert rows(similar.edges()) == rows(edges)
    assert rows(similar.edges(some)) == rows(edges.join(some.toDF("source_id"), "source_id", "left_semi").select(*edges.columns))


def test_edges_leave_in_order_of_weight(nodes):
    got = sorted(similarity_graph.SimilarityGraph(nodes, CFG).edges().withColumn("at", F.monotonically_increasing_id()).collect(), key=lambda r: r["at"])
    # each group of sources starts again
    assert len(got) > 1000 and sum(b["weight"] < a["weight"] for a, b in zip(got, got[1:])) < 30


@pytest.mark.parametrize("name", ["section_two_hop", "channel_attribution"])
def test_hops_write_no_edges(spark, monkeypatch, name):
    forbid(monkeypatch, graph, "similarity_edges", "two_hop")
    forbid(monkeypatch, retrieval, "two_hop")
    assert entry.queries()[name](spark, entry.DATA).count() > 0


LEARNED = ["neighbors_filtered", "decay_cycle", "hebbian_fold", "replay_episodes", "updated_edges", "updated_triggers", "learned_triggers", "state_edge_lookup"]


@pytest.mark.parametrize("name", LEARNED)
def test_learning_joins_and_ranks_only_edges_of_named_nodes(spark, monkeypatch, name):
    forbid(monkeypatch, graph, "similarity_edges")
    assert entry.queries()[name](spark, entry.DATA).count() > 0


def test_ranks_and_cycles_by_source(nodes):
    cfg = replace(CFG, out_degree_cap=4)
    edges = cut(graph.similarity_edges(nodes, cfg))
    similar = similarity_graph.SimilarityGraph(nodes, cfg)
    assert rows(similar.neighbors(0.4, "soft")) == rows(graph.neighbors(edges, 0.4, "soft").select("source_id", "target_id", "weight", "edge_type", "rank"))
    counted = edges.withColumn("co_activation_count", F.length(F.col("target_id").cast("string")) * 7)
    own = lambda source, targets: np.array([len(str(x)) for x in targets.tolist()]) * 7
    got = learning.decayed_sources(similar, own, 3, 4, None, cfg)
    assert rows(got) == rows(learning.decay_cycle(counted, cfg).select(*got.columns))


def test_consolidated_edges(spark, nodes):
    cfg = replace(CFG, out_degree_cap=4)
    edges = graph.similarity_edges(nodes, cfg).withColumn("co_activation_count", F.length(F.col("target_id").cast("string")) * 7)
    own = lambda source, targets: np.array([len(str(x)) for x in targets.tolist()]) * 7
    pick = lambda *x: F.array(*[F.lit(i).cast(nodes.schema["id"].dataType) for i in x])
    said = spark.range(3).select(F.col("id").alias("episode_seq"), F.lit("words of it").alias("context"), F.array(F.lit(1.0)).alias("context_embedding"), pick(3, 150, 151, 9).alias("retrieved_ids"), pick(3).alias("triggered_ids"), pick(3, 150, 151).alias("useful_ids"))
    none = spark.createDataFrame([], f"id string, pattern array<string>, pattern_embedding array<float>, associated_node_id {nodes.schema['id'].dataType.simpleString()}, confidence double, fire_count int, useful_count int, origin string")
    want, _ = learning.consolidate(cut(edges), none, said, cut, -1, cfg)
    got = learning.consolidated_edges(similarity_graph.SimilarityGraph(nodes, cfg), own, said, cut, -1, cfg)
    assert want.where("co_activation_count = 0").count() > 0 and rows(got) == rows(want.select(*got.columns))


def test_consolidation_checkpoints_no_rows_of_all_edges(spark, monkeypatch):
    forbid(monkeypatch, graph, "similarity_edges")
    assert entry.queries()["consolidated_edges"](spark, entry.DATA).count() > 0


@pytest.mark.parametrize("name", ["promote_edges", "decay_edges"])
def test_plain_passes_take_edges_from_sweeps(spark, monkeypatch, name):
    forbid(monkeypatch, graph, "similarity_edges")
    assert entry.queries()[name](spark, entry.DATA).count() > 0


@pytest.mark.parametrize("least, floor", [(0.35, 0.15), (0.5, 0.15), (0.35, 0.45)])
def test_bridges(nodes, monkeypatch, least, floor):
    monkeypatch.setattr(similarity_graph, "TILE", 70)
    monkeypatch.setattr(similarity_graph, "BETWEEN", 64)
    cfg = replace(CFG, bridge_min_weight=least, bridge_mean_floor=floor)
    want = learning.discover_bridges(cut(graph.similarity_edges(nodes, cfg)), cfg)
    got = rows(learning.discover_bridges(similarity_graph.SimilarityGraph(nodes, cfg), cfg))
    assert len(got) > 100 and got == rows(want)


def test_bridge_discovery_writes_no_edges(spark, monkeypatch):
    forbid(monkeypatch, graph, "similarity_edges")
    forbid(monkeypatch, learning, "_wedges")
    assert entry.queries()["bridge_discovery"](spark, entry.DATA).count() > 0


def test_bridges_leave_in_order_of_weight(nodes):
    got = learning.discover_bridges(similarity_graph.SimilarityGraph(nodes, CFG), CFG).withColumns({"task": F.spark_partition_id(), "at": F.monotonically_increasing_id()}).collect()
    by_task = {}
    for r in sorted(got, key=lambda r: r["at"]):
        by_task.setdefault(r["task"], []).append(r["weight"])
    # a task that holds several tiles starts again with each
    falls = sum(b < a for x in by_task.values() for a, b in zip(x, x[1:]))
    assert len(got) > 1000 and falls < 50


def test_degrees_and_changed_edges(nodes):
    edges = cut(graph.similarity_edges(nodes, CFG))
    similar = similarity_graph.SimilarityGraph(nodes, CFG)
    n = edges.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("degree"))
    assert rows(similar.degrees()) == rows(n)
    changes = nodes.where("i % 4 = 0").select("id", F.when(F.col("i") % 8 == 0, 0.5).otherwise(3.0).alias("factor"), (F.col("i") % 3 == 0).alias("closed"))
    own = lambda end: changes.toDF(f"{end}_id", f"{end}_factor", f"{end}_closed")
    want = edges.join(own("source"), "source_id", "left").join(own("target"), "target_id", "left")
    want = want.where("coalesce(source_closed, false) OR NOT coalesce(target_closed, false)").select("source_id", "target_id", (F.col("weight") * F.coalesce("source_factor", F.lit(1.0))).alias("weight"), "edge_type")
    assert want.count() < edges.count() and rows(similar.changed_edges(changes)) == rows(want)


def test_state_changes_stores_no_edges(spark, monkeypatch):
    forbid(monkeypatch, graph, "similarity_edges")
    assert entry.queries()["state_changes"](spark, entry.DATA).count() > 0


@pytest.mark.parametrize("kind", ["string", "bigint"])
@pytest.mark.parametrize("threshold", [0.0, 0.1, 0.15])
def test_fired_triggers_as_the_join_gives_them(spark, monkeypatch, kind, threshold):
    monkeypatch.setattr(similarity_graph, "BLOCK", 30)
    monkeypatch.setattr(similarity_graph, "GROUP", 2)
    monkeypatch.setattr(similarity_graph, "OUT", 50)
    cfg = MemoryConfig(trigger_threshold=threshold)
    rng = np.random.default_rng(9)
    v = lambda i: [float(x) for x in rng.normal(size=6)] if i % 13 != 5 else None
    words = ["red", "green", "blue", "grey"]
    t = [(i, [words[i % 4], words[i % 3], words[i % 4]] if i % 7 else None, v(i), i // 2, (i % 11) / 10) for i in range(90)]
    q = [(i, [None, "Red and blue", "a green, a RED one", "none of it", ""][i % 5], v(i)) for i in range(25)]
    triggers = cut(spark.createDataFrame(t, "id long, pattern array<string>, embedding array<double>, node_id long, confidence double").withColumns({"id": F.col("id").cast(kind), "node_id": F.col("node_id").cast(kind), "s": F.lit(1)}))
    asks = cut(spark.createDataFrame(q, "query_id long, text string, embedding array<double>").withColumn("s", F.lit(1)))
    want = rows(retrieval.fire_triggers(asks, triggers, cfg, "s"))
    forbid(monkeypatch, retrieval, "vector_join", "keyword_scores")
    got = retrieval.fire_triggers(asks, triggers, cfg)
    assert len(want) > 100 and rows(got.select("query_id", "trigger_id", "node_id", "score")) == want


@pytest.mark.parametrize("cfg", [CFG, replace(CFG, diffuse_temperature=0.6, diffuse_top_k=3, seed=-7)])
def test_walks(nodes, monkeypatch, cfg):
    monkeypatch.setattr(similarity_graph, "WALKS", 40)
    edges = cut(graph.similarity_edges(nodes, cfg))
    similar = similarity_graph.SimilarityGraph(nodes, cfg)
    queries = nodes.where("i % 7 = 0 AND embedding IS NOT NULL").select(F.col("id").alias("query_id"), "embedding")
    entries = cut(search.nearest(queries, nodes, 3).select("query_id", "id"))
    if nodes.schema["id"].dataType.simpleString() == "string":
        with pytest.raises(ValueError):
            similar.diffuse_walk(entries, entries)
        return
    access = nodes.where("i % 2 = 0").select("id", (F.col("i") % 5).cast("int").alias("access_count"))
    for own in (None, access):
        want = rows(graph.diffuse_walk(entries, edges, entries, own, cfg))
        assert len(want) > 40 and rows(similar.diffuse_walk(entries, entries, own)) == want


def test_diffuse_walk_writes_no_edges(spark, monkeypatch):
    forbid(monkeypatch, graph, "similarity_edges")
    assert entry.queries()["diffuse_walk"](spark, entry.DATA).count() > 0


def test_siblings_of_many_blocks_are_dealt_to_tiles(nodes, monkeypatch):
    from engram.functions import vector

    want = {}
    for a in nodes.where("embedding IS NOT NULL").collect():
        want.setdefault(a["parent_id"], []).append(a["id"])
    monkeypatch.setattr(vector, "BLOCK", 17)
    monkeypatch.setattr(graph, "vector_join", None)
    got = [(r["source_id"], r["target_id"]) for r in graph.sibling_edges(nodes, CFG).collect()]
    assert sorted(got) == sorted((a, b) for x in want.values() for a in x for b in x if a != b)
