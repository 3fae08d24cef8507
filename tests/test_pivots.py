"""Pruned similarity joins against all pairs, and what they leave out."""

import numpy as np
import pytest

from engram.config import MemoryConfig
from engram.functions import vector
from engram.operators import graph, pivots
from engram.operators.cuts import stored
from engram.operators.vector_index import VectorIndex

SCHEMA = "id long, parent_id string, embedding array<double>"


def clustered(n, dim=16, centres=25, near=0.08, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return c[rng.integers(0, centres, n)] + near * rng.normal(size=(n, dim))


def frame(spark, m, start=0):
    return spark.createDataFrame([(start + i, f"p{i % 7}" if i % 11 else None, list(map(float, v))) for i, v in enumerate(m)], SCHEMA)


def cosines(x, y):
    unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + vector.EPSILON)
    return np.round(unit(x) @ unit(y).T, 6)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 40)


def test_self_join_is_pruned(spark, small_blocks):
    m = clustered(2000)
    report = pivots.Report()
    got = {(r["a"], r["b"]): r["sim"] for r in pivots.similar_pairs(frame(spark, m), 0.9, report=report).collect()}
    sim = cosines(m, m)
    assert got == {(int(a), int(b)): sim[a, b] for a, b in zip(*np.nonzero(np.triu(sim >= 0.9, 1)))}
    assert report.all > 500 and report.share < 0.3


def test_marks_keep_rows_apart(spark, small_blocks):
    m = clustered(600)
    df = frame(spark, m)
    parent = {r["id"]: r["parent_id"] for r in df.collect()}
    got = {(r["source_id"], r["target_id"]) for r in graph.cross_edges(df, MemoryConfig(cross_threshold=0.8)).collect()}
    sim = cosines(m, m)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(sim >= 0.8)) if a != b and (parent[a] is None or parent[a] != parent[b])}
    assert got == want


def test_new_against_stored(spark, small_blocks):
    m, new = clustered(1500), clustered(60, seed=1)
    got = {(r["a"], r["b"]) for r in pivots.similar_pairs(frame(spark, new, 10_000), 0.9, others=frame(spark, m)).collect()}
    assert got == {(10_000 + int(a), int(b)) for a, b in zip(*np.nonzero(cosines(new, m) >= 0.9))}


@pytest.mark.parametrize("exclude", [False, True])
def test_nearest_is_pruned(spark, small_blocks, exclude):
    m = clustered(2500)
    m[100:400] = m[7]  # a third of a cell, and ties
    df = frame(spark, m)
    q = df.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    report = pivots.Report()
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in pivots.nearest(q, df, 5, exclude, report).collect()}
    sim = cosines(m[::10], m)
    if exclude:
        sim[np.arange(250), np.arange(0, 2500, 10)] = -9
    want = {(10 * i, r + 1): (int(j), sim[i, j]) for i in range(250) for r, j in enumerate(np.lexsort((np.arange(2500), -sim[i]))[:5])}
    assert got == want and report.share < 0.3


def test_few_zero_and_no_vectors(spark, small_blocks):
    m = clustered(300)
    m[::3] = 0.0
    df = frame(spark, m)
    q = df.where("id < 20").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["rank"]): r["id"] for r in pivots.nearest(q, df, 400).collect()}
    assert len(got) == 20 * 300  # fewer than asked for: all
    none = df.limit(0)
    assert pivots.nearest(q, none, 3).count() == 0 and pivots.nearest(q.limit(0), df, 3).count() == 0
    assert pivots.similar_pairs(none, 0.5).count() == 0 and pivots.similar_pairs(df.limit(3), 0.5, others=none).count() == 0


def test_index_links_like_a_rebuild(spark, small_blocks, tmp_path):
    """Document by document: the pairs of all parts are those of all vectors, and a call reads a part of what is stored."""
    m = clustered(1500)
    df = frame(spark, m)
    index, got, shares = VectorIndex(spark, str(tmp_path)), set(), []
    for a, b in ((0, 900), (900, 1200), (1200, 1230), (1230, 1500)):
        index = VectorIndex.opened(spark, str(tmp_path), index.row())
        report = pivots.Report()
        new, rest = df.where(f"id >= {a} AND id < {b}"), df.where(f"id < {a}")
        got |= {tuple(sorted((r["a"], r["b"]))) for r in index.link(new, rest, 0.9, report=report).collect()}
        shares.append((report.read, a))
    sim = cosines(m, m)
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(sim >= 0.9, 1)))}
    assert index.held == 1500 and len(index.parts) == 4
    assert shares[2][0] < 0.9 * shares[2][1]
    # one of the stored vectors is replaced: a new generation, without the old one
    moved = spark.createDataFrame([(0, "p0", list(map(float, m[700])))], SCHEMA)
    pairs = {(r["a"], r["b"]) for r in index.link(moved, df.where("id > 0"), 0.9, replaced=True).collect()}
    assert pairs == {(0, int(b)) for b in np.flatnonzero(sim[700] >= 0.9) if b} and index.held == 1500 and len(index.parts) == 2


def test_small_parts_share_blocks(spark):
    """20 000 rows of parents with eight sections each fill their blocks; one large parent has several."""
    m = clustered(20_000, 4)
    rows = [(i, "big" if i >= 12_000 else f"p{i // 8}", list(map(float, v))) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, SCHEMA)
    b = stored(vector.blocks(df, "id", "embedding", "parent_id"), "blocks")
    assert b.count() <= 40 and b.selectExpr("sum(size(ids))").first()[0] == 20_000
    few = df.where("id < 4000")
    got = graph.sibling_edges(few)
    assert got.count() == 4000 * 7 and got.where("source_id = 9").count() == 7


def test_a_block_goes_to_tiles_not_to_pairs(spark):
    """Of 40 blocks that all meet, 8 copies of each side's blocks cross the network, not 40."""
    left = spark.range(40).selectExpr("id AS block", "array(id) AS ids", "array(0L) AS parts", "array(0L) AS marks", "cast('x' AS binary) AS matrix")
    pairs = left.selectExpr("block AS la").crossJoin(left.selectExpr("block AS lb"))
    df = pivots.fetched(pairs, left, left)
    got = [(r["a"]["ids"][0], r["b"]["ids"][0]) for r in df.collect()]
    assert sorted(got) == [(i, j) for i in range(40) for j in range(40)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(lb" in plan and "Aggregate [lb" in plan
