"""A memory from end to end, against a row-wise model where one is short."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.config import MemoryConfig, ablations
from engram.functions.vector import blocks, vector_join, vector_topk
from engram.memory import Memory
from engram.operators import harness, search
from engram.operators.ingest import hashed_embedding

DOCS = [
    ("deploy", "Deploy guide", "## Rollback\nRun rollback_release before noon and tell the crew.\n## Canary\nSend a tenth of traffic to the canary fleet first."),
    ("vacation", "Vacation policy", "## Requests\nAsk your lead two weeks ahead of a vacation.\n## Carryover\nUnused vacation days expire in March."),
    ("kitchen", "Kitchen", "Please rinse every mug. The dishwasher runs at night."),
    ("empty", None, None),
]
QUERIES = [("q1", "how do I rollback_release a bad deploy"), ("q2", "do vacation days expire"), ("q3", ""), ("q4", None)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def made(spark, tmp_path):
    def make(**kw):
        m = Memory(spark, str(tmp_path / "memory"), **kw)
        m.index(frame(spark, DOCS, "id string, title string, text string"))
        return m

    return make


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_text_ids_join_like_numbers(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(30, 8))
    rows = [(i, f"n{i:02d}", f"p{i % 4}", [float(x) for x in v[i]]) for i in range(30)]
    df = frame(spark, rows, "n long, s string, p string, e array<double>")
    num, txt = blocks(df, "n", "e"), blocks(df, "s", "e")
    a = {(r["a"], r["b"]) for r in vector_join(num, num, 0.2, ordered=True).collect()}
    assert {(f"n{x:02d}", f"n{y:02d}") for x, y in a} == {(r["a"], r["b"]) for r in vector_join(txt, txt, 0.2, ordered=True).collect()}
    part = blocks(df, "s", "e", "p")
    assert {(r["a"], r["b"]) for r in vector_join(part, part, 0.2, same_part=True, ordered=True).collect()} == {(f"n{x:02d}", f"n{y:02d}") for x, y in a if x % 4 == y % 4}
    near = vector_topk(part, part, 3, exclude_self=False, same_part=True).collect()
    assert len(near) == 90 and all(int(r["query_id"][1:]) % 4 == int(r["id"][1:]) % 4 for r in near)


def test_sections(spark, made):
    m = made()
    nodes = {r["id"]: r for r in m.table("nodes").collect()}
    assert {"deploy", "deploy::s0", "deploy::s1", "vacation::s1", "kitchen::s0"} <= nodes.keys()
    edges = {(r["source_id"], r["target_id"]): r for r in m.table("edges").collect()}
    assert edges["deploy", "deploy::s0"]["edge_type"] == "hard" and ("deploy::s0", "deploy") not in edges
    assert ("deploy::s0", "deploy::s1") in edges and ("deploy::s1", "deploy::s0") in edges
    assert len(edges) == m.table("edges").count()
    found = ranked(m.retrieve(frame(spark, QUERIES, "query_id string, text string"), 3))
    assert all(len(v) <= 3 and len(set(v)) == len(v) for v in found.values())
    m.cfg = MemoryConfig(enable_triggers=False, enable_graph=False)
    plain = ranked(m.retrieve(frame(spark, QUERIES, "query_id string, text string"), 3))
    for q, text in QUERIES:
        score = {i: cosine(vector(text), np.array(n["embedding"])) for i, n in nodes.items() if n["node_type"] == "section"}
        assert plain[q] == sorted(score, key=lambda i: (-score[i], i))[:3]


def test_trigger_channel(spark, made):
    m = made()
    m.index(frame(spark, [(f"filler{i}", f"w{i}", f"w{i}a w{i}b w{i}c") for i in range(12)], "id string, title string, text string"))
    rows = m.retrieve(frame(spark, [("q", "rollback_release before noon and tell the crew")], "query_id string, text string"), 3).collect()
    assert {r["id"]: r["channel"] for r in rows}["deploy::s0"] == "trigger"
    m.cfg, m.gate = MemoryConfig(enable_gate=True), lambda c: c.where(F.lit(False))
    rows = m.retrieve(frame(spark, [("q", "rollback_release before noon and tell the crew")], "query_id string, text string"), 3).collect()
    assert all(r["channel"] != "trigger" for r in rows)


def test_indexing_again_keeps_one_row_an_id(spark, made):
    m = made()
    n, e = m.table("nodes").count(), m.table("edges").count()
    m.index(frame(spark, DOCS[:1], "id string, title string, text string"))
    assert (m.table("nodes").count(), m.table("edges").count()) == (n, e)
    m.index(frame(spark, [("new", "Canary birds", "The canary fleet sings first.")], "id string, title string, text string"))
    assert m.table("edges").where("source_id = 'new::s0' AND target_id = 'deploy::s1'").count() == 1
    assert m.table("nodes").groupBy("id").count().where("count > 1").count() == 0
    m.reset()
    assert m.table("nodes").count() == 0


def test_replaced_document_leaves_nothing_stale(spark, made):
    """A section that a document no longer has goes, with its edges, its triggers and its vector; others stay."""
    m = made()
    schema = "id string, title string, text string"
    pair = ["deploy::s1", "kitchen::s0"]
    m.update(frame(spark, [(0, "mug", pair, [], pair)], "episode_seq long, context string, retrieved_ids array<string>, triggered_ids array<string>, useful_ids array<string>"))
    assert m.table("edges").where("target_id = 'deploy::s1'").count() > 0
    others = {r["id"] for r in m.table("nodes").collect() if not r["id"].startswith("deploy")}
    m.index(frame(spark, [("deploy", "Deploying", "# Deploying\n\nOnly one plain section is left.")], schema), replace=True)
    ids = {r["id"] for r in m.table("nodes").collect()}
    assert "deploy::s0" in ids and "deploy::s1" not in ids and others <= ids
    assert m.table("edges").where("source_id = 'deploy::s1' OR target_id = 'deploy::s1'").count() == 0
    named = {r["associated_node_id"] for t in ("explicit", "triggers") for r in m.table(t).collect()}
    assert "deploy::s1" not in named and named <= ids
    words = [w for r in m.table("explicit").where("associated_node_id = 'deploy::s0'").collect() for w in r["pattern"]]
    assert "canary" not in words
    found = ranked(m.retrieve(frame(spark, QUERIES, "query_id string, text string"), 10))
    assert all("deploy::s1" not in v for v in found.values())
    assert m.table("edges").count() == m.table("edges").select("source_id", "target_id").distinct().count()


def test_learning_and_consolidation(spark, made):
    m = made(cfg=MemoryConfig(promote_soft=2, promote_hard=3, promote_trigger=4))
    pair = ["deploy::s0", "kitchen::s0"]
    start = {(r["source_id"], r["target_id"]): r["weight"] for r in m.table("edges").collect()}
    rows = [(i, "rollback_release mug", pair, [], pair) for i in range(6)]
    schema = "episode_seq long, context string, retrieved_ids array<string>, triggered_ids array<string>, useful_ids array<string>"
    m.update(frame(spark, rows, schema))
    edge = m.table("edges").where("source_id = 'deploy::s0' AND target_id = 'kitchen::s0'").first()
    w, n = (start.get(tuple(pair)), 0)
    for _ in range(6):
        w, n = (0.2, 0) if w is None else (min(w + 0.1, 1.0), n + 1)
    assert edge["weight"] == pytest.approx(w) and edge["co_activation_count"] == n and edge["edge_type"] == "hard"
    learned = {r["id"]: r for r in m.table("triggers").collect()}
    assert learned["hebbian_deploy::s0_kitchen::s0"]["pattern"] == ["rollback_release", "mug"]
    assert {r["id"]: r["access_count"] for r in m.table("nodes").collect()}["deploy::s0"] == 6
    m.update(frame(spark, [(6, "x", ["deploy::s0", "nowhere"], [], ["deploy::s0", "nowhere"])], schema))
    assert m.table("edges").where("target_id = 'nowhere'").count() == 0
    m.consolidate()
    assert m.table("consolidated").first()[0] == 6
    after = m.table("edges").where("source_id = 'deploy::s0' AND target_id = 'kitchen::s0'").first()
    assert after["co_activation_count"] == n + 6
    opened = Memory(spark, m.folder, version=m.version)
    assert opened.table("edges").count() == m.table("edges").count()


def vector(text, size=64):
    import hashlib

    v = np.zeros(size)
    for t in re.findall(r"[a-zA-Z][a-zA-Z0-9_-]+", (text or "").lower()):
        v[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % size] += 1
    return v


def cosine(a, b):
    return round(float(a @ b) / ((math.sqrt(a @ a) + 1e-8) * (math.sqrt(b @ b) + 1e-8)), 6)


def test_flat_documents_equal_brute_force(spark, made):
    flat = ablations()["flat"]
    m = made(level="document", cfg=flat)
    found = ranked(m.retrieve(frame(spark, QUERIES, "query_id string, text string"), 2))
    texts = {i: f"{t}: {x}" if t else x or "" for i, t, x in DOCS}
    for q, text in QUERIES:
        score = {i: cosine(vector(text), vector(x)) for i, x in texts.items()}
        assert found[q] == sorted(score, key=lambda i: (-score[i], i))[:2]


def test_variants_of_documents(spark, made):
    m = made(level="document")
    q = frame(spark, QUERIES, "query_id string, text string")
    for name in ("flat", "graph-only", "full"):
        cfg = m.cfg = ablations()[name]
        found = m.retrieve(q, 3).collect()
        assert {r["query_id"] for r in found} == {"q1", "q2", "q3", "q4"}, name
        assert max(r["rank"] for r in found) <= 3
        assert any(r["is_triggered"] for r in found) == cfg.enable_triggers
    m.index(frame(spark, DOCS, "id string, title string, text string"), rebuild=True)
    assert m.table("nodes").count() == 4


EXAMPLES = [
    ("a", "set", "Where is the red lamp", [("1", "Lamps", "The red lamp stands in the hall.", True), ("2", "Cups", "Cups are blue.", False), ("1", "Again", "Repeated.", False)], ["1"], "one"),
    ("b", "set", "Who owns the boat", [("1", "Boat", "The boat belongs to Ida.", True)], ["1"], "two"),
    ("c", "set", None, [], None, "two"),
]


def test_examples_stay_apart(spark):
    schema = "id string, benchmark string, query string, documents array<struct<id:string,title:string,text:string,is_supporting:boolean>>, supporting_doc_ids array<string>, category string"
    ex = frame(spark, EXAMPLES, schema)
    for cfg in (ablations()["flat"], MemoryConfig()):
        rows = harness.retrieve_examples(ex, 2, cfg).collect()
        assert rows and all(r["id"].split("/")[0] == r["query_id"] for r in rows)
        got = {(r["query_id"], r["metric"]): r["value"] for r in harness.evaluate_examples(ex, 3, cfg).collect()}
        assert got["a", "recall@1"] == 1.0 and got["b", "precision@1"] == 1.0
        assert got["c", "recall@1"] == 1.0 and got["c", "precision@1"] == 0.0 and ("c", "recall@5") not in got


def test_scenarios(spark):
    memories = frame(spark, [("deploys", "## Rollback\nRun rollback_release before noon."), ("food", "## Lunch\nPizza on Fridays.")], "name string, text string")
    expect = "array<struct<memory:string,section:string,reason:string>>"
    rows = [("s1", "n", "c", "please rollback_release now before noon", [("deploys", None, None)], [("food", None, None)]), ("s2", "n", "c", "zzz", [], None)]
    sc = frame(spark, rows, f"id string, name string, category string, context string, expected {expect}, non_expected {expect}")
    got = {r["id"]: r for r in harness.evaluate_scenarios(sc, memories).collect()}
    assert got["s1"]["trigger_recall"] == 1.0 and got["s1"]["trigger_precision"] == 1.0 and got["s1"]["fired"] == ["deploys"]
    assert got["s2"]["trigger_recall"] == 1.0 and got["s2"]["trigger_precision"] == 1.0


def test_feedback_makes_episodes(spark, made):
    m = made()
    q = frame(spark, QUERIES[:2], "query_id string, text string")
    gold = frame(spark, [("q1", "deploy::s0"), ("q2", "vacation::s1")], "query_id string, id string")
    e = harness.feedback(m.retrieve(q, 3), q, gold, after=4)
    rows = {r["episode_seq"]: r for r in e.collect()}
    assert rows.keys() == {5, 6} and rows[5]["useful_ids"] == ["deploy::s0"] and "deploy::s0" in rows[5]["retrieved_ids"]
    m.update(e)
    assert m.table("episodes").count() == 2
