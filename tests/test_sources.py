import json
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from engram.operators import gate, ingest
from engram.schema import EPISODES
from engram.sources import loaders
from engram.streaming.episodes import learn_online, read_episodes


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")
    return str(path)


def test_paragraphs(spark, tmp_path):
    p = lines(tmp_path / "musique_dev.jsonl", [{"id": "2hop__9_8", "question": "q", "answer": "a", "answer_aliases": ["b"], "paragraphs": [{"idx": 0, "title": "T", "paragraph_text": "x", "is_supporting": True}, {"idx": 1, "title": "U", "paragraph_text": "y", "is_supporting": False}], "question_decomposition": [{"question": "s", "answer": "t", "paragraph_support_idx": None}]}])
    r = loaders.load_paragraph_qa(spark, p).first()
    assert r["supporting_doc_ids"] == ["musique_2hop__9_8_p0"] and r["category"] == "2hop" and r["reasoning_chain"][0]["supporting_doc_id"] is None and r["metadata"] == {"answerable": "true"}
    assert list(loaders.load_all(spark, str(tmp_path))) == ["musique"]


def test_contexts_sessions_agents(spark, tmp_path):
    p = lines(tmp_path / "h.jsonl", [{"id": "h1", "question": "q", "answer": "a", "type": "bridge", "level": "hard", "context": {"title": ["A", "B"], "sentences": [["one.", "two."], ["three."]]}, "supporting_facts": {"title": ["B"], "sent_id": [0]}}])
    r = loaders.load_context_qa(spark, p).first()
    assert [d["text"] for d in r["documents"]] == ["one. two.", "three."] and r["supporting_doc_ids"] == ["hotpotqa_h1_p1"]
    (tmp_path / "l.json").write_text(json.dumps([{"question_id": "x", "question": "q", "answer": "a", "question_type": "single", "haystack_dates": ["d"], "haystack_session_ids": ["s1"], "haystack_sessions": [[{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]], "answer_session_ids": ["s1"]}]))
    r = loaders.load_session_qa(spark, str(tmp_path / "l.json")).first()
    assert r["documents"][0]["text"] == "[user]: hi\n[assistant]: yo" and r["supporting_doc_ids"] == ["s1"]
    p = lines(tmp_path / "m.jsonl", [{"context": "c", "questions": ["q1", "q2", "q3"], "answers": [["a", "b"], "z"], "metadata": {"source": "src", "qa_pair_ids": ["id0"]}}])
    rows = sorted(loaders.load_agent_qa(spark, p).collect(), key=lambda r: r["query"])
    assert [(r["id"], r["answer"], r["answer_aliases"]) for r in rows] == [("id0", "a", ["b"]), ("src_q1", "z", [])]


def test_scenarios_and_memories(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("- id: s1\n  name: n\n  category: c\n  context: text\n  expected_triggers:\n    - {memory: m, section: s}\n")
    r = loaders.load_trigger_scenarios(spark, str(tmp_path / "r.yaml")).first()
    assert r["expected"][0]["memory"] == "m" and r["non_expected"] == []
    (tmp_path / "p.yaml").write_text("- id: p1\n  sequence:\n    - {context: a, expect_edge: soft}\n    - {context: b}\n")
    assert [x["expectations"] for x in loaders.load_promotion_scenarios(spark, str(tmp_path / "p.yaml")).orderBy("step").collect()] == [{"expect_edge": '"soft"'}, {}]
    (tmp_path / "b.md").write_text("two"), (tmp_path / "a.md").write_text("one")
    assert [tuple(x) for x in loaders.load_memories(spark, str(tmp_path)).collect()] == [("a.md", "one"), ("b.md", "two")]
    (tmp_path / "q.yaml").write_text("scenarios:\n  - id: p2\n    description: d\n    sequence:\n      - {context: a, marked_useful: false}\n")
    row = loaders.load_promotion_scenarios(spark, str(tmp_path / "q.yaml")).first()
    assert (row["id"], row["description"], row["expectations"]) == ("p2", "d", {"marked_useful": "false"})
    (tmp_path / "t.yaml").write_text("scenarios:\n  - {id: s2, context: x, expected_non_triggers: [{memory: a.md}]}\n")
    both = loaders.load_trigger_scenarios(spark, str(tmp_path / "r.yaml"), str(tmp_path / "t.yaml")).collect()
    assert [r["id"] for r in both] == ["s1", "s2"] and both[1]["non_expected"][0]["memory"] == "a.md"


def test_ingest(spark):
    docs = spark.createDataFrame([("d", "Doc", "# Head\nintro text\n## Rate limits\nUse NGINX here."), ("e", "Plain", "no headings"), ("f", "Chat", "[user]: Kyoto trip\n[assistant]: ok")], "id string, title string, content string")
    s = {r["id"]: (r["title"], r["content"]) for r in ingest.sections(docs).collect()}
    assert s["d::s0"] == ("Head", "intro text") and s["d::s1"] == ("Rate limits", "Use NGINX here.") and s["e::s0"] == ("Plain", "no headings")
    t = {r["id"]: r["pattern"] for r in ingest.explicit_triggers(docs).collect()}
    assert t["trigger_d_1"] == ["rate", "limits", "use", "nginx", "here"] and t["trigger_f_conv"] == ["kyoto", "trip"]
    a = ingest.sections(docs).select("id", "embedding").orderBy("id").first()
    assert len(a["embedding"]) == 64 and sum(a["embedding"]) == 3.0


def test_gate(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4)], "query_id long, id long, score double")
    assert gate.gated(df, None).count() == 2
    assert [r["id"] for r in gate.gated(df, lambda rows: pd.Series(["irrelevant" if i == 1 else "possibly_relevant" for i in rows["id"]])).collect()] == [2]

    def broken(rows):
        raise RuntimeError

    assert gate.gated(df, broken).count() == 2


ANSWERS = {
    '{"decision": "irrelevant", "reason": "x"}': "irrelevant",
    ' so ```json\n{"decision": "irrelevant"}\n``` or {"decision": "relevant"}': "irrelevant",
    '``` none ``` ```{"decision": "possibly_relevant", "a": {"b": 1}}```': "possibly_relevant",
    '{"decision": "irrelevant"} {"decision": "irrelevant"}': "relevant",
    '{"decision": "irrelevant"}, {"decision": "irrelevant"}': "relevant",
    '{"decision": "suppress"}': "relevant",
    '{"decision": "Irrelevant"}': "relevant",
    '{"reason": "irrelevant"}': "relevant",
    '{"decision": "irrelevant"': "relevant",
    "irrelevant": "relevant",
    "": "relevant",
}


def test_decisions(spark):
    df = spark.createDataFrame([(x,) for x in [*ANSWERS, None]], "a string")
    got = {r["a"]: r["d"] for r in df.select("a", gate.extract_decision(F.col("a")).alias("d")).collect()}
    assert got == {**ANSWERS, None: "relevant"}


def test_model_gate(spark):
    """The model sees the task, the title, the parent and 200 characters; what it can't judge passes."""
    cand = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.8), (1, "c", 0.7), (1, "lost", 0.6)], "query_id long, id string, score double").coalesce(1)
    q = spark.createDataFrame([(1, "fix the lamp")], "query_id long, text string")
    nodes = spark.createDataFrame([("a", "Lamps", "home", "x" * 300), ("b", "Boats", None, "sea"), ("c", "Crash", "p", None)], "id string, title string, parent_id string, content string")
    shown = {r["id"]: r["prompt"] for r in gate.prompts(cand, q, nodes).collect()}
    assert shown["lost"] is None and "fix the lamp" in shown["a"] and "Lamps (part of home)" in shown["a"] and "x" * 200 in shown["a"] and "x" * 201 not in shown["a"]
    failures = spark.sparkContext.accumulator(0)

    def ask(prompts):
        if prompts.str.contains("Crash").any():
            raise RuntimeError("no answer")
        return prompts.map(lambda p: '{"decision": "irrelevant"}' if "Boats" in p else "fine")

    kept = gate.model_gate(ask, q, nodes, failures)(cand)
    assert kept.columns == cand.columns and sorted(r["id"] for r in kept.collect()) == ["a", "c", "lost"] and failures.value == 1


def test_stream(spark, tmp_path):
    row = lambda i: (i, "c", None, ["a", "b"], ["a"], ["a", "b"], datetime(2024, 1, 1))
    for i in range(3):
        spark.createDataFrame([row(i)], EPISODES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([], "source_id string, target_id string, weight double, edge_type string, co_activation_count int").write.parquet(str(tmp_path / "edges/v0"))
    spark.createDataFrame([("t", "a", 0.7, 0, 0)], "id string, associated_node_id string, confidence double, fire_count int, useful_count int").write.parquet(str(tmp_path / "triggers/v0"))
    q = learn_online(read_episodes(spark, str(tmp_path / "in")), str(tmp_path), str(tmp_path / "ck"))
    q.awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "edges/v3")).where("source_id = 'a'").first()
    assert (last["co_activation_count"], round(last["weight"], 6)) == (2, 0.4)
    assert spark.read.parquet(str(tmp_path / "triggers/v3")).first()["useful_count"] == 3


def test_gate_failures_are_counted(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4)], "query_id long, id long, score double").coalesce(1)
    failures = spark.sparkContext.accumulator(0)

    def broken(rows):
        raise RuntimeError("no model")

    assert gate.gated(df, broken, failures=failures).count() == 2 and failures.value == 2  # one for each candidate


def test_wide_vectors_count_tokens(spark):
    """The dense vector of any size equals counts slot by slot; null stays null and no token gives zeros."""
    import hashlib

    rows = [(0, "red lamp red Boat"), (1, ""), (2, None), (3, "x1 y2 z3 " * 50)]
    df = spark.createDataFrame(rows, "id int, text string").select("id", ingest.hashed_embedding(F.col("text"), 7).alias("a"), ingest.wide_embedding(F.col("text")).alias("b"))
    for r in df.collect():
        text = rows[r["id"]][1]
        for got, size in ((r["a"], 7), (r["b"], ingest.WIDE)):
            want = None if text is None else [0.0] * size
            for t in [w for w in (text or "").lower().split()]:
                want[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % size] += 1
            assert got == want
