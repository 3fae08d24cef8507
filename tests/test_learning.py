"""The set-wise fold against a sequential model, and the single rules by hand."""

import random

import pytest
from pyspark.sql import functions as F

from engram.config import MemoryConfig, ablations
from engram.operators import graph, learning
from engram.schema import require_valid_ids

CFG = MemoryConfig(promote_soft=2, promote_hard=4, promote_trigger=6)
EDGE = "source_id long, target_id long, weight double, edge_type string, co_activation_count int"


def sequential(edges, episodes, cfg):
    e = {(s, t): [w, k, c, None] for s, t, w, k, c in edges}
    for seq, retrieved, useful in episodes:
        for a in useful:
            for b in useful:
                if a == b:
                    continue
                if (a, b) not in e:
                    e[a, b] = [cfg.new_edge_weight, "diffuse", 0, None]
                    continue
                x = e[a, b]
                x[0], x[2] = min(x[0] + cfg.strengthen_rate, 1.0), x[2] + 1
                if x[1] == "diffuse" and x[2] >= cfg.promote_soft:
                    x[1] = "soft"
                elif x[1] == "soft" and x[2] >= cfg.promote_hard:
                    x[1] = "hard"
                elif x[1] == "hard" and x[2] >= cfg.promote_trigger:
                    x[3] = seq
        for a in useful:
            for b in set(retrieved) - set(useful):
                for p in ((a, b), (b, a)):
                    if p in e:
                        e[p][0] = max(e[p][0] - cfg.strengthen_rate * cfg.useless_factor, 0.0)
    return {k: (round(v[0], 6), v[1], v[2], v[3]) for k, v in e.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_sequential(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b, round(rng.random(), 2), rng.choice(["diffuse", "soft", "hard"]), rng.randrange(8)) for a in range(6) for b in range(6) if a != b and rng.random() < 0.5]
    episodes = []
    for seq in range(25):
        r = rng.sample(range(6), rng.randrange(2, 6))
        episodes.append((seq, r, rng.sample(r, rng.randrange(0, len(r)))))
    got = learning.fold_edges(spark.createDataFrame(edges, EDGE), spark.createDataFrame(episodes, "episode_seq long, retrieved_ids array<long>, useful_ids array<long>"), None, CFG)
    assert {(r["source_id"], r["target_id"]): (round(r["weight"], 6), r["edge_type"], r["co_activation_count"], r["trigger_seq"]) for r in got.collect()} == sequential(edges, episodes, CFG)


def test_decay_prune_cap(spark):
    rows = [(1, t, 0.1 + 0.01 * t, "diffuse", 0) for t in range(25)] + [(2, 1, 0.8, "soft", 20), (2, 3, 0.8, "soft", 1), (3, 1, 0.01, "diffuse", 0)]
    out = {(r["source_id"], r["target_id"]): r["weight"] for r in learning.decay_cycle(spark.createDataFrame(rows, EDGE)).collect()}
    assert sum(w == 0 for (s, _), w in out.items() if s == 1) == 5
    assert out[2, 1] == pytest.approx(0.798) and out[2, 3] == pytest.approx(0.78) and out[3, 1] == 0
    report = learning.decay_report(spark.createDataFrame(rows, EDGE), spark.createDataFrame([("t", 0.5, 4, 1), ("u", 0.06, 3, 0)], "id string, confidence double, fire_count int, useful_count int")).first()
    assert (report["edges_decayed"], report["edges_pruned"], report["edges_capped"], report["triggers_decayed"], report["triggers_dead"]) == (27, 1, 5, 2, 1)


def test_bridges(spark):
    rows = [(2, 1, 0.6, "soft", 0), (2, 3, 0.5, "soft", 0), (4, 1, 0.9, "soft", 0), (4, 5, 0.1, "soft", 0)]
    got = learning.discover_bridges(spark.createDataFrame(rows, EDGE)).collect()
    assert [(r["a"], r["c"], r["via"]) for r in got] == [(1, 3, 2)] and got[0]["weight"] == pytest.approx((0.6 * 0.5) ** 0.5 * 0.5, abs=1e-6)


def test_consolidation_makes_triggers(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    eps = spark.createDataFrame([(i, "Deploy pipeline checks", [1.0, 0.0], ["a", "b"], ["a"], ["a", "b"]) for i in range(5)], "episode_seq long, context string, context_embedding array<float>, retrieved_ids array<string>, triggered_ids array<string>, useful_ids array<string>")
    triggers = spark.createDataFrame([], "id string, pattern array<string>, pattern_embedding array<float>, associated_node_id string, confidence double, fire_count int, useful_count int, origin string")
    edges = spark.createDataFrame([], EDGE.replace("long", "string"))
    edges, triggers = learning.learn(edges, triggers, eps, lambda df: df.checkpoint(), CFG)
    edge = edges.where("source_id = 'a'").first()
    assert (edge["edge_type"], edge["co_activation_count"]) == ("hard", 4) and edge["weight"] == pytest.approx(0.6)
    edges, triggers = learning.consolidate(edges, triggers, eps, lambda df: df.checkpoint(), -1, CFG)
    found = {r["id"]: r for r in triggers.collect()}
    assert set(found) == {"hebbian_a_b", "hebbian_b_a"} or "consolidated_a" in found
    t = found["hebbian_a_b"]
    assert t["pattern"] == ["deploy", "pipeline", "checks"] and t["pattern_embedding"] == [1.0, 0.0] and t["associated_node_id"] == "b"


def test_feedback_upsert_and_ids(spark):
    t = spark.createDataFrame([("t", "a", 0.7, 0, 0), ("u", "z", 0.7, 0, 0)], "id string, associated_node_id string, confidence double, fire_count int, useful_count int")
    e = spark.createDataFrame([(1, ["a"], ["a"]), (2, ["a"], ["b"]), (3, [], ["a"])], "episode_seq long, triggered_ids array<string>, useful_ids array<string>")
    r = {x["id"]: x for x in learning.trigger_feedback(t, e).collect()}
    assert (r["t"]["fire_count"], r["t"]["useful_count"], round(r["t"]["confidence"], 6), r["u"]["fire_count"]) == (2, 1, 0.68, 0)
    old, new = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string"), spark.createDataFrame([(2, "z"), (3, "q")], "id int, v string")
    assert sorted((x["id"], x["v"]) for x in learning.upsert(old, new, ["id"]).collect()) == [(1, "x"), (2, "z"), (3, "q")]
    with pytest.raises(Exception):
        require_valid_ids(spark.createDataFrame([("",)], "id string"), "id").collect()


def test_bfs_first_visit_and_cap(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.9), (3, 2, 0.9), (2, 4, 0.5), (3, 4, 0.3), (4, 5, 0.2)], "source_id long, target_id long, weight double")
    entries = spark.createDataFrame([(7, 1, 1)], "query_id long, id long, rank int")
    got = {r["id"]: (r["depth"], round(r["path"], 6)) for r in graph.focused_bfs(entries, edges).collect()}
    assert got == {2: (1, 0.5), 3: (1, 0.9), 4: (2, 0.27)}


def test_config():
    assert MemoryConfig().variant == "full" and len(ablations()) == 6
    with pytest.raises(ValueError):
        MemoryConfig(strengthen_rate=2)


def test_diffuse_walk_equals_brute_force(spark):
    """Walk by walk over a small graph, with the operator's own uniforms: weights by temperature and novelty."""
    import math
    import random

    cfg = MemoryConfig(diffuse_temperature=0.7, novelty_penalty=0.8, diffuse_top_k=3)
    rng = random.Random(4)
    nodes, queries = list(range(12)), [1, 2]
    edges = {(a, b): round(rng.uniform(0.1, 1), 3) for a in nodes for b in rng.sample(nodes, 4) if a != b}
    edges[0, 11] = 0.0
    access = {n: rng.randrange(4) for n in nodes if n != 5}
    entries = {1: [0, 3], 2: [7]}
    visited = {1: {0, 3, 4}, 2: {7}}
    e = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "source_id long, target_id long, weight double")
    pairs = lambda d: spark.createDataFrame([(q, n) for q, x in d.items() for n in x], "query_id long, id long")
    got = graph.diffuse_walk(pairs(entries), e, pairs(visited), spark.createDataFrame(list(access.items()), "id long, access_count int"), cfg)

    walks = 3 * cfg.diffuse_top_k
    u = lambda *c: (F.pmod(F.xxhash64(*c, F.lit(cfg.seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    grid = spark.createDataFrame([(q, w, n) for q in queries for w in range(1, walks + 1) for n in nodes], "query_id long, walk int, id long")
    cols = [u("query_id", "walk").alias("a"), u("query_id", "walk", "id").alias("b"), *[u("query_id", "walk", "id", F.lit(s)).alias(f"s{s}") for s in (1, 2, 3)]]
    draws = {(r["query_id"], r["walk"], r["id"]): r for r in grid.select("*", *cols).collect()}
    want = set()
    for q in queries:
        first: dict[int, list[int]] = {}
        for w in range(1, walks + 1):
            at = min(entries[q], key=lambda n: draws[q, w, n]["b"])
            for step in range(1, 3 + (draws[q, w, 0]["a"] >= 0.5)):
                ways = [(math.log(draws[q, w, b][f"s{step}"]) / (x ** (1 / 0.7) / (1 + access.get(b, 0) * 0.8)), -b) for (a, b), x in edges.items() if a == at and x > 0 and b not in visited[q]]
                if not ways:
                    break
                at = -max(ways)[1]
                old = first.setdefault(at, [w, step])
                first[at] = [min(old[0], w), min(old[1], step)]
        want |= {(q, n) for n in sorted(first, key=lambda n: (*first[n], n))[: cfg.diffuse_top_k]}
    assert {(r["query_id"], r["id"]) for r in got.collect()} == want and len(want) == 6
    assert graph.diffuse_walk(pairs(entries), e, pairs(visited), None, MemoryConfig(diffuse_top_k=0)).count() == 0
    assert graph.focused_bfs(pairs(entries).withColumn("rank", F.lit(1)), e, MemoryConfig(focused_max_depth=0)).count() == 0


def online(edges, episodes, cfg):
    """One episode after the other with a decay cycle after each tick: edges, learned triggers, feedback, as a plain model."""
    from collections import Counter

    e = {(a, b): [w, k, c] for a, b, w, k, c in edges}
    triggers, cycles, seen = {}, episodes[0][0] // cfg.tick_every, []

    def cycle():
        for k, x in e.items():
            rate = cfg.decay_rate * (cfg.crystallise_slowdown if x[2] >= cfg.crystallise_count else 1)
            x[0] = x[0] - rate if x[0] > rate else x[0]
            x[0] = 0.0 if x[0] < cfg.prune_floor else x[0]
        for a in {k[0] for k in e}:
            for k in sorted((k for k in e if k[0] == a), key=lambda k: (-e[k][0], k[1]))[cfg.out_degree_cap :]:
                e[k][0] = 0.0
        for t in triggers.values():
            if t["f"] >= cfg.min_fires and t["u"] / t["f"] < cfg.usefulness_floor:
                t["conf"] = max(t["conf"] - cfg.decay_rate, 0.0)

    for seq, context, vector, retrieved, fired, useful in episodes:
        while cycles < seq // cfg.tick_every:
            cycle()
            cycles += 1
        seen.append((seq, context, vector, set(useful)))
        for t in triggers.values():
            if t["node"] in fired:
                t["f"] += 1
                t["u"] += t["node"] in useful
                if t["node"] not in useful:
                    t["conf"] = max(t["conf"] - cfg.decay_rate, 0.0)
        asked = []
        for a in useful:
            for b in useful:
                if a == b:
                    continue
                x = e.get((a, b))
                if x is None:
                    e[a, b] = [cfg.new_edge_weight, "diffuse", 0]
                    continue
                x[0], x[2] = min(x[0] + cfg.strengthen_rate, 1.0), x[2] + 1
                if x[1] == "diffuse" and x[2] >= cfg.promote_soft:
                    x[1] = "soft"
                elif x[1] == "soft" and x[2] >= cfg.promote_hard:
                    x[1] = "hard"
                elif x[1] == "hard" and x[2] >= cfg.promote_trigger:
                    asked.append((a, b))
        for a in useful:
            for b in set(retrieved) - set(useful):
                for p in ((a, b), (b, a)):
                    if p in e:
                        e[p][0] = max(e[p][0] - cfg.strengthen_rate * cfg.useless_factor, 0.0)
        for a, b in asked:
            own = [(c, v) for _, c, v, u in seen if a in u and b in u]
            n, first = Counter(), {}
            for i, (c, _) in enumerate(own):
                for j, w in enumerate(c.lower().split()):
                    n[w] += 1
                    first.setdefault(w, (i, j))
            words = sorted(n, key=lambda w: (-n[w], first[w]))[: cfg.learned_keywords]
            mean = [round(sum(v[k] for _, v in own) / len(own), 4) for k in range(2)]
            triggers[f"hebbian_{a}_{b}"] = {"node": b, "conf": cfg.learned_confidence, "f": 0, "u": 0, "words": words, "mean": mean}
    while cycles < (episodes[-1][0] + 1) // cfg.tick_every:
        cycle()
        cycles += 1
    return {k: (round(x[0], 6), x[1], x[2]) for k, x in e.items()}, {k: (t["node"], round(t["conf"], 6), t["f"], t["u"], t["words"], t["mean"]) for k, t in triggers.items()}


LEARN = "episode_seq long, context string, context_embedding array<float>, retrieved_ids array<string>, triggered_ids array<string>, useful_ids array<string>"
TRIGGER = "id string, pattern array<string>, pattern_embedding array<float>, associated_node_id string, confidence double, fire_count int, useful_count int, origin string"


def some_episodes(rng, nodes, gaps=True):
    out, seq = [], rng.randrange(20)
    for _ in range(60):
        r = rng.sample(nodes, rng.randrange(2, 7))
        out.append((seq, " ".join(rng.choice(["lamp", "boat", "tree", "stone", "river"]) for _ in range(4)), [rng.random(), rng.random()], r, rng.sample(nodes, 3), rng.sample(r, rng.randrange(0, len(r)))))
        seq += rng.choice([1, 1, 1, 2, 13]) if gaps else 1
    return out


@pytest.mark.parametrize("seed,cuts", [(1, [0, 60]), (2, [0, 7, 8, 31, 60]), (3, list(range(0, 61, 10)))])
def test_learning_equals_one_by_one(spark, tmp_path, seed, cuts):
    """Ticks, the cap and learned triggers; whatever the batches, the state is that of one episode after the other."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    cfg = MemoryConfig(promote_soft=1, promote_hard=2, promote_trigger=3, tick_every=4, out_degree_cap=3, crystallise_count=4)
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(8)]
    edges = [(a, b, round(rng.random(), 2), rng.choice(["diffuse", "soft", "hard"]), rng.randrange(6)) for a in nodes for b in nodes if a != b and rng.random() < 0.4]
    edges += [("far", x, 0.5, "soft", 0) for x in nodes]  # a source without episodes decays too
    eps = some_episodes(rng, nodes)
    want_edges, want_triggers = online(edges, eps, cfg)
    e, t, last = spark.createDataFrame(edges, EDGE.replace("long", "string")), spark.createDataFrame([], TRIGGER), None
    for a, b in zip(cuts, cuts[1:]):
        before = spark.createDataFrame(eps[:a], LEARN) if a else None
        e, t = learning.learn(e, t, spark.createDataFrame(eps[a:b], LEARN), lambda df: df.checkpoint(), cfg, None, before, last)
        last = eps[b - 1][0]
    assert {(r["source_id"], r["target_id"]): (round(r["weight"], 6), r["edge_type"], r["co_activation_count"]) for r in e.collect()} == want_edges
    got = {r["id"]: (r["associated_node_id"], round(r["confidence"], 6), r["fire_count"], r["useful_count"], r["pattern"], [round(x, 4) for x in r["pattern_embedding"]]) for r in t.collect()}
    assert got.keys() == want_triggers.keys() and len(got) > 5
    for k, v in got.items():
        assert v[:5] == want_triggers[k][:5] and v[5] == pytest.approx(want_triggers[k][5], abs=2e-4)


def test_stream_gives_the_state_of_learn(spark, tmp_path):
    """Sixty episodes in files of uneven sizes, one a micro-batch, against one episode after the other."""
    from engram.streaming.episodes import learn_online, read_episodes

    cfg = MemoryConfig(promote_soft=1, promote_hard=2, promote_trigger=3, tick_every=4, out_degree_cap=3, crystallise_count=4)
    rng = random.Random(11)
    nodes = [f"n{i}" for i in range(8)]
    edges = [(a, b, round(rng.random(), 2), "soft", rng.randrange(6)) for a in nodes for b in nodes if a != b and rng.random() < 0.4]
    eps = some_episodes(rng, nodes)
    want_edges, want_triggers = online(edges, eps, cfg)
    spark.createDataFrame(edges, EDGE.replace("long", "string")).write.parquet(str(tmp_path / "edges/v0"))
    spark.createDataFrame([], TRIGGER).write.parquet(str(tmp_path / "triggers/v0"))
    cuts = [0, 3, 25, 26, 60]
    for a, b in zip(cuts, cuts[1:]):
        spark.createDataFrame(eps[a:b], LEARN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = learn_online(read_episodes(spark, str(tmp_path / "in"), LEARN), str(tmp_path), str(tmp_path / "ck"), cfg)
    q.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "edges/v4"))
    assert {(r["source_id"], r["target_id"]): (round(r["weight"], 6), r["edge_type"], r["co_activation_count"]) for r in got.collect()} == want_edges
    triggers = {r["id"]: (r["associated_node_id"], round(r["confidence"], 6), r["fire_count"], r["useful_count"], r["pattern"]) for r in spark.read.parquet(str(tmp_path / "triggers/v4")).collect()}
    assert triggers == {k: v[:5] for k, v in want_triggers.items()} and len(triggers) > 5
