"""The Jaccard join and decontamination against brute force."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engram.llm.decontamination import drop_leaked, find_leaks
from engram.llm.jaccard_groups import Threshold, components, jaccard_components, keep_one_of_each, part_keys
from helpers import empty_docs, odd_docs, prose, words


def low(text):
    return words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, k):
    w = low(text)
    return [tuple(w)] if 0 < len(w) < k else list(zip(*[w[i:] for i in range(k)]))


def brute_components(docs, t):
    sets = {i: frozenset(grams(x, t.k)) for i, x in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if t.over * both >= t.of * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    """Near copies by chains of edits, shared passages, short texts of few words, exact copies."""
    rng = random.Random(seed)
    passage, docs = prose(rng, 60), []
    for _ in range(12):
        base = prose(rng, rng.choice([4, 8, 20, 60, 150])).split()
        if rng.random() < 0.4:
            base += passage.split()
        docs.append(" ".join(base))
        for _ in range(rng.randrange(7)):
            for _ in range(rng.randrange(4)):
                base[rng.randrange(len(base))] = f"w{rng.randrange(400)}"
            docs.append(" ".join(base) + " W1" * (rng.random() < 0.2))
    docs += [docs[0]] * 5 + ["w1 w2 w3", "w1 w2 w3 w4", "W1 w2 W3"]
    return list(enumerate(docs))


@pytest.mark.parametrize("seed,t", [(1, Threshold(4, 85)), (2, Threshold(5, 80)), (3, Threshold(5, 80)), (4, Threshold(4, 85))])
def test_components_equal_brute_force(spark, seed, t):
    docs = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), t).collect()}
    assert got == brute_components(docs, t)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 120), st.integers(0, 30), st.integers(0, 30), st.integers(0, 10**6), st.sampled_from([(4, 85), (5, 80), (5, 50)]))
def test_linked_sets_share_enough_parts(n, more, less, seed, kt):
    """What the join stands on: sets over the threshold share as many parts as each of them says."""
    import numpy as np

    t = Threshold(*kt)
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**64, n + more + less, dtype=np.uint64))
    a, b = np.sort(pool[: n + more]), np.sort(np.concatenate([pool[:n], pool[n + more :]]))
    both = len(np.intersect1d(a, b))
    key, at, need = part_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), t)
    shared = len(np.intersect1d(key[at == 0], key[at == 1]))
    if t.over * both >= t.of * (len(a) + len(b) - both) and both < max(len(a), len(b)):
        assert shared >= max(need)


@pytest.mark.parametrize("kt", [(4, 85), (5, 80)])
def test_pairs_just_over_the_threshold_share_enough_parts(kt):
    """Many pairs that barely link, at sizes about the edges of the classes, where empty parts are many."""
    import numpy as np

    t = Threshold(*kt)
    rng = np.random.default_rng(7)
    edges = t.classes(200)[0]
    below = 0
    for n in sorted({int(e) + d for e in edges for d in (-1, 0, 1)} & set(range(2, 120)) | {28}):
        apart = max(d for d in range(n) if t.over * (n - d) >= t.of * (n + d))  # both have n, d of them their own
        pool = rng.integers(0, 2**64, (3000 if n == 28 else 400, n + apart), dtype=np.uint64)
        for row in pool if apart else ():
            a, b = np.sort(row[:n]), np.sort(row[apart:])
            key, at, need = part_keys(np.concatenate([a, b]), np.array([0, n, 2 * n]), t)
            below += len(np.intersect1d(key[at == 0], key[at == 1])) < max(need)
    assert below == 0


def test_leader_that_is_nobodys_best(spark, monkeypatch):
    """N leads its own parts, each neighbour shares more parts with another leader, and N links with one of them."""
    import numpy as np

    from engram.llm import jaccard_groups
    from engram.llm.arrays import utf8
    import pyarrow as pa

    t, p = Threshold(4, 85), [f"p{i}" for i in range(100)]
    docs = {"N": p[:94] + [f"n{i}" for i in range(6)], "P": p, "L": [f"l{i}" for i in range(6)] + p[6:]}
    keys = {"N": "a n1 n2 n3", "P": "n1 n2 n3 p1 p2 p3 p4", "L": "p1 p2 p3 p4 f1 f2 f3 f4 f5"}
    for j in range(10):
        docs |= {f"D{j}": [f"d{j}.{i}" for i in range(50)], f"E{j}": [f"e{j}.{i}" for i in range(50)]}
        keys |= {f"D{j}": f"a d{j}.1 d{j}.2", f"E{j}": f"d{j}.1 d{j}.2 f1 f2 f3 f4 f5"}
    number = {k: i + 1 for i, k in enumerate(dict.fromkeys(" ".join(keys.values()).split()))}
    own = {}
    for name, w in docs.items():
        h, _ = jaccard_groups.shingle_sets(*utf8(pa.array([" ".join(w)], pa.large_string())), t.k)
        own[int(jaccard_groups.node_ids(h, np.array([0, len(h)]))[0][0])] = [number[k] for k in keys[name].split()]

    def parts(h, bounds, t):
        lists = [own[int(v)] for v in jaccard_groups.node_ids(h, bounds)[0]]
        return np.array(sum(lists, []), np.int64), np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.ones(len(lists), np.int64)

    monkeypatch.setattr(jaccard_groups, "part_keys", parts)
    rows = [(i, " ".join(w)) for i, w in enumerate(docs.values())]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), t).collect()}
    assert got == brute_components(rows, t) and got[0][1] == got[1][1] == got[2][1] == 0


def test_odd_rows(spark):
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_shingles"], r["component_id"] or -1) for r in jaccard_components(odd_docs(spark)).collect())
    assert [(i, n) for i, n, _ in got] == [(-1, 1), (1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (5, 1), (6, 1), (7, 1)]
    assert all(c == i for i, _, c in got if i > 0)
    assert jaccard_components(empty_docs(spark)).count() == 0
    assert keep_one_of_each(odd_docs(spark)).count() == 9


def test_texts_of_one_id_are_apart(spark):
    """Ids with two texts, each a near copy of another document's; and an id with two near copies of its own."""
    rng = random.Random(12)
    rows, want, kept = [], {}, set()
    for i in range(20):
        a, b = prose(rng, 80, 5000), prose(rng, 80, 5000)
        rows += [(i, a), (100 + i, b), (200 + i, a + " end"), (200 + i, b + " end")]
        want |= {(200 + i, len(grams(a, 5)) + 1): {i, 100 + i}}
        kept |= {(i, a), (100 + i, b)}
    a, b = prose(rng, 80, 5000), prose(rng, 80, 5000)
    rows += [(50, a), (60, a + " end"), (60, b), (70, b + " end"), (80, a + " twice"), (80, a + " twice more"), (90, "x y z w v u"), (90, "x y z w v u t"), (90, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_components(df).where("doc_id >= 200").collect()
    found = {}
    for r in got:
        found.setdefault((r["doc_id"], r["n_shingles"]), set()).add(r["component_id"])
    assert found == want
    left = [tuple(r) for r in keep_one_of_each(df).collect()]
    assert {r for r in left if r[0] not in (90,)} == kept | {(50, a), (60, b)}
    assert sorted(i for i, _ in left if i == 90) == [90, 90, 90]  # 2/3 of the shingles: no link


def test_chain_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def brute_leaks(docs, items, threshold=0.8, k=5):
    out = set()
    for d, text in docs:
        g = grams(text, k)
        for i, item in items:
            h = grams(item, k)
            if not g or not h:
                continue
            size = min(len(h), len(g))
            for a in range(len(g) - size + 1):
                x, y = Counter(g[a : a + size]), Counter(h)
                if sum((x & y).values()) >= threshold * sum((x | y).values()) - 1e-12:
                    out.add((d, i))
                    break
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.choice([3, 15, 40, 60]), 2000)) for i in range(12)] + [(90, None), (91, " ")]
    docs = []
    for d in range(60):
        parts = [prose(rng, rng.randrange(1, 80), 2000)]
        if rng.random() < 0.6:
            item = (rng.choice(items[:12])[1]).split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                item[rng.randrange(len(item))] = "zzz"
            parts.insert(rng.randrange(2), " ".join(item).upper() if rng.random() < 0.3 else " ".join(item))
        docs.append((d, "\n".join(parts)))
    docs.append((60, items[2][1]))
    sd, si = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, [x for x in items if x[1] and x[1].strip()])
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(sd, si).collect()} == want and len(want) > 10
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(sd, si, limit=300).collect()} == want  # several passes
    kept = {r["doc_id"] for r in drop_leaked(sd, si).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_leaks_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two three"), (1, "one two three")], "item_id long, text string")
    assert find_leaks(odd_docs(spark), items).count() == 2
    assert find_leaks(empty_docs(spark), items).count() == 0
    assert find_leaks(odd_docs(spark), items.limit(0)).count() == 0 and drop_leaked(odd_docs(spark), items.limit(0)).count() == 9


def test_large_groups_and_hot_ids(spark, monkeypatch):
    """More nodes with one leader than a hand holds, one id with many texts, many copies of one text."""
    from engram.llm import jaccard_groups

    monkeypatch.setattr(jaccard_groups, "HAND", 8)
    rng = random.Random(61)
    base = prose(rng, 120, 9000).split()
    docs = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(len(w))] = f"v{i}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, docs[0][1]) for i in range(50)] + [(500 + i, prose(rng, 40, 9000)) for i in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), Threshold(5, 80)).collect()}
    assert got == brute_components(docs, Threshold(5, 80))
    hot = [(7, t) for _, t in docs[:40]] + [(i, t) for i, t in docs[110:]] + [(8, docs[110][1] + " end")]
    df = spark.createDataFrame(hot, "doc_id long, text string")
    roots = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_components(df, Threshold(5, 80)).where("doc_id IN (7, 8)").collect()}
    assert all(c == 7 for (i, _), c in roots.items() if i == 7) and [c for (i, _), c in roots.items() if i == 8] == [8]
    assert keep_one_of_each(df, Threshold(5, 80)).where("doc_id = 7").count() == 1


def test_repeated_items_and_index_pieces(spark, monkeypatch):
    """Items that repeat make one entry of the index and a row each; looking up block by block in pieces changes nothing."""
    from engram.llm import decontamination

    rng = random.Random(62)
    items = [(i, prose(rng, 30, 900)) for i in range(20)]
    docs = [(i, prose(rng, 20, 900) + " " + items[i % 20][1]) for i in range(30)]
    sd, si = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + [(90 + i, items[0][1]) for i in range(5)] + [items[1]], "item_id long, text string")
    want = {(d, i) for d, i in brute_leaks(docs, items)}
    got = [(r["doc_id"], r["item_id"]) for r in find_leaks(sd, si, limit=400).collect()]
    assert {x for x in got if x[1] < 90} == want and sum(i == 1 for _, i in got) == 2 * sum(i == 1 for _, i in want) and sum(i >= 90 for _, i in got) == 5 * sum(i == 0 for _, i in want)
    import numpy as np

    prints = np.random.default_rng(1).integers(0, 2**64, 300, dtype=np.uint64)
    index = decontamination.MultiIndex(prints, 20)
    query = np.concatenate([prints[:50] ^ np.uint64(7), np.random.default_rng(2).integers(0, 2**64, 50, dtype=np.uint64)])
    monkeypatch.setattr(decontamination, "PAIRS", 900)
    q, p = index.within(query)
    brute = {(i, j) for i in range(len(query)) for j in range(len(prints)) if int(query[i] ^ prints[j]).bit_count() <= 20}
    assert set(zip(q.tolist(), p.tolist())) == brute
