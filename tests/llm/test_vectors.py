import hashlib
import random

import numpy as np
import pytest

from engram.llm import topk_join as topk
from engram.llm.centroids import Centroids, assign_centroids, fit_centroids, nearest
from engram.llm.topk_join import join_plan, topk_join

SCHEMA = "vec_id long, embedding array<float>, id string, v array<int>, cluster int, row int"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", [1], 2, 3) for i, v in rows], SCHEMA)


def rounded(v, scale):
    return [int(np.floor(scale * float(np.float32(x)))) for x in v]


def clustered(rng, n, dim, centres=20, near=0.05):
    c = rng.normal(size=(centres, dim))
    return c[rng.integers(0, centres, n)] + near * rng.normal(size=(n, dim))


def plain_clusters(rows, k, rounds, scale, dim):
    kept = [(i, rounded(v, scale)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    c = [v for _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, w)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        c = [[sum(x) // len(x) for x in zip(*(v for (_, v), o in zip(kept, own) if o == j))] if j in own else w for j, w in enumerate(c)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, o, d in found if o == j) for j in range(len(c))]
    return sorted((i or -1, o, d, inertia[o], sum(inertia), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for i, o, d in found)


def odd_vectors(rng, dim):
    rows = [(i, list(map(float, v))) for i, v in enumerate(clustered(rng, 120, dim, 5, 0.3))]
    return rows + [(500, rows[0][1]), (500, rows[0][1]), (500, rows[3][1]), (None, rows[7][1]), (501, None), (502, []), (503, rows[1][1][:-1]), (504, [None, *rows[1][1][1:]]), (505, [NAN, *rows[1][1][1:]]), (506, [-INF, *rows[1][1][1:]]), (507, [-x for x in rows[2][1]])]


@pytest.mark.parametrize("k,rounds", [(8, 3), (1, 1), (3, 10), (200, 2)])
def test_clusters_equal_plain(spark, k, rounds):
    rows = odd_vectors(np.random.default_rng(k), 12)
    df = vectors(spark, rows)
    got = assign_centroids(df, fit_centroids(df, k=k, rounds=rounds, dim=12))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    own = sorted((r["vec_id"] or -1, *(r[c] for c in got.columns[1:])) for r in got.collect())
    assert own == plain_clusters(rows, k, rounds, 1024, 12)


def test_empty_tables(spark):
    none = vectors(spark, [])
    assert assign_centroids(none, fit_centroids(none)).count() == 0 and topk_join(none, none).count() == 0
    nulls = vectors(spark, [(1, None), (2, [NAN] * 64)])
    assert assign_centroids(nulls, fit_centroids(nulls)).count() == 0 and topk_join(nulls, nulls).count() == 0


def test_huge_components_take_no_part(spark):
    df = vectors(spark, [(1, [1.0] * 64), (2, [3e38] + [0.0] * 63), (3, [2.0] * 64)])
    assert sorted(r["vec_id"] for r in assign_centroids(df, fit_centroids(df)).collect()) == [1, 3]
    assert [(r["query_id"], r["vec_id"]) for r in topk_join(df, df).orderBy("query_id").collect()] == [(1, 3), (3, 1)]


def test_partial_distances_save_work():
    rng = np.random.default_rng(5)
    x = np.floor(1024 * clustered(rng, 2000, 64, 30)).astype(np.int64)
    model = Centroids(x[:30], np.argsort(-x.var(0)), 1024)
    who, distance, work = nearest(x, model)
    full = ((x[:, None, :] - model.values[None]) ** 2).sum(2)
    assert (who == full.argmin(1)).all() and (distance == full.min(1)).all()
    assert work < 0.4 * full.size * 64
    # equal centroids: the smaller number has it
    twice = Centroids(np.concatenate([x[5:6], x[:30], x[:30]]), model.order, 1024)
    assert (nearest(x, twice)[0] == ((x[:, None, :] - twice.values[None]) ** 2).sum(2).argmin(1)).all()


def plain_topk(queries, base, k, scale, dim):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    pad = lambda v: rounded(v, scale) + [0] * (dim - len(v))
    base = [(i, pad(v)) for i, v in base if i is not None and ok(v)]
    out = []
    for i, v in queries:
        if i is None or not ok(v):
            continue
        q = pad(v)
        best = sorted((-sum(x * y for x, y in zip(q, w)), j) for j, w in base if j != i)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("group,chunk,pivots", [(8192, 8192, 128), (10, 16, 12), (3, 1000, 4), (1, 7, 1)])
def test_topk_equals_plain(spark, monkeypatch, group, chunk, pivots):
    for name, value in (("GROUP", group), ("CHUNK", chunk), ("PIVOTS", pivots)):
        monkeypatch.setattr(topk, name, value)
    rows = odd_vectors(np.random.default_rng(9), 8)
    rows += [(1000 + i, rows[4][1]) for i in range(60)]  # one vector in a third of the rows
    asked = [r for r in rows if r[0] is None or r[0] % 7 == 0 or r[0] == 500]
    got = topk_join(vectors(spark, asked), vectors(spark, rows), 5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_topk(asked, rows, 5, 256, 8)


def test_few_rows_and_large_numbers(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-4e5, 4e5) for _ in range(3)]) for i in range(4)]
    got = topk_join(vectors(spark, rows), vectors(spark, rows), 5)
    assert sorted(tuple(r) for r in got.collect()) == plain_topk(rows, rows, 5, 256, 3)


def test_cells_save_copies(spark, monkeypatch):
    """On clustered vectors few of the pairs of a group and a row are needed; all in all every row once or not at all."""
    monkeypatch.setattr(topk, "GROUP", 60)
    rng = np.random.default_rng(2)
    x = clustered(rng, 4000, 32, 25, 0.02)
    rows = [(i, list(map(float, v))) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    df = vectors(spark, rows)
    plan, _, base, dim = join_plan(df.where("vec_id % 10 = 0"), df, 5, 256, "vec_id", "embedding")
    kept = base.toPandas()
    sent = len(plan.wanted(np.stack(kept["v"]), kept["cell"].to_numpy())[0])
    assert len(plan.chunks) >= 6 and sent < 0.3 * len(plan.chunks) * len(rows)
    got = topk_join(df.where("vec_id % 10 = 0"), df)
    own = np.floor(256 * np.array([np.float32(v) for _, v in rows]).astype(np.float64)).astype(np.int64)
    score = own[::10] @ own.T
    score[np.arange(400), np.arange(0, 4000, 10)] = -(1 << 60)
    want = {(10 * q, r + 1): (int(j), int(score[q, j])) for q in range(400) for r, j in enumerate(np.argsort(-score[q], kind="stable")[:5])}
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got.collect()} == want
