"""Sets that share a first digest are still different nodes."""

import random

import numpy as np

from engram.llm import jaccard_groups as jg
from engram.llm.arrays import U64
from helpers import prose


def test_numbers_part_what_a_digest_joins():
    node, check = np.array([5, 5, 5, 9], np.int64), np.array([1, 2, 1, 3], np.int64)
    out = jg._apart(node, check, np.array([5], np.int64))
    assert out[0] == out[2] != out[1] and out[3] == 9 and 5 not in out
    assert (jg._apart(node, check, np.zeros(0, np.int64)) == node).all()


def test_forced_clash_gives_right_components(spark, monkeypatch):
    """All digests fall on seven numbers; components and kept rows are as without."""
    rng = random.Random(8)
    texts = [prose(rng, 60, 5000) for _ in range(25)]
    texts += [t.rsplit(" ", 1)[0] for t in texts[:8]] + texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r["doc_id"]: r["component_id"] for r in jg.jaccard_components(docs, jg.Threshold(4, 85)).collect()}
    plain = jg.node_ids

    def few(h, bounds):
        node, check = plain(h, bounds)
        return np.where(node == 0, 0, node.view(U64) % U64(7) + U64(1)).view(np.int64), check

    monkeypatch.setattr(jg, "node_ids", few)
    monkeypatch.setattr(jg, "numbers", lambda h, bounds, clashes: jg._apart(*few(h, bounds), clashes))
    got = {r["doc_id"]: r["component_id"] for r in jg.jaccard_components(docs, jg.Threshold(4, 85)).collect()}
    assert got == want and sum(i != c for i, c in got.items()) >= 13
