"""Each distinct text is encoded once."""

import pandas as pd
from pyspark.sql import functions as F

from engram.memory import Memory
from engram.operators.ingest import hashed_embedding
from engram.operators.vector_cache import VectorCache

DOCS = [("a", "A", "## One\nalpha beta gamma\n## Two\ndelta alpha"), ("b", "B", "plain text of b"), ("c", "C", "")]


def counting(spark):
    """An encoder that writes down what it is asked."""
    asked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        asked.add(len(texts))
        return texts.map(lambda t: [float(len(t)), float(t.count("a")), 1.0])

    return embed, asked


def test_each_text_once(spark, tmp_path):
    embed, asked = counting(spark)
    cache = VectorCache(spark, str(tmp_path), embed)
    rows = [(1, "x a"), (2, "yy"), (3, "x a"), (4, None), (5, "")] + [(i, "hot") for i in range(6, 40)]
    df = spark.createDataFrame(rows, "id int, text string")
    want = {i: None if t is None else [float(len(t)), float(t.count("a")), 1.0] for i, t in rows}
    assert {r["id"]: r["text"] for r in cache.vectors(df, "text").collect()} == want
    assert asked.value == 4
    more = df.unionByName(spark.createDataFrame([(99, "new")], df.schema))
    assert cache.vectors(more, "text").count() == len(rows) + 1 and asked.value == 5
    cache.compact(1)
    assert {r["id"]: r["text"] for r in cache.vectors(df, "text").collect()} == want and asked.value == 5
    assert cache.vectors(df.limit(0), "text").count() == 0
    other = VectorCache(spark, str(tmp_path), embed, "other model")
    other.fill(df, "text")
    assert asked.value == 9 and cache.stored().count() == 9


def test_memory_encodes_each_text_once(spark, tmp_path):
    embed, asked = counting(spark)
    docs = spark.createDataFrame(DOCS, "id string, title string, text string")
    m = Memory(spark, str(tmp_path / "m"), embed=embed, cache=str(tmp_path / "vectors"))
    m.index(docs)
    first = asked.value
    assert first == m.cache.stored().count()
    m.index(docs)
    m.index(docs, replace=True)
    assert asked.value == first
    q = spark.createDataFrame([("q1", "alpha?"), ("q2", "alpha?"), ("q3", None)], "query_id string, text string")
    m.retrieve(q, 2).collect()
    m.retrieve(q, 2).collect()
    assert asked.value == m.cache.stored().count() == first + 2


def test_cached_memory_equals_uncached(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "id string, title string, text string")
    made = [Memory(spark, str(tmp_path / n), embed=hashed_embedding, cache=c) for n, c in (("m1", None), ("m2", str(tmp_path / "v")))]
    for m in made:
        m.index(docs)
    for name, key in (("nodes", ["id", "embedding"]), ("explicit", ["id", "pattern_embedding"]), ("edges", ["source_id", "target_id", "weight"])):
        one, two = (sorted(map(tuple, m.table(name).select(*key).collect()), key=str) for m in made)
        assert one == two and one
