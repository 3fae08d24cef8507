"""Evaluation of rankings and fired triggers, all examples in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import metrics


def ranked_lists(results: DataFrame, key: str = "query_id") -> DataFrame:
    """key, retrieved: ids in order of rank."""
    return results.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("retrieved"))


def ranking_metrics(lists: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), top_k: int = 10, key: str = "query_id") -> DataFrame:
    """key, metric, value for lists (key, retrieved, gold); trigger metrics where fired is there and not empty."""
    r, g = F.coalesce("retrieved", F.array().cast(lists.schema["gold"].dataType)), F.col("gold")
    values = {"support_f1": metrics.support_f1(r, g)}
    for k in (k for k in ks if k <= top_k):
        values[f"recall@{k}"], values[f"precision@{k}"] = metrics.recall_at(r, g, k), metrics.precision_at(r, g, k)
    if "fired" in lists.columns:
        values["trigger_recall"] = F.when(F.size("fired") > 0, metrics.trigger_recall(F.col("fired"), g))
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in values.items()])
    return lists.select(key, F.inline(rows)).where("value IS NOT NULL")


def summary(values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, least, largest and count of each metric."""
    return values.groupBy(*(by or []), "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("largest"), F.count("value").alias("n"))


def by_class_and_overall(values: DataFrame, cls: str) -> DataFrame:
    """Means of each metric by class, and over all of them (class null)."""
    return values.rollup("metric", cls).agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n")).where("metric IS NOT NULL")


def running_average(df: DataFrame, order: str, value: str, width: int = 10, by: str | None = None) -> DataFrame:
    """value averaged over the last width rows in order, fewer at the start; without by, of all rows in one task."""
    w = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn("average", F.round(F.avg(value).over(w.orderBy(order).rowsBetween(1 - width, 0)), 6))


def halves(df: DataFrame, order: str, value: str, by: str) -> DataFrame:
    """by, first, second: means of the first floor(n / 2) rows and of the others."""
    own = Window.partitionBy(by)
    at = df.withColumns({"_at": F.row_number().over(own.orderBy(order)), "_n": F.count("*").over(own)})
    early = F.col("_at") <= F.floor(F.col("_n") / 2)
    return at.groupBy(by).agg(F.round(F.avg(F.when(early, F.col(value))), 6).alias("first"), F.round(F.avg(F.when(~early, F.col(value))), 6).alias("second"))


def attribution(gold: DataFrame, triggered: DataFrame, graph: DataFrame, semantic: DataFrame) -> DataFrame:
    """query_id, id, channel of each gold node: trigger before graph before semantic, else MISS; rescued if not by meaning."""
    key = ["query_id", "id"]
    mark = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    df = gold.join(mark(triggered, "t"), key, "left").join(mark(graph, "g"), key, "left").join(mark(semantic, "s"), key, "left")
    channel = F.when(F.col("t"), "trigger").when(F.col("g"), "graph").when(F.col("s"), "semantic").otherwise("MISS")
    return df.select(*key, channel.alias("channel"), (F.col("s").isNull() & (F.col("t").isNotNull() | F.col("g").isNotNull())).alias("rescued"))


def by_channel(found: DataFrame) -> DataFrame:
    """What attribution() gives, of SimilarityGraph.channels()."""
    has = lambda bits: F.col("found").bitwiseAND(bits) != 0
    channel = F.when(has(1), "trigger").when(has(2), "graph").when(has(4), "semantic").otherwise("MISS")
    return found.select("query_id", "id", channel.alias("channel"), (~has(4) & has(3)).alias("rescued"))


def compare_runs(base: DataFrame, trained: DataFrame) -> DataFrame:
    """metric, base, trained, delta of two results of ranking_metrics."""
    m = lambda df, name: df.groupBy("metric").agg(F.avg("value").alias(name))
    return m(base, "base").join(m(trained, "trained"), "metric", "full").withColumn("delta", F.round(F.col("trained") - F.col("base"), 6))


def replay_order(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """day, kind, id, step: the events of a simulation day by day, on each day documents before queries, then by id.

    Steps count from 1.  They are sorted by range over all tasks and numbered by sums of the days before.
    """
    kinds = [(documents, 0, "document"), (queries, 1, "query")]
    events = None
    for df, order, name in kinds:
        rows = df.select("day", F.lit(order).alias("_order"), F.lit(name).alias("kind"), "id")
        events = rows if events is None else events.unionByName(rows)
    sizes = events.groupBy("day").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("day", "before")
    at = F.row_number().over(Window.partitionBy("day").orderBy("_order", "id"))
    return events.withColumn("at", at).join(before, "day").select("day", "kind", "id", (F.col("before") + F.col("at")).alias("step"))


def proactive_hits(triggered: DataFrame, gold: DataFrame, semantic: DataFrame) -> DataFrame:
    """query_id, hit, lead: gold nodes (query_id, id) that a trigger brought up, and those of them that similarity did not find.

    Both are counts; a query without such nodes has 0.
    """
    key = ["query_id", "id"]
    found = gold.select(*key).distinct().join(triggered.select(*key).distinct().withColumn("t", F.lit(True)), key, "left").join(semantic.select(*key).distinct().withColumn("s", F.lit(True)), key, "left")
    return found.groupBy("query_id").agg(F.count_if(F.col("t").isNotNull()).alias("hit"), F.count_if(F.col("t").isNotNull() & F.col("s").isNull()).alias("lead"))
