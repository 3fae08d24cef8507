"""Runs of whole systems over example sets and scenarios, all examples in one job.

Vectors are made once and checkpointed, so the session needs a checkpoint directory.  Where examples or steps
learn from those before them, what comes at the same time is one job: a step of all scenarios, a batch of examples.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.config import MemoryConfig
from engram.functions import metrics
from engram.functions.text import document_text
from engram.memory import NEVER, TABLES, Memory
from engram.operators import evaluation, graph, learning, search
from engram.operators.cuts import cut
from engram.operators.ingest import explicit_triggers, wide_embedding

Embed = Callable[[Column], Column]
#: Settings under which a few steps promote an edge all the way.
PROMOTION = MemoryConfig(strengthen_rate=0.15, promote_soft=2, promote_hard=4, promote_trigger=6, trigger_threshold=0.10)


def _lists(results: DataFrame) -> DataFrame:
    """query_id, retrieved by rank, fired."""
    fired = results.groupBy("query_id").agg(F.array_sort(F.collect_set(F.when(F.col("is_triggered"), F.col("id")))).alias("fired"))
    return evaluation.ranked_lists(results).join(fired, "query_id")


def retrieve_examples(examples: DataFrame, k: int = 10, cfg: MemoryConfig = MemoryConfig(), embed: Embed = wide_embedding) -> DataFrame:
    """Each example's query against its own documents alone; ids are {example}/{document}.

    Ids of examples are distinct.  Of documents with one id in an example the first counts.
    """
    d = examples.select(F.col("id").alias("example"), F.posexplode("documents").alias("pos", "d"))
    once = d.groupBy("example", F.col("d.id").alias("doc")).agg(F.min_by("d", "pos").alias("d"))
    title, text = F.coalesce("d.title", F.lit("")), F.coalesce("d.text", F.lit(""))
    docs = cut(once.select(F.concat_ws("/", "example", "doc").alias("id"), "example", embed(document_text(title, text)).alias("embedding"), F.concat(title, F.lit("\n\n"), text).alias("content"), F.lit(0).alias("access_count")))
    queries = cut(examples.select(F.col("id").alias("query_id"), F.col("id").alias("example"), F.col("query").alias("text"), embed(F.coalesce("query", F.lit(""))).alias("embedding")))
    triggers = cut(explicit_triggers(docs.select("id", "content"), embed).join(docs.select(F.col("id").alias("associated_node_id"), "example"), "associated_node_id"))
    return search.retrieve_documents(queries, docs, graph.similarity_edges(docs, cfg, by="example"), triggers, k, cfg, scope="example")


def evaluate_examples(examples: DataFrame, k: int = 10, cfg: MemoryConfig = MemoryConfig(), embed: Embed = wide_embedding) -> DataFrame:
    """query_id, benchmark, category, metric, value; every example starts from an empty memory."""
    gold = examples.select(F.col("id").alias("query_id"), "benchmark", "category", F.transform(F.coalesce("supporting_doc_ids", F.array().cast("array<string>")), lambda x: F.concat_ws("/", "id", x)).alias("gold"))
    lists = gold.join(_lists(retrieve_examples(examples, k, cfg, embed)), "query_id", "left")
    return evaluation.ranking_metrics(lists, top_k=k).join(gold.select("query_id", "benchmark", "category"), "query_id")


def evaluate_scenarios(scenarios: DataFrame, memories: DataFrame, cfg: MemoryConfig = MemoryConfig(), embed: Embed = wide_embedding) -> DataFrame:
    """id, name, category, fired, trigger_recall, trigger_precision of scenarios against memories (name, text), by whole memory."""
    docs = cut(memories.select(F.col("name").alias("id"), embed(document_text(F.col("name"), F.col("text"))).alias("embedding"), F.concat("name", F.lit("\n\n"), "text").alias("content"), F.lit(0).alias("access_count")))
    queries = cut(scenarios.select(F.col("id").alias("query_id"), F.col("context").alias("text"), embed(F.coalesce("context", F.lit(""))).alias("embedding")))
    found = search.retrieve_documents(queries, docs, graph.similarity_edges(docs, cfg), cut(explicit_triggers(docs.select("id", "content"), embed)), max(memories.count(), 1), cfg)
    files = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array()), lambda x: x["memory"]))
    df = scenarios.join(_lists(found).withColumnRenamed("query_id", "id"), "id", "left").withColumn("fired", F.coalesce("fired", F.array().cast("array<string>")))
    recall = metrics.trigger_recall(F.col("fired"), files(F.col("expected")))
    return df.select("id", "name", "category", "fired", recall.alias("trigger_recall"), metrics.trigger_precision(F.col("fired"), files(F.col("non_expected"))).alias("trigger_precision"))


def feedback(results: DataFrame, queries: DataFrame, gold: DataFrame, after: int = -1) -> DataFrame:
    """Episodes from results of a retrieval: gold (query_id, id) is what was useful; numbered by query from after + 1 on.

    The numbering sorts the batch's queries in one task: one id a row.
    """
    useful = gold.groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("useful_ids"))
    seq = queries.select("query_id", "text", (F.row_number().over(Window.orderBy("query_id")) + after).cast("long").alias("episode_seq"))
    lists = results if "is_triggered" in results.columns else results.withColumn("is_triggered", F.col("channel") == "trigger")
    df = seq.join(_lists(lists), "query_id", "left").join(useful, "query_id")
    none = F.array().cast("array<string>")
    return df.select("episode_seq", F.col("text").alias("context"), F.coalesce("retrieved", none).alias("retrieved_ids"), F.coalesce("fired", none).alias("triggered_ids"), "useful_ids")


def evaluate_in_order(memory: Memory, examples: DataFrame, k: int = 10, batch: int = 1) -> DataFrame:
    """evaluate_examples() over one memory that is never reset: query_id, benchmark, category, metric, value.

    Examples come by id.  The documents of a batch are indexed, its queries are answered from what was learned of the
    batches before, then the memory learns from those with supporting documents.  With a batch of one every
    example sees all before it; larger ones need fewer jobs and learn later.  Ids of documents are their own, and a
    document that is there already is skipped or replaced as Memory.index() does.
    """
    numbered = cut(examples.withColumn("_n", F.row_number().over(Window.orderBy("id"))))
    values = None
    for first in range(1, numbered.count() + 1, batch):
        own = numbered.where((F.col("_n") >= first) & (F.col("_n") < first + batch))
        d = own.select("_n", F.posexplode("documents").alias("pos", "d"))
        memory.index(d.groupBy(F.col("d.id").alias("id")).agg(F.min_by("d", F.struct("_n", "pos")).alias("d")).select("id", "d.title", "d.text"))
        queries = own.select(F.col("id").alias("query_id"), F.col("query").alias("text"))
        found = cut(memory.retrieve(queries, k))
        marked = found if "is_triggered" in found.columns else found.withColumn("is_triggered", F.col("channel") == "trigger")
        gold = own.select(F.col("id").alias("query_id"), "benchmark", "category", F.coalesce("supporting_doc_ids", F.array().cast("array<string>")).alias("gold"))
        rows = cut(evaluation.ranking_metrics(gold.join(_lists(marked), "query_id", "left"), top_k=k).join(gold.drop("gold"), "query_id").select("query_id", "benchmark", "category", "metric", "value"))
        values = rows if values is None else values.unionByName(rows)
        last = memory.table("episodes").agg(F.max("episode_seq")).first()[0]
        told = feedback(found, queries, gold.select("query_id", F.explode("gold").alias("id")), -1 if last is None else last)
        if not told.isEmpty():
            memory.update(told)
    return values if values is not None else examples.select(F.col("id").alias("query_id"), "benchmark", "category", F.lit("").alias("metric"), F.lit(0.0).alias("value")).limit(0)


def _told(steps: DataFrame) -> DataFrame:
    """Steps with useful_ids, the files that they name as useful; null where the memory is told nothing.

    A step that says marked_useful: false tells that nothing was useful, whatever else it names.
    """
    names = lambda key: F.coalesce(F.from_json(F.try_element_at("expectations", F.lit(key)), "array<string>"), F.array().cast("array<string>"))
    useful = F.array_distinct(F.concat(*[names(x) for x in ("expect_diffuse_useful", "mark_useful", "co_retrieved_useful")]))
    refused = F.try_element_at("expectations", F.lit("marked_useful")) == "false"
    return steps.withColumn("useful_ids", F.when(refused, F.array().cast("array<string>")).when(F.size(useful) > 0, F.transform(useful, lambda x: F.concat_ws("/", "id", x))))


def _checks(steps: DataFrame, lists: DataFrame, edges: DataFrame, triggers: DataFrame) -> DataFrame:
    """id, step, expectation, wanted, found, passed: each expectation of a step against the lists and the state after it.

    passed is null where nothing tells: a trigger expected to have decayed that was never learned.
    """
    none = F.array().cast("array<string>")
    df = steps.join(lists.withColumnRenamed("query_id", "id"), "id", "left").select("id", "step", F.coalesce("retrieved", none).alias("retrieved"), F.coalesce("fired", none).alias("fired"), F.explode("expectations").alias("expectation", "wanted"))
    whole = F.transform(F.from_json("wanted", "array<string>"), lambda x: F.concat_ws("/", "id", x))
    shown = lambda ids: F.to_json(F.transform(F.array_sort(ids), lambda x: F.substring(x, F.length("id") + 2, 1 << 30)))
    in_lists = df.where(F.col("expectation").isin("expect_trigger_now", "expect_co_retrieved"))
    there = F.array_intersect(whole, F.when(F.col("expectation") == "expect_trigger_now", F.col("fired")).otherwise(F.col("retrieved")))
    one = in_lists.select("id", "step", "expectation", "wanted", shown(there).alias("found"), (F.size(there) == F.size(F.array_distinct(whole))).alias("passed"))
    e = F.from_json("wanted", "struct<`from`:string,`to`:string,type:string>")
    asked = df.where("expectation = 'expect_edge_type'").select("id", "step", "expectation", "wanted", e["type"].alias("_type"), F.concat_ws("/", "id", e["from"]).alias("source_id"), F.concat_ws("/", "id", e["to"]).alias("target_id"))
    kind = F.coalesce("edge_type", F.lit("none"))
    two = asked.join(edges.select("source_id", "target_id", "edge_type"), ["source_id", "target_id"], "left").select("id", "step", "expectation", "wanted", kind.alias("found"), kind.eqNullSafe(F.col("_type")).alias("passed"))
    faded = df.where("expectation = 'expect_trigger_decayed'").select("id", "step", "expectation", "wanted", F.explode(whole).alias("associated_node_id"))
    first = triggers.groupBy("associated_node_id").agg(F.min_by("confidence", "id").alias("confidence"))
    three = faded.join(first, "associated_node_id", "left").groupBy("id", "step", "expectation", "wanted").agg(F.min("confidence").cast("string").alias("found"), F.bool_and(F.col("confidence") < 0.9).alias("passed"))
    return one.unionByName(two).unionByName(three)


def run_promotions(scenarios: DataFrame, memories: DataFrame, cfg: MemoryConfig = PROMOTION, embed: Embed = wide_embedding) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scenarios (id, step, context, expectations) from load_promotion_scenarios(), each over its own copy of memories (name, text).

    A step retrieves all memories for its context and tells what was useful, if it names any; the next step of the scenario
    meets what was learned.  Step n of all scenarios is one job, as no id of one scenario is one of another's.
    Results: checks (id, step, expectation, wanted, found, passed), edges and learned triggers at the end (ids are
    {scenario}/{name}).  Tables of state as in Memory; a decay cycle follows every tick_every updates of a scenario.
    """
    spark = scenarios.sparkSession
    steps = _told(scenarios)
    so_far = Window.partitionBy("id").orderBy("step")
    steps = cut(steps.withColumn("updates", F.count("useful_ids").over(so_far)).join(scenarios.select("id").distinct().withColumn("number", F.row_number().over(Window.orderBy("id")) - 1), "id").withColumn("embedding", embed(F.coalesce("context", F.lit("")))))
    vectors = cut(memories.select("name", embed(document_text(F.col("name"), F.col("text"))).alias("embedding"), F.concat("name", F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("content")))
    # one copy of the memories for each scenario is what is asked for
    docs = cut(steps.select(F.col("id").alias("scenario")).distinct().crossJoin(vectors).select(F.concat_ws("/", "scenario", "name").alias("id"), "scenario", "embedding", "content", F.lit(0).alias("access_count")))
    k, n = max(memories.count(), 1), max(steps.agg(F.max("number")).first()[0] or 0, 0) + 1
    own = docs.select(F.col("id").alias("associated_node_id"), "scenario")
    explicit = cut(explicit_triggers(docs.select("id", "content"), embed))
    edges = cut(graph.similarity_edges(docs, cfg, by="scenario").withColumn("co_activation_count", F.lit(0)))
    triggers, log, checks = spark.createDataFrame([], TABLES["triggers"]), None, None
    never = replace(cfg, tick_every=NEVER)
    used = ["id", "pattern", "pattern_embedding", "associated_node_id", "confidence"]
    for step in range((steps.agg(F.max("step")).first()[0] or 0) + 1):
        now = steps.where(F.col("step") == step)
        queries = now.select(F.col("id").alias("query_id"), F.col("id").alias("scenario"), F.col("context").alias("text"), "embedding")
        scanned = cut(explicit.select(*used).unionByName(triggers.select(*used)).join(own, "associated_node_id"))
        lists = cut(_lists(search.retrieve_documents(queries, docs, edges, scanned, k, cfg, scope="scenario")))
        told = now.where("useful_ids IS NOT NULL").join(lists.withColumnRenamed("query_id", "id"), "id", "left")
        none = F.array().cast("array<string>")
        episodes = cut(told.select((F.lit(step).cast("long") * n + F.col("number")).alias("episode_seq"), F.col("context"), F.col("embedding").alias("context_embedding"), F.coalesce("retrieved", none).alias("retrieved_ids"), F.coalesce("fired", none).alias("triggered_ids"), "useful_ids"))
        edges, triggers = learning.learn(edges, triggers, episodes, cut, never, docs, log)
        due = cut(now.where(f"useful_ids IS NOT NULL AND updates % {cfg.tick_every} = 0").select(F.col("id").alias("scenario")).join(own, "scenario"))
        if not due.isEmpty():
            edges, triggers = _cycled(edges, "source_id", due, lambda e: learning.decay_cycle(e, cfg)), _cycled(triggers, "associated_node_id", due, lambda t: learning.decay_triggers(t, cfg))
        docs = cut(docs.join(learning.access_counts(episodes), "id", "left").withColumn("access_count", (F.col("access_count") + F.coalesce("accesses", F.lit(0))).cast("int")).drop("accesses"))
        log = episodes if log is None else log.unionByName(episodes)
        found = cut(_checks(now, lists, edges, triggers))
        checks = found if checks is None else checks.unionByName(found)
    return checks, edges, triggers


def _cycled(state: DataFrame, node: str, due: DataFrame, cycle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """state with a decay cycle over its rows whose node is one of those due."""
    df = state.join(due.select(F.col("associated_node_id").alias(node), F.lit(True).alias("_due")), node, "left")
    return cut(cycle(df.where("_due IS NOT NULL").drop("_due")).select(*state.columns).unionByName(df.where("_due IS NULL").select(*state.columns)))
