"""Loaders of question-answering sets and scenarios into the example schema, and the result writer."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARAGRAPHS = "id STRING, question STRING, answer STRING, answer_aliases ARRAY<STRING>, answerable BOOLEAN, paragraphs ARRAY<STRUCT<idx: INT, title: STRING, paragraph_text: STRING, is_supporting: BOOLEAN>>, question_decomposition ARRAY<STRUCT<question: STRING, answer: STRING, paragraph_support_idx: INT>>"
CONTEXTS = "id STRING, question STRING, answer STRING, type STRING, level STRING, context STRUCT<title: ARRAY<STRING>, sentences: ARRAY<ARRAY<STRING>>>, supporting_facts STRUCT<title: ARRAY<STRING>, sent_id: ARRAY<INT>>"
SESSIONS = "question_id STRING, question STRING, answer STRING, question_type STRING, question_date STRING, haystack_dates ARRAY<STRING>, haystack_session_ids ARRAY<STRING>, haystack_sessions ARRAY<ARRAY<STRUCT<role: STRING, content: STRING>>>, answer_session_ids ARRAY<STRING>"
AGENT = "context STRING, questions ARRAY<STRING>, answers ARRAY<STRING>, metadata STRUCT<source: STRING, qa_pair_ids: ARRAY<STRING>, question_types: ARRAY<STRING>>"
_NO_CHAIN = "cast(array() as array<struct<question:string,answer:string,supporting_doc_id:string>>)"


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _doc(i: Column, title: Column, text: Column, supporting: Column) -> Column:
    return F.struct(i.alias("id"), title.alias("title"), text.alias("text"), supporting.alias("is_supporting"))


def _supporting(docs: Column) -> Column:
    return F.transform(F.filter(docs, lambda d: d["is_supporting"]), lambda d: d["id"])


def _map(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def load_paragraph_qa(spark: SparkSession, path: str, name: str = "musique") -> DataFrame:
    """One JSON object a line: paragraphs with a flag, and a chain of questions that point at paragraphs."""
    df = spark.read.schema(PARAGRAPHS).json(path)
    pid = lambda k: F.concat_ws("_", F.lit(name), "id", F.concat(F.lit("p"), k.cast("string")))
    docs = F.transform("paragraphs", lambda p: _doc(pid(p["idx"]), p["title"], p["paragraph_text"], F.coalesce(p["is_supporting"], F.lit(False))))
    chain = F.transform("question_decomposition", lambda q: F.struct(q["question"].alias("question"), q["answer"].alias("answer"), F.when(q["paragraph_support_idx"].isNotNull(), pid(q["paragraph_support_idx"])).alias("supporting_doc_id")))
    df = df.withColumn("documents", F.coalesce(docs, _empty("struct<id:string,title:string,text:string,is_supporting:boolean>")))
    return df.select("id", F.lit(name).alias("benchmark"), F.col("question").alias("query"), "answer", F.coalesce("answer_aliases", _empty("string")).alias("answer_aliases"), "documents", _supporting(F.col("documents")).alias("supporting_doc_ids"), F.coalesce(chain, F.expr(_NO_CHAIN)).alias("reasoning_chain"), F.split("id", "__")[0].alias("category"), _map(answerable=F.coalesce("answerable", F.lit(True))).alias("metadata"))


def load_context_qa(spark: SparkSession, path: str, name: str = "hotpotqa") -> DataFrame:
    """One JSON object a line: parallel titles and sentence lists; a document supports if its title is named."""
    df = spark.read.schema(CONTEXTS).json(path)
    pairs = F.arrays_zip(F.col("context.title").alias("t"), F.col("context.sentences").alias("s"))
    named = F.coalesce(F.col("supporting_facts.title"), _empty("string"))
    docs = F.transform(pairs, lambda p, i: _doc(F.concat(F.lit(f"{name}_"), F.col("id"), F.lit("_p"), i.cast("string")), p["t"], F.array_join(p["s"], " "), F.array_contains(named, p["t"])))
    df = df.withColumn("documents", docs)
    return df.select("id", F.lit(name).alias("benchmark"), F.col("question").alias("query"), "answer", _empty("string").alias("answer_aliases"), "documents", _supporting(F.col("documents")).alias("supporting_doc_ids"), F.expr(_NO_CHAIN).alias("reasoning_chain"), F.col("type").alias("category"), _map(level=F.col("level")).alias("metadata"))


def session_text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("["), t["role"], F.lit("]: "), t["content"])), "\n")


def load_session_qa(spark: SparkSession, path: str, name: str = "longmemeval") -> DataFrame:
    """One JSON array: chat sessions as documents; a session supports if its id is named."""
    df = spark.read.schema(SESSIONS).option("multiLine", True).json(path)
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("i"), F.col("haystack_sessions").alias("s"), F.col("haystack_dates").alias("d"))
    named = F.coalesce("answer_session_ids", _empty("string"))
    docs = F.transform(F.filter(zipped, lambda z: z["s"].isNotNull()), lambda z: _doc(z["i"], F.coalesce(z["d"], F.lit("")), session_text(z["s"]), F.array_contains(named, z["i"])))
    df = df.withColumn("documents", docs)
    return df.select(F.col("question_id").alias("id"), F.lit(name).alias("benchmark"), F.col("question").alias("query"), "answer", _empty("string").alias("answer_aliases"), "documents", _supporting(F.col("documents")).alias("supporting_doc_ids"), F.expr(_NO_CHAIN).alias("reasoning_chain"), F.col("question_type").alias("category"), _map(question_date=F.col("question_date")).alias("metadata"))


def load_agent_qa(spark: SparkSession, path: str, name: str = "memoryagentbench") -> DataFrame:
    """One JSON object a line: a context with several questions, each a row; an answer may be a list or a scalar."""
    df = spark.read.schema(AGENT).json(path)
    pairs = F.arrays_zip(F.col("questions").alias("q"), F.col("answers").alias("a"))
    df = df.select("context", "metadata", F.size("questions").alias("nq"), F.size("answers").alias("na"), F.posexplode(pairs).alias("i", "p")).where(F.col("i") < F.least("nq", "na"))
    ident = F.coalesce(F.get("metadata.qa_pair_ids", F.col("i")), F.concat(F.col("metadata.source"), F.lit("_q"), F.col("i").cast("string")))
    listed = F.when(F.col("p.a").startswith("["), F.from_json("p.a", "array<string>"))
    answers = F.coalesce(listed, F.array("p.a"))
    doc = F.array(_doc(F.concat(F.col("metadata.source"), F.lit("_ctx")), F.col("metadata.source"), F.col("context"), F.lit(True)))
    df = df.select(ident.alias("id"), "p", "i", "metadata", answers.alias("ans"), doc.alias("documents"))
    return df.select("id", F.lit(name).alias("benchmark"), F.col("p.q").alias("query"), F.get("ans", F.lit(0)).alias("answer"), F.slice("ans", F.lit(2), F.size("ans")).alias("answer_aliases"), "documents", _supporting(F.col("documents")).alias("supporting_doc_ids"), F.expr(_NO_CHAIN).alias("reasoning_chain"), F.get("metadata.question_types", F.col("i")).alias("category"), _map(source=F.col("metadata.source")).alias("metadata"))


def load_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every set whose file Spark finds in the folder, by name."""
    found: dict[str, DataFrame] = {}
    jvm = spark.sparkContext._jvm
    for pattern, name, load in (("musique*.jsonl", "musique", load_paragraph_qa), ("hotpotqa*.jsonl", "hotpotqa", load_context_qa), ("longmemeval*.json", "longmemeval", load_session_qa), ("memoryagentbench*.jsonl", "memoryagentbench", load_agent_qa)):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path):
            found[name] = load(spark, f"{folder}/{pattern}")
    return found


def _scenarios(path: str) -> list[dict]:
    """The scenarios of a YAML file: a list, or a mapping that holds it under "scenarios"."""
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or []
    return (data.get("scenarios") or []) if isinstance(data, dict) else data


def load_trigger_scenarios(spark: SparkSession, *paths: str) -> DataFrame:
    """Scenarios of YAML files, in the order of the paths."""
    expect = "array<struct<memory:string,section:string,reason:string>>"
    rows = []
    for p in paths:
        for s in _scenarios(p):
            pick = lambda k, s=s: [(x.get("memory"), x.get("section"), x.get("reason")) for x in s.get(k) or []]
            rows.append((s["id"], s.get("name"), s.get("category"), s["context"], pick("expected_triggers"), pick("expected_non_triggers"), json.dumps(s.get("baseline_flat_rag")) if s.get("baseline_flat_rag") is not None else None))
    return spark.createDataFrame(rows, f"id string, name string, category string, context string, expected {expect}, non_expected {expect}, baseline string")


def load_promotion_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """One row a step: the context, and all other fields as a map of JSON texts."""
    rows = [(s["id"], s.get("name"), s.get("category"), s.get("description"), i, step.get("context"), {k: json.dumps(v) for k, v in step.items() if k != "context"}) for s in _scenarios(path) for i, step in enumerate(s.get("sequence") or [])]
    return spark.createDataFrame(rows, "id string, name string, category string, description string, step int, context string, expectations map<string,string>")


def load_memories(spark: SparkSession, folder: str) -> DataFrame:
    """name, text of the Markdown files of a folder, by file name: scenarios name memories by their files."""
    df = spark.read.text(f"{folder}/*.md", wholetext=True)
    return df.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text")).orderBy("name")


def sessions_from_turns(turns: DataFrame) -> DataFrame:
    """conv_id, content: the turns of each conversation as [role]: text lines."""
    rows = turns.select("conv_id", F.struct("turn", F.col("role"), F.coalesce("text", F.lit("")).alias("content")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", session_text(F.col("t")).alias("content"))


def save_results(df: DataFrame, folder: str, system: str, benchmark: str) -> str:
    """Write results as JSON lines below folder; the path."""
    path = f"{folder}/{system}_{benchmark}"
    df.write.mode("overwrite").json(path)
    return path


def save_state(tables: dict[str, DataFrame], folder: str) -> None:
    """A snapshot of the state tables; edges lie sorted by source."""
    for name, df in tables.items():
        (df.repartition("source_id").sortWithinPartitions("source_id") if name == "edges" else df).write.mode("overwrite").parquet(f"{folder}/{name}")


def load_state(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names or ("nodes", "edges", "triggers", "episodes")}
