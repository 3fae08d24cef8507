"""The write path: sections, containment, explicit triggers, embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.expressions import let
from engram.functions.text import chat_keywords, is_chat, markdown_sections, raw_tokens, section_parts, trigger_keywords, user_turns

#: Slots of the hashed vectors of large tables, and of those that a memory holds.
DIMENSIONS, WIDE = 64, 1024


def hashed_embedding(text: Column, size: int = DIMENSIONS) -> Column:
    """Counts of tokens by the first 32 bits of their md5: an embedding that needs no model."""
    slots = F.array_sort(F.transform(raw_tokens(F.lower(text)), lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % size).cast("int")))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)

    def dense(x: Column) -> Column:
        # each run of one slot gives the zeros since the run before, and its length
        s, first = x["slots"], x["first"]
        run = lambda i, k: F.concat(zeros(F.get(s, i) - F.coalesce(F.get(s, i - 1), F.lit(-1)) - 1), F.array((F.coalesce(F.get(first, k + 1), F.size(s)) - i).cast("double")))
        return F.concat(F.flatten(F.transform(first, run)), zeros(size - 1 - F.element_at(s, -1)))

    def starts(x: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(x["slots"]) - 1), lambda i: (i == 0) | (F.get(x["slots"], i) != F.get(x["slots"], i - 1)))
        return F.when(F.size(x["slots"]) == 0, zeros(F.lit(size))).otherwise(let(dense, slots=x["slots"], first=first))

    return F.when(text.isNotNull(), let(starts, slots=slots))


def wide_embedding(text: Column) -> Column:
    """hashed_embedding() with so many slots that different words seldom share one."""
    return hashed_embedding(text, WIDE)


def hashed_vectors(df: DataFrame, id_col: str, text_col: str, size: int = DIMENSIONS) -> DataFrame:
    """id, embedding: the same counts for many texts, by one aggregation; ids are distinct, texts without tokens give zeros."""
    slot = (F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long") % size).cast("int")
    found = df.select(id_col, F.explode_outer(raw_tokens(F.lower(text_col))).alias("token"))
    counts = found.groupBy(id_col, slot.alias("slot")).agg(F.count("token").cast("double").alias("n"))
    held = counts.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "n")))).alias("m"))
    return held.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))


def model_embedding(encode: Callable[[list[str]], list], load: Callable | None = None) -> Callable[[Column], Column]:
    """A column function from an encoder of string batches; load, if given, is called once a task and passed on."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load() if load else None
        for texts in parts:
            yield pd.Series([[float(x) for x in v] for v in (encode(texts.tolist(), model) if load else encode(texts.tolist()))])

    return embed


def sections(docs: DataFrame, embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """Section nodes of docs (id, title, content): id {doc}::s{i}, the heading or else the document's title, body, embedding.

    A document without sections gives one, its whole content.
    """
    parts = markdown_sections(docs.select("id", "content"), "id", "content")
    df = docs.select("id", F.col("title").alias("_title"), "content").join(parts, "id", "left")
    heading = F.when(F.coalesce("heading", F.lit("")) != "", F.col("heading")).otherwise(F.col("_title"))
    df = df.select(F.concat("id", F.lit("::s"), F.coalesce("section", F.lit(0))).alias("sid"), heading.alias("title"), F.coalesce("body", "content").alias("body"), F.col("id").alias("parent_id"))
    return df.select(F.col("sid").alias("id"), "title", F.col("body").alias("content"), F.lit("section").alias("node_type"), "parent_id", embed(F.concat("title", F.lit("\n"), "body")).alias("embedding"))


def containers(docs: DataFrame) -> DataFrame:
    return docs.select("id", "title", F.lit("").alias("content"), F.lit("document").alias("node_type"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("array<double>").alias("embedding"))


def explicit_triggers(docs: DataFrame, embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """Triggers of docs (id, content): one for each section with keywords, or one for a chat; confidence 1."""
    made = lambda tid, pattern, text: F.struct(tid.alias("tid"), pattern.alias("pattern"), text.alias("text"))
    chat = let(lambda x: F.array(made(F.concat(F.lit("trigger_"), F.col("id"), F.lit("_conv")), chat_keywords(x["turns"]), F.substring(F.array_join(x["turns"], " "), 1, 1000))), turns=user_turns(F.col("content")))

    def of_part(p: Column, i: Column) -> Column:
        text = F.when(p["heading"] != "", F.concat_ws(" ", p["heading"], p["body"])).otherwise(p["body"])
        return made(F.concat_ws("_", F.lit("trigger"), F.col("id"), i), trigger_keywords(p["heading"], p["body"]), text)

    both = F.when(is_chat(F.col("content")), chat).otherwise(F.transform(section_parts(F.col("content")), of_part))
    rows = docs.select(F.col("id").alias("node"), F.inline(both)).where(F.size("pattern") > 0)
    return rows.select(F.col("tid").alias("id"), "pattern", embed(F.col("text")).alias("pattern_embedding"), F.col("node").alias("associated_node_id"), F.lit(1.0).alias("confidence"), F.lit("explicit").alias("origin"))
