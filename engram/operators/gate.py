"""A relevance gate for triggered nodes: a model is shown each candidate, and only "irrelevant" is a veto."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a node's text that a gate is shown, and an arbitrator.
GATE_PREVIEW, ARBITER_PREVIEW = 200, 150
#: The decisions, of which the last also stands for whatever a model says instead.
DECISIONS = ("irrelevant", "possibly_relevant", "relevant")
VETO, DEFAULT = DECISIONS[0], DECISIONS[-1]

PROMPT = """A task is given, and a note that came to mind. Does the note bear on the task?

Task: %s
Note: %s (part of %s)
Begins: %s

Answer with one JSON object, {"decision": "relevant" | "possibly_relevant" | "irrelevant", "reason": "one sentence"}."""


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\x0B]+|[\s\x0B]+$", "")


def answered_object(answer: Column) -> Column:
    """The JSON object of a model's answer, as text; null without one.

    It lies between the outermost braces of the first fenced block that starts with a brace (after the word
    json, if it is there), or of the whole answer if there is no such block.
    """
    said = _strip(F.coalesce(answer, F.lit("")))
    blocks = F.slice(F.split(said, "```", -1), F.lit(2), F.lit(1 << 30))
    blocks = F.transform(blocks, lambda b: _strip(F.regexp_replace(_strip(b), "^json", "")))
    fenced = F.get(F.filter(blocks, lambda b: b.startswith("{")), F.lit(0))
    body = F.regexp_extract(F.coalesce(fenced, said), r"(?s)(\{.*\})", 1)
    return F.when(body != "", body)


def extract_decision(answer: Column) -> Column:
    """One of DECISIONS.  What is no decision, no JSON, or more than one object counts as "relevant": it vetoes nothing."""
    # as the only element of a list, since a parser may overlook what follows an object
    parsed = F.try_parse_json(F.concat(F.lit("["), answered_object(answer), F.lit("]")))
    said = F.try_variant_get(parsed, "$[0].decision", "string")
    alone = F.try_variant_get(parsed, "$[1]", "variant").isNull()
    return F.when(alone & said.isin(*DECISIONS), said).otherwise(DEFAULT)


def prompts(candidates: DataFrame, queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """candidates (query_id, id) with what a model is asked: the query's text, and the title, parent and first characters of the node.

    Candidates that are no nodes have a null prompt.
    """
    q = queries.select("query_id", F.coalesce("text", F.lit("")).alias("_task"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    n = nodes.select("id", text("title").alias("_title"), text("parent_id").alias("_parent"), F.substring(text("content"), 1, GATE_PREVIEW).alias("_begins"))
    shown = candidates.join(q, "query_id", "left").join(n, "id", "left")
    return shown.select(*candidates.columns, F.when(F.col("_title").isNotNull(), F.format_string(PROMPT, "_task", "_title", "_parent", "_begins")).alias("prompt"))


def _told(rows: pd.DataFrame, tell: Callable[[pd.DataFrame], pd.Series], default: object, failures: Accumulator | None) -> pd.Series:
    """tell() of all rows at once; if that fails, of each alone, with the default where it fails again."""
    log = logging.getLogger(__name__)
    try:
        return pd.Series(list(tell(rows)), index=rows.index)
    except Exception:
        log.exception("the gate's model failed on %d candidates; each is tried alone", len(rows))
    out = []
    for i in range(len(rows)):
        try:
            out.append(list(tell(rows.iloc[i : i + 1]))[0])
        except Exception:  # an unavailable model vetoes nothing
            if failures is not None:
                failures.add(1)
            out.append(default)
    return pd.Series(out, index=rows.index)


def gated(candidates: DataFrame, decide: Callable[[pd.DataFrame], pd.Series] | None, context: DataFrame | None = None, failures: Accumulator | None = None) -> DataFrame:
    """Candidates that decide() does not call "irrelevant"; without a decider all of them.

    context: query_id, id, and what decide() is to see.  A candidate on which decide() fails is kept, and counted in
    failures; failures are logged by the worker.
    """
    if decide is None:
        return candidates
    shown = candidates if context is None else candidates.join(context, ["query_id", "id"], "left")

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            yield rows[(_told(rows, decide, DEFAULT, failures) != VETO).to_numpy()]

    return shown.mapInPandas(judge, shown.schema).select(*candidates.columns)


def model_gate(ask: Callable[[pd.Series], pd.Series], queries: DataFrame, nodes: DataFrame, failures: Accumulator | None = None) -> Callable[[DataFrame], DataFrame]:
    """A gate for guard_triggers(): ask() turns a batch of prompts into a model's answers; "irrelevant" is a veto.

    queries: query_id, text; nodes: id, title, parent_id, content.  Candidates that are no nodes pass unasked, and so
    do those on which ask() fails.
    """

    def gate(candidates: DataFrame) -> DataFrame:
        shown = prompts(candidates, queries, nodes)

        def answer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in parts:
                known = rows["prompt"].notna()
                said = pd.Series([None] * len(rows), index=rows.index, dtype=object)
                if known.any():
                    said[known] = _told(rows[known], lambda r: ask(r["prompt"]), None, failures)
                yield rows.assign(prompt=said)

        return shown.mapInPandas(answer, shown.schema).where(extract_decision(F.col("prompt")) != VETO).select(*candidates.columns)

    return gate


def arbitrate(candidates: DataFrame, choose: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """Candidates with a keep flag from choose(), which sees previews; by default all are kept."""
    if choose is None:
        return candidates.withColumn("keep", F.lit(True))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            yield rows.assign(keep=choose(rows).astype(bool))

    return candidates.mapInPandas(run, candidates.schema.add("keep", "boolean"))
