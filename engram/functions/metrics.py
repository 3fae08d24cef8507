"""Answer and retrieval metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions.expressions import let
from engram.functions.text import answer_tokens, normalize_answer


def exact_match(predicted: Column, golds: Column) -> Column:
    """1.0 if the normalised prediction equals one of the answers."""
    p = normalize_answer(predicted)
    return F.exists(golds, lambda g: normalize_answer(g) == p).cast("double")


def _overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection."""
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 of answer tokens as multisets; 0 where one side has none."""

    def score(x: Column) -> Column:
        p, g, both = x["p"], x["g"], _overlap(x["p"], x["g"])
        return let(lambda y: F.when((F.size(p) == 0) | (F.size(g) == 0) | (y["both"] == 0), 0.0).otherwise(2 * y["both"] / (F.size(p) + F.size(g))), both=both)

    return let(score, p=answer_tokens(predicted), g=answer_tokens(gold))


def best_f1(predicted: Column, golds: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(golds, lambda g: token_f1(predicted, g))), F.lit(0.0))


def recall_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Share of gold among the first k; 1 without gold."""
    hit = F.size(F.array_intersect(F.slice(retrieved, 1, k), gold))
    return F.when(F.size(F.array_distinct(gold)) == 0, 1.0).otherwise(hit / F.size(F.array_distinct(gold)))


def precision_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Share of the returned (k at most) that is gold; 0 where nothing is returned."""
    top = F.slice(retrieved, 1, k)
    return F.when(F.size(top) == 0, 0.0).otherwise(F.size(F.array_intersect(top, gold)) / F.size(top))


def support_f1(retrieved: Column, gold: Column) -> Column:
    """F1 of two id sets; 1 if both are empty."""
    r, g = F.array_distinct(retrieved), F.array_distinct(gold)
    both = F.size(F.array_intersect(r, g))
    return F.when((F.size(r) == 0) & (F.size(g) == 0), 1.0).when(both == 0, 0.0).otherwise(2 * both / (F.size(r) + F.size(g)))


def trigger_recall(fired: Column, expected: Column) -> Column:
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.array_intersect(fired, expected)) / F.size(F.array_distinct(expected)))


def trigger_precision(fired: Column, unexpected: Column) -> Column:
    """Share of the fired ids that nobody ruled out, neutral ones included; 1 if nothing fired."""
    bad = F.size(F.array_intersect(fired, unexpected))
    return F.when(F.size(fired) == 0, 1.0).otherwise(1 - bad / F.size(F.array_distinct(fired)))


def suppression(fired: Column, gold: Column) -> Column:
    """Without gold 1 if nothing fired, else 0; null with gold."""
    return F.when(F.size(gold) == 0, (F.size(fired) == 0).cast("double"))


def trigger_shares(fired: Column, gold: Column, hit: Column) -> tuple[Column, Column, Column]:
    """Recall, precision with all but gold ruled out, and suppression, from the numbers of fired, gold and common ids."""
    return F.when(gold == 0, 1.0).otherwise(hit / gold), F.when(fired == 0, 1.0).otherwise(1 - (fired - hit) / fired), F.when(gold == 0, (fired == 0).cast("double"))
