"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.  Expectation
maximisation over the counts of vote patterns estimates how often each labeller is right; the
posterior of a pattern labels a bounded sample, on which a hashed linear scorer is trained.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.arrays import U64, mix, prefix_hash, slices, span_hash, sum_by, words
from engram.llm.quality_rules import common_hashes

#: Labellers: (name, value below which good, value above which bad); between the two, and on texts of fewer than MIN_WORDS words, they abstain.
LABELLERS = (
    ("symbols", 0.01, 0.05),  # symbols among all characters
    ("capitals", 0.25, 0.60),  # capitals among ASCII letters
    ("stutter", 0.05, 0.20),  # words equal to the one before
    ("sameness", 0.50, 0.80),  # word pairs equal to an earlier one
    ("tables", 0.02, 0.10),  # words that are a bar
    ("shouts", 0.02, 0.20),  # words ending in !!
    ("rare", 0.80, 0.97),  # words that are no common word
    ("run_on", 0.985, 0.999),  # words that end without a stop
)
MIN_WORDS = 8
BINS = 512
ABSTAIN, GOOD, BAD = 0, 1, 2
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _LOWER[97:123] = True, True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
#: Bytes by shape: letters and digits lose their identity, other characters keep it.
_SHAPE = np.arange(256, dtype=np.uint32)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97


def measures(data: np.ndarray, offs: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A column for each labeller, and the words, by text."""
    texts = len(offs) - 1
    total = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offs])
    s, e, d = words(data, offs)
    n = sum_by(d, texts)
    h = span_hash(prefix_hash(data, lower=True), s, e)
    exclaim = (data == 33).astype(np.int64)
    twice = np.zeros(len(data) + 1, bool)
    twice[2:] = (exclaim[1:] & exclaim[:-1]).astype(bool)
    again = np.zeros(len(d), bool)
    again[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    pairs = np.flatnonzero(d[1:] == d[:-1])
    pd = d[pairs]
    _, one = np.unique(mix(mix(h[pairs]) + h[pairs + 1] + pd.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    count = lambda flag: sum_by(d[flag], texts)
    upper, lower = total(_UPPER[data]), total(_LOWER[data])
    per = np.maximum(n, 1)
    cols = [
        total(_SYMBOL[data]) / np.maximum(total((data & 0xC0) != 0x80), 1),
        upper / np.maximum(upper + lower, 1),
        count(again) / per,
        1 - sum_by(pd[one], texts) / np.maximum(sum_by(pd, texts), 1),
        count((e - s == 1) & (data[s] == 124)) / per,
        count(twice[e] & (e - s >= 2)) / per,
        1 - count(common[at] == h) / per,
        1 - count(_STOP[data[e - 1]]) / per,
    ]
    return np.stack(cols, 1), n


def votes(values: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    low = np.array([x[1] for x in LABELLERS])
    high = np.array([x[2] for x in LABELLERS])
    v = np.where(values <= low, GOOD, np.where(values >= high, BAD, ABSTAIN))
    return np.where(n_words[:, None] < MIN_WORDS, ABSTAIN, v)


def codes(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(v.shape[1])


def features(data: np.ndarray, offs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Root frequencies of hashed shape 3-grams, then hashed steps of the measures."""
    texts, n = len(offs) - 1, len(data)
    x = np.zeros((texts, BINS + 64), np.float32)
    if n >= 3:
        doc = np.repeat(np.arange(texts), np.diff(offs))
        c = _SHAPE[data]
        h = (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA6B) ^ c[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F) >> np.uint32(23)
        same = doc[:-2] == doc[2:]
        counts = np.bincount((doc[:-2] * BINS + h)[same], minlength=texts * BINS).reshape(texts, BINS)
        x[:, :BINS] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    step = np.clip((values * 8).astype(np.int64), 0, 7)
    for j in range(values.shape[1]):
        x[np.arange(texts), BINS + (j * 8 + step[:, j]) % 64] = 0.5
    return x


@dataclass
class LabelModel:
    """Share of good documents, and P(vote | class) by labeller, class (good, bad) and vote."""

    prior: float
    table: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(good | votes); abstaining tells nothing."""
        log = np.zeros((len(v), 2)) + np.log([self.prior, 1 - self.prior])
        for j in range(v.shape[1]):
            said = v[:, j] != ABSTAIN
            log[said] += np.log(self.table[j][:, v[said, j]]).T
        return 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -50, 50)))

    @staticmethod
    def fit(v: np.ndarray, weight: np.ndarray, rounds: int = 200) -> LabelModel:
        """From distinct vote patterns and their counts: all shares are estimated, each with one vote added on either side.

        The start says which class is the good one: the larger, which labellers seldom call bad.
        """
        j = v.shape[1]
        table = np.zeros((j, 2, 3))
        table[:, 1, GOOD], table[:, 1, BAD], table[:, 0, GOOD], table[:, 0, BAD] = 0.7, 0.3, 0.99, 0.01
        model = LabelModel(0.85, table)
        for _ in range(rounds):
            good = model.posterior(v)
            new = np.zeros_like(table)
            for k in range(j):
                for vote in (GOOD, BAD):
                    at = v[:, k] == vote
                    new[k, 0, vote], new[k, 1, vote] = (weight * good)[at].sum() + 1, (weight * (1 - good))[at].sum() + 1
                new[k] /= new[k].sum(1, keepdims=True)
            prior = float(np.clip((weight * good).sum() / max(weight.sum(), 1), 0.01, 0.99))
            done = abs(prior - model.prior) < 1e-7 and np.abs(new - model.table).max() < 1e-7
            model = LabelModel(prior, new)
            if done:
                break
        return model


def linear_scorer(x: np.ndarray, good: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is a constant."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - good) / len(x) + penalty * w
        s = np.maximum(p * (1 - p), 1e-4) / len(x)
        step = np.linalg.solve((x * s[:, None]).T @ x + penalty * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray


def _pieces(batches: Iterator[pa.RecordBatch], common: np.ndarray, size: int = 512) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch, data, offs in slices(batches, 1):
        for a in range(0, batch.num_rows, size):
            b = min(a + size, batch.num_rows)
            d, o = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            values, n = measures(d, o, common)
            yield batch.slice(a, b - a), d, o, values, votes(values, n)


def fit_quality_model(docs: DataFrame, text_col: str = "text", key: Column | None = None, sample: int = 2000) -> QualityModel:
    """The label model from the vote patterns of all rows, the scorer from about sample rows drawn by a hash of key.

    Patterns and their counts come to the driver: 3 ** labellers rows at most.  Of the sample come features, not texts.
    """
    common = common_hashes()
    key = F.monotonically_increasing_id() if key is None else key
    rows = docs.select(key.cast("string").alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for *_, v in _pieces(batches, common):
            total += np.bincount(codes(v), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["code", "n"])

    got = rows.mapInArrow(patterns, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toPandas()
    v = got["code"].to_numpy(np.int64)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    labels = LabelModel.fit(v, got["n"].to_numpy(np.float64))
    total = int(got["n"].sum())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, d, o, values, v in _pieces(batches, common):
            x = features(d, o, values)
            yield pa.RecordBatch.from_arrays([pa.array(labels.posterior(v), pa.float64()), pa.array(v.any(1)), pa.array([r.tobytes() for r in x], pa.binary())], ["good", "told", "x"])

    u = F.pmod(F.xxhash64("key", F.lit("quality")), F.lit(1 << 20)) / float(1 << 20)
    drawn = rows.where(u < min(1.0, sample / max(total, 1))).mapInArrow(extract, "good double, told boolean, x binary").where("told").toPandas().sort_values(["x", "good"]).head(2 * sample)
    if not len(drawn):
        return QualityModel(labels, np.zeros(BINS + 65))
    return QualityModel(labels, linear_scorer(np.stack([np.frombuffer(b, np.float32) for b in drawn["x"]]), drawn["good"].to_numpy(np.float64)))


def quality_scores(docs: DataFrame, model: QualityModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_votes, posterior (of the label model), score (of the linear scorer) and kept of every whole text.

    kept: score >= threshold, or no labeller votes (the text is too short to speak against it).

    A null text counts as empty; texts too short for any vote get the prior as posterior.  Null ids
    and repeated rows stay; other columns are left out.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    common = common_hashes()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, d, o, values, v in _pieces(batches, common):
            score = 1 / (1 + np.exp(-np.clip(features(d, o, values) @ model.weights[:-1] + model.weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array((v != ABSTAIN).sum(1), pa.int64()), pa.array(model.labels.posterior(v), pa.float64()), pa.array(score, pa.float64()), pa.array((score >= threshold) | ~v.any(1))], ["id", "n_votes", "posterior", "score", "kept"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(judge, f"id {id_type}, n_votes long, posterior double, score double, kept boolean").withColumnRenamed("id", id_col)
