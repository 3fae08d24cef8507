"""Benchmark decontamination by SimHash of item-sized windows.

A document's windows have as many words as a benchmark item.  Their 64-bit SimHash fingerprints
over five-word shingles are looked up in a multi-index: the bits are cut into RADIUS + 1 blocks,
and two fingerprints within RADIUS agree in one block at least, so no such pair is missed.
(A window of similarity 0.8 lies about ten bits away, give or take three; to hold them the radius has to
be so wide that blocks of three bits select little.  What selects is the bound below.)
Candidates within the radius are verified by exact weighted-shingle similarity: the sum of the
smaller weights over the sum of the larger, a shingle weighing as often as it occurs.

A window that can be verified shares most shingles with an item.  So only windows with enough
shingles that some item has are fingerprinted; this bound loses nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.arrays import U64, prefix_hash, shingles, slices, span_hash, spread, sum_by, utf8, words

K, RADIUS = 5, 20
#: Bytes of benchmark text held by a task at once; a larger benchmark is searched in several passes.
BENCHMARK_BYTES = 32 << 20
#: Pairs of windows and items that agree in a block, looked at together.
PAIRS = 1 << 20


def simhash(h: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of shingle hashes: each bit by the majority of its shingles, ties giving 0."""
    out = np.zeros(len(start), U64)
    step = 1 << 14
    for a in range(0, len(start), step):
        c = count[a : a + step]
        rows = h[spread(start[a : a + step], c)]
        bits = np.unpackbits(rows[:, None].view(np.uint8), axis=1).astype(np.int32)
        ones = np.add.reduceat(bits, np.cumsum(c) - c, axis=0)
        out[a : a + step] = np.packbits(2 * ones > c[:, None], axis=1).view(U64)[:, 0]
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(where[: len(a)], minlength=len(both)), np.bincount(where[len(a) :], minlength=len(both))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class MultiIndex:
    """Fingerprints by the value of each of radius + 1 blocks of bits."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        #: Of each block: shift, mask, fingerprints by value, and where each value's begin.
        self.blocks = []
        edges = np.linspace(0, 64, radius + 2).astype(int).tolist()
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            shift, mask = U64(lo), U64((1 << (hi - lo)) - 1)
            value = ((prints >> shift) & mask).astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << (hi - lo)))])
            self.blocks.append((shift, mask, np.argsort(value, kind="stable"), begin))

    def within(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, fingerprint) at most radius bits apart, from the queries and fingerprints that agree in a block."""
        step = max(1, PAIRS // max(1, len(self.prints)))
        found = [self._within(query[a : a + step]) + a * len(self.prints) for a in range(0, len(query), step)]
        pair = np.concatenate(found) if found else np.zeros(0, np.int64)
        return pair // max(1, len(self.prints)), pair % max(1, len(self.prints))

    def _within(self, query: np.ndarray) -> np.ndarray:
        near = []
        for shift, mask, order, begin in self.blocks:
            value = ((query >> shift) & mask).astype(np.int64)
            n = begin[value + 1] - begin[value]
            q, p = np.repeat(np.arange(len(query)), n), order[spread(begin[value], n)]
            ok = np.bitwise_count(query[q] ^ self.prints[p]) <= self.radius
            near.append(q[ok] * len(self.prints) + p[ok])
        return np.unique(np.concatenate(near))


class BenchmarkIndex:
    """The items of a benchmark, by their number of shingles."""

    def __init__(self, texts: list[str], threshold: float, radius: int = RADIUS):
        data, offs = utf8(pa.array(texts, pa.large_string()))
        s, e, d = words(data, offs)
        h, at = shingles(span_hash(prefix_hash(data, lower=True), s, e), d, len(texts), K)
        self.threshold = threshold
        self.n_words = sum_by(d, len(texts))
        count = sum_by(at, len(texts))
        first = np.cumsum(count) - count
        self.shingles = [h[a : a + n] for a, n in zip(first.tolist(), count.tolist(), strict=True)]
        self.known = np.unique(h)
        prints = simhash(h, first[count > 0], count[count > 0])
        full = np.flatnonzero(count)
        self.sizes = {int(n): full[count[full] == n] for n in np.unique(count[full])}
        self.index = {n: MultiIndex(prints[np.searchsorted(full, items)], radius) for n, items in self.sizes.items()}

    def search(self, data: np.ndarray, offs: np.ndarray) -> dict[tuple[int, int], tuple[float, int, int]]:
        """(text, item) -> (similarity, first word, words) of its best window; the first of equals."""
        texts = len(offs) - 1
        s, e, d = words(data, offs)
        h, at = shingles(span_hash(prefix_hash(data, lower=True), s, e), d, texts, K)
        found: dict[tuple[int, int], tuple[float, int, int]] = {}
        if not len(h) or not len(self.known):
            return found
        place = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        known = self.known[place] == h
        marked = np.unique(at[known])
        if not len(marked):
            return found
        hits = np.concatenate([[0], np.cumsum(known)])
        low, high = np.searchsorted(at, marked), np.searchsorted(at, marked, "right")
        n_words = sum_by(d, texts)
        for size, items in self.sizes.items():
            # a window is as long as the item, or the whole text if that is shorter
            wide = np.minimum(size, high - low)
            start = spread(low, high - low - wide + 1)
            width = np.repeat(wide, high - low - wide + 1)
            shared = hits[start + width] - hits[start]
            need = np.ceil(self.threshold * (size + width) / (1 + self.threshold) - 1e-9)
            ok = shared >= need
            start, width = start[ok], width[ok]
            if not len(start):
                continue
            q, p = self.index[size].within(simhash(h, start, width))
            for i, j in zip(q.tolist(), p.tolist(), strict=True):
                a, n, item = int(start[i]), int(width[i]), int(items[j])
                sim = similarity(h[a : a + n], self.shingles[item])
                if sim >= self.threshold - 1e-12:
                    text = int(at[a])
                    first = a - int(low[np.searchsorted(marked, text)])
                    best = (-sim, first, min(n + K - 1, int(n_words[text])))
                    found[text, item] = min(found.get((text, item), best), best)
        return {k: (-v[0], v[1], v[2]) for k, v in found.items()}


_built: dict[tuple, BenchmarkIndex] = {}


def _index(token: str, texts: list[str], threshold: float) -> BenchmarkIndex:
    """The index of a pass, built once by a worker and kept until another pass needs one."""
    if (token, threshold) not in _built:
        _built.clear()
        _built[token, threshold] = BenchmarkIndex(texts, threshold)
    return _built[token, threshold]


def _passes(items: DataFrame, limit: int) -> Iterator[tuple[list[bytes], list[str]]]:
    """Digests and texts of the distinct items in passes of about limit bytes each, so that what a task holds is bounded."""
    distinct = items.select("digest", "item_text").dropDuplicates(["digest"])
    total = distinct.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    parts = -(-total // limit)
    for k in range(parts):
        rows = distinct.where(F.pmod(F.xxhash64("digest"), F.lit(parts)) == k).orderBy("digest").collect()
        yield [bytes(r["digest"]) for r in rows], [r["item_text"] for r in rows]


def _items(benchmark: DataFrame, text_col: str, id_col: str | None = None) -> DataFrame:
    """Items with text, and the digests by which repeated ones are one."""
    text = F.col(f"`{text_col}`").cast("string")
    own = [F.col(f"`{id_col}`").alias("item")] if id_col else []
    return benchmark.where(F.trim(text) != "").select(*own, text.alias("item_text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", limit: int = BENCHMARK_BYTES) -> DataFrame:
    """id, item id, similarity, first_word, n_words: the best window of each document and item that reaches threshold.

    Words are runs without white space, A-Z lower-cased.  An item or document of fewer than five words
    is one shingle, the whole of it.  Null and empty texts on either side match nothing; null ids and repeated rows
    stay, and a repeated item gives a row each time.  No rows mean no leak.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", "digest", "similarity", "first_word", "n_words"]
    schema = f"id {id_type}, digest binary, similarity double, first_word long, n_words long"
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    items = _items(benchmark, item_text_col, item_id_col)
    out = docs.sparkSession.createDataFrame([], schema)
    for digests, texts in _passes(items, limit):
        held, token = docs.sparkSession.sparkContext.broadcast((digests, texts)), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], held=held, token=token) -> Iterator[pa.RecordBatch]:
            digests, texts = held.value
            index = _index(token, texts, threshold)
            for batch, data, offs in slices(batches, 1):
                found = index.search(data, offs)
                key, value = list(found), list(found.values())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k[0] for k in key], pa.int64())), pa.array([digests[k[1]] for k in key], pa.binary()), pa.array([v[0] for v in value], pa.float64()), pa.array([v[1] for v in value], pa.int64()), pa.array([v[2] for v in value], pa.int64())], names)

        out = out.unionByName(rows.mapInArrow(scan, schema))
    # the items' texts stay behind: only ids meet the few rows found
    found = out.join(items.select("digest", "item"), "digest")
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_id_col), "similarity", "first_word", "n_words")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", limit: int = BENCHMARK_BYTES) -> DataFrame:
    """The rows of docs in which find_leaks finds nothing."""
    at, schema = docs.columns.index(text_col), docs.schema
    for _, texts in _passes(_items(benchmark, item_text_col), limit):
        held, token = docs.sparkSession.sparkContext.broadcast(texts), uuid.uuid4().hex

        def keep(batches: Iterator[pa.RecordBatch], held=held, token=token) -> Iterator[pa.RecordBatch]:
            index = _index(token, held.value, threshold)
            for batch, data, offs in slices(batches, at):
                clean = np.ones(batch.num_rows, bool)
                clean[[text for text, _ in index.search(data, offs)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, schema)
    return docs
