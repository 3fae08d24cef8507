"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

The texts of a batch are cut into pre-tokens; the distinct ones are held as one ragged numpy
array of symbols.  In each round every sequence applies its own lowest-rank pair, at all places
at once, until no pair has a rank.  The surviving symbols are the tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from engram.llm.arrays import SLICE_BYTES

#: Pre-token pattern of the byte-level family; fixed value.  \\s is spelled out as Unicode White_Space.
_S = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Pre-tokens whose counts a worker remembers; it forgets all when there are more.
CACHE = 400_000
NONE = np.iinfo(np.int64).max


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that such files use for the 256 bytes."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class RankMerger:
    """Merge ranks of a byte-level BPE file, applied to batches of pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in merges]
        self.size = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.byte_id = np.zeros(256, np.int64)
        for ch, b in byte_symbols().items():
            self.byte_id[b] = vocab[ch]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = regex.compile("|".join(map(regex.escape, self.special))).split if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a * self.size + b
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, self.rank[at], NONE)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        length = np.array([len(t) for t in tokens], np.int64)
        out = length.copy()
        live = np.flatnonzero(length > 1)
        sym = self.byte_id[np.frombuffer(b"".join(tokens[i] for i in live), np.uint8)]
        size = length[live]
        seq = np.repeat(np.arange(len(live)), size)
        rank = np.full(len(sym), NONE)
        if len(sym):
            inner = np.flatnonzero(seq[1:] == seq[:-1])
            rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(sym):
            start = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, start)
            going = low < NONE
            if not going.all():  # the rest is done
                out[live[~going]] = size[~going]
                keep = np.repeat(going, size)
                sym, rank, live, size, low = sym[keep], rank[keep], live[going], size[going], low[going]
                if not len(sym):
                    break
            seq = np.repeat(np.arange(len(size)), size)
            hit = np.flatnonzero(rank == low[seq])
            # of overlapping places (a symbol paired with itself) the leftmost go first
            run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            place = np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))
            hit = hit[place % 2 == 0]
            sym[hit] = self.merged[low[seq[hit]]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            now = hit - np.arange(len(hit))  # where the merged symbols stand afterwards
            size = size - np.bincount(seq[hit], minlength=len(size))
            sym, rank, seq = sym[keep], rank[keep], seq[keep]
            for at in (now, now[now > 0] - 1):
                inside = at[at + 1 < len(sym)]
                same = seq[inside] == seq[inside + 1]
                rank[at] = NONE
                inside = inside[same]
                rank[inside] = self.ranks(sym[inside], sym[inside + 1])
        return out

    def texts(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts; the file's added tokens count as one where they stand."""
        found, extra = [], []
        for t in texts:
            if self.split and any(s in t for s in self.special):
                parts = self.split(t)
                found.append([x for p in parts for x in self.find(p)])
                extra.append(len(parts) - 1)
            else:
                found.append(self.find(t))
                extra.append(0)
        if len(self.known) > CACHE:
            self.known.clear()
        new = list({x for f in found for x in f if x not in self.known})
        self.known.update(zip(new, self.count([x.encode("utf-8") for x in new]).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, f)) + e for f, e in zip(found, extra, strict=True)]


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every whole text.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null and repeated rows stay
    repeated.  Other columns are left out, whatever their names.  vocabulary is the path of a
    byte-level BPE file that every executor can read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocabulary)
        for batch in batches:
            at = 0
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_tokens: list[int] = []
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= SLICE_BYTES):
                    chars += len(texts[to])
                    to += 1
                n_tokens += m.texts(texts[at:to])
                at = to
            n_bytes = [len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
