"""Alignment of two tokenizers by a dangling-suffix transducer.

The tokens of both sides are fed in turn: the side that lags gets its next token, and the state is
which side leads and the bytes by which it does (a suffix of its last token).  An empty residual
closes a group.  A transition depends on the residual and the next token alone, so it is worked out
once and remembered; numpy steps all pieces of a batch through the remembered transitions together.

Texts are cut where both tokenizers must have a boundary (before the space of a word, after a single
line feed), equal pieces are encoded and aligned once a worker, and a text is the row of its pieces.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.arrays import U64, give_back, mix, prefix_hash, slices, span_hash, spread, sum_by
from engram.llm.tables import stage
from engram.llm.token_counts import byte_symbols

#: Remembered transitions of a worker: a direct-mapped table of this many places.
MEMO = 1 << 20
#: A worker forgets its pieces when it has more of them, or more bytes of them.
PIECES, PIECE_BYTES = 300_000, 32 << 20
#: Pairs whose counts travel to the tasks: those of at least 1/HEAVY of all links, of which there are at most HEAVY.
HEAVY = 1 << 18
EMPTY, FAILED = 0, 1
#: Below so many pieces of a batch numpy's steps cost more than plain ones.
FEW = 16

#: Bytes that may stand after a cut: no white space of either tokenizer starts with them.
_OPENS = np.zeros(256, bool)
_OPENS[0x21:0x7F] = True
_OPENS[0xC3:0xF8] = True
_OPENS[[0xE1, 0xE2, 0xE3]] = False
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True


class Transducer:
    """States are numbers: EMPTY, FAILED, and one for each side and residual met (at most the suffixes of all tokens)."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.tokens = [*a, *b]
        self.shift = len(a)
        self.number: dict[tuple[bool, bytes], int] = {}
        self.residual: list[tuple[bool, bytes]] = [(False, b""), (False, b"")]
        #: By state: whether the next token comes from b, which is so when a leads.
        self.wants_b = np.zeros(1 << 12, bool)
        self.memo_key, self.memo = np.full(MEMO, -1, np.int64), np.zeros(MEMO, np.int32)
        self.single: dict[tuple[int, int], int] = {}

    def state(self, a_leads: bool, rest: bytes) -> int:
        if not rest:
            return EMPTY
        s = self.number.setdefault((a_leads, rest), len(self.residual))
        if s == len(self.residual):
            self.residual.append((a_leads, rest))
            if s >= len(self.wants_b):
                self.wants_b = np.concatenate([self.wants_b, np.zeros(len(self.wants_b), bool)])
            self.wants_b[s] = a_leads
        return s

    def transition(self, s: int, token: int) -> int:
        word = self.tokens[token]
        if s == EMPTY:
            return self.state(token < self.shift, word)
        a_leads, rest = self.residual[s]
        if rest.startswith(word):
            return self.state(a_leads, rest[len(word) :])
        if word.startswith(rest):
            return self.state(not a_leads, word[len(rest) :])
        return FAILED

    def step(self, s: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Next states; tokens of b are numbered after those of a."""
        key = s * len(self.tokens) + token
        at = (mix(key.astype(U64)) & U64(MEMO - 1)).astype(np.int64)
        out = self.memo[at].astype(np.int64)
        miss = np.flatnonzero(self.memo_key[at] != key)
        if len(miss):
            new, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            made = np.array([self.transition(*x) for x in zip(s[miss][first].tolist(), token[miss][first].tolist(), strict=True)], np.int64)
            out[miss] = made[back]
            place = at[miss][first]
            self.memo_key[place], self.memo[place] = new, made
        return out

    def align(self, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, ...]:
        """ok by sequence; seq, place in a, place in b of every link; seq and the places that follow each group's last tokens.

        Sequences stand one after the other in a and b at the offsets; links and groups come in no order.
        """
        n = len(a_at) - 1
        ia, ib, state = a_at[:-1].copy(), b_at[:-1].copy(), np.full(n, EMPTY)
        ok, live = np.ones(n, bool), np.flatnonzero((np.diff(a_at) > 0) | (np.diff(b_at) > 0))
        links, closes = [], []
        while len(live):
            if len(live) < FEW:  # long pieces are left: one after the other
                for k in live.tolist():
                    ok[k] = self._walk(k, int(state[k]), a[a_at[k] : a_at[k + 1]].tolist(), int(ia[k] - a_at[k]), b[b_at[k] : b_at[k + 1]].tolist(), int(ib[k] - b_at[k]), (int(a_at[k]), int(b_at[k])), links, closes)
                break
            s = state[live]
            from_b = self.wants_b[s]
            lacks = np.where(from_b, ib[live] >= b_at[live + 1], ia[live] >= a_at[live + 1])
            if lacks.any():  # the lagging side has ended
                ok[live[lacks]] = False
                live, s, from_b = live[~lacks], s[~lacks], from_b[~lacks]
            pa_, pb = ia[live], ib[live]
            token = np.zeros(len(live), np.int64)
            token[from_b] = b[pb[from_b]] + self.shift
            token[~from_b] = a[pa_[~from_b]]
            after = self.step(s, token)
            linked = np.flatnonzero((s != EMPTY) & (after != FAILED))
            links.append((live[linked], pa_[linked] - from_b[linked], pb[linked] - ~from_b[linked]))
            ib[live] += from_b
            ia[live] += ~from_b
            state[live] = after
            shut = live[after == EMPTY]
            closes.append((shut, ia[shut], ib[shut]))
            ok[live[after == FAILED]] = False
            live = live[(after != FAILED) & ((after != EMPTY) | (ia[live] < a_at[live + 1]) | (ib[live] < b_at[live + 1]))]
        none = (np.zeros(0, np.int64),) * 3
        return ok, *(np.concatenate(x) for x in zip(*(links or [none]), strict=True)), *(np.concatenate(x) for x in zip(*(closes or [none]), strict=True))


    def _walk(self, k: int, s: int, a: list[int], i: int, b: list[int], j: int, base: tuple[int, int], links: list, closes: list) -> bool:
        """The rest of sequence k, whose ids are a and b and start at base; False if the sides differ."""
        link, shut, known = [], [], self.single
        wants_b, ok = self.wants_b, True
        while i < len(a) or j < len(b) or s != EMPTY:
            from_b = bool(wants_b[s])
            if (j if from_b else i) >= (len(b) if from_b else len(a)):
                ok = False
                break
            token = b[j] + self.shift if from_b else a[i]
            after = known.get((s, token))
            if after is None:
                if len(known) > MEMO:
                    known.clear()
                after = known[s, token] = self.transition(s, token)
                wants_b = self.wants_b
            if after == FAILED:
                ok = False
                break
            if s != EMPTY:
                link.append((i - from_b, j - (not from_b)))
            i, j = (i, j + 1) if from_b else (i + 1, j)
            if after == EMPTY:
                shut.append((i, j))
            s = after
        for found, out in ((link, links), (shut, closes)):
            pairs = np.array(found, np.int64).reshape(-1, 2) + np.array(base)
            out.append((np.full(len(pairs), k), pairs[:, 0], pairs[:, 1]))
        return ok


class Aligner:
    """Both vocabularies, the transducer, and what a worker remembers of pieces of text."""

    def __init__(self, path_a: str, path_b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        byte = byte_symbols()
        self.a_bytes: list[bytes] = [b""] * (max(spec["vocab"].values()) + 1)
        for text, i in spec["vocab"].items():
            if all(ch in byte for ch in text):
                self.a_bytes[i] = bytes(byte[ch] for ch in text)
        made = [spec["vocab"]["".join(m.split(" ", 1) if isinstance(m, str) else m)] for m in spec["merges"]]
        if made != sorted(made):
            raise ValueError("ids of merged tokens must ascend with their ranks")
        ranks = {t: i for i, t in enumerate(self.a_bytes) if t and (len(t) == 1 or i >= made[0]) and i <= made[-1]}
        self.encode_a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        text = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.sp.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(text)]
        plain = [t for i, t in enumerate(text) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))]
        if any("\n" in t or "▁" in t.lstrip("▁") for t in plain) or len(self.sp.encode("\n", out_type=str)) != 2 or self.sp.decode(self.sp.encode(" a  b ")) != " a  b ":
            raise ValueError("the model must put a space before a text, keep spaces, and have no piece that crosses words or lines")
        self.transducer = Transducer(self.a_bytes, self.b_bytes)
        self.width = len(self.b_bytes)
        digits = [str(i).encode() for i in range(max(len(self.a_bytes), self.width))]
        self.digit_n = np.array([len(d) for d in digits], np.int64)
        self.digit_at = np.cumsum(self.digit_n) - self.digit_n
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.h, self.row = np.zeros(0, U64), np.zeros(0, np.int64)
        #: By row: tokens of a and b, groups, links, whether both sides have the piece's bytes.
        self.facts = np.zeros((0, 5), np.int64)
        self.codes, self.code_at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.shown: list[bytes] = []
        self.held = 0

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, ...]:
        """Ids and offsets of both sides; a piece begins with a space, or follows a line feed."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        a = [self.encode_a(t) for t in texts]
        b = self.sp.encode([t[1:] if t[0] == " " else "\n" + t for t in texts], num_threads=1)
        b = [x if t[0] == " " else x[2:] for x, t in zip(b, texts, strict=True)]
        flat = []
        for side in (a, b):
            flat += [np.array([i for x in side for i in x], np.int64), np.cumsum([0, *map(len, side)])]
        return tuple(flat)

    def show(self, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, shut: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> list[bytes]:
        """Each sequence's groups as a1,a2|b1;a3|b2 with decimal ids."""
        by = np.lexsort((end_a, shut))
        end_a, end_b, shut = end_a[by], end_b[by], shut[by]
        groups = len(shut)
        # tokens by group, those of a before those of b; each with the sign that follows it
        of_a = np.searchsorted(end_a, np.arange(len(a)), "right")
        of_b = np.searchsorted(end_b, np.arange(len(b)), "right")
        order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
        ids = np.concatenate([a, b])[order]
        sign = np.full(len(order), ord(","), np.uint8)
        n_a, n_b = sum_by(of_a, groups), sum_by(of_b, groups)
        last = np.cumsum(n_a + n_b)
        sign[last - 1] = ord(";")
        sign[last - n_b - 1] = ord("|")
        n = self.digit_n[ids] + 1
        end = np.cumsum(n)
        out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
        out[spread(end - n, n - 1)] = self.digits[spread(self.digit_at[ids], n - 1)]
        out[end - 1] = sign
        stop = np.zeros(len(a_at), np.int64)
        stop[1:] = end[np.cumsum(np.diff(a_at) + np.diff(b_at)) - 1]
        raw = out.tobytes()
        return [raw[i : j - 1] for i, j in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)]

    def learn(self, h: np.ndarray, pieces: list[bytes]) -> None:
        """Encode and align pieces not met before, of the given sorted hashes."""
        a, a_at, b, b_at = self.encode(pieces)
        ok, seq, link_a, link_b, shut, end_a, end_b = self.transducer.align(a, a_at, b, b_at)
        n = len(pieces)
        facts = np.stack([np.diff(a_at), np.diff(b_at), sum_by(shut, n), sum_by(seq, n), ok], 1)
        if not ok.all():  # texts that hold such pieces have no tokens
            facts[~ok, :4] = 0
            keep = ok[seq]
            seq, link_a, link_b = seq[keep], link_a[keep], link_b[keep]
            some = np.flatnonzero(ok)
            na, nb = np.diff(a_at)[some], np.diff(b_at)[some]
            a_own, b_own = np.concatenate([[0], np.cumsum(na)]), np.concatenate([[0], np.cumsum(nb)])
            keep = ok[shut]
            shut, end_a, end_b = shut[keep], end_a[keep], end_b[keep]
            at = np.searchsorted(some, shut)
            strings = self.show(a[spread(a_at[some], na)], a_own, b[spread(b_at[some], nb)], b_own, at, end_a - a_at[shut] + a_own[at], end_b - b_at[shut] + b_own[at]) if len(some) else []
            shown = [b""] * n
            for i, t in zip(some.tolist(), strings, strict=True):
                shown[i] = t
        else:
            shown = self.show(a, a_at, b, b_at, shut, end_a, end_b)
        codes = a[link_a] * self.width + b[link_b]
        base = len(self.facts)
        self.facts = np.concatenate([self.facts, facts])
        count = facts[:, 3]
        self.code_at = np.concatenate([self.code_at, np.cumsum(count) - count + len(self.codes)])
        self.codes = np.concatenate([self.codes, codes[np.argsort(seq, kind="stable")]])
        self.shown += shown
        at = np.searchsorted(self.h, h)
        self.h, self.row = np.insert(self.h, at, h), np.insert(self.row, at, base + np.arange(n))
        self.held += sum(map(len, shown))

    def rows(self, h: np.ndarray, own: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Rows of the pieces own[start:stop], whose distinct hashes h are sorted."""
        if len(self.row) > PIECES or self.held > PIECE_BYTES:
            self.forget()
        at = np.searchsorted(self.h, h)
        new = np.ones(len(h), bool)
        inside = np.flatnonzero(at < len(self.h))
        new[inside] = self.h[at[inside]] != h[inside]
        if new.any():
            raw = own.tobytes()
            self.learn(h[new], [raw[i:j] for i, j in zip(start[new].tolist(), stop[new].tolist(), strict=True)])
        return self.row[np.searchsorted(self.h, h)]

    def texts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """By text n_a, n_b, n_groups, n_links and the digest; then text, pair code and count of its distinct links."""
        texts = len(offs) - 1
        size = np.diff(offs)
        size = size + (size > 0)
        bounds = np.concatenate([[0], np.cumsum(size)])
        own = np.full(bounds[-1], 0x20, np.uint8)
        inner = np.ones(bounds[-1], bool)
        inner[bounds[:-1][size > 0]] = False
        own[inner] = data
        n = len(own)
        none = np.zeros(0, np.int64)
        if not n:
            return np.zeros((texts, 4), np.int64), [""] * texts, none, none, none
        cut = np.zeros(n, bool)
        space, opens = own == 0x20, _OPENS[own]
        cut[1:-1] = space[1:-1] & opens[2:] & ~space[:-2]
        cut[2:] |= opens[2:] & (own[1:-1] == 0x0A) & _PLAIN[own[:-2]]
        cut[bounds[:-1][size > 0]] = True
        # the space of a word at a text's end, or a line feed in front of the next text, is no cut
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], n)
        text_of = np.searchsorted(bounds, start, "right") - 1
        h, rep, back = np.unique(span_hash(prefix_hash(own), start, stop), return_index=True, return_inverse=True)
        row = self.rows(h, own, start[rep], stop[rep])[back]
        bad = sum_by(text_of, texts, 1 - self.facts[row, 4]) > 0
        totals = np.stack([sum_by(text_of, texts, self.facts[row, k]) for k in range(4)], 1)
        totals[bad] = 0
        shown, at = list(map(self.shown.__getitem__, row.tolist())), np.searchsorted(text_of, np.arange(texts + 1)).tolist()
        digest = ["" if x or i == j else sha256(b";".join(shown[i:j])).hexdigest() for x, i, j in zip(bad.tolist(), at[:-1], at[1:], strict=True)]
        live = ~bad[text_of]
        row, text_of = row[live], text_of[live]
        count = self.facts[row, 3]
        codes = self.codes[spread(self.code_at[row], count)]
        key, times = np.unique(np.repeat(text_of, count) * (len(self.a_bytes) * self.width) + codes, return_counts=True)
        return totals, digest, *np.divmod(key, len(self.a_bytes) * self.width), times


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _links(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """row, id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct links of a text: pairs and times; staged."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = aligner(path_a, path_b)
        for rows, data, offs in slices(batches, 1):
            totals, digest, text, pair, times = m.texts(data, offs)
            at = pa.array(np.searchsorted(text, np.arange(len(offs))), pa.int32())
            cols = [rows.column(0), *(pa.array(totals[:, k]) for k in range(4)), pa.array(digest, pa.string()), pa.ListArray.from_arrays(at, pa.array(pair)), pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    made = rows.mapInArrow(links, f"id {docs.schema[id_col].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")
    return stage(made.withColumn("row", F.monotonically_increasing_id()), "links", "zstd")


def _flat(batch: pa.RecordBatch, pairs: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, times and offsets of two list columns without nulls."""
    offs = batch.column(pairs).offsets.to_numpy()
    return batch.column(pairs).flatten().to_numpy(), batch.column(times).flatten().to_numpy(), offs - offs[0]


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """pair, n, best: corpus-wide links of each pair, and whether no pair of the same token of b has more; staged."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pair, back = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pair, sum_by(back, len(pair), np.concatenate([n for _, n in held]))

        for batch in batches:
            held.append(_flat(batch, 0, 1)[:2])
            if sum(len(p) for p, _ in held[1:]) > 1 << 20:
                held[:] = [merged()]
            if len(held[0][0]) > 1 << 21:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["pair", "n"])
                held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["pair", "n"])
        give_back()

    counts = stage(links.select("pairs", "times").mapInArrow(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    other = F.col("pair") % width
    most = counts.groupBy(other.alias("b")).agg(F.max("n").alias("most"))
    return stage(counts.join(most, F.col("b") == other).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-bests")


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text.

    path_a is a byte-level BPE file, which encodes space + text; path_b is a merge-ranked model that puts the space there
    itself.  Groups lie between the byte offsets where tokens of both end; groups_sha256 is the digest of their decimal
    ids, `a1,a2|b1;a3|b2`.  A link is a pair of occurrences whose bytes overlap, its count that of its ids' links in all
    texts; n_best counts links of which none with the same id of b is more frequent (ties included).

    A text that is null, empty or not kept as it is (U+2581, which b takes for a space) has no tokens: zeros and ''.
    Null ids and repeated rows stay, each row of its own; other columns are left out.  Counts of frequent pairs, at most
    HEAVY by their share of all links, go to the tasks; rare pairs are joined.
    """
    spark = docs.sparkSession
    links = _links(docs, path_a, path_b, id_col, text_col)
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    counts = pair_counts(links, width)
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * HEAVY >= total
    heavy = counts.where(frequent).toPandas().sort_values("pair")
    known = spark.sparkContext.broadcast(tuple(heavy[c].to_numpy() for c in ("pair", "n", "best")))

    def looked_up(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table of frequent pairs, and which pairs stand there."""
        own = known.value[0]
        at = np.minimum(np.searchsorted(own, pair), max(len(own) - 1, 0))
        return at, own[at] == pair if len(own) else np.zeros(len(pair), bool)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, times, offs = _flat(batch, 1, 2)
            here = np.flatnonzero(~looked_up(pair)[1])
            row = np.repeat(batch.column(0).to_numpy(), np.diff(offs))
            yield pa.RecordBatch.from_arrays([pa.array(row[here]), pa.array(pair[here]), pa.array(times[here])], ["row", "pair", "times"])

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = known.value
        for batch in batches:
            pair, times, offs = _flat(batch, batch.num_columns - 2, batch.num_columns - 1)
            at, hit = looked_up(pair)
            text, at, times = np.repeat(np.arange(batch.num_rows), np.diff(offs))[hit], at[hit], times[hit]
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], text, times * best[at])
            np.add.at(sums[1], text, times * n[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *map(pa.array, sums)], [*batch.schema.names[:-2], "best_often", "sum_often"])

    found = links.select("row", "pairs", "times").mapInArrow(rare, "row long, pair long, times long")
    few = found.join(counts.where(~frequent), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_rare"), F.sum(F.col("times") * F.col("n")).alias("sum_rare"))
    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = {f.name: f.dataType.simpleString() for f in links.schema}
    scored = links.select(*names, "pairs", "times").mapInArrow(often, ", ".join(f"{c} {kinds[c]}" for c in names) + ", best_often long, sum_often long")
    both = scored.join(few, "row", "left")
    plus = lambda c: (F.col(f"{c}_often") + F.coalesce(f"{c}_rare", F.lit(0))).cast("long")
    return both.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", plus("best").alias("n_best"), plus("sum").alias("count_sum"), "groups_sha256")
