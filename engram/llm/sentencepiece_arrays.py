"""SentencePiece encoding and decoding by suffix-array matching.

A batch of texts is cut into units no piece crosses (a word with the space before it, a control
character).  The distinct units, concatenated, are indexed by a suffix array that is sorted as
deep as the longest piece; a binary search finds the occurrence range of every piece at once;
the occurrences are the edges of a lattice.  The edges, sorted by where they end, are relaxed:
an edge is taken if its piece may follow the last piece of the prefix that ends where it starts.
For merge-ranked vocabularies exactly one edge ends each prefix, so the path is the library's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from engram.llm.arrays import U64, mix, prefix_hash, slices, span_hash, spread, sum_by

MARK, SPACE_BYTE = "▁".encode(), 0x20
#: Remembered answers of may_follow() in a worker: a direct-mapped table of this many places.
MEMO = 1 << 19
#: Units whose ids a worker remembers; it forgets all when there are more.
UNITS = 150_000
#: Bytes of new units that one suffix array indexes (a longer unit has its own): its edges take some hundred bytes a byte.
INDEX_BYTES = 128 << 10
FAR = np.iinfo(np.int64).max


class PieceModel:
    """Pieces, merge ranks and the tables that say which piece may follow which."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if sp.encode("a  b", out_type=str)[0][:1] != "▁" or sp.decode(sp.encode(" a  b ")) != " a  b ":
            raise ValueError("the model must put a space before a text and keep spaces as they are")
        self.size, self.unknown = n, n
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i) for i in plain}
        self.id = {t: i for i, t in text.items()}
        #: Bytes that each id stands for when decoded; control ids stand for nothing.
        self.bytes = [text[i].replace("▁", " ").encode() if i in text else b"" for i in range(n)]
        for b in range(256):
            self.bytes[self.byte_id[b]] = bytes([b])
        if any("▁" in t.lstrip("▁") or (t[:2] == "▁▁" and t.strip("▁")) for t in text.values()):
            raise ValueError("pieces may not cross words")
        #: Control bytes in no piece, such as a line feed: each is a unit, as nothing merges with it.
        self.control = np.zeros(256, bool)
        self.control[sorted(set(range(32)) - {ord(c) for t in text.values() for c in t})] = True
        self.score = {t: sp.get_score(i) for t, i in self.id.items()}
        order = sorted((i for i in plain if len(text[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        self.rank = np.full(n + 1, -1, np.int64)
        self.rank[order] = np.arange(len(order))
        self.left, self.right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        pair, made, usable = [], [], []
        for i in plain:
            t = text[i]
            if len(t) == 1:
                usable.append(i)
                continue
            for k in range(1, len(t)):
                a, b = self.id.get(t[:k]), self.id.get(t[k:])
                if a is not None and b is not None:
                    pair.append(a * n + b)
                    made.append(self.rank[i])
            if t.strip("▁") and (last := self._last_merge(t)):
                self.left[i], self.right[i] = last
                usable.append(i)
        by = np.argsort(pair)
        self.pair, self.made = np.array(pair, np.int64)[by], np.array(made, np.int64)[by]
        self.usable = np.array(usable, np.int64)
        lens = np.array([len(self.bytes[i]) for i in usable], np.int64)
        self.depth = 8
        while self.depth < lens.max():
            self.depth *= 2
        self.matrix = np.zeros((len(usable), self.depth), np.uint8)
        self.matrix[np.repeat(np.arange(len(usable)), lens), spread(np.zeros(len(usable), np.int64), lens)] = np.frombuffer(b"".join(self.bytes[i] for i in usable), np.uint8)
        self.lens = lens
        self.space = self.id["▁"]
        self.longest_run = max(len(t) for t in self.id if not t.strip("▁"))
        self.runs = [[self.id[x] for x in self.merge("▁" * m)] for m in range(2 * self.longest_run + 1)]
        self.unit_h, self.unit_at, self.unit_n, self.pool = np.zeros(0, U64), *(np.zeros(0, np.int64),) * 2, np.zeros(0, np.int32)
        self.memo_key, self.memo = np.full(MEMO, -1, np.int64), np.zeros(MEMO, bool)

    def merge(self, t: str) -> list[str]:
        """Merges one after the other, best score first, leftmost of equals; for building tables only."""
        parts = list(t)
        while len(parts) > 1:
            best = max(((self.score.get(a + b, -np.inf), -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(-np.inf, 0))
            if best[0] == -np.inf:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _last_merge(self, t: str) -> tuple[int, int] | None:
        """The two pieces that t is made of in the end; None if merging does not lead to t."""
        parts = list(t)
        while len(parts) > 2:
            k = -max((self.score.get(a + b, -np.inf), -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))[1]
            if parts[k] + parts[k + 1] not in self.score:
                return None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        ids = [self.id.get(p) for p in parts]
        return None if None in ids else (ids[0], ids[1])

    def space_run(self, m: int) -> list[int]:
        """Ids of m spaces that no word takes."""
        more = max(0, (m - self.longest_run) // self.longest_run)
        return self.runs[self.longest_run] * more + self.runs[m - more * self.longest_run]

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the texts of a and b together leaves just a and b."""
        out = (a < 0) | (a >= self.size) | (b >= self.size)
        todo = np.flatnonzero(~out)
        key = a[todo] * self.size + b[todo]
        at = (mix(key.astype(U64)) & U64(MEMO - 1)).astype(np.int64)
        hit = self.memo_key[at] == key
        out[todo[hit]] = self.memo[at[hit]]
        if not hit.all():
            new, back = np.unique(key[~hit], return_inverse=True)
            ok = self._walk(new // self.size, new % self.size)
            out[todo[~hit]] = ok[back]
            place = (mix(new.astype(U64)) & U64(MEMO - 1)).astype(np.int64)
            self.memo_key[place], self.memo[place] = new, ok
            # of several pairs at one place the last one written holds both arrays
        return out

    def _walk(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Undo the merges at the border of x and y, latest first; fail where x and y would have merged sooner.

        until: twice the rank of the undone merge, plus one if it lay to the right (of equal ranks the left goes first).
        """
        ok, live = np.ones(len(x), bool), np.arange(len(x))
        until = np.full(len(x), FAR)
        while len(live):
            k = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair, k), len(self.pair) - 1)
            bad = (self.pair[at] == k) & (2 * self.made[at] < until)
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            first = rx > ry
            go = ~bad & (first | (ry >= 0))
            until = np.where(first, 2 * rx, 2 * ry + 1)[go]
            x, y, live = np.where(first, self.right[x], x)[go], np.where(first, y, self.left[y])[go], live[go]
        return ok

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and id of every occurrence of every piece in data (units parted by byte 0)."""
        n = len(data)
        key = np.zeros(n, U64)
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U64)
        for j in range(8):
            key = (key << U64(8)) | padded[j : j + n]
        levels, depth = [], 8
        while True:
            sorted_keys, rank = np.unique(key, return_inverse=True)
            levels.append(sorted_keys)
            if depth >= self.depth:
                break
            after = np.zeros(n, np.int64)
            after[: max(n - depth, 0)] = rank[depth:] + 1
            key = rank * (len(sorted_keys) + 1) + after
            depth *= 2
        suffix = np.argsort(rank, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=len(levels[-1])))])
        low, high = self._range(levels, len(levels) - 1, self.matrix, self.lens)
        count = starts[high] - starts[low]
        some = np.flatnonzero(count > 0)
        start = suffix[spread(starts[low[some]], count[some])]
        return start, start + np.repeat(self.lens[some], count[some]), np.repeat(self.usable[some], count[some])

    def _range(self, levels: list[np.ndarray], level: int, m: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks at a level, from low to below high, of the suffixes that start with each piece."""
        if level == 0:
            value = np.zeros(len(m), U64)
            for j in range(8):
                value = (value << U64(8)) | m[:, j].astype(U64)
            beyond = value + (U64(1) << (U64(64) - U64(8) * np.clip(lens, 1, 8).astype(U64)))
            return np.searchsorted(levels[0], value), np.searchsorted(levels[0], beyond)
        half, below = 4 << level, len(levels[level - 1]) + 1
        low, high = np.zeros(len(m), np.int64), np.zeros(len(m), np.int64)
        s = np.flatnonzero(lens <= half)
        a, b = self._range(levels, level - 1, m[s, :half], lens[s])
        low[s], high[s] = np.searchsorted(levels[level], a * below), np.searchsorted(levels[level], b * below)
        s = np.flatnonzero(lens > half)
        if len(s):
            a, b = self._range(levels, level - 1, m[s, :half], np.full(len(s), half))
            c, d = self._range(levels, level - 1, m[s, half:], lens[s] - half)
            low[s] = np.searchsorted(levels[level], a * below + c + 1)
            high[s] = np.where(b > a, np.searchsorted(levels[level], a * below + d + 1), low[s])
        return low, np.maximum(low, high)

    def encode_units(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units data[start:end] (each followed by byte 0), one after the other, and their counts."""
        s, e, piece = self.edges(data)
        lead = (data & 0xC0) != 0x80
        chars = np.flatnonzero(lead & (data != 0))
        after = np.append(np.flatnonzero(lead), len(data))
        char_end = after[np.searchsorted(after, chars, "right")]
        known = np.zeros(len(data), bool)
        one = self.rank[piece] < 0
        known[s[one]] = True
        lost = ~known[chars]  # no piece has this character: its bytes stand for it
        s, e = np.concatenate([s, chars[lost]]), np.concatenate([e, char_end[lost]])
        piece = np.concatenate([piece, np.full(int(lost.sum()), self.unknown)])
        base = np.repeat(start, end + 1 - start)  # of the unit at each byte, its byte 0 included
        reach = e - base[s]
        by = np.lexsort((s, e, reach)) if len(s) and reach.max() >= 65536 else self._order(s, e, reach)
        s, e, piece, reach = s[by], e[by], piece[by], reach[by]
        last, back = np.full(len(data) + 1, -2, np.int64), np.zeros(len(data) + 1, np.int64)
        last[start] = -1
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(reach)) + 1, [len(reach)]]) if len(reach) else np.zeros(1, np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            # edges of one place stand together, the longest first; the first that may follow is the one
            ends = e[a:b]
            at = np.flatnonzero(np.diff(ends, prepend=-1)) + a
            stop = np.append(at[1:], b)
            while len(at):
                ok = (last[s[at]] > -2) & self.may_follow(last[s[at]], piece[at])
                took = at[ok]
                last[e[took]], back[e[took]] = piece[took], s[took]
                at, stop = at[~ok] + 1, stop[~ok]
                more = at < stop
                at, stop = at[more], stop[more]
        unit, cur, got, of, turn = np.arange(len(start)), end.copy(), [], [], 0
        steps = []
        while len(unit):
            got.append(np.stack([last[cur], back[cur], cur]))
            of.append(unit)
            steps.append(np.full(len(unit), turn))
            cur = back[cur]
            going = cur > start[unit]
            unit, cur, turn = unit[going], cur[going], turn + 1
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, frm, to = np.concatenate(got, 1)
        of_all, step = np.concatenate(of), np.concatenate(steps)
        by = np.lexsort((-step, of_all))
        ids, frm, to, of_all = ids[by], frm[by], to[by], of_all[by]
        wide = np.where(ids == self.unknown, to - frm, 1)
        flat = np.repeat(ids, wide)
        raw = np.flatnonzero(flat == self.unknown)
        flat[raw] = self.byte_id[data[spread(frm, wide)[raw]]]
        return flat, sum_by(np.repeat(of_all, wide), len(start))

    @staticmethod
    def _order(s: np.ndarray, e: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """By reach, then end, then start: stable radix sorts of small numbers after one sort of places."""
        by = np.argsort(e * 65536 + (65535 - (e - s)))
        by = by[np.argsort(reach[by].astype(np.uint16), kind="stable")]
        return by

    def _known(self, h: np.ndarray, own: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it the ids of each distinct unit (sorted hashes h) stand; units met before are looked up."""
        if len(self.unit_h) > UNITS:
            self.unit_h, self.unit_at, self.unit_n, self.pool = h[:0], start[:0], start[:0], self.pool[:0].copy()
        at = np.searchsorted(self.unit_h, h)
        new = np.ones(len(h), bool)
        inside = np.flatnonzero(at < len(self.unit_h))
        new[inside] = self.unit_h[at[inside]] != h[inside]
        s, lens = start[new], (stop - start)[new]
        nul = own[s] == 0
        total = np.cumsum(lens + 1)
        parts, a = [], 0
        while a < len(s):
            b = max(a + 1, int(np.searchsorted(total, total[a] - lens[a] + INDEX_BYTES)))
            n = lens[a:b]
            u = np.cumsum(n + 1) - (n + 1)
            # NUL parts the units, so a NUL of the text is encoded as its byte beside them
            buf = np.zeros(int(n.sum()) + len(n), np.uint8)
            buf[spread(u, n)] = own[spread(s[a:b], n)]
            buf[u[nul[a:b]]] = 1
            parts.append(self.encode_units(buf, u, u + n))
            a = b
        ids, count = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else ((), ())))
        first = np.cumsum(count) - count
        ids[first[nul]] = self.byte_id[0]
        ids = ids.astype(np.int32)
        self.unit_h = np.insert(self.unit_h, at[new], h[new])
        self.unit_at = np.insert(self.unit_at, at[new], first + len(self.pool))
        self.unit_n = np.insert(self.unit_n, at[new], count)
        self.pool = np.concatenate([self.pool, ids])
        at = np.searchsorted(self.unit_h, h)
        return self.pool, self.unit_at[at], self.unit_n[at]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after the other, and their counts."""
        texts = len(offs) - 1
        if MARK in data.tobytes():
            parts = [data[a:b].tobytes().replace(MARK, b" ") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            data = np.frombuffer(b"".join(parts), np.uint8)
        size = np.diff(offs)
        size = size + (size > 0)  # a space goes before a text that isn't empty
        at = np.concatenate([[0], np.cumsum(size)])
        own = np.full(at[-1], SPACE_BYTE, np.uint8)
        first = at[:-1][size > 0]
        inner = np.ones(at[-1], bool)
        inner[first] = False
        own[inner] = data
        n = len(own)
        if not n:
            return np.zeros(0, np.int32), np.zeros(texts, np.int64)
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        control, space = self.control[own], own == SPACE_BYTE
        prev_plain = np.zeros(n, bool)
        prev_plain[1:] = ~control[:-1] & ~space[:-1]
        prev_plain &= ~cut[:-1]
        next_word = np.zeros(n, bool)
        next_word[:-1] = ~control[1:] & ~space[1:] & ~cut[1:-1]
        head = space & next_word  # a space that its word may take
        after_space = np.zeros(n, bool)
        after_space[1:] = head[:-1]
        word = ~control & ~space
        start = np.flatnonzero(control | head | (word & ~prev_plain & ~after_space))
        lone = np.flatnonzero(space & ~head)
        stop = np.where(control[start], start + 1, 0)
        brk = np.append(np.flatnonzero(control | space | cut[:-1]), n)
        open_ = np.flatnonzero(stop == 0)
        stop[open_] = brk[np.searchsorted(brk, start[open_], "right")]
        text_of = np.searchsorted(at, start, "right") - 1
        # spaces alone: each belongs to the next unit of its text, or to the text's end
        nxt = np.searchsorted(start, lone)
        lone_text = np.searchsorted(at, lone, "right") - 1
        inside = nxt < len(start)
        inside[inside] = text_of[nxt[inside]] == lone_text[inside]
        before = sum_by(nxt[inside], len(start))
        trailing = sum_by(lone_text[~inside], texts)

        h, rep, back = np.unique(span_hash(prefix_hash(own), start, stop), return_index=True, return_inverse=True)
        ids, u_at, count = self._known(h, own, start[rep], stop[rep])

        # a bare space before characters that no piece joins belongs to the spaces before it
        bare = (before > 0) & head[start] & (ids[u_at[back]] == self.space)
        m = before + bare
        frm, cnt = u_at[back] + bare, count[back] - bare
        out_count = sum_by(text_of, texts, cnt)
        if not m.any() and not trailing.any():
            return ids[spread(frm, cnt)], out_count
        runs, which = np.unique(np.concatenate([m, trailing]), return_inverse=True)
        table = [self.space_run(int(r)) for r in runs]
        t_count = np.array([len(t) for t in table], np.int64)
        t_at = np.cumsum(t_count) - t_count + len(ids)
        pool = np.concatenate([ids, np.array([i for t in table for i in t], np.int32)])
        w_m, w_t = which[: len(m)], which[len(m) :]
        # order: spaces, unit, spaces, unit, ..., then a text's trailing spaces
        n_u = len(start)
        frm_all = np.concatenate([np.stack([t_at[w_m], frm], 1).ravel(), t_at[w_t]])
        cnt_all = np.concatenate([np.stack([t_count[w_m], cnt], 1).ravel(), t_count[w_t]])
        pos = np.concatenate([np.repeat(text_of, 2), np.arange(texts)])
        by = np.lexsort((np.concatenate([np.arange(2 * n_u), np.full(texts, 2 * n_u)]), pos))
        return pool[spread(frm_all[by], cnt_all[by])], sum_by(pos, texts, cnt_all)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, without the space put before it; bytes that aren't UTF-8 give U+FFFD."""
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """id, n_pieces, piece_ids (array of int; left out unless keep_ids), pieces_sha256, round_trip of every whole text.

    pieces_sha256 is the hex digest of the ids as 32-bit little-endian numbers.  round_trip says whether
    decoding gives the text back; it does unless the text holds U+2581, which stands for a space.
    A null or empty text has no ids.  Null ids and repeated rows stay; other columns are left out.
    model is the path of a merge-ranked model file that every executor can read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for rows, data, offs in slices(batches, 1):
            ids, count = m.encode(data, offs)
            small, bounds = ids.astype("<i4"), np.concatenate([[0], np.cumsum(count)])
            digest, same = [], []
            raw = data.tobytes()
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                digest.append(sha256(small[a:b].tobytes()).hexdigest())
                same.append(m.decode(ids[a:b]) == raw[offs[k] : offs[k + 1]].decode("utf-8"))
            cols = [rows.column(0), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())]
            names = ["id", "n_pieces", "pieces_sha256", "round_trip"]
            if keep_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(small, pa.int32())))
                names.append("piece_ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = f"id {id_type}, n_pieces long, pieces_sha256 string, round_trip boolean" + ", piece_ids array<int>" * keep_ids
    return rows.mapInArrow(encode, schema).withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, model: str, ids_col: str = "piece_ids", text_col: str = "text") -> DataFrame:
    """The columns of encoded and the text of its ids (in a column that must not be there yet); a null array gives a null text."""
    if text_col in encoded.columns:
        raise ValueError(f"there is a column {text_col} already")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    at = encoded.columns.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for batch in batches:
            text = [None if x is None else m.decode(np.array(x, np.int64)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, text_col])

    return encoded.mapInArrow(decode, f"{fields}, `{text_col}` string")
