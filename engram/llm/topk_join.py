"""Exact top-k inner products as a Voronoi kNN join.

Pivots cut queries and data into cells.  Summaries of the cells (counts by distance to the pivot,
radii and norms of the queries) give each query cell a score that its k best reach for certain;
a row goes to a group of query cells only if its bound can reach that score for one of them.  The rows
of a group are dealt out to tasks, each of which streams them past the group's queries, leaving
out cells that cannot reach a query's present k-th score.  The k best of each task are merged.

With x in the cell of pivot p at distance t, and q in the query cell of pivot o with radius R and largest norm N:
    o.p - R|p| - N t  <=  q.x  <=  o.p + R|p| + N t     and     q.x  <=  o.x + R|x|.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.arrays import give_back
from engram.llm.tables import small_batches, stage
from engram.llm.vectors import FIT, as_lists, padded_rows, stored

#: Rows (drawn by a hash of the id) that pivots are chosen from, and the most pivots.
SAMPLE, PIVOTS = 4096, 128
#: Queries of a group at most; a larger cell is split.
GROUP = 8192
#: Rows that a task streams, unless that takes more than TASKS tasks.
CHUNK, TASKS = 8192, 20_000
#: Relative slack of bounds computed with doubles.
SLACK = 1e-9
#: Edges of the counts by distance: eighths of powers of two.
FINE = 8.0


def choose_pivots(sample: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """Up to count pivots: means of the sample's vectors about distinct starting ones."""
    p = np.unique(sample, axis=0)
    p = p[np.random.default_rng(0).permutation(len(p))[:count]].astype(np.float64)
    for _ in range(rounds):
        near = (sample @ p.T - (p * p).sum(1) / 2).argmax(1)
        n = np.bincount(near, minlength=len(p))
        total = np.zeros_like(p)
        np.add.at(total, near, sample)
        p[n > 0] = total[n > 0] / n[n > 0, None]
    return p


def nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.float64)
    cell = (x @ pivots.T - (pivots * pivots).sum(1) / 2).argmax(1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


@dataclass(frozen=True)
class Plan:
    """pivots; for each query cell: radius, largest norm, certain score, first group, groups; chunks by group; reach: groups x cells."""

    pivots: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    sure: np.ndarray
    first_group: np.ndarray
    hands: np.ndarray
    chunks: np.ndarray
    #: By query cell and data cell: whether any row of the one may matter to the other.
    reach: np.ndarray

    @property
    def tasks(self) -> int:
        return int(self.chunks.sum())

    def wanted(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the groups that need them, by the bounds of the rows themselves."""
        x = x.astype(np.float64)
        bound = x @ self.pivots.T + np.sqrt((x * x).sum(1))[:, None] * self.radius
        bound += SLACK * (1 + np.abs(bound))
        need = (bound >= self.sure) & self.reach.T[cell] & (self.hands > 0)
        group = np.zeros((len(x), len(self.chunks)), bool)
        for j in np.flatnonzero(self.hands):
            group[:, self.first_group[j] : self.first_group[j] + self.hands[j]] |= need[:, j, None]
        return np.nonzero(group)


def make_plan(pivots: np.ndarray, queries: list[tuple[int, int, float, float]], counts: list[tuple[int, int, int]], k: int) -> Plan:
    """queries: cell, number, radius, largest norm; counts: data cell, distance bucket, rows."""
    m = len(pivots)
    number, radius, norm = np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
    for c, n, r, s in queries:
        number[c], radius[c], norm[c] = n, r, s
    c, b, n = (np.array(x) for x in zip(*counts, strict=True))
    far = np.exp2((b + 1) / FINE) - 1  # no row of the bucket lies farther from its pivot
    dots, size = pivots @ pivots.T, np.sqrt((pivots * pivots).sum(1))
    sure, reach = np.full(m, -np.inf), np.zeros((m, m), bool)
    radius, norm = radius * (1 + SLACK), norm * (1 + SLACK)
    for j in np.flatnonzero(number):
        low = dots[j, c] - radius[j] * size[c] - norm[j] * far
        by = np.argsort(-low)
        enough = np.flatnonzero(np.cumsum(n[by]) > k)  # one of them may be the query itself
        if len(enough):
            sure[j] = low[by[enough[0]]]
            sure[j] -= SLACK * (1 + abs(sure[j]))
        high = dots[j, c] + radius[j] * size[c] + norm[j] * far
        np.logical_or.at(reach[j], c, high + SLACK * (1 + np.abs(high)) >= sure[j])
    # near cells share a group, up to GROUP queries; a larger cell has groups of its own
    first, hands, held, group, left = np.zeros(m, np.int64), np.zeros(m, np.int64), 0, -1, set(np.flatnonzero(number).tolist())
    at = min(left, default=None)
    members: list[list[int]] = []
    while left:
        left.discard(at)
        hands[at] = -(-number[at] // GROUP)
        if hands[at] > 1 or group < 0 or held + number[at] > GROUP:
            first[at], group, held = group + 1, group + int(hands[at]), 0 if hands[at] == 1 else GROUP
            members += [[] for _ in range(int(hands[at]))]
        else:
            first[at] = group
        held += int(number[at])
        for g in range(int(hands[at])):
            members[first[at] + g].append(at)
        at = min(left, key=lambda x: (-dots[at, x] + dots[x, x] / 2, x), default=None)
    rows = np.bincount(c, n, m)
    most = np.array([rows[reach[js].any(0)].sum() for js in members])
    chunk = max(CHUNK, most.sum() / TASKS)
    return Plan(pivots, radius, norm, sure, first, hands, np.maximum(np.ceil(most / chunk), 1).astype(np.int64), reach)


class Best:
    """The k best rows so far of each of a block of queries; NONE where there are fewer."""

    NONE = -(1 << 62)

    def __init__(self, q: np.ndarray, ids: np.ndarray, pivots: np.ndarray, k: int):
        self.q, self.ids, self.k = q, ids, k
        self.norm = np.sqrt((q.astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
        self.dots = q @ pivots.T
        self.largest = int(np.abs(q).max(initial=0))
        self.score, self.id = np.full((len(q), k), self.NONE), np.zeros((len(q), k), np.int64)

    def add(self, x: np.ndarray, ids: np.ndarray, cell: int, far: float) -> int:
        """Rows of one cell, none farther than far from its pivot; returns how many products were made."""
        bound = self.dots[:, cell] + self.norm * far
        live = np.flatnonzero(bound + SLACK * (1 + np.abs(bound)) >= self.score[:, -1])
        by = np.argsort(ids, kind="stable")
        x, ids = x[by], ids[by]
        high = self.largest * int(np.abs(x).max(initial=0)) * x.shape[1]
        right = (x.astype(np.float64) if high < 1 << 53 else x).T  # doubles are exact so far
        n, take = len(x), min(self.k, len(x))
        for a in range(0, len(live), 256):
            own = live[a : a + 256]
            score = (self.q[own].astype(right.dtype) @ right).astype(np.int64)
            score[ids == self.ids[own, None]] = self.NONE  # a query is none of its own
            if high * n < 1 << 61:  # one number for score and place, of equal scores the smaller id first
                key = np.where(score == self.NONE, self.NONE, score * n + np.arange(n - 1, -1, -1))
                top = np.argpartition(key, n - take, axis=1)[:, n - take :]
            else:
                top = np.argsort(-score, axis=1, kind="stable")[:, :take]
            row = np.arange(len(own))[:, None]
            score, found = np.concatenate([self.score[own], score[row, top]], 1), np.concatenate([self.id[own], ids[top]], 1)
            by = np.lexsort((found, -score))[:, : self.k]
            self.score[own], self.id[own] = score[row, by], found[row, by]
        return len(live) * n


def _cells(df: DataFrame, pivots: np.ndarray, dim: int, scale: int, id_col: str, vector_col: str, name: str) -> DataFrame:
    """row, id, v, cell, dist, norm of the vectors that take part; staged."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, m = padded_rows(batch.column(1), dim)
            m = np.floor(m * scale)
            fine = (np.abs(m) < FIT).all(1)
            rows, m = rows[fine], m[fine].astype(np.int64)
            cell, dist = nearest_pivot(m, pivots)
            norm = np.sqrt((m.astype(np.float64) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), as_lists(m), pa.array(cell, pa.int32()), pa.array(dist), pa.array(norm)], ["id", "v", "cell", "dist", "norm"])

    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    made = rows.mapInArrow(assign, "id long, v array<int>, cell int, dist double, norm double")
    return stage(made.withColumn("row", F.monotonically_increasing_id()), name)


def _sample(base: DataFrame, scale: int, id_col: str, vector_col: str) -> tuple[np.ndarray, int, int]:
    """Scaled vectors of SAMPLE rows, the largest number of components, and the number of rows."""
    dim, n = base.agg(F.max(F.size(vector_col)), F.count(F.lit(1))).first()
    dim = max(dim or 0, 1)
    drawn = base.where(F.col(id_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(vector_col).cast("array<double>").alias("v")).orderBy("h").limit(SAMPLE).collect()
    _, m = padded_rows(pa.array([r["v"] for r in drawn], pa.list_(pa.float64())), dim)
    m = np.floor(m * scale)
    return m[(np.abs(m) < FIT).all(1)], dim, n


def join_plan(queries: DataFrame, base: DataFrame, k: int, scale: int, id_col: str, vector_col: str) -> tuple[Plan | None, DataFrame, DataFrame, int]:
    """The plan, and queries and base with their cells; no plan where one of them is empty."""
    sample, dim, n = _sample(base, scale, id_col, vector_col)
    pivots = choose_pivots(sample, min(PIVOTS, int(n**0.5) + 1)) if len(sample) else np.zeros((1, dim))
    q = _cells(queries, pivots, dim, scale, id_col, vector_col, "topk-queries")
    b = _cells(base, pivots, dim, scale, id_col, vector_col, "topk-base")
    bucket = F.floor(F.log2(F.col("dist") + 1) * FINE).cast("int")
    of = q.groupBy("cell").agg(F.count(F.lit(1)), F.max("dist"), F.max("norm")).collect()
    counts = b.groupBy("cell", bucket).agg(F.count(F.lit(1))).collect()
    return (make_plan(pivots, [tuple(r) for r in of], [tuple(r) for r in counts], k) if of and counts else None), q, b, dim


def topk_join(queries: DataFrame, base: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: of each query the k rows of base with the highest inner product (all, if fewer).

    Components x stand for floor(scale * x).  Ties go to the smaller id; rows with the query's own id are none of its
    rows, repeated rows of base count each, and each row of a repeated query id is a query.  Vectors that are null, or
    hold a null or non-finite component, take no part, nor do rows without id and components of 2**27 or more after
    scaling (scores might not fit in 64 bits).  A shorter vector ends in zeros.  Queries longer than all of base take
    no part.  Other columns are left out.
    """
    spark = base.sparkSession
    small_batches(spark)
    plan, q, b, dim = join_plan(queries, base, k, scale, id_col, vector_col)
    if plan is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    start = np.cumsum(plan.chunks) - plan.chunks
    pivots, cells = plan.pivots, len(plan.pivots)
    #: By group: in which order its tasks see the cells, the most promising first.
    place = np.zeros((len(plan.chunks), cells), np.int32)
    for j in np.flatnonzero(plan.hands):
        for g in range(plan.first_group[j], plan.first_group[j] + plan.hands[j]):
            place[g, np.argsort(-(pivots[j] @ pivots.T), kind="stable")] = np.arange(cells)
    schema = "task int, side int, place int, cell int, dist double, row long, id long, v array<int>"
    names = ["task", "side", "place", "cell", "dist", "row", "id", "v"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query, to all tasks of its group."""
        for batch in batches:
            row, cell = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            group = plan.first_group[cell] + row % plan.hands[cell]
            n = plan.chunks[group]
            for i in range(0, len(row), 512):
                own = np.repeat(np.arange(i, min(i + 512, len(row))), n[i : i + 512])
                task = start[group[own]] + np.arange(len(own)) - np.repeat(np.cumsum(n[i : i + 512]) - n[i : i + 512], n[i : i + 512])
                zero = pa.array(np.zeros(len(own), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), zero, zero, *(batch.column(c).take(pa.array(own)) for c in (3, 4, 0, 1, 2))], names)

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row of base, to one task of each group that needs it."""
        for batch in batches:
            x, row, cell = stored(batch.column(2), dim), batch.column(0).to_numpy(), batch.column(3).to_numpy()
            for i in range(0, len(x), 1024):
                own, group = plan.wanted(x[i : i + 1024], cell[i : i + 1024])
                own += i
                task = start[group] + row[own] % plan.chunks[group]
                yield pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), pa.array(np.ones(len(own), np.int32)), pa.array(place[group, cell[own]]), *(batch.column(c).take(pa.array(own)) for c in (3, 4, 0, 1, 2))], names)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries come first, then rows by cell; a cell is taken in pieces as they come."""
        rows, ids, vectors, best = [], [], [], None
        for batch in batches:
            side = batch.column(1).to_numpy()
            asked = int((side == 0).sum())
            x, own = stored(batch.column(7), dim), batch.column(6).to_numpy()
            if asked:
                rows.append(batch.column(5).to_numpy()[:asked])
                ids.append(own[:asked])
                vectors.append(x[:asked])
            if asked == len(x):
                continue
            if not rows:  # of a split cell, a group may have got no query
                return
            if best is None:
                best = Best(np.concatenate(vectors), np.concatenate(ids), pivots, k)
            cell, dist = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            cuts = np.flatnonzero(np.diff(cell[asked:], prepend=-1)) + asked
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(x)], strict=True):
                for a in range(i, j, 2048):
                    z = min(j, a + 2048)
                    best.add(x[a:z], own[a:z], int(cell[a]), float(dist[a:z].max()))
        if best is not None:
            at, r = np.nonzero(best.score > Best.NONE)
            row = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(best.ids[at]), pa.array(best.id[at, r]), pa.array(best.score[at, r])], ["row", "query_id", "id", "score"])
        give_back()

    sent = q.select("row", "id", "v", "cell", "dist").mapInArrow(ask, schema).unionByName(b.select("row", "id", "v", "cell", "dist").mapInArrow(offer, schema))
    solved = sent.repartitionById(plan.tasks, F.col("task")).sortWithinPartitions("side", "place", "dist").mapInArrow(solve, "row long, query_id long, id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    ranked = solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
