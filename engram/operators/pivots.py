"""Exact similarity joins that leave out what cannot match: vectors in cells about pivots, blocks with radii.

A vector belongs to the cell of its nearest pivot, and a block holds vectors of one cell.  Unit vectors of two
blocks with centres c, d and radii r, s are at least |c - d| - r - s apart, which bounds their cosine from
above; a pair of blocks is multiplied only if that bound reaches the threshold, or the k-th score that the
queries of the block are sure of.  Cells are held against each other first, on the driver (their number is bounded),
then the blocks of reachable cells, without their vectors; the vectors are fetched for the pairs that are left.
With too few vectors for two cells all blocks meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.functions import vector
from engram.functions.vector import best_of_blocks, block_schema, join_blocks, kinds_of, matrix, packed_rows, ranked, side, vector_rows
from engram.operators.cuts import stored

#: Vectors (drawn by a hash of the id) that pivots are made from, and the most pivots.
SAMPLE, MOST = 8192, 512
#: Blocks of base that a block of queries meets first, for the scores that it is sure of.
SEEDS = 2
#: Tiles of a side, and blocks of a side in a tile, when blocks are fetched.
SIDES, TILE = 8, 64
#: Slack of bounds computed with doubles, and of cosines rounded to six places.
SLACK = 1e-6


@dataclass(frozen=True)
class Pivots:
    points: np.ndarray

    def cell(self, m: np.ndarray) -> np.ndarray:
        if len(self.points) < 2:
            return np.zeros(len(m), np.int32)
        return (m @ self.points.T - (self.points**2).sum(1) / 2).argmax(1).astype(np.int32)


def fit_pivots(df: DataFrame, id_col: str = "id", vector_col: str = "embedding", rows: int | None = None, rounds: int = 4) -> Pivots:
    """One pivot for each full block of rows, MOST at most: means of a bounded sample about distinct starting vectors."""
    want = min(MOST, (df.count() if rows is None else rows) // vector.BLOCK)
    if want < 2:
        return Pivots(np.zeros((1, 0)))
    drawn = df.where(F.col(vector_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(vector_col).cast("array<double>").alias("v")).orderBy("h").limit(SAMPLE).collect()
    m = matrix(pa.array([r["v"] for r in drawn], pa.list_(pa.float64())))
    p = np.unique(m, axis=0)
    p = p[np.random.default_rng(0).permutation(len(p))[:want]]
    for _ in range(rounds):
        near = Pivots(p).cell(m)
        n, total = np.bincount(near, minlength=len(p)), np.zeros_like(p)
        np.add.at(total, near, m)
        p = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], p)
    return Pivots(p)


def cell_blocks(df: DataFrame, pivots: Pivots, id_col: str = "id", vector_col: str = "embedding", mark: str | None = None) -> DataFrame:
    """block (a number), and the columns of blocks(): packed by cell, nearest to the pivot first."""
    rows, id_kind, part_kind, mark_kind = vector_rows(df, id_col, vector_col, None, mark)
    if len(pivots.points) < 2:
        rows = rows.withColumns({"cell": F.lit(0), "far": F.lit(0.0)})
    else:

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = matrix(batch.column(3))
                cell = pivots.cell(m)
                far = np.sqrt(((m - pivots.points[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], [*batch.schema.names, "cell", "far"])

        rows = rows.mapInArrow(assign, f"id {id_kind}, part {part_kind}, mark {mark_kind}, v array<double>, cell int, far double")
        # a cell of many blocks is dealt to several tasks, by distance so that their blocks stay small
        large = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (vector.DEAL * vector.BLOCK)).alias("hands"))
        rows = rows.join(large, "cell").repartition("cell", F.pmod(F.xxhash64("id"), F.col("hands"))).sortWithinPartitions("cell", "far")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = batch.column(4).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
                cuts = [x for a, b in zip(edges, edges[1:]) for x in range(a, b, vector.BLOCK)] + [len(cell)]
                yield packed_rows(*(batch.column(c) for c in range(3)), matrix(batch.column(3)), cell, cuts)

    packed = rows.select("id", "part", "mark", "v", "cell").mapInArrow(pack, block_schema(id_kind, part_kind, mark_kind))
    return packed.withColumn("block", F.monotonically_increasing_id())


@dataclass
class Report:
    """What a join multiplied: pairs of blocks, of all that there are; and the vectors of the right side in cells that it read."""

    pairs: int = 0
    all: int = 0
    read: int = 0

    @property
    def share(self) -> float:
        return self.pairs / self.all if self.all else 0.0


def _spans(b: DataFrame) -> DataFrame:
    return b.select("block", "cell", "centre", "radius", F.size("ids").alias("n"))


def cell_spans(b: DataFrame) -> list[tuple[int, np.ndarray, float]]:
    """cell, centre, radius of the cells that blocks are in: a ball about the mean centre that holds all of a cell's blocks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for cell, centre, radius in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(cell, []).append((np.frombuffer(centre), radius))
                if len(held[cell]) > 64:
                    held[cell] = [_ball(held[cell])]
        balls = [(c, *_ball(x)) for c, x in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, *_ in balls], pa.int32()), pa.array([p.tobytes() for _, p, _ in balls], pa.binary()), pa.array([r for *_, r in balls], pa.float64())], ["cell", "centre", "radius"])

    parts: dict[int, list] = {}
    for r in b.select("cell", "centre", "radius").coalesce(64).mapInArrow(partial, "cell int, centre binary, radius double").collect():
        parts.setdefault(r["cell"], []).append((np.frombuffer(r["centre"]), r["radius"]))
    return [(c, *_ball(x)) for c, x in sorted(parts.items())]


def _ball(balls: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, float]:
    c = np.mean([p for p, _ in balls], axis=0)
    return c, max(float(np.sqrt(((p - c) ** 2).sum())) + r for p, r in balls)


def cosine_bound(c: np.ndarray, r: np.ndarray, d: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The largest cosine that vectors within r of c and s of d can have (norms are 1, or less where EPSILON counts)."""
    gap = np.maximum(np.sqrt(((c - d) ** 2).sum(-1)) - r - s, 0)
    return 1 - gap * gap / 2 + SLACK


def reachable_cells(left: list, right: list, threshold: float) -> list[tuple[int, int]]:
    out = []
    for c, p, r in left:
        bound = cosine_bound(p, r, np.array([x[1] for x in right]), np.array([x[2] for x in right])) if right else []
        out += [(c, right[j][0]) for j in np.flatnonzero(np.asarray(bound) >= threshold)]
    return out


def bounded_pairs(left: DataFrame, right: DataFrame, threshold: float, near: list[tuple[int, int]] | None = None) -> DataFrame:
    """la, lb, bound, n: pairs of blocks whose bound reaches the threshold; near: the cells that may meet."""
    spark: SparkSession = left.sparkSession
    near = reachable_cells(cell_spans(left), cell_spans(right), threshold) if near is None else near
    reach = spark.createDataFrame(near, "ca int, cb int")
    a = _spans(left).selectExpr("block AS la", "cell AS ca", "centre AS pa", "radius AS ra", "n AS na")
    b = _spans(right).selectExpr("block AS lb", "cell AS cb", "centre AS pb", "radius AS rb", "n AS nb")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist())).reshape(batch.num_rows, -1) for c in (2, 3))
            top = cosine_bound(p, batch.column(4).to_numpy(), q, batch.column(5).to_numpy())
            keep = np.flatnonzero(top >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(top[keep]), batch.column(6).take(pa.array(keep))], ["la", "lb", "bound", "n"])

    both = a.join(reach, "ca").join(b, "cb").select("la", "lb", "pa", "pb", "ra", "rb", F.col("nb").alias("n"))
    return both.mapInArrow(bound, "la long, lb long, bound double, n int")


def fetched(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b: the blocks of pairs (la, lb).

    Pairs lie in a grid of SIDES by SIDES tiles, more if a tile would hold over TILE blocks of a side.  A block goes once to
    each tile that it is needed in, not once to each pair: what is shuffled grows with the blocks, not with their square.
    """
    n = max(SIDES, -(-max(left.count(), right.count()) // TILE))
    tile = lambda c: F.pmod(F.xxhash64(c), F.lit(n))
    a, b = side(left, "a", F.col("block").alias("la")), side(right, "b", F.col("block").alias("lb"))
    at = pairs.select("la", "lb", tile("la").alias("i"), tile("lb").alias("j"))
    rows = at.groupBy("la", "i", "j").agg(F.collect_set("lb").alias("lbs")).join(a, "la")
    columns = at.select("lb", "i", "j").distinct().join(b, "lb")
    return rows.join(columns, ["i", "j"]).where(F.array_contains("lbs", F.col("lb"))).select("a", "b")


def join_cells(left: DataFrame, right: DataFrame, threshold: float, ids: tuple[str, str] = ("a", "b"), ordered: bool = False, apart: bool = False, report: Report | None = None) -> DataFrame:
    """What vector_join() gives of the same vectors, from stored cell_blocks(): a self join if left is right.

    Of blocks that are stored by cell only those of cells in reach are read.
    """
    near = reachable_cells(cell_spans(left), cell_spans(right), threshold)
    itself = left is right
    if report is not None:
        report.all = left.count() * right.count()
    right = right.where(F.col("cell").isin(sorted({b for _, b in near})))
    left = right if itself else left.where(F.col("cell").isin(sorted({a for a, _ in near})))
    pairs = bounded_pairs(left, right, threshold, near)
    if itself and ordered:  # each pair of blocks once, then the ids of a pair in order
        pairs = pairs.where("la <= lb")
    if report is not None:
        report.pairs, report.read = pairs.count(), right.selectExpr("coalesce(sum(size(ids)), 0)").first()[0]
        if itself and ordered:
            n = int(report.all**0.5)
            report.all = n * (n + 1) // 2
    kinds = kinds_of(left, right)
    if not (itself and ordered):
        return join_blocks(fetched(pairs, left, right), kinds, threshold, ids, ordered=ordered, apart=apart)
    alone = join_blocks(fetched(pairs.where("la = lb"), left, right), kinds, threshold, ids, ordered=True, apart=apart)
    two = join_blocks(fetched(pairs.where("la < lb"), left, right), kinds, threshold, ids, apart=apart).where(F.col(ids[0]) != F.col(ids[1]))
    return alone.unionByName(two.select(F.least(*ids).alias(ids[0]), F.greatest(*ids).alias(ids[1]), "sim"))


def similar_pairs(nodes: DataFrame, threshold: float, id_col: str = "id", others: DataFrame | None = None, mark: str | None = None, report: Report | None = None) -> DataFrame:
    """a, b, sim of pairs of nodes (a < b), or of nodes and others, whose cosine reaches the threshold; mark: only of different marks."""
    base = nodes if others is None else others
    pivots = fit_pivots(base, id_col)
    if len(pivots.points) < 2:  # one cell: nothing to prune
        a = vector.blocks(nodes, id_col, "embedding", mark=mark)
        return vector.vector_join(a, a if others is None else vector.blocks(others, id_col, "embedding", mark=mark), threshold, ordered=others is None, apart=mark is not None)
    a = stored(cell_blocks(nodes, pivots, id_col, mark=mark), "blocks")
    b = a if others is None else stored(cell_blocks(others, pivots, id_col, mark=mark), "blocks")
    return join_cells(a, b, threshold, ordered=others is None, apart=mark is not None, report=report)


def topk_cells(queries: DataFrame, base: DataFrame, k: int, exclude_self: bool = False, report: Report | None = None) -> DataFrame:
    """query_id, id, rank, score: the k nearest of base for each query, from stored cell_blocks() of both.

    Each block of queries meets its SEEDS most promising blocks first; of the others only those whose bound reaches the
    least k-th score in the block.
    """
    pairs = bounded_pairs(queries, base, -2.0)
    first = Window.partitionBy("la").orderBy(F.desc("bound"), "lb")
    pairs = stored(pairs.withColumn("at", F.row_number().over(first)), "pairs")
    kinds = kinds_of(queries, base)
    seeds = stored(best_of_blocks(fetched(pairs.where(F.col("at") <= SEEDS), queries, base), kinds, k, exclude_self), "seeds")
    sure = ranked(seeds, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("sure"))
    own = queries.select(F.col("block").alias("la"), F.explode("ids").alias("query_id"))
    sure = own.join(sure, "query_id", "left").groupBy("la").agg(F.min(F.coalesce("sure", F.lit(-2.0))).alias("sure"))
    rest = pairs.where(F.col("at") > SEEDS).join(sure, "la").where(F.col("bound") >= F.col("sure")).select("la", "lb")
    if report is not None:
        rest = stored(rest, "pairs")
        report.pairs, report.all = rest.count() + pairs.where(F.col("at") <= SEEDS).count(), queries.count() * base.count()
    return ranked(seeds.unionByName(best_of_blocks(fetched(rest, queries, base), kinds, k, exclude_self)), k)


def nearest(queries: DataFrame, nodes: DataFrame, k: int, exclude_self: bool = False, report: Report | None = None) -> DataFrame:
    """query_id, id, rank, score: the k nodes most similar to each of queries (query_id, embedding), ties by id."""
    n = nodes.count()
    pivots = fit_pivots(nodes, rows=n)
    if len(pivots.points) < 2:  # one cell: nothing to prune
        return vector.vector_topk(vector.blocks(queries, "query_id", "embedding"), vector.blocks(nodes, "id", "embedding"), k, exclude_self)
    q, b = stored(cell_blocks(queries, pivots, "query_id"), "blocks"), stored(cell_blocks(nodes, pivots), "blocks")
    return topk_cells(q, b, k, exclude_self, report)
