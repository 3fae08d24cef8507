"""Centroid clustering of integer vectors with partial-distance search.

Squared differences are summed over the dimensions of highest variance first, a few at a time; a
vector leaves a centroid as soon as its sum is strictly above the best distance it has, and only
survivors finish all dimensions.  Distances are integers, so the search gives the exact nearest
centroid.  A round is one pass over the rows, which gives sums by centroid and dimension from each
task; the driver holds the centroids and nothing that grows with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.arrays import give_back, sum_by
from engram.llm.tables import discard, small_batches, stage
from engram.llm.vectors import as_lists, stored, whole_numbers

#: Dimensions summed before a vector may leave a centroid.
STEP = 8
#: Vectors times centroids that are held against each other at once.
CELLS = 1 << 17


@dataclass(frozen=True)
class Centroids:
    """values: one row for each centroid; order: dimensions by falling variance; scale: components stand for x * scale."""

    values: np.ndarray
    order: np.ndarray
    scale: int
    #: Distance summed by cluster; None until it is measured.
    inertia: tuple[int, ...] | None = None

    @property
    def dim(self) -> int:
        return self.values.shape[1]

    def digests(self) -> list[str]:
        return [sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.values.tolist()]


def nearest(x: np.ndarray, model: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (ties: the smaller), squared distance, and how many differences were squared."""
    y, c = x[:, model.order], model.values[:, model.order]
    n, dim = y.shape
    head = ((y[:, None, :STEP] - c[None, :, :STEP]) ** 2).sum(2)
    # the centroid that is nearest in the first dimensions gives the first bound
    who = head.argmin(1)
    best = head[np.arange(n), who] + ((y[:, STEP:] - c[who, STEP:]) ** 2).sum(1)
    first, work = who.copy(), n * (len(c) * min(STEP, dim) + max(dim - STEP, 0))
    for j in range(len(c)):
        live = np.flatnonzero((first != j) & (head[:, j] <= best))
        part = head[live, j]
        for a in range(STEP, dim, STEP):
            work += len(live) * min(STEP, dim - a)
            part = part + ((y[live, a : a + STEP] - c[j, a : a + STEP]) ** 2).sum(1)
            stay = part <= best[live]
            live, part = live[stay], part[stay]
        better = (part < best[live]) | (j < who[live])
        live, part = live[better], part[better]
        best[live], who[live] = part, j
    return who, best, work


def _blocks(m: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    step = max(64, CELLS // max(k, 1))
    for a in range(0, len(m), step):
        yield a, m[a : a + step]


def _sums(kept: DataFrame, model: Centroids) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    dim, k = model.dim, len(model.values)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for _, x in _blocks(stored(batch.column(0), dim), k):
                who = nearest(x, model)[0]
                n += sum_by(who, k)
                by = np.argsort(who, kind="stable")
                own, at = np.unique(who[by], return_index=True)
                total[own] += np.add.reduceat(x[by], at, axis=0)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, dim)), pa.array(np.tile(np.arange(dim), len(own))), pa.array(np.repeat(n[own], dim)), pa.array(total[own].ravel())], ["cluster", "pos", "n", "total"])
        give_back()

    return sums


def _variance_order(kept: DataFrame, dim: int) -> np.ndarray:
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros((2, dim))
        for batch in batches:
            x = stored(batch.column(0), dim).astype(np.float64)
            n, s = n + len(x), s + np.stack([x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(np.full(dim, float(n))), *map(pa.array, s)], ["pos", "n", "s", "ss"])

    rows = kept.select("v").mapInArrow(moments, "pos long, n double, s double, ss double").groupBy("pos").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss"))).collect()
    spread_ = {r["pos"]: r["ss"] / r["n"] - (r["s"] / r["n"]) ** 2 if r["n"] else 0.0 for r in rows}
    return np.array(sorted(range(dim), key=lambda d: (-spread_.get(d, 0.0), d)), np.int64)


def fit_centroids(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> Centroids:
    """Centroids after so many rounds over all vectors of dim finite components.

    The first centroids are the vectors with the smallest hex sha256 of `seed:id` (ties: the smaller vector).  A round
    gives every vector to its nearest centroid and sets each centroid to floor(sum / count) of its vectors; one without
    vectors stays.  Rounds that would change nothing are left out.  A null id starts no centroid, repeated rows count
    each; with fewer vectors than k there are fewer centroids, and none without any.
    """
    small_batches(vectors.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, m = whole_numbers(batch.column(1), dim, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), as_lists(m)], ["id", "v"])

    rows = vectors.select(vectors[id_col].cast("string").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    kept = stage(rows.mapInArrow(keep, "id string, v array<int>"), "centroid-vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id")), 256)
    starts = kept.where(F.col("id").isNotNull()).select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
    model = Centroids(np.array([r["v"] for r in starts], np.int64).reshape(-1, dim), np.arange(dim), scale)
    if len(model.values):
        model = replace(model, order=_variance_order(kept, dim))
        for _ in range(rounds):
            made = kept.select("v").mapInArrow(_sums(kept, model), "cluster long, pos long, n long, total long").groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
            values = model.values.copy()
            for r in made:
                values[r["cluster"], r["pos"]] = r["total"] // r["n"]  # Python's // takes the floor
            if (values == model.values).all():
                break
            model = replace(model, values=values)
    discard(kept)
    return model


def _assigned(vectors: DataFrame, model: Centroids, id_col: str, vector_col: str, emit: Callable, schema: str) -> DataFrame:
    """emit(ids, clusters, distances) of each batch of vectors that take part."""
    dim, scale, k = model.dim, model.scale, len(model.values)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, m = whole_numbers(batch.column(1), dim, scale)
            who, distance = np.zeros(len(m), np.int64), np.zeros(len(m), np.int64)
            for a, x in _blocks(m, k):
                who[a : a + len(x)], distance[a : a + len(x)], _ = nearest(x, model)
            yield emit(batch.column(0).take(pa.array(rows)), who, distance)

    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    if not k:
        rows = rows.limit(0)
    return rows.mapInArrow(assign, schema)


def measure(vectors: DataFrame, model: Centroids, id_col: str = "vec_id", vector_col: str = "embedding") -> Centroids:
    """The model with the inertia of its clusters over these vectors."""
    k = len(model.values)

    def emit(_: pa.Array, who: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        total = np.zeros(k, np.int64)
        np.add.at(total, who, distance)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(total)], ["cluster", "total"])

    rows = _assigned(vectors, model, id_col, vector_col, emit, "cluster long, total long").groupBy("cluster").agg(F.sum("total").alias("total")).collect()
    total = {r["cluster"]: r["total"] for r in rows}
    return replace(model, inertia=tuple(total.get(j, 0) for j in range(k)))


def assign_centroids(vectors: DataFrame, model: Centroids, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance of every vector, and by its cluster cluster_inertia, inertia (of all), centroid_sha256.

    Vectors that are null, of another length, or with a null or non-finite component are left out, and so are those with
    a component of 2**27 or more after scaling, whose distances might not fit in 64 bits.  Null ids and repeated rows
    stay; other columns are left out.
    """
    if model.inertia is None:
        model = measure(vectors, model, id_col, vector_col)
    own, total, digest = np.array(model.inertia, np.int64), sum(model.inertia), np.array(model.digests(), object)

    def emit(ids: pa.Array, who: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(who, pa.int32()), pa.array(distance), pa.array(own[who]), pa.array(np.full(len(who), total, np.int64)), pa.array(digest[who], pa.string())], ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    schema = f"id {vectors.schema[id_col].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    return _assigned(vectors, model, id_col, vector_col, emit, schema).withColumnRenamed("id", id_col)
