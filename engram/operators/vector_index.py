"""Stored blocks of a memory's vectors: new vectors are linked with the cells they can reach, not with all.

A generation is a set of pivots and a folder of blocks by cell.  Each call that adds vectors appends a part to it;
a version of the memory names the generation, its pivots and its parts, so older versions stay as they are.
When the vectors are GROWTH times those the pivots were made for, or vectors are replaced, a new generation is written.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.vector import kind_of
from engram.operators import pivots as pv

GROWTH = 4
SCHEMA = "generation string, fitted bigint, held bigint, points array<array<double>>, parts array<string>"


@dataclass
class VectorIndex:
    """folder: where the generations are.  The other fields are the row that a version of the memory keeps."""

    spark: SparkSession
    folder: str
    generation: str = ""
    fitted: int = 0
    held: int = 0
    pivots: pv.Pivots = pv.Pivots(np.zeros((1, 0)))
    parts: tuple[str, ...] = ()

    @staticmethod
    def opened(spark: SparkSession, folder: str, row: DataFrame) -> VectorIndex:
        r = row.first()
        if r is None:
            return VectorIndex(spark, folder)
        return VectorIndex(spark, folder, r["generation"], r["fitted"], r["held"], pv.Pivots(np.array(r["points"], float).reshape(len(r["points"]), -1)), tuple(r["parts"]))

    def row(self) -> DataFrame:
        if not self.generation:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.createDataFrame([(self.generation, self.fitted, self.held, self.pivots.points.tolist(), list(self.parts))], SCHEMA)

    def _write(self, rows: DataFrame, mark: str | None) -> DataFrame:
        """A part of these rows, and its blocks as they are read again."""
        part = uuid.uuid4().hex
        blocks = pv.cell_blocks(rows, self.pivots, mark=mark)
        path = f"{self.folder}/{self.generation}/{part}"
        blocks.write.partitionBy("cell").parquet(path)
        self.parts = (*self.parts, part)
        return self._read(part, blocks)

    def _read(self, part: str, like: DataFrame) -> DataFrame:
        # numbers of blocks are those of a part; apart from each other by its place
        at = self.parts.index(part)
        return self.spark.read.schema(like.schema).parquet(f"{self.folder}/{self.generation}/{part}").withColumn("block", F.col("block") + F.lit(at).cast("long") * F.lit(1 << 52))

    def link(self, new: DataFrame, rest: DataFrame, threshold: float, mark: str | None = None, replaced: bool = False, report: pv.Report | None = None) -> DataFrame:
        """a, b, sim: pairs of new vectors, and of new and stored ones, from threshold on; the new ones are stored.

        new, rest: id, embedding and mark; rest are all vectors stored before, read only for a new generation.
        replaced: some of new were stored before (rest is without them).
        """
        n = new.where("embedding IS NOT NULL").count()
        old = self.parts
        if not self.generation or replaced or self.held + n > GROWTH * max(self.fitted, 1):
            total = n + rest.where("embedding IS NOT NULL").count()
            every = new.select("id", "embedding", *([mark] if mark else []))
            pivots = pv.fit_pivots(every.unionByName(rest.select(*every.columns)), rows=total)
            self.generation, self.fitted, self.held, self.pivots, self.parts = uuid.uuid4().hex, total, total, pivots, ()
            stored = [self._write(rest, mark)] if total > n else []
            mine = self._write(new, mark)
        else:
            self.held += n
            mine = self._write(new, mark)
            stored = [self._read(p, mine.withColumn("cell", F.col("cell").cast("int"))) for p in old]
        found = pv.join_cells(mine, mine, threshold, ordered=True, apart=mark is not None)
        if stored:
            base = stored[0]
            for x in stored[1:]:
                base = base.unionByName(x)
            found = found.unionByName(pv.join_cells(mine, base, threshold, apart=mark is not None, report=report))
        return found
