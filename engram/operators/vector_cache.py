"""Vectors by content: each distinct text is encoded once over all calls that share a folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, embedding array<double>"


@dataclass(frozen=True)
class VectorCache:
    """folder: where the vectors of this model are kept; embed: its column function; model: its name, part of the key.

    Every call appends one set of files, and only when it is whole; two calls at a time may both encode a text, which is
    then kept twice and read once.
    """

    spark: SparkSession
    folder: str
    embed: Callable[[Column], Column]
    model: str = ""

    def stored(self) -> DataFrame:
        """key, embedding: all that has been encoded so far."""
        path = f"{self.folder}/vectors"
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(path).dropDuplicates(["key"])

    def key(self, text: Column) -> Column:
        return F.sha2(F.concat(F.lit(f"{self.model}\n"), text), 256)

    def fill(self, df: DataFrame, text: str) -> None:
        """Encode the texts of a column that are not stored yet; nulls are not encoded."""
        texts = df.where(F.col(text).isNotNull()).select(self.key(F.col(text)).alias("key"), F.col(text).alias("text"))
        # the texts themselves cross the network once each, and only those that are missing
        new = texts.join(self.stored().select("key"), "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))
        new.select("key", self.embed(F.col("text")).cast("array<double>").alias("embedding")).write.mode("append").parquet(f"{self.folder}/vectors")

    def vectors(self, df: DataFrame, text: str) -> DataFrame:
        """df with the vector of each text in place of the text; a null text has none."""
        self.fill(df, text)
        keyed = df.withColumn(text, self.key(F.col(text)))
        return keyed.join(self.stored().select(F.col("key").alias(text), F.col("embedding").alias("_vector")), text, "left").withColumn(text, F.col("_vector")).select(*df.columns)

    def compact(self, files: int) -> None:
        """The stored vectors in so many files of a new folder, which takes the place of the old one; if it fails between, texts are encoded anew."""
        new = f"{self.folder}/compacted"
        self.stored().repartition(files, "key").write.mode("overwrite").parquet(new)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        old, at = path(f"{self.folder}/vectors"), path(new)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(old, True)
        fs.rename(at, old)
