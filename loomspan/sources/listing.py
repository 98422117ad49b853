"""Listings in a global order, written once, of which any page is one range read.

Rows are range-partitioned and sorted, and every partition is a folder; running counts of the
partitions, of which there are few, say where in the whole order each begins. A page reads the
partitions that its places lie in, one or two, and sorts the page alone.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIZE = 20
#: Orders of listings where none is asked for.
DEFAULTS = {
    "papers": [F.desc, "published", F.asc, "doc_id"],
    "chunks": [F.asc, "doc_id", F.asc, "chunk_index"],
    "runs": [F.desc, "started", F.desc, "run"],
    "queries": [F.asc, "item_id", F.asc, "mode"],
}


def default_order(kind: str) -> list[Column]:
    """The order of a listing of papers, chunks, runs or queries."""
    own = DEFAULTS[kind]
    return [f(c) for f, c in zip(own[::2], own[1::2])]


@dataclass(frozen=True)
class Listing:
    spark: SparkSession
    root: str
    n: int

    @classmethod
    def write(cls, df: DataFrame, order: list[Column], root: str) -> "Listing":
        """A listing of all rows; ``order`` should leave no ties, for these have no order of their own."""
        i = F.monotonically_increasing_id()  # the partition, then the row's number in it
        rows = df.orderBy(*order).withColumn("_i", i).withColumn("_part", F.shiftright("_i", 33)).withColumn("_i", F.col("_i").bitwiseAND((1 << 33) - 1))
        rows.write.mode("overwrite").partitionBy("_part").parquet(posixpath.join(root, "rows"))
        written = df.sparkSession.read.schema("_i long, _part long").parquet(posixpath.join(root, "rows"))
        counts = written.groupBy("_part").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
        counts.select(F.col("_part").alias("part"), "n", before.alias("before")).coalesce(1).write.mode("overwrite").parquet(posixpath.join(root, "starts"))
        return cls.open(df.sparkSession, root)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> "Listing":
        return cls(spark, root, sum(r.n for r in cls(spark, root, 0).starts().collect()))  # a row for each partition

    def starts(self) -> DataFrame:
        return self.spark.read.schema("part long, n long, before long").parquet(posixpath.join(self.root, "starts"))

    def rows(self, parts: list[int] | None = None) -> DataFrame:
        """Rows with their ``place`` from 1, of all partitions or of some."""
        rows = self.spark.read.option("basePath", posixpath.join(self.root, "rows")).parquet(posixpath.join(self.root, "rows"))
        rows = rows if parts is None else rows.where(F.col("_part").isin(parts))
        starts = F.broadcast(self.starts().select(F.col("part").alias("_part"), "before"))  # a row for each partition
        return rows.join(starts, "_part").withColumn("place", F.col("before") + F.col("_i") + 1).drop("_part", "_i", "before")

    def page(self, number: int, size: int = SIZE) -> DataFrame:
        """One page, from 1, in order; beyond the last one there is none."""
        first, last = (number - 1) * size + 1, number * size
        parts = [r.part for r in self.starts().where((F.col("before") < last) & (F.col("before") + F.col("n") >= first)).collect()]
        return self.rows(parts).where(F.col("place").between(first, last)).orderBy("place")
