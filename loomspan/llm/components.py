"""Connected components by alternating large and small stars, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.shared import shuffled, table


def _star(edges: DataFrame) -> DataFrame:
    """Joins every node's neighbours to the smallest of them and itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(shuffled(least), "u")


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every node of the edges (a, b); the smallest id names it.

    Each round links neighbours to their minima, first among larger neighbours, then
    among smaller ones; the number of rounds is logarithmic in practice. Minima are
    partial aggregates and their join is one that Spark can split, so a node with very
    many neighbours is no single task. The edges of each round are written, which cuts
    the lineage.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = table(edges, "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        starred = _star(large)
        small = starred.select("u", F.col("m").alias("v")).unionByName(starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = table(small.distinct(), "edges")
        if edges.join(shuffled(edges.select(F.col("v").alias("u"))), "u", "left_semi").isEmpty():
            break  # no node is both a leaf and a centre: each component is one star
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
