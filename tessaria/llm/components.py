"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessaria.llm.common import drop, keep


def _kept(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """Edges in the shared folder, their path, and a mark of their set that is gathered while they are written."""
    seen = Observation()
    marked = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a")).alias("y"))
    df, path = keep(marked, "edges")
    m = seen.get
    return df, path, (m["n"], m["x"], m["y"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest node next to it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node that has an edge, and the smallest node it is connected with, itself included.

    Edges are (a, b) in any direction, of any type that has an order; loops are ignored. Each round is a few
    shuffles of the edges, without collecting any, and its table is written to the
    shared folder; their number grows with the logarithm of the graph's size.
    """
    spark = edges.sparkSession
    now, path, mark = _kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        old, before = mark, path
        now, path, mark = _kept(_small_star(_large_star(now)))
        drop(spark, before)
        if mark == old:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
