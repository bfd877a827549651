"""Skewed joins and connected components, over tables of any size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaria.operators.index import shared_root

#: A key's rows are dealt into so many parts where the key may hold any share of the table.
SALTS = 1024


def join_spread(df: DataFrame, other: DataFrame, keys: list[str], by: Column, how: str = "inner") -> DataFrame:
    """df joined with ``other``, which has one row per key, where one key may hold any share of df's rows.

    df's rows are dealt by a hash of ``by``; ``other`` is first joined to the distinct (key, part) pairs, at most SALTS per key.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(by, F.lit(9)), F.lit(SALTS)))
    spots = dealt.select(*keys, "_part").distinct().join(other, keys)
    return dealt.join(spots, [*keys, "_part"], how).drop("_part")


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and nothing is computed twice."""
    path = f"{shared_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """node, class_id of every node that an edge (a, b) names; class_id is the smallest node that edges lead to.

    Each round hangs a node's neighbours on the smallest of them, and then every
    node on its parent's parent, until nothing changes: a few rounds for any
    shape, sums and minima alone, with no neighbourhood in one task.
    """
    pair = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to"))))
    links = kept(edges.where("a <> b").select(pair.alias("p")).select("p.*").distinct(), "edges")
    parent = kept(links.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("class_id")), "classes")
    while True:
        # The least class among the neighbours goes to the head of a node's own class, so that classes merge as wholes.
        near = links.join(parent.select(F.col("node").alias("to"), F.col("class_id").alias("theirs")), "to").groupBy("node").agg(F.min("theirs").alias("theirs"))
        offer = parent.join(near, "node").groupBy("class_id").agg(F.min("theirs").alias("best")).where("best < class_id")
        up = join_spread(parent, offer, ["class_id"], F.col("node"), "left").select("node", F.coalesce("best", "class_id").alias("class_id"))
        step = kept(up, "classes")
        top = step.select(F.col("node").alias("class_id"), F.col("class_id").alias("above"))
        step = kept(join_spread(step, top, ["class_id"], F.col("node"), "left").select("node", F.least("class_id", F.coalesce("above", "class_id")).alias("class_id")), "classes")
        if step.join(parent.withColumnRenamed("class_id", "before"), "node").where("class_id < before").isEmpty():
            return step
        parent = step
