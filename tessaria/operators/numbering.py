"""Consecutive numbers in the order of a table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessaria.operators.components import kept

#: The bits of a row's place in its partition, in the numbers that Spark gives to rows.
_PLACE = (1 << 33) - 1


def gapless(df: DataFrame, order: list[Column | str], name: str = "row", first: int = 0) -> DataFrame:
    """df with ``name``, numbers from ``first`` without a gap in the given order; rows that tie in it have theirs in any order.

    Rows are dealt by ranges and sorted within them; a row's number is its place in
    its range and the sizes of the ranges before. The only sum over all ranges
    has a row per range. Ranges are written once, so that a row has the same number whoever reads it.
    """
    place = F.monotonically_increasing_id()
    ranged = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", place), "ranges")
    ranged = ranged.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit(_PLACE))})
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return ranged.join(F.broadcast(sizes.select("_range", "_before")), "_range").withColumn(name, F.col("_before") + F.col("_at") + first).drop("_range", "_at", "_before")
