"""Approximate aggregates that are stored by day and merged for any range: distinct counts and most frequent values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Registers are 2^PRECISION: the relative standard error of a distinct count is about 1.04 / sqrt(2^PRECISION). Values whose counts a sketch follows.
PRECISION, TRACKED = 12, 10_000


@dataclass
class SketchStore:
    """A table of sketches: day, the columns ``by``, bucket, n, distinct (a sketch), frequent (a sketch). Days are folders, of which a query reads its range's.

    Values are dealt to ``buckets`` by their hash, with a sketch each: counts of
    values are exact while no bucket sees more than TRACKED of them. All goes of a store have one number of buckets.
    """

    spark: SparkSession
    path: str
    by: list[str]
    buckets: int = 1

    def write(self, rows: DataFrame, day: Column, value: str, mode: str = "append") -> None:
        """Adds the sketches of rows; a day may be written in several goes, whose sketches are merged when read."""
        g = rows.groupBy(day.cast("date").alias("day"), *self.by, F.pmod(F.xxhash64(value), F.lit(self.buckets)).alias("bucket"))
        made = g.agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(value, PRECISION).alias("distinct"), F.expr(f"approx_top_k_accumulate(`{value}`, {TRACKED})").alias("frequent"))
        made.write.mode(mode).partitionBy("day").parquet(self.path)

    def _range(self, first: str, last: str) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))

    def counts(self, first: str, last: str, *by: str) -> DataFrame:
        """by, n, distinct: rows, and an estimate of the different values, of the days from first to last; no row of the source is read again."""
        return self._range(first, last).groupBy(*by).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"))

    def frequent(self, first: str, last: str, k: int, *by: str) -> DataFrame:
        """by, value, count: the k most frequent values, of which each bucket gives its own k; exact while no bucket sees more than TRACKED values."""
        merged = self._range(first, last).groupBy(*by, "bucket").agg(F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("s"))
        found = merged.select(*by, F.expr(f"inline(approx_top_k_estimate(s, {int(k)}))")).withColumnRenamed("item", "value")
        best = Window.partitionBy(*by).orderBy(F.col("count").desc(), "value")
        return found.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k).drop("_rank")


def buckets_for(rows: DataFrame, value: str) -> int:
    """So many buckets that each sees about half of TRACKED values at most."""
    return rows.agg(F.approx_count_distinct(value).alias("n")).first()["n"] * 2 // TRACKED + 1


def within(estimate: Column, exact: Column, sigmas: float = 4.0) -> Column:
    """The estimate lies within so many standard errors of the exact count."""
    return F.abs(estimate - exact) <= sigmas * 1.04 / 2 ** (PRECISION / 2) * exact + 1
