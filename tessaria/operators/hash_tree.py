"""A tree of digests over key buckets: two versions of a table are compared from the root, and only buckets that differ are read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessaria.operators.changes import change_set, content_hash

#: Each node has FAN children; rows of a bucket, on average; most levels under the root.
FAN, BUCKET_ROWS, MOST_LEVELS = 16, 100_000, 4


def levels_for(rows: int, fan: int = FAN) -> int:
    """As many levels as buckets of BUCKET_ROWS rows need."""
    return next((k for k in range(1, MOST_LEVELS) if rows <= BUCKET_ROWS * fan**k), MOST_LEVELS)


@dataclass
class HashTree:
    """A stored version: rows (key, digest) in a folder per bucket, and nodes (level, node, n, digest), of which level 0 is the root."""

    spark: SparkSession
    path: str
    key: str = "path"
    digest: str = "digest"

    def write(self, rows: DataFrame, levels: int, fan: int = FAN) -> None:
        """Stores rows of key and digest, one per key; null keys can't be compared and are left out.

        Trees are comparable if their levels and fans are the same.
        """
        bucket = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(fan**levels)).cast("int").alias("bucket")
        put = rows.where(F.col(self.key).isNotNull()).select(self.key, self.digest, bucket)
        put.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/rows")
        held = self.spark.read.schema(put.schema).parquet(f"{self.path}/rows")
        # A bucket's digest folds sums of its rows' hashes: they depend on no order and are added up within tasks.
        h = content_hash(F.concat_ws("\u0001", F.col(self.key).cast("string"), F.coalesce(self.digest, F.lit("\u0002"))))
        words = [F.sum(F.conv(F.substring(h, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(5)]
        level = held.groupBy(F.col("bucket").cast("long").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("-", F.count(F.lit(1)).cast("string"), *words), 256).alias("digest"))
        nodes = level.select(F.lit(levels).alias("level"), "node", "n", "digest", F.lit(fan).alias("fan"))
        nodes.write.mode("overwrite").parquet(f"{self.path}/nodes/of={levels}")
        for k in range(levels - 1, -1, -1):
            below = self.spark.read.parquet(f"{self.path}/nodes/of={k + 1}")
            kids = F.array_sort(F.collect_list(F.concat_ws(":", F.format_string("%010d", "node"), "digest")))  # at most FAN
            up = below.groupBy(F.floor(F.col("node") / fan).alias("up")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(kids, "|"), 256).alias("digest"))
            up.select(F.lit(k).alias("level"), F.col("up").alias("node"), "n", "digest", F.lit(fan).alias("fan")).write.mode("overwrite").parquet(f"{self.path}/nodes/of={k}")

    def nodes(self, level: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/nodes/of={level}")

    def shape(self) -> tuple[int, int] | None:
        """(levels, fan), None for a tree without rows."""
        r = self.spark.read.parquet(f"{self.path}/nodes").agg(F.max("level").alias("levels"), F.max("fan").alias("fan")).first()
        return None if r["levels"] is None else (r["levels"], r["fan"])

    def rows(self, like: DataFrame, buckets: list[int]) -> DataFrame:
        """The rows of some buckets; other folders aren't read."""
        return self.spark.read.schema(StructType([*like.schema.fields, StructField("bucket", IntegerType())])).parquet(f"{self.path}/rows").where(F.col("bucket").isin(buckets)).drop("bucket")


def differing(old: HashTree, new: HashTree) -> list[int]:
    """The buckets in which two stored versions differ: children are looked at only under nodes that differ."""
    shapes = {s for t in (old, new) if (s := t.shape()) is not None}
    if not shapes:
        return []
    if len(shapes) > 1:
        raise ValueError("trees of different levels or fans can't be compared")
    levels, fan = shapes.pop()
    under: list[int] | None = None
    for k in range(levels + 1):
        a, b = (t.nodes(k).select("node", F.col("digest").alias(c)) for t, c in ((old, "x"), (new, "y")))
        if under is not None:
            a, b = (d.where(F.floor(F.col("node") / fan).isin(under)) for d in (a, b))
        both = a.join(b, "node", "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
        under = sorted(r["node"] for r in both.select("node").collect())  # a row per differing bucket at most
        if not under:
            return []
    return under


def changes(old: HashTree, new: HashTree, like: DataFrame, unchanged: bool = False) -> DataFrame:
    """key, status (added, modified, removed), old, new: the change set of two stored versions, from the buckets that differ.

    ``like`` has the columns key and digest. Rows of equal buckets are unchanged, and left out.
    """
    at = differing(old, new)
    pair = [t.rows(like.select(t.key, t.digest), at) for t in (old, new)]
    found = change_set(*pair, old.key, old.digest)
    return found if unchanged else found.where("status <> 'unchanged'")
