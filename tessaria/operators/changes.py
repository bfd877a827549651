"""Change capture by content hash, incremental replacement, dedup of questions, the cache of embeddings."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_WORD = re.compile(r"\w+")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def change_set(stored: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """key, status (added, modified, removed, unchanged), old and new digest."""
    a, b = stored.select(F.col(key).alias("k1"), F.col(digest).alias("old")), incoming.select(F.col(key).alias("k2"), F.col(digest).alias("new"))
    j = a.join(b, F.col("k1") == F.col("k2"), "full_outer")
    status = F.when(F.col("k1").isNull(), "added").when(F.col("k2").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("modified")
    return j.select(F.coalesce("k1", "k2").alias(key), status.alias("status"), "old", "new")


def ingest_decision(changes: DataFrame) -> DataFrame:
    """What ingestion does: create, update or skip; removed keys stay for a rebuild."""
    return changes.withColumn("action", F.when(F.col("status") == "added", "create").when(F.col("status") == "modified", "update").when(F.col("status") == "unchanged", "skip").otherwise("keep"))


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The children of old keys that are not in ``new``, and the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def keep_first(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key; blank and null keys go."""
    keyed = rows.withColumn("_key", key).where("_key <> ''")
    return keyed.groupBy("_key").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")  # the least of each task is shuffled


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def duplication(rows: DataFrame, key: Column) -> DataFrame:
    """One row: distinct keys, surplus copies, keys with more than one and with more than five copies."""
    g = rows.groupBy(key.alias("k")).count()
    many = lambda n: F.count_if(F.col("count") > n)
    return g.agg(F.count(F.lit(1)).alias("distinct_keys"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("surplus"), many(1).alias("over_1"), many(5).alias("over_5"))


def embed_missing(rows: DataFrame, cache: DataFrame, text: str, embed: Callable[[Column], Column]) -> DataFrame:
    """rows with a vector: from the cache (hash, vector) where the text's hash is there, else computed once per hash."""
    hashed = rows.withColumn("hash", content_hash(F.col(text)))
    todo = hashed.join(cache.select("hash"), "hash", "left_anti").groupBy("hash").agg(F.first(text).alias("t"))
    made = todo.select("hash", embed(F.col("t")).alias("vector"))
    return hashed.join(cache.select("hash", "vector").unionByName(made), "hash", "left")


def hash_embed(c: Column, dims: int = 64) -> Column:
    """The built-in embedder: words hashed into a fixed number of signed dimensions, of length 1. One pass over a text's words."""

    @F.pandas_udf("array<double>")
    def embed(s: pd.Series) -> pd.Series:
        def one(text: str | None) -> np.ndarray:
            h = np.fromiter((zlib.crc32(w.encode()) for w in _WORD.findall((text or "").lower())), np.int64)
            v = np.bincount(h % dims, np.where(h // dims % 2 == 0, 1.0, -1.0), dims)
            return v / (np.linalg.norm(v) or 1.0)

        return s.map(one)

    return embed(c)
