"""Exact dedup: an extendible-hash index on shared files, with native operators only.

Texts are compared without their ASCII white space. One pass writes an entry per
row to the shared folder: its 64-bit key, and the digest and length that stand for
the text's bytes, so that no text is shuffled. Copies are summed up in parts before
they meet, so that a group of any size costs its owner a few entries.

The directory is made of the keys' leading bits: an overfull bucket is split by
one more bit, and the directory doubles where the bucket is as deep as it is, until
no bucket holds more entries than its capacity. Entries are routed through it: a
bucket is a range of keys, and the task that owns it merges the parts, chains the
entries whose keys collide and tells them apart by their bytes' digests. Its
file is the bucket in the shared folder, where every row is looked up.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessaria.llm.common import drop, join_spread, keep

#: The white space that equality ignores: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: Entries a bucket of the index may hold before it is split.
CAPACITY = 4096
#: The directory has 2**MAX_DEPTH cells at most, whatever the input's size; buckets that deep aren't split any more, and their owner tasks may spill.
MAX_DEPTH = 16
#: A group of copies is summed up in so many parts.
PARTS = 16


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def cell(key: Column, depth: int) -> Column:
    """The key's leading bits: its cell in a directory of that depth."""
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def buckets(counts: dict[int, int], capacity: int, most: int) -> list[tuple[int, int, int]]:
    """(bucket, first cell, local depth) of each bucket of a directory of depth ``most``, numbered in the order of keys.

    counts has the entries of each cell. A bucket of more than ``capacity`` entries is
    split by its next bit, unless it is a single cell.
    """
    before = [0, *accumulate(counts.get(c, 0) for c in range(1 << most))]
    out, open_ = [], [(0, 0)]  # (first cell, depth), the next in order on top
    while open_:
        first, depth = open_.pop()
        wide = 1 << (most - depth)
        if before[first + wide] - before[first] > capacity and depth < most:
            open_ += [(first + wide // 2, depth + 1), (first, depth + 1)]
        else:
            out.append((len(out), first, depth))
    return out


def directory(keys: DataFrame, capacity: int = CAPACITY, most: int = MAX_DEPTH) -> DataFrame:
    """(cell, bucket, depth) of each cell; the driver sees a histogram of bounded size."""
    counts = {r[0]: r[1] for r in keys.groupBy(cell(F.col("key"), most).alias("cell")).count().collect()}
    made = buckets(counts, capacity, most)
    ends = [first for _, first, _ in made[1:]] + [1 << most]
    spark = keys.sparkSession
    ranges = spark.createDataFrame([(b, f, e - 1, d) for (b, f, d), e in zip(made, ends, strict=True)], "bucket int, first int, last int, depth int")
    return ranges.select(F.explode(F.sequence("first", "last")).alias("cell"), "bucket", "depth")


def entries(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, key, digest and bytes of the normalised text, code points of the text."""
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("points"))
    return norm.select("doc_id", F.xxhash64("norm").alias("key"), F.unhex(F.sha2("norm", 256)).alias("digest"), F.octet_length("norm").alias("bytes"), "points")


#: Of equal texts the most code points win, then the smallest doc_id: one number of fixed width, which sums hold in place.
_WIDE = "decimal(38,0)"
SAME = ["key", "digest", "bytes"]


def _number(n: int) -> Column:
    return F.lit(str(n)).cast(_WIDE)


def build_index(located: DataFrame, capacity: int = CAPACITY, most: int = MAX_DEPTH) -> tuple[DataFrame, str]:
    """The index of entries, and its path: a row per distinct text with bucket, depth, key, place in the key's chain, digest, bytes, keep_id, group_size; a file per bucket."""
    last = _number(1 << 63)  # stands for a null doc_id
    base = F.col("points").cast(_WIDE) * _number(1 << 64)
    parts = (
        located.withColumn("rank", (base - F.coalesce(F.col("doc_id").cast(_WIDE), last)).cast(_WIDE))
        .groupBy(*SAME, F.pmod(F.xxhash64("doc_id", "points"), F.lit(PARTS)).alias("part"))
        .agg(F.max("rank").alias("rank"), F.max("points").alias("points"), F.count(F.lit(1)).alias("n"))
    )
    parts, raw = keep(parts, "exact-parts")
    routes = directory(parts.select("key"), capacity, most)
    routed = parts.withColumn("cell", cell(F.col("key"), most)).join(F.broadcast(routes), "cell").repartition("bucket")
    keep_id = (base - F.col("rank")).cast(_WIDE)
    # From here on all is done by a bucket's owner task, without another shuffle.
    merged = routed.groupBy("bucket", "depth", *SAME).agg(F.max("rank").alias("rank"), F.max("points").alias("points"), F.sum("n").alias("group_size"))
    chained = merged.withColumn("place", F.row_number().over(Window.partitionBy("bucket", "key").orderBy("digest", "bytes")))
    index, path = keep(chained.select("bucket", "depth", "key", "place", "digest", "bytes", F.when(keep_id < last, keep_id.cast("long")).alias("keep_id"), "group_size"), "exact-index", by="bucket")
    drop(located.sparkSession, raw)
    return index, path


def look_up(rows: DataFrame, index: DataFrame, most: int = MAX_DEPTH) -> DataFrame:
    """Rows of key, digest and bytes with their entry of the index.

    The directory, of 2^most cells at most, sends each row to its bucket, and a
    bucket's rows meet that bucket's entries; rows of one text are spread over many tasks.
    """
    at = cell(F.col("key"), most).alias("cell")
    routes = index.select(at, "bucket").distinct()
    routed = rows.withColumn("cell", cell(F.col("key"), most)).join(F.broadcast(routes), "cell").drop("cell")
    return join_spread(routed, index, ["bucket", *SAME], ["doc_id", "points"])


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; a null text counts
    as empty, so that null, empty and blank rows form one group. Of equal texts
    the row with most code points stays, then the smallest doc_id; a null doc_id
    comes last. Rows that repeat the doc_id that stays are all kept. Columns other
    than doc_id and text are ignored, an empty table gives an empty result.
    """
    located, _ = keep(entries(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "exact-entries")
    index, _ = build_index(located)
    return look_up(located, index).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows that stay, with their own columns: exactly one of each text, whatever their ids.

    It is a row with the index's keep_id, null or not, and with that text. Of several
    such rows the one with most code points stays, then the smallest text and hash of the row.
    """
    located, raw = keep(entries(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "exact-entries")
    index, _ = build_index(located)
    drop(docs.sparkSession, raw)
    named = lambda c: (F.coalesce(c, F.lit(0)).alias("id"), c.isNull().alias("unnamed"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(*docs.columns).alias("row"), F.struct(*docs.columns).alias("doc"))
    rows = rows.withColumn("norm", normalised(F.col("text"))).select(
        F.xxhash64("norm").alias("key"), F.unhex(F.sha2("norm", 256)).alias("digest"), F.octet_length("norm").alias("bytes"), *named(F.col("doc_id")),
        F.coalesce(F.char_length("text"), F.lit(0)).alias("points"), "row", "doc",
    )
    # The id is part of the key, so that the copies of a hot text are dealt over all tasks.
    key = [*SAME, "id", "unnamed"]
    found = rows.join(index.select(*SAME, *named(F.col("keep_id"))).hint("merge"), key, "left_semi")
    order = Window.partitionBy(*key).orderBy(F.col("points").desc(), "doc.text", "row")
    return found.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("doc.*")
