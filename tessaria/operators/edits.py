"""Edits of chunks: each gives a new table, none is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessaria.functions.text import strip
from tessaria.functions.tokens import estimate_tokens

VERIFY, EDIT, DELETE = "verify", "edit", "delete"


def apply_edits(chunks: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """chunks with content, token_count, is_verified and status after the edits (key, action, content, and ``at`` that orders them).

    A chunk's last edit counts. ``verify`` marks it, ``edit`` gives it a new content
    that isn't verified, ``delete`` leaves it in place as ``deleted``. Edits of
    unknown chunks do nothing; chunks without an edit stay as they are.
    """
    last = edits.groupBy(key).agg(F.max_by(F.struct("action", "content"), "at").alias("_edit"))
    action, new = F.col("_edit.action"), F.col("_edit.content")
    out = chunks.join(last, key, "left")
    held = out.withColumn("content", F.when((action == EDIT) & new.isNotNull(), new).otherwise(F.col("content")))
    return held.withColumns({
        "token_count": estimate_tokens(F.col("content")), "is_verified": F.coalesce(action == VERIFY, F.lit(False)) | (F.col("is_verified") & (action.isNull() | (action == DELETE))),
        "status": F.when(action == DELETE, "deleted").otherwise(F.col("status")),
    }).drop("_edit")


def split_chunks(chunks: DataFrame, doc: str, pattern: str, chosen: Column | None = None) -> DataFrame:
    """(doc, ordinal, content): the chosen chunks cut at a pattern, blank pieces gone, all numbered anew in their order."""
    cut = F.filter(F.transform(F.split("content", pattern), strip), lambda x: x != "")
    pieces = cut if chosen is None else F.when(chosen, cut).otherwise(F.array("content"))
    rows = chunks.select(doc, "ordinal", F.posexplode(pieces).alias("_piece", "content"))
    again = F.row_number().over(Window.partitionBy(doc).orderBy("ordinal", "_piece")) - 1
    return rows.select(doc, again.cast("long").alias("ordinal"), "content")


def merge_chunks(chunks: DataFrame, doc: str, group: Column, mark: str = "\n") -> DataFrame:
    """(doc, part, content): chunks of one group put together in their order."""
    parts = chunks.withColumn("part", group).groupBy(doc, "part").agg(F.array_sort(F.collect_list(F.struct("ordinal", "content"))).alias("all"))
    return parts.select(doc, "part", F.array_join(F.transform("all", lambda x: x["content"]), mark).alias("content"))
