"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and keeps the columns of documents, but for the last.

All decide row by row, whatever the ids: null and repeated ids are no reason to
stay or go. Other columns pass through, also where their names clash with those of
an operator. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.llm import decontaminate, exact_dedup, language_id, near_dedup, packing
from tessaria.llm.common import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language isn't recognised (``und``): null and empty texts, texts without a letter, and all where nothing is labelled."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (white space apart) exactly one stays, the one with most code points, then the smallest id; null and blank texts are equal."""
    return exact_dedup.keep_one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates exactly one row stays, the one with the smallest id, null last; rows without a word all stay."""
    return near_dedup.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; null texts stay."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a sequence, also for null and empty texts; a row that repeats is packed for itself."""
    return packing.pack(docs)
