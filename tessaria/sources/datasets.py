"""Datasets of questions and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.functions.text import strip
from tessaria.operators.numbering import gapless


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array, or one object per line."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def retrieval_dataset(rows: DataFrame, order: str, query_field: str, corpus_field: str, id_field: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, corpus, qrels) from rows of question and passage.

    Row i in the given order, from 0, is query ``q_<i>``; rows with a blank query or
    text are skipped but counted; of passages with one id the last counts.
    Numbers come from ranges of the order and the sizes of the ranges before.
    """
    numbered = gapless(rows, [order], "_row")
    full = numbered.where((strip(F.col(query_field)) != "") & (strip(F.col(corpus_field)) != ""))
    named = full.select("_row", F.concat(F.lit("q_"), "_row").alias("query_id"), F.col(query_field).alias("text"), F.col(id_field).cast("string").alias("doc_id"), F.col(corpus_field).alias("passage"))
    corpus = named.groupBy("doc_id").agg(F.max_by("passage", "_row").alias("text"))
    return named.select("query_id", "text"), corpus, named.select("query_id", "doc_id", F.lit(1).alias("rel"))


def tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Parquet tables of a folder, also as temporary views for spark.sql."""
    out = {}
    for n in names:
        out[n] = spark.read.parquet(f"{folder}/{n}.parquet")
        out[n].createOrReplaceTempView(n)
    return out
