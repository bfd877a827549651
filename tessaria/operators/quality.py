"""Validation of chunks and documents, issue codes, completeness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaria.functions.text import strip
from tessaria.functions.tokens import encoding_quality, persian_ratio


@dataclass(frozen=True)
class Thresholds:
    min_chunk_length: int = 20
    max_chunk_length: int = 10_000
    min_persian_ratio: float = 0.1
    min_encoding_quality: float = 0.8
    min_doc_chunks: int = 1
    max_doc_chunks: int = 500
    stale_days: int = 90


def chunk_errors(content: Column, t: Thresholds = Thresholds()) -> Column:
    """Codes of what is wrong with a chunk, in a fixed order; blank content has that one alone."""
    blank = content.isNull() | (F.char_length(strip(content)) == 0)
    n = F.char_length(content)
    rest = F.array_compact(F.array(
        F.when(n < t.min_chunk_length, F.lit("too_short")), F.when(n > t.max_chunk_length, F.lit("too_long")),
        F.when(encoding_quality(content, delete=True) < t.min_encoding_quality, F.lit("low_encoding_quality")),
        F.when(persian_ratio(content) < t.min_persian_ratio, F.lit("low_persian_ratio")),
    ))
    return F.when(blank, F.array(F.lit("empty"))).otherwise(rest)


def validate_documents(docs: DataFrame, chunks: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """doc_id, n_chunks, n_failed, errors, warnings, valid from docs (doc_id, title, source_path) and chunks (doc_id, content)."""
    per = chunks.select("doc_id", (F.size(chunk_errors(F.col("content"), t)) > 0).alias("bad")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if("bad").alias("n_failed"))
    d = docs.join(per, "doc_id", "left").fillna(0, ["n_chunks", "n_failed"])
    empty = lambda c: F.coalesce(F.char_length(strip(F.col(c))), F.lit(0)) == 0
    errors = F.array_compact(F.array(
        F.when(empty("title"), F.lit("title_empty")), F.when(F.coalesce("source_path", F.lit("")) == "", F.lit("source_path_empty")),
        F.when(F.col("n_chunks") < t.min_doc_chunks, F.lit("too_few_chunks")), F.when(F.col("n_failed") > 0, F.lit("chunks_failed")),
    ))
    warnings = F.array_compact(F.array(F.when(F.col("n_chunks") > t.max_doc_chunks, F.lit("many_chunks"))))
    return d.select("doc_id", "n_chunks", "n_failed", errors.alias("errors"), warnings.alias("warnings"), (F.size(errors) == 0).alias("valid"))


def issue_codes(content: Column, heading: Column, has_embedding: Column) -> Column:
    """The stricter design's codes: bounds of 50 and 2000 characters, 30 % script, heading and embedding there."""
    n = F.char_length(F.coalesce(content, F.lit("")))
    return F.array_compact(F.array(
        F.when(n < 50, F.lit("too_short")), F.when(n > 2000, F.lit("too_long")), F.when(persian_ratio(content) < 0.3, F.lit("low_persian")),
        F.when(~has_embedding, F.lit("missing_embedding")), F.when(F.coalesce(heading, F.lit("")) == "", F.lit("missing_heading")),
    ))


def completeness(chunks: DataFrame, content: str, fields: dict[str, str]) -> DataFrame:
    """One row: n, and for each name how many contents hold its text."""
    return chunks.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.contains(F.col(content), F.lit(text))).alias(name) for name, text in fields.items()])
