"""Chunkers as table functions of SQL: ``SELECT ... FROM documents, LATERAL sentence_chunks(text, 512)``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tessaria.operators.chunking import MAX_TOKENS

SCHEMA = StructType().add("ordinal", "long").add("content", "string").add("token_count", "long")


class LineChunks:
    """Lines packed, one after another, into pieces of at most so many tokens (two a word); a longer line is a piece of its own. Blank lines go."""

    @staticmethod
    def analyze(text: AnalyzeArgument, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        if text.dataType.typeName() != "string":
            raise ValueError("line_chunks takes a text")
        if most is not None and (not most.isConstantExpression or not isinstance(most.value, int) or most.value < 1):
            raise ValueError("the number of tokens must be a constant of 1 and more")
        return AnalyzeResult(SCHEMA)

    def eval(self, text: str, most: int = MAX_TOKENS) -> Iterator[tuple]:
        n, held, size = 0, [], 0
        for line in (text or "").split("\n"):
            own = 2 * len(re.findall(r"\S+", line))
            if not own:
                continue
            if held and size + own > most:
                yield n, "\n".join(held), size
                n, held, size = n + 1, [], 0
            held.append(line)
            size += own
        if held:
            yield n, "\n".join(held), size


def register(spark: SparkSession) -> None:
    """Makes ``line_chunks(text[, tokens])`` known to spark.sql; rows reach it in Arrow batches."""
    spark.udtf.register("line_chunks", udtf(LineChunks, useArrow=True))
