"""The registry of queries, shared inputs and pieces of oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); sql is what DuckDB runs to the same result."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


#: Tables below this size are dealt out over all cores, as one small file with one row group is one task otherwise.
SMALL_BYTES = 64 << 20
TEXTUAL = ("documents", "pages")


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt over all cores; a larger one has splits enough and isn't shuffled."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SMALL_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTUAL else df


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rr(x: str, pattern: str, replacement: str) -> str:
    """regexp_replace of all matches."""
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(replacement)}, 'g')"


#: Texts that the driver's tables lack: Arabic script, marks, white space of all kinds, broken markup.
TEXTS = [
    "كتاب‌هاي آموزشي و ةٱأإآءئىي ۱۲۳ ٤٥٦ ٪ ؛ ،", "می‌شود  می‌کنند\n\n\n\nسؤال: چیست؟ پاسخ.", "a b c d\t e\n\n\n f ", "﻿a​b‍c‪d‮e⁦f⁩g",
    "<!-- a\nb --> x <b>y</b> a < b > c //cdn.example.org/x ftp://h/p?q HTTP://EXAMPLE.com/a'b", "mail me.you+tag@ex-am.ple.co.uk, ~$lock.docx ~$ x", "é Å ﬁ 가", "\u0000? bad � \u0007 ok".replace("\u0000", "\u0001"),
    "", "   ", "word", "سلام؟دنیا ا?ب x?y", "# Title here \n text\n## Sub\nmore", "Report-42 report-42 code_X1 the the of کد گزارش گزارش در", "شماره ۱۲ و 12 برابر است! درست؟ بله. پایان",
    "reason_code", " Model-Name ", "brief answer", "قرارداد ثبت نامه امضا ارسال مدارک دسترسی می‌شود؟",
]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and the fixed texts under negative ids: id, text."""
    fixed = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(TEXTS)], "id long, text string")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(fixed)


def fixed_sql() -> str:
    return ", ".join(f"({-1 - k}, {quoted(t)})" for k, t in enumerate(TEXTS))


TEXTS_SQL = f"texts AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM (VALUES {fixed_sql()}) v(id, text))"
