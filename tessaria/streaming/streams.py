"""Streaming twins of batch operators; each has a batch form that gives the same rows once the stream has ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessaria.functions.text import question_form
from tessaria.operators.changes import content_hash


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """n, mean and largest value by window and type; events later than the watermark allows are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    src = events.withWatermark("ts", late) if events.isStreaming else events
    g = src.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("mean", 6).alias("mean"), "most")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    src = events.withWatermark("ts", late) if events.isStreaming else events
    g = src.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "user_id", "n")


def first_questions(rows: DataFrame, question: str, late: str = "1 day") -> DataFrame:
    """The first row of each question within the watermark's time; blank questions go."""
    keyed = rows.withColumn("question_key", question_form(F.col(question))).where("question_key <> ''")
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["question_key"]) if rows.isStreaming else keyed.dropDuplicates(["question_key"])


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is there now as Parquet, and ends."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()


def incremental(stream: DataFrame, key: str, text: str, state: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Merges each batch into a keyed table: new and changed keys are written under the batch's number, so that a batch that is repeated overwrites itself.

    :func:`merged` reads the table: of each key the row of its last batch.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("content_hash", content_hash(F.col(text)))
        rows = rows.groupBy(key).agg(*[F.max_by(c, "content_hash").alias(c) for c in rows.columns if c != key])
        before = merged(batch.sparkSession, state, key, rows.schema, below=number).select(F.col(key).alias("_k"), F.col("content_hash").alias("_h"))
        new = rows.join(before, (F.col(key) == F.col("_k")) & (F.col("content_hash") == F.col("_h")), "left_anti")
        (make(new) if make else new).write.mode("overwrite").parquet(f"{state}/batch={number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged(spark: SparkSession, state: str, key: str, schema: StructType, below: int | None = None) -> DataFrame:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root) or not len(fs.listStatus(root)):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(state)
    if below is not None:
        rows = rows.where(F.col("batch") < below)
    names = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(*[F.max_by(F.struct(c), "batch")[c].alias(c) for c in names])
