"""Sinks: JSON files, snapshot folders, vector indexes by fingerprint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.operators.index import corpus_fingerprint


def write_jsonl(df: DataFrame, path: str, single: bool = False) -> None:
    """Lines of JSON; ``single`` gives one file, for results that are small by nature."""
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


def export_counts(chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, question chunks and all others."""
    qa = F.col("chunk_type") == "qa_pair"
    return chunks.agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("chunks_total"), F.count_if(qa).alias("qa_chunks"), F.count_if(~qa).alias("body_chunks"))


def write_snapshot(chunks: DataFrame, root: str, label: str, created_at: Column, notes: str = "", extra: dict[str, DataFrame] | None = None) -> str:
    """Writes ``root/<label>``: the export, further tables and, last, a manifest row. A label that exists is an error."""
    where = f"{root}/{label.strip().replace(' ', '_')}"
    spark = chunks.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise FileExistsError(where)
    chunks.write.mode("errorifexists").parquet(f"{where}/export")
    for name, df in (extra or {}).items():
        df.write.mode("errorifexists").parquet(f"{where}/{name}")
    manifest = export_counts(chunks).select(F.lit(label).alias("version"), created_at.alias("created_at"), F.lit(notes).alias("notes"), "*")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{where}/manifest")
    return where


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Manifests, newest first; folders without one are unfinished and left out."""
    return spark.read.json(f"{root}/*/manifest").orderBy(F.col("created_at").desc(), "version")


def load_or_build(rows: DataFrame, root: str, parts: list[str], build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool]:
    """The table built from these rows: read if one with the rows' fingerprint is there, else built and kept. (table, was it there)."""
    spark = rows.sparkSession
    mark = corpus_fingerprint(rows, *parts).first()["fingerprint"]
    where = f"{root}/fingerprint={mark}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    there = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
    if not there:
        build(rows).write.mode("overwrite").parquet(where)
    return spark.read.parquet(where), there
