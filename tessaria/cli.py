"""python -m tessaria: ingest, status, search, inspect, eval-generate, eval-run, status-chunks over a knowledge base's folder."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.operators import changes, generation, ingest, metrics, monitoring, ranking


def session() -> SparkSession:
    return SparkSession.builder.appName("tessaria").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def run(args: list[str], spark: SparkSession | None = None) -> DataFrame:
    """Runs a command and returns its rows."""
    p = argparse.ArgumentParser(prog="tessaria", description=__doc__)
    p.add_argument("--kb", required=True, help="folder of the knowledge base")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("ingest", help="take in a folder of files")
    i.add_argument("folder")
    i.add_argument("--full", action="store_true", help="rebuild instead of update")
    i.add_argument("--as-of", help="the run's time; now by default")
    sub.add_parser("status", help="counts of documents and chunks")
    sub.add_parser("status-chunks", help="sums over chunks")
    s = sub.add_parser("search", help="search in chunks")
    s.add_argument("--by", choices=["bm25", "dense", "hybrid"], default="bm25", help="words, vectors, or both with their ranks fused")
    s.add_argument("query")
    s.add_argument("--top-k", type=int, default=10, choices=range(1, 51), metavar="1-50")
    n = sub.add_parser("inspect", help="a document's chunks")
    n.add_argument("doc_id")
    sub.add_parser("eval-generate", help="queries and judgements from question chunks")
    e = sub.add_parser("eval-run", help="metrics of BM25 on generated queries")
    e.add_argument("--k", type=int, default=10)
    a = p.parse_args(args)
    spark = spark or session()
    kb = ingest.KnowledgeBase(spark, a.kb)
    chunks = lambda: kb.read("chunks")
    pairs = lambda: chunks().where("chunk_type = 'qa_pair'").select("chunk_id", F.regexp_extract("content", r"(?m)^سوال: (.*)$", 1).alias("question"))
    if a.command == "ingest":
        at = F.lit(a.as_of).cast("timestamp") if a.as_of else F.current_timestamp()
        return kb.rebuild(a.folder, at) if a.full else kb.update(a.folder, at)
    if a.command == "status":
        return kb.status()
    if a.command == "status-chunks":
        return monitoring.chunk_summary(chunks())
    if a.command == "inspect":
        return chunks().where(F.col("doc_id") == a.doc_id).orderBy("ordinal").select("ordinal", "chunk_type", "token_count", F.substring("content", 1, 300).alias("preview"))
    if a.command == "search":
        q = spark.createDataFrame([(1, a.query)], "query_id int, text string")
        if a.by == "bm25":
            found = ranking.bm25(q, kb.index(), a.top_k)
        else:
            asked = q.select("query_id", changes.hash_embed(F.col("text")).alias("vector"))
            found = ranking.dense(asked, kb.vectors(), a.top_k) if a.by == "dense" else ranking.hybrid(q, kb.index(), kb.vectors(), asked, a.top_k)
        titled = chunks().join(kb.read("documents").select("doc_id", "title"), "doc_id", "left").select(F.col("chunk_id").alias("doc_id"), F.coalesce("title", F.lit("Unknown")).alias("title"), "ordinal", F.substring("content", 1, 300).alias("preview"))
        return found.join(titled, "doc_id").orderBy("rank").select("rank", F.round("score", 4).alias("score"), "title", "ordinal", "preview")
    queries, qrels = generation.dataset_from_pairs(pairs())
    if a.command == "eval-generate":
        return queries.join(qrels, "query_id")
    found = ranking.bm25(queries, kb.index(children=True), a.k)
    return metrics.summary(metrics.per_query(found, qrels, a.k, queries))


def main() -> None:
    import sys

    run(sys.argv[1:]).show(100, truncate=False)
