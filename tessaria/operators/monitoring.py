"""Monitoring aggregates, paging and sampling over documents, chunks, jobs and retrieval logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaria.operators.quantiles import exact_quantiles


def list_page(df: DataFrame, filters: dict, order: str, tie: str, page: int = 1, size: int = 20) -> DataFrame:
    """A page of rows that equal the given values, newest first. Values of None don't filter."""
    if page < 1 or not 1 <= size <= 1000:
        raise ValueError("page and size begin at 1; size is at most 1000")
    for k, v in filters.items():
        if v is not None:
            df = df.where(F.col(k) == v)
    return df.orderBy(F.col(order).desc(), tie).offset((page - 1) * size).limit(size)


def page_count(df: DataFrame, filters: dict, size: int = 20) -> DataFrame:
    for k, v in filters.items():
        if v is not None:
            df = df.where(F.col(k) == v)
    return df.agg(F.count(F.lit(1)).alias("total"), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("long").alias("pages"))


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """(dimension, value, n) for each of several columns, in one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    return df.select(pairs).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """One row over chunks (doc_id, token_count, quality_score, is_verified)."""
    n = F.count(F.lit(1))
    return chunks.agg(
        n.alias("n_chunks"), F.coalesce(F.round(F.try_divide(n, F.countDistinct("doc_id")), 2), F.lit(0.0)).alias("chunks_per_doc"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"),
        F.coalesce(F.round(F.avg("quality_score"), 4), F.lit(0.0)).alias("avg_quality"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"),
        F.round(F.avg("token_count"), 4).alias("avg_tokens"), F.count_if("is_verified").alias("verified"), F.count_if(~F.col("is_verified")).alias("unverified"),
    )


def staleness(docs: DataFrame, as_of: Column, days: int = 90, active: str = "active") -> DataFrame:
    """category (null: all), total, stale, stale_pct of active documents that weren't updated for so many days."""
    old = F.col("updated_at") < as_of - F.make_interval(days=F.lit(days))
    g = docs.where(F.col("status") == active).rollup("category").agg(F.count(F.lit(1)).alias("total"), F.count_if(old).alias("stale"))
    return g.withColumn("stale_pct", F.coalesce(F.round(F.try_divide(100.0 * F.col("stale"), F.col("total")), 2), F.lit(0.0)))


def stale_list(docs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Documents that are old or without a hash, oldest first."""
    old = (F.col("updated_at") < as_of - F.make_interval(days=F.lit(days))) | (F.coalesce("content_hash", F.lit("")) == "")
    return docs.where(old).orderBy("updated_at", "doc_id")


def drift(logs: DataFrame, as_of: Column, value: str, recent: int = 7, baseline: int = 30) -> DataFrame:
    """One row: the means of the last days and of the days before, and their relative change."""
    day = lambda n: as_of - F.make_interval(days=F.lit(n))
    now = logs.where((F.col("ts") >= day(recent)) & (F.col("ts") < as_of)).agg(F.count(F.lit(1)).alias("n_recent"), F.avg(value).alias("recent"))
    was = logs.where((F.col("ts") >= day(baseline)) & (F.col("ts") < day(recent))).agg(F.count(F.lit(1)).alias("n_baseline"), F.avg(value).alias("baseline"))
    return now.crossJoin(was).withColumn("change", F.round(F.try_divide(F.col("recent") - F.col("baseline"), F.col("baseline")), 6))  # one row each


def latency_percentiles(logs: DataFrame, value: str, *by: str) -> DataFrame:
    """by, n, p50, p95, p99: exact, between the nearest values; see :mod:`tessaria.operators.quantiles`."""
    found = exact_quantiles(logs, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, *by)
    n = logs.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.count(F.lit(1)).alias("n"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return n.join(found, on).select(*by, "n", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int = 30) -> DataFrame:
    """bin (1 to bins), from, n: the data of a histogram plot."""
    b = F.least(F.width_bucket(F.col(value), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins))
    return df.where(F.col(value).between(lo, hi)).groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("from", F.round(lo + (F.col("bin") - 1) * ((hi - lo) / bins), 6))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded hash: the same rows whatever the order or number of partitions."""
    return df.withColumn("_h", F.sha2(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")), 256)).orderBy("_h", key).limit(n).drop("_h")


def by_domain(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The rows that a reader of these domains may see."""
    return df.where(F.col("domain").isin(*allowed)) if allowed else df.where(F.lit(False))


def job_counters() -> dict[str, Column]:
    """Counters of a run over rows (action, ok, n_chunks): aggregates, to be observed or summed."""
    a = F.col("action")
    return {
        "files": F.count(F.lit(1)), "succeeded": F.count_if("ok"), "failed": F.count_if(~F.col("ok")), "created": F.count_if((a == "create") & F.col("ok")),
        "updated": F.count_if((a == "update") & F.col("ok")), "skipped": F.count_if(a == "skip"), "chunks": F.coalesce(F.sum(F.when(F.col("ok"), F.col("n_chunks"))), F.lit(0)),
    }


def job_summary(results: DataFrame) -> DataFrame:
    """One row of the counters."""
    return results.agg(*[c.alias(n) for n, c in job_counters().items()])


def judge_stats(scores: DataFrame, value: str, least: float = 0.7) -> DataFrame:
    r = lambda c: F.round(c, 6)
    sums = scores.agg(F.count(F.lit(1)).alias("n"), r(F.avg(value)).alias("mean"), r(F.min(value)).alias("min"), r(F.max(value)).alias("max"), F.count_if(F.col(value) >= least).alias("passed"))
    middle = exact_quantiles(scores, value, {"median": 0.5}).select(r(F.col("median")).alias("median"))
    return sums.join(middle, F.lit(True), "left").select("n", "mean", "median", "min", "max", "passed")  # a row each


def grouping_sets(df: DataFrame, columns: list[str], sets: list[list[str]], *measures: Column) -> DataFrame:
    """The columns (null where a set lacks them), grouping_id and measures of several groupings in one pass.

    grouping_id has a bit per column, the last column's the lowest, which is 1 where the
    column was summed over: so a total is told from a group whose value is null.
    """
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(F.grouping_id().cast("long").alias("grouping_id"), *measures)


def cube(df: DataFrame, columns: list[str], *measures: Column) -> DataFrame:
    """All groupings of the columns, as :func:`grouping_sets` gives them."""
    return df.cube(*columns).agg(F.grouping_id().cast("long").alias("grouping_id"), *measures)
