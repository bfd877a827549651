"""Metrics of retrieval over whole run tables.

run: query_id, doc_id, rank (from 1); qrels: query_id, doc_id, rel. Queries that
are judged but found nothing, and those without relevant documents, count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return run.join(qrels, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)).cast("double"))


def per_query(run: DataFrame, qrels: DataFrame, k: int, queries: DataFrame | None = None, gain: str = "linear", binary: bool = False, ap_base: str = "relevant") -> DataFrame:
    """A row per query: n_rel, precision, recall, hit, rr, ndcg, ap, first_rank.

    ``gain`` is linear or exp; ``binary`` ignores grades; average precision is
    divided by the number of relevant documents (``relevant``) or by at most k (``min``).
    """
    q = qrels.withColumn("rel", F.when(F.lit(binary), (F.col("rel") > 0).cast("double")).otherwise(F.col("rel").cast("double")))
    g = (lambda r: F.pow(F.lit(2.0), r) - 1) if gain == "exp" else (lambda r: r)
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rel").desc(), "doc_id"))
    truth = q.withColumn("at", ideal_rank).groupBy("query_id").agg(
        F.sum((F.col("rel") > 0).cast("long")).alias("n_rel"), F.sum(F.when(F.col("at") <= k, g(F.col("rel")) / F.log2(F.col("at") + 1.0))).alias("idcg")
    )
    hits = judged(run, q)
    seen = F.sum((F.col("rel") > 0).cast("long")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    hits = hits.withColumn("seen", seen)
    good, top = F.col("rel") > 0, F.col("rank") <= k
    found = hits.groupBy("query_id").agg(
        F.sum((good & top).cast("long")).alias("n_hit"), F.min(F.when(good, F.col("rank"))).alias("first_rank"),
        F.sum(F.when(top, g(F.col("rel")) / F.log2(F.col("rank") + 1.0))).alias("dcg"), F.sum(F.when(good & top, F.col("seen") / F.col("rank"))).alias("ap_sum"),
    )
    base = queries.select("query_id").distinct() if queries is not None else qrels.select("query_id").union(run.select("query_id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n_hit, n_rel = F.coalesce("n_hit", F.lit(0)), F.coalesce("n_rel", F.lit(0))
    ap_n = F.least(n_rel, F.lit(k)) if ap_base == "min" else n_rel
    return base.join(truth, "query_id", "left").join(found, "query_id", "left").select(
        "query_id", n_rel.alias("n_rel"), (n_hit / k).alias("precision"), zero(F.try_divide(n_hit, n_rel)).alias("recall"), (n_hit > 0).cast("double").alias("hit"),
        zero(1.0 / F.col("first_rank")).alias("rr"), zero(F.try_divide(F.col("dcg"), F.col("idcg"))).alias("ndcg"), zero(F.try_divide(F.col("ap_sum"), ap_n)).alias("ap"), "first_rank",
    )


def summary(per: DataFrame, drop_empty: bool = False) -> DataFrame:
    """One row: n_queries and the means; ``drop_empty`` leaves out queries without relevant documents."""
    per = per.where("n_rel > 0") if drop_empty else per
    mean = lambda c, n: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(n)
    return per.agg(F.count(F.lit(1)).alias("n_queries"), mean("precision", "p_at_k"), mean("recall", "recall_at_k"), mean("hit", "hit_at_k"), mean("rr", "mrr"), mean("ndcg", "ndcg_at_k"), mean("ap", "map_at_k"))


def at_many_k(run: DataFrame, qrels: DataFrame, ks=(1, 3, 5, 10, 20, 100)) -> DataFrame:
    """Binary metrics at several k, in one pass: k, hit, recall, map (by at most k), ndcg, mrr."""
    good = qrels.select("query_id", "doc_id", (F.col("rel") > 0).cast("double").alias("rel"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rel").desc(), "doc_id"))
    gain = lambda at: F.col("rel") / F.log2(F.col(at) + 1.0)
    truth = good.withColumn("at", nth).groupBy("query_id").agg(F.sum("rel").alias("n_rel"), *[F.sum(F.when(F.col("at") <= k, gain("at"))).alias(f"ideal{k}") for k in ks])
    seen = F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    hits = judged(run, good).withColumn("seen", seen)
    upto = lambda k, x: F.sum(F.when(F.col("rank") <= k, x))
    each = [x for k in ks for x in (upto(k, F.col("rel")).alias(f"n{k}"), upto(k, gain("rank")).alias(f"dcg{k}"), upto(k, F.col("rel") * F.col("seen") / F.col("rank")).alias(f"ap{k}"))]
    found = hits.groupBy("query_id").agg(F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"), *each)
    per = qrels.select("query_id").union(run.select("query_id")).distinct().join(truth, "query_id", "left").join(found, "query_id", "left")
    mean = lambda x: F.round(F.avg(F.coalesce(x, F.lit(0.0))), 6)
    rows = [
        F.struct(
            F.lit(k).alias("k"), mean((F.col(f"n{k}") > 0).cast("double")).alias("hit"), mean(F.try_divide(f"n{k}", "n_rel")).alias("recall"), mean(F.try_divide(F.col(f"ap{k}"), F.least("n_rel", F.lit(float(k))))).alias("map"),
            mean(F.try_divide(f"dcg{k}", f"ideal{k}")).alias("ndcg"), mean(1.0 / F.col("first")).alias("mrr"),
        )
        for k in ks
    ]
    return per.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("x")).select("x.*")


def by_format(results: DataFrame) -> DataFrame:
    """Benchmark aggregate per format and overall, from rows (format, rank or -1, elapsed_ms)."""
    hit = F.col("rank") != -1
    agg = results.rollup("format").agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg(hit.cast("double")), 4).alias("hit_rate"), F.round(F.avg((F.col("rank") == 1).cast("double")), 4).alias("top1_hit_rate"),
        F.round(F.sum(F.when(hit, 1.0 / F.col("rank")).otherwise(0.0)) / F.count(F.lit(1)), 4).alias("mrr"), F.round(F.coalesce(F.avg(F.when(hit, F.col("rank"))), F.lit(0.0)), 2).alias("avg_rank"),
        F.round(F.coalesce(F.avg(F.when(F.col("elapsed_ms") > 0, F.col("elapsed_ms"))), F.lit(0.0)), 1).alias("avg_latency_ms"), F.grouping("format").alias("g"),
    )
    return agg.withColumn("format", F.when(F.col("g") == 1, F.lit("overall")).otherwise(F.col("format"))).drop("g")


def context_relevance(query_terms: Column, contexts_terms: Column) -> Column:
    """Share of contexts (arrays of terms) that have a term of the query."""
    n = F.size(contexts_terms)
    return F.when(n > 0, F.size(F.filter(contexts_terms, lambda c: F.arrays_overlap(c, query_terms))) / n).otherwise(F.lit(0.0))


def answer_coverage(answer_terms: Column, contexts_terms: Column) -> Column:
    """Share of the answer's distinct terms that any context has; the faithfulness score is the same."""
    a = F.array_distinct(answer_terms)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, F.flatten(contexts_terms))), F.size(a)), F.lit(0.0))


def set_scores(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Set precision, recall and F1 per query."""
    found = run.select("query_id", "doc_id").distinct().join(qrels.where("rel > 0").select("query_id", "doc_id", F.lit(1).alias("good")), ["query_id", "doc_id"], "full_outer")
    run_n = run.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_run"))
    rel_n = qrels.where("rel > 0").groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_rel"))
    both = run.select("query_id", "doc_id").distinct().join(qrels.where("rel > 0"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_both"))
    out = found.select("query_id").distinct().join(run_n, "query_id", "left").join(rel_n, "query_id", "left").join(both, "query_id", "left").fillna(0)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("query_id", z(F.try_divide("n_both", "n_run")).alias("precision"), z(F.try_divide("n_both", "n_rel")).alias("recall"), z(F.try_divide(2 * F.col("n_both"), F.col("n_run") + F.col("n_rel"))).alias("f1"))


def rank_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id, n, spearman, kendall of two runs, over the n documents that both have; null where n is 1.

    The shared documents are ranked anew in each run, 1 to n without ties.
    """
    both = a.select("query_id", "doc_id", F.col("rank").alias("x")).join(b.select("query_id", "doc_id", F.col("rank").alias("y")), ["query_id", "doc_id"])
    again = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(c)).cast("long")
    both = both.select("query_id", again("x").alias("x"), again("y").alias("y"))
    n, d = F.count(F.lit(1)), F.col("x") - F.col("y")
    rho = both.groupBy("query_id").agg(n.alias("n"), F.when(n > 1, 1 - F.lit(6.0) * F.sum(d * d) / (n * (n * n - 1))).alias("spearman"))
    # Runs are cut at their k, so that a query has at most k * (k - 1) / 2 pairs.
    other = both.select("query_id", F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = both.join(other, "query_id").where("x < x2").groupBy("query_id").agg(F.avg(F.when(F.col("y") < F.col("y2"), 1.0).otherwise(-1.0)).alias("kendall"))
    return rho.join(pairs, "query_id", "left").select("query_id", "n", "spearman", "kendall")


def fusion_gain(fused: DataFrame, legs: list[DataFrame], qrels: DataFrame, k: int, queries: DataFrame | None = None, metric: str = "ndcg") -> DataFrame:
    """One row: the fused run's mean of a metric, the best leg's, the gain, and the gain as a share of the best leg's (null where that is 0)."""
    queries = queries if queries is not None else qrels.select("query_id").distinct()
    mean = lambda run, name: per_query(run.where(F.col("rank") <= k), qrels, k, queries).agg(F.avg(metric).alias(name))
    out = mean(fused, "fused")
    for i, leg in enumerate(legs):
        out = out.crossJoin(mean(leg, f"leg{i}"))
    names = [F.col(f"leg{i}") for i in range(len(legs))]
    best = F.greatest(*names) if len(names) > 1 else names[0]
    return out.select("fused", best.alias("best_leg"), (F.col("fused") - best).alias("gain"), F.try_divide(F.col("fused") - best, best).alias("gain_share"))


def gate(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Holds metrics (metric, value) against thresholds (metric, at_least or at_most)."""
    ok = (F.col("at_least").isNull() | (F.col("value") >= F.col("at_least"))) & (F.col("at_most").isNull() | (F.col("value") <= F.col("at_most")))
    return thresholds.join(values, "metric", "left").select("metric", "value", "at_least", "at_most", F.coalesce(ok, F.lit(False)).alias("passed"))


def deltas(versions: DataFrame, metrics: list[str], key: str = "version") -> DataFrame:
    """Each version's metrics and their change against the version before; few rows, as many as there are versions."""
    w = Window.partitionBy(F.lit(0)).orderBy(key)
    return versions.select(key, *metrics, *[F.round(F.col(m) - F.lag(m).over(w), 6).alias(f"delta_{m}") for m in metrics])


def bootstrap_mean(values: DataFrame, key: str, value: str, rounds: int = 200, seed: int = 7) -> DataFrame:
    """Percentile interval of the mean: weights of a resample come from a hash of (key, round), Poisson with mean 1."""
    u = F.pmod(F.xxhash64(key, F.col("round"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    steps, p, total = [], 0.36787944117144233, 0.0
    for n in range(8):
        total += p
        steps.append(total)
        p /= n + 1
    weight = F.lit(8)
    for n in reversed(range(8)):
        weight = F.when(u < steps[n], F.lit(n)).otherwise(weight)
    drawn = values.select(key, F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("w", weight)
    means = drawn.groupBy("round").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))


def paired_t(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, mean difference and t statistic of paired values."""
    d = F.col(a) - F.col(b)
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"), F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)))).alias("t"))
