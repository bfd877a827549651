"""Rankings of batches of queries: BM25, TF-IDF cosine, dense cosine, fusion, reranking, hybrid search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tessaria.functions.tokens import search_tokens, words
from tessaria.operators import vector_index
from tessaria.operators.components import kept
from tessaria.operators.index import B, K1, Index, idf, saturation

RRF_K = 60
#: The candidates that a leg hands to fusion are this many times the results; at most POOL are reranked.
OVERFETCH, POOL = 3, 50


def top_k(scored: DataFrame, k: int, key: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best of each key with their rank from 1. Scores that agree in nine places are ties, which go to the smaller item."""
    w = Window.partitionBy(key).orderBy(F.round(score, 9).desc(), item)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, text_col: str = "text", tokens=search_tokens) -> DataFrame:
    """query_id, term, qtf: a token that occurs twice counts twice."""
    return queries.select("query_id", F.explode(tokens(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25(queries: DataFrame, index: Index, k: int, k1: float = K1, b: float = B, tokens=search_tokens, weight: Column | None = None) -> DataFrame:
    """query_id, doc_id, score, rank. Only documents that share a term are scored; a query without terms has no result.

    ``weight`` may be a Column over ``term``, to weigh words and grams differently.
    A batch of queries that shares many postings with a written index is scored
    document by document; of a few queries the postings are looked up.
    """
    terms = query_terms(queries, tokens=tokens)
    if index.forward is not None:
        own = terms.join(index.df, "term").crossJoin(index.stats)
        w = F.col("qtf") * idf(F.col("df"), F.col("n_docs"))
        found = _by_document(own.select("query_id", "term", "df", (w if weight is None else w * weight).alias("w")), index, k, (k1, b))
        if found is not None:
            return found
    hit = index.weighted(terms).crossJoin(index.stats)
    part = F.col("qtf") * idf(F.col("df"), F.col("n_docs")) * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    if weight is not None:
        part = part * weight
    return top_k(hit.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score")), k)


#: A batch is scored by document where its queries' postings are more than this part of all, and it has no more weights than are sent to all tasks; cells of a table of scores.
SCAN_SHARE, MOST_WEIGHTS, CELLS = 1 / 10, 1 << 20, 1 << 19


def _by_document(weights: DataFrame, index: Index, k: int, saturate: tuple[float, float] | None) -> DataFrame | None:
    """query_id, doc_id, score, rank of the k best of each query, or None where looking up the postings is cheaper.

    ``weights`` (query_id, term, df, w) go to all tasks. A task reads its documents
    whole, adds up a table of scores of some documents by all queries, and keeps
    each query's k best; only those are shuffled. A posting counts w times its BM25
    saturation for (k1, b), or w * tf / length / the document's norm for None.
    """
    rows = weights.limit(MOST_WEIGHTS + 1).collect()
    if len(rows) > MOST_WEIGHTS or any(not r["w"] > 0 for r in rows) or sum(r["df"] for r in rows) <= index.n_postings * SCAN_SHARE:
        return None
    spark = weights.sparkSession
    names = sorted({r["query_id"] for r in rows})
    number = {q: i for i, q in enumerate(names)}
    vocabulary = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    rows.sort(key=lambda r: vocabulary[r["term"]])
    cuts = np.searchsorted([vocabulary[r["term"]] for r in rows], np.arange(len(vocabulary) + 1))
    avgdl = max(index.stats.first()["avgdl"], 1.0)
    shared = spark.sparkContext.broadcast((names, list(vocabulary), cuts, np.array([number[r["query_id"]] for r in rows]), np.array([r["w"] for r in rows])))
    docs = index.forward.select("doc_id", "dl", "bag")
    docs = docs.join(index.doc_norms(), "doc_id").select("doc_id", (F.col("dl") * F.col("norm")).alias("dl"), "bag") if saturate is None else docs.withColumn("dl", F.col("dl").cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, cuts, of, w = shared.value
        terms, width = pa.array(terms, pa.string()), len(names)
        best, floor = None, np.full(width, -np.inf)
        for batch in batches:
            ids = batch.column(0).to_pandas(integer_object_nulls=True).to_numpy()
            for at in range(0, len(ids), step := max(1, CELLS // width)):
                part = batch.slice(at, step)
                dl, bags = part.column(1).to_numpy(zero_copy_only=False), part.column(2)
                doc = np.repeat(np.arange(len(part)), pc.list_value_length(bags).to_numpy(zero_copy_only=False))
                pairs = bags.flatten()
                term = pc.index_in(pairs.field(0), value_set=terms)
                hit = term.is_valid().to_numpy(zero_copy_only=False)
                doc, tf, term = doc[hit], pairs.field(1).to_numpy(zero_copy_only=False)[hit], term.drop_null().to_numpy(zero_copy_only=False)
                if not len(doc):
                    continue
                x = tf / dl[doc] if saturate is None else tf * (saturate[0] + 1) / (tf + saturate[0] * (1 - saturate[1] + saturate[1] * dl[doc] / avgdl))
                # Each posting meets the queries that have its term.
                many = cuts[term + 1] - cuts[term]
                ends = np.cumsum(many)
                to = np.arange(ends[-1]) + np.repeat(cuts[term] - ends + many, many)
                table = np.bincount(np.repeat(doc, many) * width + of[to], np.repeat(x, many) * w[to], len(part) * width).reshape(-1, width)
                near = np.round(table, 9)
                if len(part) > k:
                    floor = np.maximum(floor, np.partition(near, len(part) - k, axis=0)[len(part) - k])
                row, q = np.nonzero((table > 0) & (near >= floor))
                new = pd.DataFrame({"q": q, "doc_id": ids[at:][row], "score": table[row, q], "near": near[row, q]})
                best = new if best is None else pd.concat([best, new], ignore_index=True)
                best = best.sort_values(["q", "near", "doc_id"], ascending=[True, False, True]).groupby("q").head(k)
                full = best.groupby("q")["near"].agg(["size", "min"])
                full = full[full["size"] == k]
                floor[full.index] = np.maximum(floor[full.index], full["min"])
        if best is not None:
            made = [pa.array([names[i] for i in best["q"]], of_query), pa.array(best["doc_id"], of_doc, from_pandas=True), pa.array(best["score"], pa.float64())]
            yield pa.RecordBatch.from_arrays(made, ["query_id", "doc_id", "score"])

    types = [weights.schema["query_id"].dataType, docs.schema["doc_id"].dataType]
    of_query, of_doc = map(to_arrow_type, types)
    return kept(top_k(docs.mapInArrow(run, f"query_id {types[0].simpleString()}, doc_id {types[1].simpleString()}, score double"), k), "found")


#: The terms of a query that are looked up first, the strongest; a bound on a score is compared with some room for rounding.
FIRST_TERMS, ROOM = 6, 1e-6


def bm25_pruned(queries: DataFrame, index: Index, k: int, k1: float = K1, b: float = B, tokens=search_tokens) -> DataFrame:
    """The result of :func:`bm25`, exact, over a written index: postings that can't bring a document among a query's k best aren't read.

    A block of postings tells its largest term frequency and least length, and so
    the most that a posting of it can add. The strongest terms give 2k documents a
    query, whose full scores, read from the postings by document, give a k-th
    score that the result must reach. Terms whose largest parts together stay
    below it can't bring in a document by themselves; of the others only blocks
    are read that reach it with all that the other terms may add. The documents
    found there are scored in full.
    """
    terms = kept(query_terms(queries, tokens=tokens), "terms")
    n_docs, avgdl = index.stats.first()
    score = F.col("qtf") * idf(F.col("df"), F.lit(n_docs)) * saturation(F.col("tf"), F.col("dl"), F.lit(avgdl), k1, b)
    most = F.col("qtf") * idf(F.col("df"), F.lit(n_docs)) * saturation(F.col("most_tf"), F.col("least_dl"), F.lit(avgdl), k1, b)
    own = kept(index.heads(terms, "most_tf", "least_dl").groupBy("query_id", "term", "qtf", "df").agg(F.max(most).alias("most")), "bounds")
    strongest = own.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("most").desc(), "term"))).where(F.col("i") <= FIRST_TERMS)

    def full(pairs: DataFrame) -> DataFrame:
        rows = index.of_documents(pairs).join(own, ["query_id", "term"])
        return rows.groupBy("query_id", "doc_id").agg(F.sum(score).alias("score"))

    first = index.weighted(strongest.select("query_id", "term", "qtf")).groupBy("query_id", "doc_id").agg(F.sum(score).alias("score"))
    seeds = kept(top_k(first, 2 * k).select("query_id", "doc_id"), "seeds")
    reached = top_k(full(seeds), k).where(F.col("rank") == k).select("query_id", (F.col("score") - ROOM).alias("floor"))
    up, all_ = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("query_id")
    judged_ = own.join(reached, "query_id", "left").withColumns({"floor": F.coalesce("floor", F.lit(0.0)), "below": F.sum("most").over(up), "all": F.sum("most").over(all_)})
    judged_ = kept(judged_.withColumn("weak", F.col("below") < F.col("floor")), "judged")
    strong = judged_.where("not weak").select("query_id", "term", "qtf", "floor", (F.col("all") - F.col("most")).alias("others"))
    rest = judged_.groupBy("query_id").agg(F.sum(F.when(F.col("weak"), F.col("most")).otherwise(0.0)).alias("rest"))
    blocks = index.heads(strong, "most_tf", "least_dl", "docs").where(most + F.col("others") >= F.col("floor"))
    part = blocks.select("query_id", "qtf", "df", "floor", F.inline("docs")).groupBy("query_id", "doc_id", "floor").agg(F.sum(score).alias("part")).join(rest, "query_id")
    found = part.where(F.col("part") + F.col("rest") >= F.col("floor")).select("query_id", "doc_id")
    return top_k(full(kept(found, "found")), k)


def tfidf(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """Cosine of tf / length * idf vectors. Terms that the corpus lacks weigh 1 in the query's length."""
    qw = query_weights(queries, index)
    if index.blocks is not None:
        qw = kept(qw, "weights")  # small, and read by the scan's pruning, the join and the queries' lengths
    qnorm = qw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    if index.forward is not None:
        w = F.col("qw") * idf(F.col("df"), F.col("n_docs")) / F.col("qnorm")
        found = _by_document(qw.join(index.df, "term").join(qnorm, "query_id").crossJoin(index.stats).select("query_id", "term", "df", w.alias("w")), index, k, None)
        if found is not None:
            return found
    scored = dot_products(qw, index).join(index.doc_norms(), "doc_id").join(qnorm, "query_id").select("query_id", "doc_id", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))
    return top_k(scored.where("score > 0"), k)


def query_weights(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, term, qw: share of the query's terms times idf; terms that the corpus lacks weigh as if their idf were 1."""
    q = query_terms(queries)
    total = q.groupBy("query_id").agg(F.sum("qtf").alias("ql"))
    return q.join(total, "query_id").join(index.df, "term", "left").crossJoin(index.stats).select("query_id", "term", (F.col("qtf") / F.col("ql") * F.coalesce(idf(F.col("df"), F.col("n_docs")), F.lit(1.0))).alias("qw"))


def dot_products(qw: DataFrame, index: Index) -> DataFrame:
    """query_id, doc_id, dot of query weights and tf / length * idf, over the documents that share a term."""
    w = F.col("tf") / F.col("dl") * idf(F.col("df"), F.col("n_docs"))
    return index.weighted(qw).crossJoin(index.stats).groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * w).alias("dot"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double; null where one has no length."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(d(x), d(y), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Query vectors that are sent to all tasks.
QUERY_BLOCK = 4096


def dense(queries: DataFrame, vectors: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """Exact cosine top-k of query vectors (query_id, vector) against all vectors (doc_id, vector): query_id, doc_id, score, rank.

    Up to ``block`` queries are sent to all tasks, each of which keeps its own k
    best, and only those are shuffled; more queries are packed into a table of
    blocks, which is joined with the vectors' blocks. Zero vectors have no result and are none.
    """
    spark = vectors.sparkSession
    ids = vectors.schema["doc_id"].dataType.simpleString()
    chunk = queries.where(F.exists("vector", lambda v: v != 0)).select("query_id", "vector").limit(block + 1).collect()
    if len(chunk) > block:
        return top_k(vector_index.exact_by_blocks(queries, vectors, k), k)
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {ids}, score double"
    if not chunk:
        return top_k(spark.createDataFrame([], kind), k)
    q = np.array([r["vector"] for r in chunk], float)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in chunk]), q))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = shared.value
        s, doc = np.zeros((len(names), 0)), None
        for pdf in batches:
            if not len(pdf):
                continue
            e = np.vstack(pdf["vector"].to_numpy()).astype(float)
            size = np.linalg.norm(e, axis=1)
            new = np.where(size[:, None] > 0, e @ q.T / np.where(size, size, 1)[:, None], -np.inf).T
            ids = np.broadcast_to(pdf["doc_id"].to_numpy(), new.shape)
            # The best so far and the batch: ties go to the smaller id.
            s, doc = np.hstack([s, new]), ids if doc is None else np.hstack([doc, ids])
            best = np.lexsort((doc, -s), axis=1)[:, :k]
            s, doc = np.take_along_axis(s, best, 1), np.take_along_axis(doc, best, 1)
        if doc is not None:
            got = pd.DataFrame({"query_id": np.repeat(names, s.shape[1]), "doc_id": doc.ravel(), "score": s.ravel()})
            yield got[np.isfinite(got["score"])]

    return top_k(vectors.select("doc_id", "vector").where("vector is not null").mapInPandas(run, kind), k)


def fuse(legs: list[DataFrame], k: int | None = None, weights: list[float] | None = None, rrf_k: int = RRF_K, key: str = "query_id") -> DataFrame:
    """Reciprocal rank fusion of legs (key, doc_id, score): key, doc_id, score, rank, n_legs. Ties go to the smaller id."""
    if weights is not None and len(weights) != len(legs):
        raise ValueError("as many weights as legs are needed")
    order = Window.partitionBy(key).orderBy(F.round("score", 9).desc(), "doc_id")
    parts = [leg.select(key, "doc_id", (F.lit(w) / (rrf_k + F.row_number().over(order))).alias("part")) for leg, w in zip(legs, weights or [1.0] * len(legs), strict=True)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    fused = both.groupBy(key, "doc_id").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("n_legs"))
    w = Window.partitionBy(key).orderBy(F.round("score", 12).desc(), "doc_id")
    ranked = fused.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def fuse_scores(legs: list[DataFrame], weights: list[float], how: str = "minmax") -> DataFrame:
    """Weighted sum of normalised scores: ``minmax`` (relative score), ``zscore`` (distribution-based) or ``raw``."""
    w = Window.partitionBy("query_id")
    made = []
    for leg, weight in zip(legs, weights, strict=True):
        s = F.col("score")
        if how == "minmax":
            x = F.coalesce(F.try_divide(s - F.min(s).over(w), F.max(s).over(w) - F.min(s).over(w)), F.lit(1.0))
        elif how == "zscore":
            x = F.coalesce(F.try_divide(s - F.avg(s).over(w), F.stddev_pop(s).over(w)), F.lit(0.0))
        elif how == "raw":
            x = s
        else:
            raise ValueError(how)
        made.append(leg.select("query_id", "doc_id", (weight * x).alias("part")))
    both = made[0]
    for m in made[1:]:
        both = both.unionByName(m)
    return both.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def overlap_scorer(query: Column, passage: Column) -> Column:
    """The built-in reranker: the share of the query's distinct words that the passage has."""
    q, p = F.array_distinct(words(F.lower(query))), words(F.lower(passage))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, p)), F.size(q)), F.lit(0.0))


def rerank(candidates: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = overlap_scorer, pool: int = POOL) -> DataFrame:
    """Rescores the best min(3k, pool) candidates (query_id, doc_id, score, query, passage) of each query; k stay.

    ``scorer`` is a Column function, built in or a pandas UDF that holds a model.
    """
    first = top_k(candidates, min(OVERFETCH * k, pool)).drop("rank")
    rescored = first.withColumnRenamed("score", "first_score").withColumn("score", scorer(F.col("query"), F.col("passage")))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("first_score").desc(), "doc_id")
    return rescored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def hybrid(queries: DataFrame, index: Index, vectors: DataFrame | None, query_vectors: DataFrame | None, k: int, weights: list[float] | None = None, trace: bool = False) -> DataFrame:
    """BM25 and dense legs of 3k each, fused, the k best. With ``trace`` a row per stage and candidate."""
    legs = {"bm25": bm25(queries, index, OVERFETCH * k)}
    if vectors is not None:
        legs["dense"] = kept(dense(query_vectors, vectors, OVERFETCH * k), "dense")  # read by every stage of the trace
    fused = fuse(list(legs.values()), None, weights)
    if not trace:
        return fused.where(F.col("rank") <= k)
    names = ["query_id", "doc_id", "score", "rank"]
    out = fused.select(F.lit("fused").alias("stage"), *names)
    for name, leg in legs.items():
        out = out.unionByName(leg.select(F.lit(name).alias("stage"), *names))
    return out.unionByName(fused.where(F.col("rank") <= k).select(F.lit("final").alias("stage"), *names))


def any_term(docs: DataFrame, terms: list[str], k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that contain any of the terms, by the share of terms they contain: scored before the limit."""
    low = F.lower(F.col(text_col))
    found = sum((F.when(F.contains(low, F.lit(t.lower())), 1).otherwise(0) for t in terms), F.lit(0))
    return docs.select(id_col, (found / len(terms)).alias("score")).where("score > 0").orderBy(F.col("score").desc(), id_col).limit(k)


def expand(queries: DataFrame, generator: Callable[[Column], Column]) -> DataFrame:
    """Queries with their reformulations: query_id, variant, text; ``generator`` gives an array of texts."""
    all_ = F.concat(F.array("text"), F.coalesce(generator(F.col("text")), F.array().cast("array<string>")))
    return queries.select("query_id", F.posexplode(all_).alias("variant", "text")).where("text is not null and text <> ''")


def multi_query(queries: DataFrame, index: Index, k: int, generator: Callable[[Column], Column]) -> DataFrame:
    """A BM25 leg per reformulation, fused into one ranking per query."""
    legs = expand(queries, generator).withColumn("leg", F.concat_ws("\u0001", F.col("query_id").cast("string"), F.col("variant").cast("string")))
    ranked = bm25(legs.select(F.col("leg").alias("query_id"), "text"), index, OVERFETCH * k)
    back = legs.select(F.col("leg").alias("query_id"), F.col("query_id").alias("source"))
    part = ranked.join(back, "query_id").select(F.col("source").alias("query_id"), "doc_id", (1.0 / (RRF_K + F.col("rank"))).alias("part"))
    return top_k(part.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 12).alias("score")), k)


def to_parents(ranked: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """Small-to-large: each result is replaced by its parent (doc_id, parent_id), the best rank of a parent counts."""
    parent = ranked.join(links, "doc_id", "left").select("query_id", F.coalesce("parent_id", "doc_id").alias("doc_id"), "score", "rank")
    best = parent.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.min("rank").alias("first"))
    w = Window.partitionBy("query_id").orderBy("first", "doc_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("first")
