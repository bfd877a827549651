"""Queries of paging, joins, aggregates, chunkers, versions, variants and sources (A, B, C, F, G, H, L, M, N, R rows)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessaria.functions import tokens as K
from tessaria.functions import variants as V
from tessaria.functions.text import question_form
from tessaria.operators import changes as C
from tessaria.functions import text as T
from tessaria.operators import chunking as H
from tessaria.operators import edits as E
from tessaria.operators import generation
from tessaria.operators import monitoring as N
from tessaria.operators import quality as Q
from tessaria.operators import versions as S
from tessaria.plans.base import query, quoted, rr, table
from tessaria.plans.text import QUESTION_SQL, WORD, _strip, encoding_sql, quality_sql, ratio_sql
from tessaria.sources import datasets, sinks
from tessaria.streaming import streams

long = lambda *cs: [F.col(c).cast("long").alias(c) for c in cs]
AS_OF = "1998-08-02"
as_of = lambda: F.lit(AS_OF).cast("timestamp")


def orders(spark, sf_dir):
    """Orders stand in for documents with a status, a category and a time of update."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("category"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))


ORD = "o AS (SELECT o_orderkey AS doc_id, o_orderstatus AS status, o_orderpriority AS category, o_orderdate AS updated_at FROM orders)"


def chunks(spark, sf_dir):
    """Documents as chunks: one each, with tokens, score and a judgement as verification."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.col("source").alias("category"), F.col("lang").alias("domain"), K.estimate_tokens(F.col("text")).alias("token_count"), K.quality_score(F.col("text")).alias("quality_score"), (F.coalesce("quality", F.lit(0)) == 1).alias("is_verified"), "text")


CH = f"c AS (SELECT d.doc_id, source AS category, lang AS domain, CAST(2 * length(regexp_extract_all(text, {WORD})) AS BIGINT) AS token_count, {quality_sql('text')} AS quality_score, coalesce(quality, 0) = 1 AS is_verified, text FROM documents d LEFT JOIN labels USING (doc_id))"

# --- C: projections, filters, paging -------------------------------------------------------------------------------------


@query("c1_list_page", f"WITH {ORD} SELECT doc_id, status, category FROM o WHERE status = 'O' AND category = '1-URGENT' ORDER BY updated_at DESC, doc_id LIMIT 20 OFFSET 20")
def list_page(spark, sf_dir):
    return N.list_page(orders(spark, sf_dir), {"status": "O", "category": "1-URGENT"}, "updated_at", "doc_id", 2, 20).select("doc_id", "status", "category")


@query("c1_page_count", f"WITH {ORD} SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS pages FROM o WHERE status = 'O'")
def page_count(spark, sf_dir):
    return N.page_count(orders(spark, sf_dir), {"status": "O", "category": None}, 20)


@query("c2_distinct_values", "SELECT DISTINCT o_orderstatus AS status FROM orders")
def distinct_values(spark, sf_dir):
    return orders(spark, sf_dir).select("status").distinct()


@query("c3_pruned_list", "SELECT doc_id, source, substr(text, 1, 300) AS preview FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def pruned_list(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy(F.col("n_chars").desc(), "doc_id").limit(50).select("doc_id", "source", F.substring("text", 1, 300).alias("preview"))


@query("c4_document_with_children", "SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = 7")
def with_children(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders").where("o_orderkey = 7"), table(spark, sf_dir, "lineitem")
    return o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", "l_partkey")


@query("c6_completeness", f"WITH {CH} SELECT count(*) AS n, count(*) FILTER (contains(text, '@')) AS has_mail, count(*) FILTER (contains(text, chr(10))) AS has_lines, count(*) FILTER (token_count < 80) AS short FROM c")
def completeness(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return Q.completeness(c, "text", {"has_mail": "@", "has_lines": "\n"}).crossJoin(c.agg(F.count_if(F.col("token_count") < 80).alias("short")))


@query("c6_shortest", f"WITH {CH} SELECT doc_id, token_count FROM c ORDER BY token_count, doc_id LIMIT 10")
def shortest(spark, sf_dir):
    return chunks(spark, sf_dir).orderBy("token_count", "doc_id").limit(10).select("doc_id", "token_count")


@query("c7_in_or_filter", f"WITH {ORD} SELECT doc_id FROM o WHERE status IN ('F', 'P') AND (updated_at < TIMESTAMP '1993-01-01' OR category = '5-LOW')")
def in_or(spark, sf_dir):
    return orders(spark, sf_dir).where(F.col("status").isin("F", "P") & ((F.col("updated_at") < F.lit("1993-01-01").cast("timestamp")) | (F.col("category") == "5-LOW"))).select("doc_id")


@query("c7_latest_running", f"WITH {ORD} SELECT doc_id, updated_at FROM o WHERE status = 'P' ORDER BY updated_at DESC, doc_id LIMIT 1")
def latest_running(spark, sf_dir):
    return orders(spark, sf_dir).where("status = 'P'").orderBy(F.col("updated_at").desc(), "doc_id").limit(1).select("doc_id", "updated_at")


@query("c8_versions_above_one", "SELECT l_orderkey, max(l_linenumber) AS version FROM lineitem GROUP BY l_orderkey HAVING max(l_linenumber) > 1")
def versions_above_one(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("version")).where("version > 1")


@query("c9_hash_sample", "SELECT doc_id, source FROM documents ORDER BY sha256(doc_id || '#3'), doc_id LIMIT 25")
def hash_sample(spark, sf_dir):
    return N.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 25, 3)


@query("c10_preview", "SELECT doc_id, substr(text, 1, 300) AS preview FROM documents")
def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 300).alias("preview"))


@query("c11_row_policy", "SELECT doc_id, lang AS domain FROM documents WHERE lang IN ('de', 'fr')")
def row_policy(spark, sf_dir):
    return N.by_domain(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain")), ["de", "fr"])


# --- G: joins ------------------------------------------------------------------------------------------------------------


@query("g1_left_join_title", "SELECT c.conv_id, turn, coalesce(d.source, 'Unknown') AS title FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id AND d.lang = 'en'")
def left_join_title(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source")
    return table(spark, sf_dir, "conversations").join(d, F.col("doc_id") == F.col("conv_id"), "left").select("conv_id", "turn", F.coalesce("source", F.lit("Unknown")).alias("title"))


@query("g2_inner_join", "SELECT vec_id, d.lang FROM embeddings JOIN documents d ON d.doc_id = vec_id")
def inner_join(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id")


@query("g3_known_ids", "SELECT doc_id, quality FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def known_ids(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_semi")


@query("g4_child_parent", "SELECT a.conv_id, a.turn, b.role AS parent_role FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = 0")
def child_parent(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn").join(c.where("turn = 0").select("conv_id", F.col("role").alias("parent_role")), "conv_id")


@query("g9_negatives", """
WITH q AS (SELECT DISTINCT label AS query_id FROM embeddings), n AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY sha256(query_id || '|' || vec_id), vec_id) AS k FROM q JOIN embeddings e ON e.label <> query_id)
SELECT query_id, vec_id AS doc_id, 0 AS rel FROM n WHERE k <= 2
""")
def negatives(spark, sf_dir):
    """Two negatives per label: the first in hash order of the vectors of other labels; labels are few."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = e.select(F.col("label").alias("query_id")).distinct()
    pairs = e.join(F.broadcast(q), F.col("label") != F.col("query_id"))
    w = Window.partitionBy("query_id").orderBy(F.sha2(F.concat_ws("|", F.col("query_id").cast("string"), F.col("vec_id").cast("string")), 256), "vec_id")
    return pairs.withColumn("k", F.row_number().over(w)).where("k <= 2").select("query_id", F.col("vec_id").alias("doc_id"), F.lit(0).alias("rel"))


CHANGE = """
a AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE lang <> 'es'), b AS (SELECT doc_id AS path, sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS h FROM documents WHERE lang <> 'fr'),
ch AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS status, a.h AS old, b.h AS new FROM a FULL JOIN b ON a.path = b.path)
"""


def change_tables(spark, sf_dir):
    """The stored corpus lacks Spanish; the incoming one lacks French and has changed German."""
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "path")
    h = lambda c: C.content_hash(c).alias("h")
    return d.where("lang <> 'es'").select("path", h(F.col("text"))), d.where("lang <> 'fr'").select("path", h(F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))))


@query("g10_ingest_decision", f"WITH {CHANGE} SELECT path, status, CASE status WHEN 'added' THEN 'create' WHEN 'modified' THEN 'update' WHEN 'unchanged' THEN 'skip' ELSE 'keep' END AS action FROM ch")
def ingest_decision(spark, sf_dir):
    return C.ingest_decision(C.change_set(*change_tables(spark, sf_dir), "path", "h")).select("path", "status", "action")


@query("g11_change_set", f"WITH {CHANGE} SELECT * FROM ch")
def change_set(spark, sf_dir):
    return C.change_set(*change_tables(spark, sf_dir), "path", "h")


@query("g12_orphans", "SELECT doc_id FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id AND lang = 'en')")
def orphans(spark, sf_dir):
    return C.orphans(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id").select("doc_id")


@query("g14_drift", "WITH r AS (SELECT count(*) AS n_recent, avg(value) AS recent FROM events WHERE ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31'), b AS (SELECT count(*) AS n_baseline, avg(value) AS baseline FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-24') SELECT n_recent, round(recent, 6) AS recent, n_baseline, round(baseline, 6) AS baseline, round((recent - baseline) / baseline, 6) AS change FROM r, b")
def drift(spark, sf_dir):
    d = N.drift(table(spark, sf_dir, "events"), F.lit("2024-01-31").cast("timestamp_ntz"), "value")
    return d.select("n_recent", F.round("recent", 6).alias("recent"), "n_baseline", F.round("baseline", 6).alias("baseline"), "change")


# --- H: aggregates -------------------------------------------------------------------------------------------------------


@query("h1_global_counts", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM orders) AS jobs, (SELECT count(*) FROM events) AS logs")
def global_counts(spark, sf_dir):
    n = lambda t, c: table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias(c))
    return n("documents", "documents").crossJoin(n("embeddings", "vectors")).crossJoin(n("orders", "jobs")).crossJoin(n("events", "logs"))


@query("h2_counts_by", "SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def counts_by(spark, sf_dir):
    return N.counts_by(table(spark, sf_dir, "documents"), "lang", "source")


SUMMARY = f"""WITH {CH} SELECT count(*) AS n_chunks, round(count(*)::DOUBLE / count(DISTINCT category), 2) AS chunks_per_doc, CAST(sum(token_count) AS BIGINT) AS tokens, round(avg(quality_score), 4) AS avg_quality,
min(token_count) AS min_tokens, max(token_count) AS max_tokens, round(avg(token_count), 4) AS avg_tokens, count(*) FILTER (is_verified) AS verified, count(*) FILTER (NOT is_verified) AS unverified FROM c"""


@query("h3_h4_h5_chunk_summary", SUMMARY)
def chunk_summary(spark, sf_dir):
    return N.chunk_summary(chunks(spark, sf_dir).drop("doc_id").withColumnRenamed("category", "doc_id"))


def stale_sql(days: int) -> str:
    return f"updated_at < TIMESTAMP '{AS_OF}' - INTERVAL {days} DAY"


@query("h6_staleness", f"WITH {ORD}, x AS (SELECT category, count(*) AS total, count(*) FILTER ({stale_sql(365)}) AS stale FROM o WHERE status = 'O' GROUP BY ROLLUP (category)) SELECT category, total, stale, round(100.0::DOUBLE * stale / total, 2) AS stale_pct FROM x")
def staleness(spark, sf_dir):
    return N.staleness(orders(spark, sf_dir), as_of(), 365, "O")


@query("h7_stale_list", f"WITH {ORD} SELECT doc_id, updated_at FROM o WHERE {stale_sql(500)} ORDER BY updated_at, doc_id")
def stale_list(spark, sf_dir):
    return N.stale_list(orders(spark, sf_dir).withColumn("content_hash", F.lit("x")), as_of(), 500).select("doc_id", "updated_at")


@query("h8_shelf_life", f"WITH {ORD} SELECT category, status, count(*) AS total, round(count(*) FILTER ({stale_sql(720)})::DOUBLE / nullif(count(*), 0), 6) AS stale_ratio FROM o GROUP BY ALL")
def shelf_life(spark, sf_dir):
    old = F.col("updated_at") < as_of() - F.make_interval(days=F.lit(720))
    return orders(spark, sf_dir).groupBy("category", "status").agg(F.count(F.lit(1)).alias("total"), F.round(F.try_divide(F.count_if(old), F.count(F.lit(1))), 6).alias("stale_ratio"))


@query("h12_duplication", "WITH g AS (SELECT text, count(*) AS n FROM documents GROUP BY text) SELECT count(*) AS distinct_keys, CAST(sum(n - 1) AS BIGINT) AS surplus, count(*) FILTER (n > 1) AS over_1, count(*) FILTER (n > 5) AS over_5 FROM g")
def duplication(spark, sf_dir):
    """Keyed by a hash of the text, so that texts aren't shuffled."""
    return C.duplication(table(spark, sf_dir, "documents"), C.content_hash(F.col("text")))


@query("h13_export_counts", "SELECT count(DISTINCT conv_id) AS documents, count(*) AS chunks_total, count(*) FILTER (role = 'user') AS qa_chunks, count(*) FILTER (role <> 'user') AS body_chunks FROM conversations")
def export_counts(spark, sf_dir):
    return sinks.export_counts(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.when(F.col("role") == "user", "qa_pair").otherwise("body").alias("chunk_type")))


@query("h15_similarity_by_format", "SELECT event_type, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY event_type")
def similarity_by_format(spark, sf_dir):
    r = lambda c, n: F.round(c, 6).alias(n)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(r(F.min("value"), "lo"), r(F.max("value"), "hi"), r(F.avg("value"), "mean"), F.count(F.lit(1)).alias("n"))


@query("h16_judge_stats", "SELECT count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) FILTER (value >= 0.7) AS passed FROM events")
def judge_stats(spark, sf_dir):
    return N.judge_stats(table(spark, sf_dir, "events"), "value")


@query("h17_validation_filter", "SELECT l_orderkey, l_linenumber, round((l_discount + l_tax + 0.9 + 0.9) / 4, 6) AS overall FROM lineitem WHERE round((l_discount + l_tax + 0.9 + 0.9) / 4, 6) >= 0.48")
def validation_filter(spark, sf_dir):
    overall = F.round((F.col("l_discount") + F.col("l_tax") + 0.9 + 0.9) / 4, 6)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", overall.alias("overall")).where("overall >= 0.48")


@query("h18_job_summary", f"WITH {CHANGE}, r AS (SELECT CASE status WHEN 'added' THEN 'create' WHEN 'modified' THEN 'update' WHEN 'unchanged' THEN 'skip' ELSE 'keep' END AS action, status <> 'removed' AS ok FROM ch) SELECT count(*) AS files, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok AND action = 'create') AS created, count(*) FILTER (ok AND action = 'update') AS updated, count(*) FILTER (action = 'skip') AS skipped, CAST(sum(CASE WHEN ok THEN 1 END) AS BIGINT) AS chunks FROM r")
def job_summary(spark, sf_dir):
    r = C.ingest_decision(C.change_set(*change_tables(spark, sf_dir), "path", "h"))
    return N.job_summary(r.select("action", (F.col("status") != "removed").alias("ok"), F.lit(1).cast("long").alias("n_chunks")))


@query("h20_integrity_by_source", "SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') OR contains(text, chr(65533))) AS bad FROM documents GROUP BY source")
def integrity_by_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(K.integrity_issues(F.col("text"))) > 0).alias("bad"))


@query("h22_cost_log", "SELECT l_returnflag AS operation, l_linestatus AS model, count(*) AS calls, round(sum(l_extendedprice), 2) AS cost FROM lineitem GROUP BY ALL")
def cost_log(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("operation"), F.col("l_linestatus").alias("model")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("l_extendedprice"), 2).alias("cost"))


@query("b5_latency_histogram", "WITH h AS (SELECT least(CAST(floor((value - 0.0) / (200.0 / 30)) AS BIGINT) + 1, 30) AS bin FROM events WHERE value BETWEEN 0 AND 200) SELECT bin, count(*) AS n FROM h GROUP BY bin")
def histogram(spark, sf_dir):
    return N.histogram(table(spark, sf_dir, "events"), "value", 0.0, 200.0, 30).select("bin", "n")


@query("r2_latency_percentiles", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def percentiles(spark, sf_dir):
    return N.latency_percentiles(table(spark, sf_dir, "events"), "value", "event_type")


@query("r7_type_entropy", "WITH g AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT source, n::DOUBLE / sum(n) OVER (PARTITION BY source) AS p FROM g) SELECT source, count(*) AS types, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY source")
def type_entropy(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source", "lang").count()
    p = F.col("count") / F.sum("count").over(Window.partitionBy("source"))
    return g.withColumn("p", p).groupBy("source").agg(F.count(F.lit(1)).alias("types"), F.round(-F.sum(F.col("p") * F.log("p")), 6).alias("entropy"))


# --- F: generators -------------------------------------------------------------------------------------------------------


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


BARE = f"regexp_replace(text, {quoted(f'[{T.WS}]+')}, '', 'g')"


def _bare(chunks):
    """Each document's pieces, put together in their order, without white space."""
    c = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "content"))).alias("all"))
    return c.select("doc_id", F.sha2(F.regexp_replace(F.array_join(F.transform("all", lambda x: x["content"]), ""), f"[{T.WS}]+", ""), 256).alias("bare"))


BARE_SQL = f"SELECT doc_id, sha256({BARE}) AS bare FROM documents WHERE {BARE} <> ''"


@query("f2_f3_fixed_chunker_is_whole", BARE_SQL)
def fixed_chunker_is_whole(spark, sf_dir):
    """But for overlaps and white space the pieces are the document."""
    return _bare(H.chunk(docs(spark, sf_dir), "fixed", overlap=0))


@query("f5_f8_f9_semantic_chunker_is_whole", BARE_SQL)
def semantic_chunker_is_whole(spark, sf_dir):
    return _bare(H.chunk(docs(spark, sf_dir), "semantic", overlap=0))


@query("f7_question_pieces", f"""
WITH d AS (SELECT conv_id AS doc_id, string_agg('سوال: ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
p AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(text, {quoted(H.QUESTION)}, chr(1) || '\\0', 'g'), chr(1)), lambda x: x <> '')) AS piece, generate_subscripts(list_filter(string_split(regexp_replace(text, {quoted(H.QUESTION)}, chr(1) || '\\0', 'g'), chr(1)), lambda x: x <> ''), 1) - 1 AS ordinal FROM d)
SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, {_strip('piece')} AS content FROM p
""")
def question_pieces(spark, sf_dir):
    """Conversations as texts of questions, cut before each."""
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    text = turns.select("doc_id", F.array_join(F.transform("t", lambda x: F.concat(F.lit("سوال: "), x["text"])), "\n").alias("text"))
    return H.semantic(text, doc_type="qa_pair", overlap=0).select("doc_id", "ordinal", "content")


WORDS = lambda c: f"CAST(2 * length(regexp_extract_all({c}, {WORD})) AS BIGINT)"
HEADING_SQL = _strip("regexp_extract(content, " + quoted(r"(?m)^#{1,6}[ \t]+(.+)$") + ", 1)")


def sentences_sql(source: str, key: str, text: str) -> str:
    """sent: key, i (from 1), s, n: the sentences of each text."""
    parts = f"list_filter(list_transform(string_split({rr(text, f'([.!؟?])[{T.WS}]+', chr(92) + '1' + chr(2))}, chr(2)), lambda x: {_strip('x')}), lambda x: x <> '')"
    return f"raw AS (SELECT {key}, {parts} AS ss FROM {source}), sent AS (SELECT {key}, s, i, {WORDS('s')} AS n FROM (SELECT {key}, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM raw))"


def pack_sql(most: int) -> str:
    """packed: doc_id, k, piece, n: sentences put together while they fit; one that is too long stands alone if nothing is held."""
    return f"""fold(doc_id, i, own, cur, empty, held) AS (
  SELECT doc_id, i, 0, CASE WHEN n >= {most} THEN 1 ELSE 0 END, n >= {most}, CASE WHEN n >= {most} THEN 0 ELSE n END FROM sent WHERE i = 1
  UNION ALL SELECT s.doc_id, s.i, CASE WHEN empty OR held + n <= {most} THEN cur ELSE cur + 1 END, CASE WHEN empty AND n >= {most} OR NOT empty AND held + n > {most} THEN cur + 1 ELSE cur END,
    empty AND n >= {most}, CASE WHEN empty AND n >= {most} THEN 0 WHEN NOT empty AND held + n <= {most} THEN held + n ELSE n END FROM fold f JOIN sent s ON s.doc_id = f.doc_id AND s.i = f.i + 1),
packed AS (SELECT doc_id, own AS k, string_agg(s, ' ' ORDER BY i) AS piece, CAST(sum(n) AS BIGINT) AS n FROM fold JOIN sent USING (doc_id, i) GROUP BY doc_id, own)"""


def absorb_sql(least: int) -> str:
    """chunks: doc_id, ordinal, content: pieces of which a short one takes in the next."""
    return f"""taken(doc_id, k, o, held) AS (
  SELECT doc_id, k, 0, n FROM packed WHERE k = 0
  UNION ALL SELECT p.doc_id, p.k, CASE WHEN held < {least} THEN o ELSE o + 1 END, CASE WHEN held < {least} THEN held + n ELSE n END FROM taken t JOIN packed p ON p.doc_id = t.doc_id AND p.k = t.k + 1),
chunks AS (SELECT doc_id, CAST(o AS BIGINT) AS ordinal, string_agg(piece, chr(10) || chr(10) ORDER BY k) AS content FROM taken JOIN packed USING (doc_id, k) GROUP BY doc_id, o)"""


def chunks_sql(overlap: int = H.OVERLAP, left: str = "…", right: str = "…") -> str:
    """The columns of a chunker over ``chunks``, with the last words of the one before ahead of each."""
    tail = f"regexp_extract_all(prev, {WORD})"
    n = overlap // 2
    return f"""before AS (SELECT *, {HEADING_SQL} AS heading_path, lag(content) OVER (PARTITION BY doc_id ORDER BY ordinal) AS prev FROM chunks),
full_ AS (SELECT doc_id, ordinal, heading_path, CASE WHEN prev IS NULL THEN content ELSE {quoted(left)} || array_to_string(list_slice({tail}, greatest(len({tail}) - {n - 1}, 1), len({tail})), ' ') || {quoted(right)} || chr(10) || content END AS content FROM before)
SELECT doc_id, ordinal, 'body' AS chunk_type, content, heading_path, {WORDS('content')} AS token_count FROM full_"""


@query("f2_fixed_chunker", f"WITH RECURSIVE {sentences_sql('documents', 'doc_id', 'text')}, {pack_sql(H.MAX_TOKENS)}, {absorb_sql(H.MIN_TOKENS)}, {chunks_sql()}")
def fixed_chunker(spark, sf_dir):
    return H.chunk(docs(spark, sf_dir), "fixed")


@query("f3_short_pieces", f"WITH RECURSIVE {sentences_sql('documents', 'doc_id', 'text')}, {pack_sql(40)}, {absorb_sql(30)}, {chunks_sql(20)}")
def short_pieces(spark, sf_dir):
    """The same with small pieces, of which many are too short."""
    return H.chunk(docs(spark, sf_dir), "fixed", most=40, least=30, overlap=20)


def _cut(text: str, pattern: str) -> str:
    return f"list_filter(string_split(regexp_replace({text}, {quoted(pattern)}, chr(1) || '\\0', 'g'), chr(1)), lambda x: {_strip('x')} <> '')"


def _first(text: str, patterns: list[str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {quoted(p)}) THEN {_cut(text, p)}" for p in patterns) + f" ELSE {otherwise} END"


def _finer(text: str) -> str:
    """The first mark that cuts a text in several pieces."""
    bars = f"length({text}) - length(replace({text}, '|', '')) >= 3"
    return "CASE " + " ".join(f"WHEN {f'{bars} AND ' if k == 0 else ''}len({_cut(text, p)}) > 1 THEN {_cut(text, p)}" for k, p in enumerate((H.PIPE_ROW, H.SCHEMA, H.BLANK_LINE, H.NEWLINE))) + f" ELSE [{text}] END"


def structure_sql(most: int, least: int, overlap: int) -> str:
    """Cut by the first structural mark, then more finely what is too long, then by sentences, then by length; short pieces take in the next."""
    latin = f"string_split({rr('t', '([.!?])' + f'[{T.WS}]+', chr(92) + '1' + chr(2))}, chr(2))"
    return f"""WITH RECURSIVE p1 AS (SELECT doc_id, unnest(ps) AS t, generate_subscripts(ps, 1) AS a FROM (SELECT doc_id, {_first('text', [H.ARTICLE, H.SECTION, H.HEADING, H.SHEET], '[text]')} AS ps FROM documents)),
p2 AS (SELECT doc_id, a, unnest(ps) AS t, generate_subscripts(ps, 1) AS b FROM (SELECT doc_id, a, CASE WHEN {WORDS('t')} > {most} THEN {_finer('t')} ELSE [t] END AS ps FROM p1)),
long AS (SELECT doc_id, a, b, t, {latin} AS ss FROM p2 WHERE {WORDS('t')} > {most}),
sent AS (SELECT doc_id, a, b, s, i, {WORDS('s')} AS n FROM (SELECT doc_id, a, b, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM long WHERE len(ss) > 1)),
fold(doc_id, a, b, i, own, held) AS (
  SELECT doc_id, a, b, i, 0, n FROM sent WHERE i = 1
  UNION ALL SELECT s.doc_id, s.a, s.b, s.i, CASE WHEN held + n <= {most} THEN own ELSE own + 1 END, CASE WHEN held + n <= {most} THEN held + n ELSE n END FROM fold f JOIN sent s ON s.doc_id = f.doc_id AND s.a = f.a AND s.b = f.b AND s.i = f.i + 1),
p3 AS (SELECT doc_id, a, b, 0 AS c, t FROM p2 WHERE {WORDS('t')} <= {most}
  UNION ALL SELECT doc_id, a, b, own, {_strip("string_agg(s, ' ' ORDER BY i)")} FROM fold JOIN sent USING (doc_id, a, b, i) GROUP BY doc_id, a, b, own HAVING {_strip("string_agg(s, ' ' ORDER BY i)")} <> ''
  UNION ALL SELECT doc_id, a, b, x, substr(t, CAST(x AS BIGINT) * {4 * most} + 1, {4 * most}) FROM (SELECT doc_id, a, b, t, unnest(range(0, (length(t) - 1) // {4 * most} + 1)) AS x FROM long WHERE len(ss) = 1)),
packed AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, b, c) - 1 AS k, t AS piece, {WORDS('t')} AS n FROM p3),
{absorb_sql(least).replace("string_agg(piece, chr(10) || chr(10) ORDER BY k)", _strip("string_agg(piece, chr(10) || chr(10) ORDER BY k)"))},
{chunks_sql(overlap, *H.SEMANTIC_MARKS).replace("FROM chunks)", "FROM chunks WHERE content <> '')")}"""


@query("f5_f8_semantic_chunker", structure_sql(H.MAX_TOKENS, H.MIN_TOKENS, H.OVERLAP))
def semantic_chunker(spark, sf_dir):
    return H.chunk(docs(spark, sf_dir), "semantic")


@query("f9_f10_fine_pieces", structure_sql(24, 16, 10))
def fine_chunker(spark, sf_dir):
    """The same with pieces so small that lines, sentences and cuts by length are all needed."""
    return H.chunk(docs(spark, sf_dir), "semantic", most=24, least=16, overlap=10)


@query("f17_sentence_aware_chunker", f"""
WITH RECURSIVE {sentences_sql('documents', 'doc_id', 'text')}, c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS c FROM sent),
tails AS (SELECT a.doc_id, a.i, coalesce(min(b.i), any_value(a.i) + 1) AS j FROM c a LEFT JOIN c b ON b.doc_id = a.doc_id AND b.i <= a.i AND b.i > a.i - {H.OVERLAP} AND a.c - b.c + b.n <= {H.OVERLAP} GROUP BY a.doc_id, a.i),
fold(doc_id, i, a, flush) AS (
  SELECT doc_id, i, i, CAST(NULL AS BIGINT) FROM c WHERE i = 1
  UNION ALL SELECT x.doc_id, x.i, CASE WHEN p.c - q.c + q.n + x.n > {H.MAX_TOKENS} THEN t.j ELSE f.a END, CASE WHEN p.c - q.c + q.n + x.n > {H.MAX_TOKENS} THEN f.a END
  FROM fold f JOIN c x ON x.doc_id = f.doc_id AND x.i = f.i + 1 JOIN c p ON p.doc_id = f.doc_id AND p.i = f.i JOIN c q ON q.doc_id = f.doc_id AND q.i = f.a JOIN tails t ON t.doc_id = f.doc_id AND t.i = f.i),
pieces AS (SELECT doc_id, flush AS a, i - 1 AS e FROM fold WHERE flush IS NOT NULL UNION ALL SELECT doc_id, max_by(a, i), max(i) FROM fold GROUP BY doc_id),
chunks AS (SELECT p.doc_id, e, string_agg(s, ' ' ORDER BY i) AS content FROM pieces p JOIN sent t ON t.doc_id = p.doc_id AND t.i BETWEEN a AND e GROUP BY p.doc_id, a, e)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1 AS ordinal, 'body' AS chunk_type, content, {HEADING_SQL} AS heading_path, {WORDS('content')} AS token_count FROM chunks
""")
def sentence_chunker(spark, sf_dir):
    return H.chunk(docs(spark, sf_dir), "sentence")


@query("f6_split_on_pattern", f"WITH p AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(text, '(?m)^[A-Z][a-z]*', chr(1) || '\\0', 'g'), chr(1)), lambda x: {_strip('x')} <> '')) AS piece FROM documents) SELECT doc_id, count(*) AS n, CAST(sum(length(piece)) AS BIGINT) AS chars FROM p GROUP BY doc_id")
def split_on_pattern(spark, sf_dir):
    p = docs(spark, sf_dir).select("doc_id", F.explode(H.split_on(F.col("text"), "(?m)^[A-Z][a-z]*")).alias("piece"))
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("piece")).alias("chars"))


LINES = f"l AS (SELECT doc_id, {_strip('u')} AS content, pos - 1 AS ordinal FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE {_strip('u')} <> '')"


@query("f15_build_chunks", f"WITH {LINES} SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, content, CAST(2 * length(regexp_extract_all(content, {WORD})) AS BIGINT) AS token_count FROM l")
def build_chunks(spark, sf_dir):
    return H.build(docs(spark, sf_dir), "doc_id", F.split("text", "\n")).select("doc_id", "ordinal", "content", "token_count")


@query("f4_overlap", f"""
WITH {LINES}, b AS (SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY ordinal) AS prev FROM l)
SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, CASE WHEN prev IS NULL THEN content ELSE '…' || array_to_string(list_slice(regexp_extract_all(prev, {WORD}), greatest(len(regexp_extract_all(prev, {WORD})) - 24, 1), len(regexp_extract_all(prev, {WORD}))), ' ') || '…' || chr(10) || content END AS content FROM b
""")
def overlap(spark, sf_dir):
    return H.with_overlap(H.build(docs(spark, sf_dir), "doc_id", F.split("text", "\n")), "doc_id").select("doc_id", "ordinal", "content")


@query("f10_hard_cut", "WITH s AS (SELECT doc_id, text, unnest(range(0, CAST(length(text) AS BIGINT), 2048)) AS start FROM documents) SELECT doc_id, CAST(start // 2048 AS BIGINT) AS piece, substr(text, CAST(start AS BIGINT) + 1, 2048) AS content FROM s")
def hard_cut(spark, sf_dir):
    cuts = F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(2048)), lambda i: F.substr(F.col("text"), i + 1, F.lit(2048)))).alias("piece", "content")
    return docs(spark, sf_dir).where("text <> ''").select("doc_id", cuts).select("doc_id", F.col("piece").cast("long").alias("piece"), "content")


@query("f14_heading_path", f"SELECT doc_id, {_strip(chr(114) + 'egexp_extract(text, ' + quoted('(?m)^#{1,6}[ ' + chr(92) + 't]+(.+)$') + ', 1)')} AS heading FROM documents")
def heading(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", H.heading_path(F.col("text")).alias("heading"))


@query("f16_law_sections", f"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(text, {WORD})[1:3], lambda w: NOT regexp_matches(w, '[^a-zA-Z]')) AS ws FROM documents),
s AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d) SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, (CASE i WHEN 1 THEN 'ماده ١ ' WHEN 2 THEN 'بند (٢) ' ELSE 'المادة 3 ' END) || w AS section FROM s
""")
def law_sections(spark, sf_dir):
    """The first words of each document as sections of a law, behind a preface that is none."""
    ws = F.filter(F.slice(K.words(F.col("text")), 1, 3), lambda w: ~w.rlike("[^a-zA-Z]"))
    marks = F.array(*map(F.lit, ("ماده ١ ", "بند (٢) ", "المادة 3 ")))
    text = F.concat(F.lit("preface "), F.array_join(F.zip_with(F.slice(marks, F.lit(1), F.size("ws")), "ws", lambda m, w: F.concat(m, w)), "\n"))
    rows = docs(spark, sf_dir).select("doc_id", ws.alias("ws")).select("doc_id", text.alias("text"))
    return rows.select("doc_id", F.posexplode(H.law_sections(F.col("text"))).alias("pos", "section"))


def sheets(spark, sf_dir):
    """Every three conversations as a file of three sheets: a row per question and answer, with a keyword."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("row_no"))
    side = lambda k: F.coalesce(F.max(F.when(F.col("turn") % 2 == k, F.col("text"))), F.lit(""))
    pairs = c.agg(F.array(side(0), side(1), F.concat(F.lit("k"), (F.first("conv_id") % 5).cast("string"))).alias("row"))
    rows = pairs.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "row"))), lambda x: x["row"]).alias("rows"))
    nth = F.col("conv_id") % 3
    return rows.select(F.floor(F.col("conv_id") / 3).alias("doc_id"), nth.cast("int").alias("sheet_no"), F.concat(F.lit("s"), nth.cast("string")).alias("name"), F.lit("crm_qa").alias("schema"), F.array(*map(F.lit, ("Question", "Answer", "Keyword"))).alias("headers"), "rows")


PAIRS = """pairs AS (SELECT conv_id // 3 AS doc_id, conv_id % 3 AS sheet_no, 's' || conv_id % 3 AS sheet_name, turn // 2 AS i, coalesce(max(CASE WHEN turn % 2 = 0 THEN text END), '') AS q, coalesce(max(CASE WHEN turn % 2 = 1 THEN text END), '') AS a, 'k' || conv_id % 5 AS k FROM conversations GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sheet_no ORDER BY i) - 1 AS row_no FROM pairs)"""
_cell = lambda c: f"replace({_strip(c)}, chr(10), ' ')"
ROWS_SQL = f"""{PAIRS}, kids AS (SELECT doc_id, sheet_no, row_no, row_number() OVER (PARTITION BY doc_id ORDER BY sheet_no, row_no) - 1 AS ordinal, sheet_name, {_cell('q')} AS question,
  'سوال: ' || {_cell('q')} || chr(10) || 'پاسخ کامل: ' || {_cell('a')} || chr(10) || 'کلیدواژه‌ها: ' || k AS content FROM numbered WHERE {_cell('q')} <> '' AND {_cell('a')} <> '')"""


@query("f11_f12_sheet_rows", f"WITH {ROWS_SQL} SELECT doc_id, sheet_no, row_no, ordinal, sheet_name, content FROM kids")
def sheet_rows(spark, sf_dir):
    return H.sheet_rows(sheets(spark, sf_dir)).select(*long("doc_id", "sheet_no", "row_no", "ordinal"), "sheet_name", "content")


@query("f13_parents", f"WITH {ROWS_SQL} SELECT doc_id, sheet_name AS parent_key, string_agg(content, chr(10) || chr(10) ORDER BY ordinal) AS content, count(*) AS child_count FROM kids GROUP BY ALL")
def parents(spark, sf_dir):
    return H.parents(H.sheet_rows(sheets(spark, sf_dir))).select("doc_id", "parent_key", "content", "child_count")


@query("a5_sheet_text", f"""
WITH {PAIRS}, lines AS (SELECT doc_id, sheet_no, sheet_name, row_no, concat_ws(' | ', CASE WHEN {_strip('q')} <> '' THEN 'Question: ' || regexp_replace(q, '[\r\n]+', ' ', 'g') END, CASE WHEN {_strip('a')} <> '' THEN 'Answer: ' || regexp_replace(a, '[\r\n]+', ' ', 'g') END, 'Keyword: ' || k) AS line FROM numbered)
SELECT doc_id, sheet_no, '=== Sheet: ' || sheet_name || ' ===' || chr(10) || '[Schema: crm_qa]' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY row_no) AS text FROM lines GROUP BY doc_id, sheet_no, sheet_name
""")
def sheet_text(spark, sf_dir):
    return sheets(spark, sf_dir).select("doc_id", "sheet_no", H.sheet_text(F.col("name"), F.col("schema"), F.col("headers"), F.col("rows")).alias("text"))


@query("l2_question_dedup", f"WITH r AS (SELECT conv_id, turn, {QUESTION_SQL} AS k FROM conversations WHERE role = 'user'), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY conv_id, turn) AS i FROM r WHERE k <> '') SELECT conv_id, turn FROM n WHERE i = 1")
def question_dedup(spark, sf_dir):
    return C.keep_first(table(spark, sf_dir, "conversations").where("role = 'user'"), question_form(F.col("text")), "conv_id", "turn").select("conv_id", "turn")


@query("l2_sheet_question_dedup", f"WITH {ROWS_SQL}, keyed AS (SELECT *, {QUESTION_SQL.replace('text', 'question')} AS key FROM kids), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, sheet_no, row_no) AS n FROM keyed WHERE key <> '') SELECT doc_id, sheet_no, question FROM f WHERE n = 1")
def sheet_dedup(spark, sf_dir):
    return H.sheet_rows(sheets(spark, sf_dir), dedup=True).select("doc_id", "sheet_no", "question")


@query("l18_detect_schema", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'crm_qa' WHEN 1 THEN 'reason_codes' WHEN 2 THEN NULL ELSE 'articles' END AS schema FROM documents")
def schemas(spark, sf_dir):
    """Each document's source and language as two columns among those of a known sheet, or of none."""
    kinds = [["Question", "Brief Answer", "ANSWER"], ["Reason Code", "model_name", "Model-ID", "brief_explanation", "keywords", "bin score", "bin impact", "data source", "Feature Name"], ["a", "b", None], ["Title", "Content", "Type", "Version", "Summary", "Heading"]]
    known = F.get(F.array(*[F.array(*map(F.lit, k)) for k in kinds]), (F.col("doc_id") % 4).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", H.detect_schema(F.concat(F.array("source", "lang"), known)).alias("schema"))


# --- L: state, versions, validation --------------------------------------------------------------------------------------


@query("l1_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", C.content_hash(F.col("text")).alias("hash"))


@query("l4_replace_children", "SELECT l_orderkey, l_linenumber, 0 AS fresh FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 1, 1 FROM orders WHERE o_orderstatus = 'P'")
def replace_children(spark, sf_dir):
    old = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0).alias("fresh"))
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(1).alias("fresh"))
    return C.replace_children(old, new, "l_orderkey")


@query("l5_embed_missing", "SELECT doc_id, sha256(text) AS hash FROM documents")
def embed_missing(spark, sf_dir):
    """English texts are in the cache; the others are embedded once per text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    cache = d.where("lang = 'en'").groupBy(C.content_hash(F.col("text")).alias("hash")).agg(F.array(F.lit(1.0)).alias("vector"))
    return C.embed_missing(d, cache, "text", lambda c: C.hash_embed(c, 16)).where("vector is not null").select("doc_id", "hash")


def turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    kids = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.col("role").alias("chunk_type"), F.col("text").alias("content"), F.lit("").alias("heading_path"), K.estimate_tokens(F.col("text")).alias("token_count"))
    parents_ = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.min_by("role", "turn").alias("title")).withColumns({"domain": F.lit("d"), "category": F.lit("c")})
    return parents_, kids


SNAP = "s AS (SELECT conv_id AS doc_id, 1 AS version, count(*) AS chunk_count, sha256(string_agg(sha256(text), '|' ORDER BY turn)) AS content_hash, 'snapshot' AS status FROM conversations GROUP BY conv_id)"


@query("l7_snapshot", f"WITH {SNAP} SELECT * FROM s")
def snapshot(spark, sf_dir):
    return S.snapshot(*turns(spark, sf_dir), F.lit(1)).drop("snapshot_data")


@query("l9_rollback", f"WITH {SNAP} SELECT doc_id, version, chunk_count, status FROM s UNION ALL SELECT doc_id, 2, chunk_count, 'rollback' FROM s WHERE chunk_count > 2")
def rollback(spark, sf_dir):
    v = S.snapshot(*turns(spark, sf_dir), F.lit(1))
    return S.rollback(v, v.where("chunk_count > 2").select("doc_id", "version")).select("doc_id", "version", "chunk_count", "status")


@query("l9_restored_chunks", "SELECT conv_id AS doc_id, turn AS ordinal, text AS content FROM conversations")
def restored(spark, sf_dir):
    v = S.snapshot(*turns(spark, sf_dir), F.lit(1))
    return S.restored_chunks(v, v.select("doc_id", "version")).select("doc_id", "ordinal", "content")


@query("l8_history_latest", "SELECT l_orderkey AS doc_id, max(l_linenumber) AS version FROM lineitem GROUP BY l_orderkey")
def latest(spark, sf_dir):
    return S.latest(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("version"))).select("doc_id", "version")


ERR = f"list_filter([CASE WHEN length(text) < 20 THEN 'too_short' END, CASE WHEN length(text) > 10000 THEN 'too_long' END, CASE WHEN {encoding_sql('text', True)} < 0.8 THEN 'low_encoding_quality' END, CASE WHEN {ratio_sql('text')} < 0.1 THEN 'low_persian_ratio' END], lambda x: x IS NOT NULL)"
ERRORS = f"CASE WHEN {_strip('text')} = '' THEN ['empty'] ELSE {ERR} END"


@query("l11_validate_chunks", f"SELECT doc_id, array_to_string({ERRORS}, '|') AS errors FROM documents")
def validate_chunks(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(Q.chunk_errors(F.col("text")), "|").alias("errors"))


@query("l12_validate_documents", f"WITH e AS (SELECT source, count(*) AS n_chunks, count(*) FILTER (len({ERRORS}) > 0) AS n_failed FROM documents GROUP BY source) SELECT source AS doc_id, n_chunks, n_failed, n_failed = 0 AS valid FROM e")
def validate_documents(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("text").alias("content"))
    d = c.select("doc_id").distinct().withColumns({"title": F.col("doc_id"), "source_path": F.col("doc_id")})
    return Q.validate_documents(d, c).select("doc_id", "n_chunks", "n_failed", "valid")


@query("l13_issue_codes", f"SELECT d.doc_id, array_to_string(list_filter([CASE WHEN length(text) < 50 THEN 'too_short' END, CASE WHEN length(text) > 2000 THEN 'too_long' END, CASE WHEN {ratio_sql('text')} < 0.3 THEN 'low_persian' END, CASE WHEN vec_id IS NULL THEN 'missing_embedding' END], lambda x: x IS NOT NULL), '|') AS issues FROM documents d LEFT JOIN embeddings ON vec_id = d.doc_id")
def issue_codes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source").join(e, "doc_id", "left")
    return d.select("doc_id", F.array_join(Q.issue_codes(F.col("text"), F.col("source"), F.col("has").isNotNull()), "|").alias("issues"))


@query("l14_updates", f"""
WITH e AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'delete' WHEN quality = 1 THEN 'verify' ELSE 'edit' END AS action FROM labels),
c AS (SELECT d.doc_id, CASE WHEN action = 'edit' THEN 'edited ' || text ELSE text END AS content, action FROM documents d LEFT JOIN e USING (doc_id))
SELECT doc_id, sha256(content) AS hash, CAST(2 * length(regexp_extract_all(content, {WORD})) AS BIGINT) AS token_count, coalesce(action = 'verify', false) AS is_verified, CASE WHEN action = 'delete' THEN 'deleted' ELSE 'active' END AS status FROM c
""")
def updates(spark, sf_dir):
    """Labelled documents are verified, edited or deleted; an earlier edit of each is overruled."""
    chunks = docs(spark, sf_dir).select("doc_id", F.col("text").alias("content"), K.estimate_tokens(F.col("text")).alias("token_count"), F.lit(False).alias("is_verified"), F.lit("active").alias("status"))
    action = F.when(F.col("toxic") == 1, E.DELETE).when(F.col("quality") == 1, E.VERIFY).otherwise(E.EDIT)
    last = table(spark, sf_dir, "labels").join(docs(spark, sf_dir), "doc_id").select("doc_id", action.alias("action"), F.concat(F.lit("edited "), "text").alias("content"), F.lit(2).alias("at"))
    first = last.select("doc_id", F.lit(E.EDIT).alias("action"), F.lit("overruled").alias("content"), F.lit(1).alias("at"))
    return E.apply_edits(chunks, first.unionByName(last), "doc_id").select("doc_id", C.content_hash(F.col("content")).alias("hash"), "token_count", "is_verified", "status")


@query("l19_version_diff", "SELECT DISTINCT conv_id AS doc_id, CASE WHEN conv_id % 7 = 0 THEN 'removed' WHEN conv_id % 5 = 0 THEN 'modified' ELSE 'unchanged' END AS status FROM conversations")
def version_diff(spark, sf_dir):
    """The corpus against a version that lacks every seventh conversation and has another text in every fifth."""
    heads, kids = turns(spark, sf_dir)
    other = kids.withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    new = S.snapshot(heads.where("doc_id % 7 <> 0"), other.where("doc_id % 7 <> 0"), F.lit(2))
    return S.diff(S.snapshot(heads, kids, F.lit(1)), new).select("doc_id", "status")


@query("l17_version_stamp", "SELECT doc_id, 3 AS corpus_version FROM documents")
def stamp(spark, sf_dir):
    return S.stamp(docs(spark, sf_dir), 3, as_of()).select("doc_id", "corpus_version")


@query("r1_to_parents", "WITH r AS (SELECT conv_id AS query_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank, length(text) AS score FROM conversations), p AS (SELECT query_id, turn // 2 AS doc_id, min(rank) AS first, max(score) AS score FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, doc_id) AS rank FROM p) SELECT query_id, doc_id, CAST(score AS BIGINT) AS score, rank FROM k WHERE rank <= 2")
def to_parents(spark, sf_dir):
    from tessaria.operators.ranking import to_parents as expand

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("doc_id"), F.char_length("text").cast("long").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    links = c.select("doc_id").distinct().select("doc_id", F.floor(F.col("doc_id") / 2).alias("parent_id"))
    return expand(c.withColumn("rank", F.row_number().over(w)), links, 2).withColumn("rank", F.col("rank").cast("long"))


@query("r8_merge_chunks", "SELECT conv_id, turn // 2 AS part, string_agg(text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY ALL")
def merge_chunks(spark, sf_dir):
    return E.merge_chunks(turn_chunks(spark, sf_dir), "conv_id", F.floor(F.col("ordinal") / 2))


def turn_chunks(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.col("text").alias("content"))


@query("r8_split_chunks", f"""
WITH p AS (SELECT conv_id, turn, unnest(string_split(text, '. ')) AS piece, generate_subscripts(string_split(text, '. '), 1) AS pos FROM conversations),
k AS (SELECT conv_id, turn, pos, {_strip('piece')} AS content FROM p)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS ordinal, content FROM k WHERE content <> ''
""")
def split_chunks(spark, sf_dir):
    return E.split_chunks(turn_chunks(spark, sf_dir), "conv_id", r"\. ")


# --- M: variants ---------------------------------------------------------------------------------------------------------


def bench(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.lit(None).cast("string").alias("keywords"))


@query("m1_verbatim", "SELECT item_id AS query_id, regexp_replace(text, '؟+$', '') AS query FROM benchmark")
def verbatim(spark, sf_dir):
    return bench(spark, sf_dir).select("query_id", V.verbatim(F.col("question")).alias("query"))


@query("m6_formats", "SELECT item_id AS query_id, f AS format, d AS difficulty FROM benchmark, (VALUES ('verbatim', 'easy'), ('paraphrase', 'medium'), ('typo', 'medium'), ('reworded', 'hard'), ('keyword_only', 'hard'), ('conversational', 'hard')) v(f, d)")
def formats(spark, sf_dir):
    rows = bench(spark, sf_dir).select("query_id", F.explode(F.array(*map(F.lit, V.DIFFICULTY))).alias("format"))
    return rows.select("query_id", "format", V.difficulty(F.col("format")).alias("difficulty"))


@query("m2_m7_variants")
def variants(spark, sf_dir):
    return V.all_variants(bench(spark, sf_dir))


@query("m8_pairs", "WITH r AS (SELECT CAST(item_id AS VARCHAR) AS d, row_number() OVER (ORDER BY sha256(CAST(item_id AS VARCHAR) || '#0')) - 1 AS i, count(*) OVER () AS n FROM benchmark) SELECT d AS query_id, d AS doc_id, 1 AS rel FROM r UNION ALL SELECT a.d, b.d, 0 FROM r a JOIN r b ON b.i = (a.i + 1) % a.n OR b.i = (a.i + 2) % a.n")
def pairs(spark, sf_dir):
    """Every question with its own chunk and two negatives, its successors in hash order."""
    chunks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), F.col("text").alias("question"))
    return generation.dataset_from_pairs(chunks, 2)[1]


def _cover(a: str, b: str) -> str:
    words = lambda x: f"regexp_extract_all(lower({x}), {WORD})"
    return f"coalesce(len(list_intersect(list_distinct({words(a)}), {words(b)}))::DOUBLE / nullif(len(list_distinct({words(a)})), 0), 0)"


@query("j12_judges", f"""
WITH r AS (SELECT doc_id, substr(text, 1, 80) AS question, substr(text, 41, 80) AS answer, substr(text, 1, 200) AS contexts, substr(text, 61, 120) AS truth FROM documents),
j AS (SELECT doc_id, {_cover('answer', 'contexts')} AS faithfulness, {_cover('question', 'answer')} AS answer_relevancy, {_cover('truth', 'contexts')} AS context_precision, {_cover('truth', 'contexts')} AS context_recall FROM r)
SELECT doc_id, round(faithfulness, 6) AS faithfulness, round(answer_relevancy, 6) AS answer_relevancy, round(context_precision, 6) AS context_precision, round(context_recall, 6) AS context_recall, round((faithfulness + answer_relevancy + context_precision + context_recall) / 4, 6) AS mean FROM j
""")
def judges(spark, sf_dir):
    """Answers judged by their overlap with contexts and truth, on parts of each document."""
    part = lambda a, n: F.substring("text", a, n)
    rows = docs(spark, sf_dir).select("doc_id", part(1, 80).alias("question"), part(41, 80).alias("answer"), part(1, 200).alias("contexts"), part(61, 120).alias("truth"))
    return generation.judge(rows).select("doc_id", *[F.round(c, 6).alias(c) for c in (*generation.JUDGES, "mean")])


@query("m9_role_check", "WITH g AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id) SELECT conv_id, len(r) >= 3 AND len(list_filter(r, lambda x: x NOT IN ('user', 'assistant', 'system'))) = 0 AS valid FROM g")
def role_check(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("r"))
    return g.select("conv_id", ((F.size("r") >= 3) & F.forall("r", lambda x: x.isin("user", "assistant", "system"))).alias("valid"))


@query("m10_benchmark_format", "SELECT 'q_' || (row_number() OVER (ORDER BY item_id) - 1) AS query_id, text FROM benchmark")
def benchmark_format(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", F.col("item_id").alias("docid"), F.col("text").alias("answer"))
    return datasets.retrieval_dataset(b, "item_id", "text", "answer", "docid")[0]


@query("a9_retrieval_dataset", "WITH n AS (SELECT conv_id, turn, role, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i FROM conversations) SELECT role AS doc_id, arg_max(text, i) AS text FROM n WHERE text <> '' GROUP BY role")
def retrieval_corpus(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "role", "text")
    return datasets.retrieval_dataset(c, "k", "text", "text", "role")[1]


@query("a9_retrieval_judgements", "WITH n AS (SELECT conv_id, turn, role, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i FROM conversations) SELECT 'q_' || i AS query_id, role AS doc_id, 1 AS rel FROM n WHERE text <> ''")
def retrieval_judgements(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "role", "text")
    return datasets.retrieval_dataset(c, "k", "text", "text", "role")[2]


# --- N: the batch twins of the streams -----------------------------------------------------------------------------------


@query("n_windowed", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY ALL")
def windowed(spark, sf_dir):
    return streams.windowed(table(spark, sf_dir, "events"))


@query("n_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM k GROUP BY user_id, sid")
def sessions(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"))
