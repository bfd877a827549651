"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessaria.llm import decontaminate, exact_dedup, html_extract, language_id, near_dedup, packing, sharding, substring_dedup, token_counts, url_filter, vector_codes, warc, whitening
from tessaria.llm.common import shared_dir, table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates over all documents: doc_id, class_id, rep_id, kept."""
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages: page_id, url, text, n_chars."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents: doc_id, held_out, lang_pred, score."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences, a row per piece."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on all urls."""
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated windows of twenty words."""
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of all documents."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents as one batch of inserts and commits it twice: the replay adds nothing."""
    rollup = token_counts.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    rollup.commit("load", inserts=counted)
    rollup.commit("load", inserts=counted)
    return rollup.totals()


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by the law of bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark windows in all documents."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all usable embeddings: 16 parts, 64 entries, 2 rounds."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings on the four largest components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back from them."""
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_dedup, op2_html_extract, op3_language_id, op4_packing, op5_url_filter, op6_substring_dedup, op7_exact_dedup, op8_token_counts, op9_sharding, op10_decontamination, op11_vector_codes, op12_whitening, op13_warc)
}

def _codes_sql(rounds: int = 2) -> str:
    """Codes of vectors of 64 components: a part is four columns, each round a join of parts and entries."""
    four = range(1, 5)
    sql = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
parts AS (SELECT vec_id, p, {', '.join(f'x[4 * p + {d}] AS x{d}' for d in four)} FROM v, range(16) t(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v QUALIFY k < 64),
c0 AS (SELECT p, k, {', '.join(f'x{d} AS c{d}' for d in four)} FROM parts JOIN first USING (vec_id))"""
    for r in range(rounds + 1):
        far = " + ".join(f"(x{d} - c{d}) * (x{d} - c{d})" for d in four)
        sql += f""",
a{r} AS (SELECT vec_id, p, {', '.join(f'any_value(x{d}) AS x{d}' for d in four)}, min({far}) AS far, arg_min(k, ({far}) * 64 + k) AS k FROM parts JOIN c{r} USING (p) GROUP BY vec_id, p)"""
        if r < rounds:
            sql += f""",
s{r} AS (SELECT p, k, {', '.join(f'CAST(floor(sum(x{d}) / count(*)) AS BIGINT) AS s{d}' for d in four)} FROM a{r} GROUP BY p, k),
c{r + 1} AS (SELECT p, k, {', '.join(f'coalesce(s{d}, c{d}) AS c{d}' for d in four)} FROM c{r} LEFT JOIN s{r} USING (p, k))"""
    return sql + f""",
e AS (SELECT vec_id, string_agg(lower(printf('%02x', CAST(k AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg({" || ',' || ".join(f'c{d}' for d in four)}, ',' ORDER BY p, k)) FROM c{rounds}) AS codebooks_sha256
FROM e JOIN v USING (vec_id)
"""


CODES = _codes_sql()

ORACLES: dict[str, str] = {
    "op5_url_filter": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rule, rhost, rpath, verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
         ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), fits AS (
  SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k
  FROM named JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT n.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM named n LEFT JOIN fits f ON f.page_id = n.page_id AND k = 1
""",
    "op6_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
x AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM s),
hit AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM x WHERE nth > 1)),
one AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM one ANTI JOIN hit USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
""",
    "op7_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents),
r AS (
  SELECT doc_id, k, first_value(doc_id) OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM r
""",
    "op10_decontamination": r"""
WITH texts AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), text FROM benchmark
), ws AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts
), items AS (
  SELECT id, ws, least(10, len(ws)) AS n FROM ws WHERE kind = 'b' AND len(ws) > 0
), windows AS (
  SELECT DISTINCT id AS item, n, array_to_string(ws[i:i + n - 1], ' ') AS words FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM items)
), d AS (SELECT CAST(id AS BIGINT) AS doc_id, ws FROM ws WHERE kind = 'd'),
places AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM items) WHERE len(ws) >= n),
hits AS (SELECT doc_id, i, p.n, item FROM places p JOIN windows w ON p.n = w.n AND array_to_string(ws[i:i + p.n - 1], ' ') = words),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op11_vector_codes": CODES,
    "op13_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS digest FROM p),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest, n) ELSE page_id END AS top FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM r
""",
}
