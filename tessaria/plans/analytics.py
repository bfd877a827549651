"""Queries of joins on time, grouping sets, quantiles, sketches, hash trees, streams with state and table functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessaria.operators import monitoring as N
from tessaria.functions import table as functions
from tessaria.operators import changes as C
from tessaria.operators import hash_tree, observed, quantiles, sketches, timejoin
from tessaria.operators.index import shared_root
from tessaria.plans.base import query, quoted, table
from tessaria.plans.corpus import change_tables
from tessaria.plans.text import WORD
from tessaria.streaming import state, streams


def events(spark, sf_dir, *types):
    e = table(spark, sf_dir, "events")
    return e.where(F.col("event_type").isin(*types)) if types else e


# --- joins on time -------------------------------------------------------------------------------------------------------


@query("q_asof_join", """
WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type IN ('view', 'click'))
SELECT p.event_id, p.user_id, v.event_id AS last_event_id, v.value AS last_value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def asof_join(spark, sf_dir):
    """Each purchase with the user's last view or click before it."""
    found = timejoin.asof_join(events(spark, sf_dir, "purchase"), events(spark, sf_dir, "view", "click"), "ts", ["user_id"], ["event_id", "value"])
    return found.select("event_id", "user_id", "last_event_id", "last_value")


@query("q_asof_join_one_key", """
WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'error')
SELECT p.event_id, CASE WHEN p.ts - v.ts <= INTERVAL 10 MINUTE THEN v.event_id END AS last_event_id FROM p ASOF LEFT JOIN v ON p.ts >= v.ts
""")
def asof_join_one_key(spark, sf_dir):
    """Each purchase with the last error of anyone, at most ten minutes before: one key, cut by time alone."""
    all_ = F.lit(0).alias("key")
    left, right = (events(spark, sf_dir, t).select("*", all_) for t in ("purchase", "error"))
    return timejoin.asof_join(left, right, "ts", ["key"], ["event_id"], 3600, 600).select("event_id", "last_event_id")


@query("q_interval_join", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
i AS (SELECT user_id, min(ts) AS s, max(ts) + INTERVAL 30 MINUTE AS e FROM k GROUP BY user_id, sid)
SELECT i.user_id, s AS session_start, count(*) AS errors, round(sum(value), 4) AS value FROM i JOIN events x ON x.ts >= s AND x.ts < e WHERE event_type = 'error' GROUP BY ALL
""")
def interval_join(spark, sf_dir):
    """How many errors of anyone fall into each user's sessions."""
    errors = events(spark, sf_dir, "error").select("ts", "value")
    sums = timejoin.interval_sums(errors, streams.sessions(events(spark, sf_dir)), "ts", "session_start", "session_end", "value", ["user_id", "session_start"])
    return sums.select("user_id", "session_start", F.col("n").alias("errors"), F.round("total", 4).alias("value"))


@query("q_interval_join_by_key", """
SELECT o_orderkey, l_orderkey, l_linenumber FROM orders JOIN lineitem ON l_suppkey = o_custkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + to_days(CAST(o_orderkey % 400 AS INTEGER))
""")
def interval_join_by_key(spark, sf_dir):
    """Line items shipped within an interval of an order whose customer has the supplier's number; intervals are of 0 to 399 days."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("s"))
    o = o.withColumn("e", F.timestamp_add("DAY", (F.col("o_orderkey") % 400).cast("int"), F.col("s")))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("k"), F.col("l_shipdate").cast("timestamp").alias("t"))
    return timejoin.interval_join(li, o, "t", "s", "e", ["k"], 86400).select("o_orderkey", "l_orderkey", "l_linenumber")


# --- aggregates ----------------------------------------------------------------------------------------------------------

KIND = "CASE WHEN length(text) < 300 THEN 'short' WHEN length(text) < 3000 THEN 'middle' END"


@query("h2_grouping_sets", f"""
WITH d AS (SELECT source, lang, {KIND} AS kind, length(text) AS n_chars FROM documents)
SELECT source, lang, kind, grouping(source, lang, kind) AS grouping_id, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM d GROUP BY GROUPING SETS ((source, lang), (lang, kind), (kind), ())
""")
def grouping_sets(spark, sf_dir):
    """Documents by source and language, by language and kind, by kind, and all; long texts have no kind, which is a group and no total."""
    d = table(spark, sf_dir, "documents").select("source", "lang", F.expr(KIND.replace("length", "char_length")).alias("kind"), F.char_length("text").cast("long").alias("n_chars"))
    return N.grouping_sets(d, ["source", "lang", "kind"], [["source", "lang"], ["lang", "kind"], ["kind"], []], F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("h8_cube", "SELECT o_orderpriority AS category, o_orderstatus AS status, grouping(o_orderpriority, o_orderstatus) AS grouping_id, count(*) AS total, count(*) FILTER (o_orderdate < TIMESTAMP '1996-08-02') AS stale FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def shelf_life_cube(spark, sf_dir):
    """Stale documents in all groupings of category and status."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status"), (F.col("o_orderdate") < F.lit("1996-08-02").cast("timestamp_ntz")).alias("old"))
    return N.cube(o, ["category", "status"], F.count(F.lit(1)).alias("total"), F.count_if("old").alias("stale"))


@query("r2_length_quantiles", "SELECT source, lang, round(quantile_cont(length(text), 0.1), 6) AS p10, round(quantile_cont(length(text), 0.5), 6) AS p50, round(quantile_cont(length(text), 0.999), 6) AS p999 FROM documents GROUP BY ALL")
def length_quantiles(spark, sf_dir):
    """Exact quantiles of the texts' lengths; a source may hold any share of the rows."""
    d = table(spark, sf_dir, "documents").select("source", "lang", F.char_length("text").alias("n"))
    q = quantiles.exact_quantiles(d, "n", {"p10": 0.1, "p50": 0.5, "p999": 0.999}, "source", "lang")
    return q.select("source", "lang", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p999")])


def sketch_store(spark, sf_dir):
    """Sketches of the events' users by day and type, written in two goes."""
    store = sketches.SketchStore(spark, f"{shared_root(spark)}/sketches-{uuid.uuid4().hex}", ["event_type"], sketches.buckets_for(events(spark, sf_dir), "user_id"))
    half = F.col("value") < 50
    for part in (half, ~half):
        store.write(events(spark, sf_dir).where(part), F.col("ts"), "user_id")
    return store


RANGE = ("2024-01-05", "2024-01-19")
IN_RANGE = f"CAST(ts AS DATE) BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'"


@query("q_sketch_distinct", f"SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS exact, true AS within FROM events WHERE {IN_RANGE} GROUP BY event_type")
def sketch_distinct(spark, sf_dir):
    """Users of a fortnight by type, from the stored sketches, against the exact count: within four standard errors."""
    found = sketch_store(spark, sf_dir).counts(*RANGE, "event_type")
    exact = events(spark, sf_dir).where(F.col("ts").cast("date").between(*[F.lit(x).cast("date") for x in RANGE])).groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"))
    return found.join(exact, "event_type").select("event_type", "n", "exact", sketches.within(F.col("distinct"), F.col("exact")).alias("within"))


@query("q_sketch_frequent", f"WITH g AS (SELECT event_type, user_id AS value, count(*) AS c FROM events WHERE {IN_RANGE} GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY c DESC) AS r FROM g) SELECT event_type, list_sort(list(c))[-3:] AS counts FROM g GROUP BY event_type".replace("list_sort(list(c))[-3:] AS counts", "array_to_string(list_reverse_sort(list(c))[1:3], ',') AS counts"))
def sketch_frequent(spark, sf_dir):
    """The counts of the three most frequent users of a fortnight by type, from the stored sketches."""
    top = sketch_store(spark, sf_dir).frequent(*RANGE, 3, "event_type")
    return top.groupBy("event_type").agg(F.array_join(F.reverse(F.array_sort(F.collect_list("count"))), ",").alias("counts"))


# --- streams with state --------------------------------------------------------------------------------------------------

RUNS_SQL = """
WITH g AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 1800000000 THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g), m AS (SELECT epoch_us(max(ts)) // 1000 - 3600000 AS mark FROM events),
r AS (SELECT user_id, min(ts) AS first_ts, arg_min(event_id, ts) AS first_id, max(ts) AS last_ts, count(*) AS n FROM k GROUP BY user_id, run)
SELECT user_id, first_ts, first_id, last_ts, n FROM r, m WHERE (epoch_us(last_ts) + 1800000000) // 1000 + 1 <= mark
"""


@query("n_first_of_runs", RUNS_SQL)
def first_of_runs(spark, sf_dir):
    """The first event of each run of a user's events, with its length: from the whole table."""
    return state.first_of_runs(events(spark, sf_dir), "user_id", "ts", "event_id", 1800)


#: Rows of a file that a batch of the stream reads.
SLICE_ROWS = 100_000


@query("n_first_of_runs_stream", RUNS_SQL)
def first_of_runs_stream(spark, sf_dir):
    """The same from a stream that reads the table in six batches, with keyed state and timers."""
    root = f"{shared_root(spark)}/runs-{uuid.uuid4().hex}"
    e = events(spark, sf_dir)
    ends = e.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("lo"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("hi")).first()
    step = ((ends["hi"] or 0) - (ends["lo"] or 0)) // 6 + 1
    slice_ = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(ends["lo"])) / step)
    held = {r["k"]: r["count"] for r in e.groupBy(slice_.alias("k")).count().collect()}
    files = max(1, min(held.get(k, 0) for k in range(6)) // SLICE_ROWS)  # as many for each batch, and none of them empty
    for k in range(6):  # one after another, as files are read by their time
        part = e.where(slice_ == k)
        (part.repartition(files, "event_id") if files > 1 else part.coalesce(1)).write.mode("append").parquet(f"{root}/in")
    with state.rocks(spark):
        runs = state.first_of_runs(streams.read_stream(spark, f"{root}/in", e.schema, files), "user_id", "ts", "event_id", 1800)
        streams.run_to_end(runs, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(runs.schema).parquet(f"{root}/out")


# --- counters, versions, table functions ---------------------------------------------------------------------------------


@query("h18_observed_job", """
WITH c AS (SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (lang = 'en') AS english FROM documents GROUP BY source)
SELECT CAST(sum(n) AS BIGINT) AS documents, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(english) AS BIGINT) AS english, count(*) FILTER (n > 10) AS written FROM c
""")
def observed_job(spark, sf_dir):
    """Counters of documents and of what is made of them, seen by the one pass that reads the documents and writes their summary."""
    d, read = observed.observed(table(spark, sf_dir, "documents").select("source", "lang", "text"), documents=F.count(F.lit(1)), chars=F.coalesce(F.sum(F.char_length("text")), F.lit(0)), english=F.count_if(F.col("lang") == "en"))
    made, wrote = observed.observed(d.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n > 10"), written=F.count(F.lit(1)))
    made.write.parquet(f"{shared_root(spark)}/summary-{uuid.uuid4().hex}")
    return spark.createDataFrame([tuple(read.get[k] for k in ("documents", "chars", "english")) + (wrote.get["written"],)], "documents long, chars long, english long, written long")


@query("g11_changes_by_tree", """
WITH a AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE lang <> 'es'), b AS (SELECT doc_id AS path, sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS h FROM documents WHERE lang <> 'fr')
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS status, a.h AS old, b.h AS new FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h
""")
def changes_by_tree(spark, sf_dir):
    """The change set of two stored versions, from the buckets whose digests differ."""
    sides = change_tables(spark, sf_dir)
    levels = hash_tree.levels_for(table(spark, sf_dir, "documents").count())
    trees = [hash_tree.HashTree(spark, f"{shared_root(spark)}/tree-{uuid.uuid4().hex}", "path", "h") for _ in sides]
    for tree, rows in zip(trees, sides, strict=True):
        tree.write(rows, levels)
    return hash_tree.changes(*trees, sides[0])


@query("f1_chunks_in_sql", f"""
WITH RECURSIVE l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, line, CAST(2 * length(regexp_extract_all(line, {WORD})) AS BIGINT) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE length(regexp_extract_all(line, {WORD})) > 0),
p(doc_id, i, piece, size) AS (
  SELECT doc_id, i, CAST(0 AS BIGINT), n FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, CASE WHEN p.size + l.n > 120 THEN p.piece + 1 ELSE p.piece END, CASE WHEN p.size + l.n > 120 THEN l.n ELSE p.size + l.n END FROM p JOIN l ON l.doc_id = p.doc_id AND l.i = p.i + 1)
SELECT doc_id, piece AS ordinal, string_agg(line, chr(10) ORDER BY i) AS content, CAST(sum(n) AS BIGINT) AS token_count FROM p JOIN l USING (doc_id, i) GROUP BY doc_id, piece
""")
def chunks_in_sql(spark, sf_dir):
    """A query in SQL that calls the chunker for each document."""
    functions.register(spark)
    return spark.sql("SELECT doc_id, c.ordinal, c.content, c.token_count FROM {docs} AS d, LATERAL line_chunks(d.text, 120) AS c", docs=table(spark, sf_dir, "documents"))
