"""Numbers, hash trees, observed counters, table functions and keyed state in streams."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tessaria.functions import table as functions
from tessaria.operators import changes, hash_tree, numbering, observed
from tessaria.streaming import state, streams


def test_numbers_have_no_gap(spark, capfd):
    r = random.Random(1)
    rows = [(r.randrange(50), k, None if k % 9 == 0 else k) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, row2 int").repartition(7)
    got = numbering.gapless(df, [F.col("a").desc(), "b"], "row", 1)
    assert [tuple(x) for x in got.orderBy("row").collect()] == [(*t, k + 1) for k, t in enumerate(sorted(rows, key=lambda t: (-t[0], t[1])))]
    got.explain()
    plan = capfd.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
    assert numbering.gapless(df.limit(0), ["a"]).count() == 0
    assert {x["row"] for x in numbering.gapless(df.select(F.lit(1).alias("a")), ["a"]).collect()} == set(range(500))  # all tie


def test_trees_read_the_buckets_that_differ(spark, tmp_path):
    old = spark.range(3000).select(F.col("id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    new = old.where("path <> 17").withColumn("digest", F.when(F.col("path") == 5, "changed").when(F.col("path") == 6, None).otherwise(F.col("digest"))).unionByName(spark.createDataFrame([(9000, "x"), (None, "y")], "path long, digest string"))
    trees = {n: hash_tree.HashTree(spark, f"file://{tmp_path}/{n}") for n in ("old", "new", "again", "none")}
    for n, rows in (("old", old), ("new", new), ("again", old.repartition(5)), ("none", old.limit(0))):
        trees[n].write(rows, 2)
    assert hash_tree.differing(trees["old"], trees["again"]) == [] and trees["old"].nodes(0).first()["n"] == 3000
    at = hash_tree.differing(trees["old"], trees["new"])
    want = {r["b"] for r in spark.createDataFrame([(17,), (5,), (6,), (9000,)], "p long").select(F.pmod(F.xxhash64(F.col("p").cast("string")), F.lit(256)).alias("b")).collect()}
    assert set(at) == want
    read = trees["old"].rows(old, at)
    assert 0 < read.count() < 3000 * 4 / 256 * 2.5  # the four buckets' rows alone
    got = {(r["path"], r["status"]) for r in hash_tree.changes(trees["old"], trees["new"], old).collect()}
    assert got == {(17, "removed"), (5, "modified"), (6, "modified"), (9000, "added")}
    whole = changes.change_set(old, new.where("path is not null"), "path", "digest").where("status <> 'unchanged'")
    assert sorted(map(str, whole.collect())) == sorted(map(str, hash_tree.changes(trees["old"], trees["new"], old).collect()))
    assert hash_tree.changes(trees["none"], trees["old"], old).where("status = 'added'").count() == 3000 and hash_tree.differing(trees["none"], trees["none"]) == []
    trees["none"].write(old, 1)
    with pytest.raises(ValueError):
        hash_tree.differing(trees["none"], trees["old"])
    assert [hash_tree.levels_for(n) for n in (0, 10**6, 10**8, 10**12)] == [1, 1, 3, 4]


def test_counters_of_the_writing_pass(spark, tmp_path):
    df, seen = observed.observed(spark.range(1000).where("id % 3 = 0"), rows=F.count(F.lit(1)), top=F.max("id"))
    df.write.parquet(f"{tmp_path}/t")
    assert seen.get == {"rows": 334, "top": 999}


def test_counters_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    counters = observed.StreamCounters("job")
    spark.streams.addListener(counters)
    try:
        src = streams.read_stream(spark, f"{tmp_path}/in", spark.range(1).schema).observe("job", F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % 2 == 0).alias("even"))
        streams.run_to_end(src, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        for _ in range(100):
            if counters.totals().get("n") == 30:
                break
            time.sleep(0.1)
        assert counters.totals() == {"n": 30, "even": 15} and counters.totals("no such query") == {}
    finally:
        spark.streams.removeListener(counters)


def test_a_chunker_in_sql(spark):
    functions.register(spark)
    df = spark.createDataFrame([(1, "a b\n\nc d e\nf\n" + "g " * 9), (2, None), (3, " \n ")], "id int, text string")
    got = spark.sql("SELECT id, c.* FROM {d}, LATERAL line_chunks(text, 10) AS c ORDER BY id, ordinal", d=df).collect()
    assert [tuple(r) for r in got] == [(1, 0, "a b\nc d e", 10), (1, 1, "f", 2), (1, 2, "g " * 9, 18)]
    assert spark.sql("SELECT count(*) AS n FROM {d}, LATERAL line_chunks(text)", d=df).first()["n"] == 1
    for bad in ("1", "text, 0", "text, id"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT * FROM {{d}}, LATERAL line_chunks({bad})", d=df).collect()


BEGIN = dt.datetime(2024, 1, 1)
SCHEMA = "user string, ts timestamp, id long"


def put(spark, where, rows):
    spark.createDataFrame([(u, None if m is None else BEGIN + dt.timedelta(minutes=m), i) for u, m, i in rows], SCHEMA).coalesce(1).write.mode("append").parquet(where)
    time.sleep(0.05)


def run(spark, root):
    with state.rocks(spark):
        found = state.first_of_runs(streams.read_stream(spark, f"{root}/in", spark.createDataFrame([], SCHEMA).schema), "user", "ts", "id", 600, "30 minutes")
        streams.run_to_end(found, f"{root}/out", f"{root}/checkpoint")
    return {(r["user"], (r["first_ts"] - BEGIN).total_seconds() / 60, r["first_id"], (r["last_ts"] - BEGIN).total_seconds() / 60, r["n"]) for r in spark.read.schema(found.schema).parquet(f"{root}/out").collect()}


def test_keyed_state_with_late_and_repeated_rows_and_a_restart(spark, tmp_path):
    root = f"file://{tmp_path}"
    put(spark, f"{root}/in", [("a", 0, 1), ("a", 5, 2), ("a", 5, 2), ("b", 3, 3), (None, 4, 4), ("a", None, 5), ("a", 9, None)])
    put(spark, f"{root}/in", [("a", 25, 7), ("b", 20, 8)])
    assert run(spark, root) == set()  # the watermark has not passed any run
    # 15 joins the runs of 5 and 25 of a, though it comes after them; it is behind the latest time, but not behind the watermark.
    put(spark, f"{root}/in", [("a", 15, 6), ("c", 100, 9)])
    first = {("a", 0.0, 1, 25.0, 5), ("b", 3.0, 3, 3.0, 1), ("b", 20.0, 8, 20.0, 1), (None, 4.0, 4, 4.0, 1)}
    assert run(spark, root) == first  # started anew from its checkpoint, with the state of the first run
    put(spark, f"{root}/in", [("a", 26, 10), ("a", 300, 11)])  # 26 is behind the watermark of 70, and its run is gone: dropped
    assert run(spark, root) == first | {("c", 100.0, 9, 100.0, 1)}
    assert run(spark, root) == first | {("c", 100.0, 9, 100.0, 1)}  # nothing new: nothing is given twice


def test_runs_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    r, rows = random.Random(5), []
    for k in range(300):
        rows.append((r.choice("aaaab"), k * 3 + r.randrange(20), k))
    root = f"file://{tmp_path}"
    for at in range(0, 300, 100):
        put(spark, f"{root}/in", rows[at : at + 100])
    table = state.first_of_runs(spark.read.parquet(f"{root}/in"), "user", "ts", "id", 600, "30 minutes")
    want = {(x["user"], (x["first_ts"] - BEGIN).total_seconds() / 60, x["first_id"], (x["last_ts"] - BEGIN).total_seconds() / 60, x["n"]) for x in table.collect()}
    assert run(spark, root) == want and len(want) > 20
    assert state.first_of_runs(spark.createDataFrame([], SCHEMA), "user", "ts", "id", 600).count() == 0


def test_a_key_has_one_timer():
    """However many runs a key has open, one timer stands, and it releases all runs that the watermark has passed."""
    import pandas as pd

    from tessaria.streaming.state import Runs, _close_ms

    timers, held = set(), []

    class Held:
        get = lambda self: iter(list(held))
        put = lambda self, rows: held.__setitem__(slice(None), rows)
        clear = lambda self: held.clear()

    class Handle:
        getListState = lambda self, *a: Held()
        registerTimer = lambda self, t: timers.add(t)
        deleteTimer = lambda self, t: timers.remove(t)

    class At:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    quiet, runs = 10_000_000, Runs(10_000_000)
    runs.init(Handle())
    times = [k * 60_000_000 for k in range(50)]
    list(runs.handleInputRows((7,), iter([pd.DataFrame({"us": times, "id": range(50)})]), None))
    assert timers == {_close_ms(0, quiet)} and len(held) == 50
    first = timers.pop()  # it fires when the watermark has passed 20 runs
    made = pd.concat(runs.handleExpiredTimer((7,), At(_close_ms(times[19], quiet)), type("Info", (), {"getExpiryTimeInMs": lambda self: first})()))
    assert made["first_id"].tolist() == list(range(20)) and len(held) == 30 and timers == {_close_ms(times[20], quiet)}
