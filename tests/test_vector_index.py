"""The band index against the exact search, with hot buckets, copies and zero vectors; components against union-find."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaria.operators import ranking, vector_index
from tessaria.operators.components import components, join_spread


def clouds(n, dims, spread, seed=0):
    """Vectors around a tenth as many centres."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 10), dims))
    return (centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dims)) * spread).tolist()


def table(spark, vectors, name="doc_id"):
    return spark.createDataFrame(list(enumerate(vectors)), f"{name} long, vector array<double>").repartition(3)


def test_search_within_buckets(spark):
    rows = clouds(3000, 24, 0.25) + [[0.0] * 24, None]
    v, q = table(spark, rows), table(spark, rows[:60] + [None, [0.0] * 24], "query_id")
    index = vector_index.BandIndex.build(v, 24, bands=4, bits=7)
    most, share = index.calibrate(q, v, 5, 0.9)
    exact = ranking.dense(q, v, 5)
    found = index.search(q, 5, most).cache()
    assert share >= 0.9 and vector_index.recall(found, exact) >= 0.9 and most < 1 << 7
    score = {(r["query_id"], r["doc_id"]): r["score"] for r in ranking.dense(q, v, 3002).collect()}
    assert all(abs(r["score"] - score[r["query_id"], r["doc_id"]]) < 1e-9 for r in found.collect())
    assert found.groupBy("query_id").agg(F.countDistinct("doc_id").alias("d"), F.count("doc_id").alias("n")).where("d <> n").isEmpty()
    # With all buckets probed the search is exact.
    whole = vector_index.BandIndex.build(v, 24, bands=1, bits=3).search(q, 5, 8)
    assert {tuple(r) for r in whole.select("query_id", "doc_id", "rank").collect()} == {tuple(r) for r in exact.select("query_id", "doc_id", "rank").collect()}


def test_written_buckets_give_the_same_search(spark, tmp_path):
    rows = clouds(400, 8, 0.2)
    v, q = table(spark, rows), table(spark, rows[:20], "query_id")
    index = vector_index.BandIndex.build(v, 8, bands=3, bits=4)
    index.write(f"file://{tmp_path}/bands")
    key = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "rank").collect()))
    assert key(index.search(q, 4, 2, f"file://{tmp_path}/bands")) == key(index.search(q, 4, 2))


def test_a_hot_bucket_is_many_blocks(spark):
    rows = table(spark, [[1.0, k / 1000, 0.0] for k in range(500)]).withColumns({"band": F.lit(0), "bucket": F.lit(3)})
    got = vector_index.pack(rows, ["band", "bucket"], "doc_id", "m", 50).collect()
    assert len(got) == 10 and sum(len(r["m"]) for r in got) == 500 and max(len(r["m"]) for r in got) < 100


def test_more_queries_than_a_block(spark):
    rows = clouds(700, 6, 0.5)
    v, q = table(spark, rows), table(spark, rows[:90], "query_id")
    key = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "rank").collect()))
    blocks = ranking.top_k(vector_index.exact_by_blocks(q, v, 3, 64), 3)
    assert key(blocks) == key(ranking.dense(q, v, 3)) == key(ranking.dense(q, v, 3, block=10))
    assert ranking.dense(q, v.limit(0), 3).count() == 0 and vector_index.exact_by_blocks(q, v.limit(0), 3).count() == 0 and ranking.dense(q.limit(0), v, 3).count() == 0


def brute(rows, threshold):
    ids, e = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    link = (e @ e.T >= threshold) & ~np.eye(len(ids), dtype=bool)
    cls = ids.copy()
    while True:
        new = np.minimum(cls, np.where(link, cls[None, :], 1 << 62).min(1))
        if (new == cls).all():
            return {(int(i), int(c), int(n)) for i, c, n in zip(ids, cls, link.sum(1), strict=True)}
        cls = new


@pytest.mark.parametrize("bits, block", [(0, 100), (0, 7), (6, 2048), (6, 40)])
def test_join_by_bands_and_by_blocks(spark, bits, block):
    rng = np.random.default_rng(2)
    near = [(v, (np.array(v) + rng.normal(size=12) * 0.02).tolist()) for v in clouds(120, 12, 0.6, 5)]
    rows = [(900 - k, v) for k, v in enumerate(x for pair in near for x in pair)]
    rows += [(2000 + k, rows[0][1]) for k in range(60)]  # copies are a third of all rows
    df = spark.createDataFrame(rows, "doc_id long, vector array<double>").repartition(3)
    got = {tuple(r) for r in vector_index.similarity_join(df, 0.97, bits, 0.9999, block).collect()}
    assert got == brute(rows, 0.97) and sum(n for *_, n in got) > 3000


def test_bands_for_a_chance():
    assert vector_index.bands_for(1.0, 12) == 1 and vector_index.bands_for(0.8, 10, 0.99) < vector_index.bands_for(0.6, 10, 0.99)
    p = (1 - np.arccos(0.8) / np.pi) ** 10
    assert 1 - (1 - p) ** vector_index.bands_for(0.8, 10, 0.9) >= 0.9


def test_components(spark):
    rng = np.random.default_rng(7)
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, 5), (300, 7), (7, 300)] + rng.integers(1000, 1400, size=(180, 2)).tolist()
    top = {n: n for e in edges for n in e}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    want = {(n, find(n)) for a, b in edges if a != b for n in (a, b)}
    df = spark.createDataFrame([tuple(map(int, e)) for e in edges], "a long, b long")
    assert {tuple(r) for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_spread_join_keeps_rows(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), "id")
    other = spark.createDataFrame([(0, "a"), (1, "b"), (5, "c")], "k long, name string")
    got = join_spread(df, other, ["k"], F.col("id"), "left").groupBy("k", "name").count().collect()
    assert {tuple(r) for r in got} == {(0, "a", 1000), (1, "b", 1000), (2, None, 1000)}


def test_banded_join_finds_pairs_that_are_barely_near(spark, tmp_path):
    """Pairs little above and below the threshold, of which bands miss some, and copies that single precision would move: as in SQL."""
    import duckdb

    from tessaria import plans

    rng = np.random.default_rng(11)
    centres = rng.normal(size=(60, 64))
    rows = [(c * (1 + 1e-3 * k) + rng.normal(size=64) * 0.31).tolist() for k, c in enumerate(np.repeat(centres, 6, axis=0))]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").withColumn("label", F.lit(0))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(plans.ORACLES["g7_banded_join"]).fetchall()
    got = plans.QUERIES["g7_banded_join"](spark, str(tmp_path)).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(n for *_, n in want) > 2 * len(want)


def test_links_that_single_precision_cannot_decide(spark):
    """Cosines a billionth above and below the threshold, in one block and in several, and a chain that later rows of a block close."""
    rows = [(k, [float(np.cos(a)), float(np.sin(a))]) for k, a in enumerate(np.r_[0, np.arccos(0.9 + np.array([1e-9, -1e-9, 3e-8, -3e-8])), -np.arange(1, 40) * 0.07])]
    df = spark.createDataFrame(rows, "doc_id long, vector array<double>").repartition(3)
    for block in (None, 9):
        assert {tuple(r) for r in vector_index.similarity_join(df, 0.9, block=block).collect()} == brute(rows, 0.9)
