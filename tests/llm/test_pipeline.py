"""The pipeline against a plain version of its rules, and its stages on hard tables."""

import re

import corpus_pipeline
import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessaria.llm import decontaminate, language_id
from tessaria.llm.queries import ORACLES, QUERIES

from .conftest import changed, prose


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_stages_drop_what_they_should(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    first = docs.orderBy(F.col("n_chars").desc()).first()
    more = [(9001, first["text"] + " ", "en", "s", 1), (9002, changed(first["text"], 80), "en", "s", 1), (9003, "123 ... !!!", "en", "s", 1), (9004, None, "en", "s", 1), (9005, prose(1, 50) + " " + bench[0], "en", "s", 1)]
    both = docs.unionByName(spark.createDataFrame(more, docs.schema))
    ids, at = {}, both
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, d)
        assert at.columns == docs.columns
        at.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = {r["doc_id"] for r in at.collect()}
    every = {r["doc_id"] for r in both.collect()}
    assert every - ids["language_id"] == {r["doc_id"] for r in language_id.identify(both).where("lang_pred = 'und'").collect()} >= {9003, 9004}
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    norm = {}
    for i in sorted(ids["language_id"], key=lambda i: (-len(texts[i]), i)):
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]", "", texts[i]), i)
    assert ids["exact_dedup"] == set(norm.values())
    assert 9002 not in ids["near_dedup"] or first["doc_id"] not in ids["near_dedup"]
    auto = decontaminate.build([(str(k), t) for k, t in enumerate(bench)])
    assert ids["decontamination"] == {i for i in ids["near_dedup"] if not auto.scan(decontaminate.word_list(texts[i]))[1]}
    packed = corpus_pipeline.STAGES[-1][1](spark, at, d).select("doc_id", "start", "length", "doc_tokens").collect()
    assert {r["doc_id"] for r in packed} == ids["decontamination"]


def check_one_row_of_each_text(spark, table):
    """Brute force: of equal texts the row with most code points stays, then the smallest id, null last."""
    best = {}
    for r in table.collect():
        t = r["text"] or ""
        order = (-len(t), r["doc_id"] is None, r["doc_id"] or 0)
        k = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[k] = min(best.get(k, (order, r["doc_id"])), (order, r["doc_id"]), key=lambda x: x[0])
    got = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, table, "/root/testdata/sf0.001")
    assert got.columns == table.columns
    stay = [(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), r["doc_id"], -len(r["text"] or "")) for r in got.collect()]
    assert sorted(map(str, stay)) == sorted(str((k, d, order[0])) for k, (order, d) in best.items())


def test_exact_copies_go_row_by_row(spark, docs, empty):
    """Null and repeated ids: a row is dropped for its own text only, and one row of each text stays."""
    more = [(None, prose(61, 30)), (None, prose(61, 30) + " "), (None, prose(62, 30)), (70, prose(63, 30)), (70, prose(64, 30)), (3, prose(63, 30)), (80, prose(65, 30)), (80, prose(65, 30)), (None, prose(65, 30)), (None, prose(66, 30)), (None, prose(66, 30))]
    rows = spark.createDataFrame([(i, t, None, None, None, None, None, None, None) for i, t in more], docs.schema)
    for table in (docs, docs.unionByName(rows), rows, empty):
        check_one_row_of_each_text(spark, table)


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).where("n <> doc_tokens").count() == 0


def test_stages_on_hard_tables(spark, docs, empty):
    for table in (docs, empty):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, "/root/testdata/sf0.001").count() <= max(table.count() * 30, 0)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, spark):
    """Queries that SQL can express give what DuckDB gives."""
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    got, want = QUERIES[name](spark, d).toPandas(), con.execute(ORACLES[name]).df()
    show = lambda df: sorted(tuple("null" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and show(got) == show(want)
