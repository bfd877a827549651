"""Ingestion end to end, the command line, and what stands behind a language model."""

from pyspark.sql import functions as F

from tessaria import cli
from tessaria.operators import changes, generation, ingest
from tessaria.operators.index import build_index

from .test_goldens import DOCX, xlsx


def test_ingest_update_search(spark, tmp_path):
    src, kb = tmp_path / "src", f"file://{tmp_path}/kb"
    src.mkdir()
    (src / "qa.xlsx").write_bytes(xlsx([["question", "answer", "keyword"], ["how to register contract", "send documents", "k1"], ["payment report", "ask support", ""], ["no answer", None, ""]]))
    (src / "guide.docx").write_bytes(DOCX)
    (src / "bad.docx").write_bytes(b"broken")
    first = cli.run(["--kb", kb, "ingest", str(src), "--as-of", "2024-01-01"], spark).first()
    assert (first["files"], first["succeeded"], first["failed"], first["created"], first["skipped"]) == (3, 2, 1, 2, 0) and "bad.docx" in first["errors"][0]
    again = cli.run(["--kb", kb, "ingest", str(src), "--as-of", "2024-01-02"], spark).first()
    assert (again["created"], again["updated"], again["skipped"]) == (0, 0, 2)
    (src / "qa.xlsx").write_bytes(xlsx([["question", "answer", "keyword"], ["how to cancel contract", "call us", "k1"]]))
    third = cli.run(["--kb", kb, "ingest", str(src), "--as-of", "2024-01-03"], spark).first()
    assert (third["updated"], third["skipped"]) == (1, 1)
    base = ingest.KnowledgeBase(spark, kb)
    doc = {r["title"]: r for r in base.read("documents").collect()}
    assert doc["qa"]["version"] == 2 and doc["guide"]["version"] == 1 and doc["qa"]["chunk_count"] == 2  # a child and its parent
    assert base.read("versions").where(F.col("doc_id") == doc["qa"]["doc_id"]).count() == 2
    hit = cli.run(["--kb", kb, "search", "cancel contract", "--top-k", "1"], spark).first()
    assert hit["title"] == "qa" and "cancel" in hit["preview"]
    assert cli.run(["--kb", kb, "search", "register"], spark).count() == 0
    assert cli.run(["--kb", kb, "inspect", doc["guide"]["doc_id"]], spark).count() >= 1
    assert cli.run(["--kb", kb, "status"], spark).where("dimension = 'status'").first()["n"] == 2
    assert cli.run(["--kb", kb, "status-chunks"], spark).first()["n_chunks"] == base.read("chunks").count()
    assert cli.run(["--kb", kb, "eval-run"], spark).first()["mrr"] == 1.0 and cli.run(["--kb", kb, "eval-generate"], spark).count() == 1
    for by in ("dense", "hybrid"):
        best = cli.run(["--kb", kb, "search", "how to cancel contract", "--by", by, "--top-k", "2"], spark).collect()
        assert best[0]["title"] == "qa" and [r["rank"] for r in best] == [1, 2]
    log = base.read("files")
    assert {(r["action"], r["count"]) for r in log.groupBy("action").count().collect()} == {("create", 2), ("failed", 3), ("skip", 3), ("update", 1)}
    full = cli.run(["--kb", kb, "ingest", str(src), "--full", "--as-of", "2024-01-04"], spark).first()
    assert full["created"] == 2 and ingest.KnowledgeBase(spark, kb).read("documents").where("version = 1").count() == 2


def test_known_files_are_not_parsed(spark, tmp_path, monkeypatch):
    src, kb = tmp_path / "src", ingest.KnowledgeBase(spark, f"file://{tmp_path}/kb")
    src.mkdir()
    for k in range(3):
        (src / f"f{k}.docx").write_bytes(DOCX)
    assert kb.update(str(src), F.lit("2024-01-01").cast("timestamp")).first()["created"] == 3
    given, parse = [], ingest.office.parse_files
    monkeypatch.setattr(ingest.office, "parse_files", lambda files: given.append(files.count()) or parse(files))
    assert kb.update(str(src), F.lit("2024-01-02").cast("timestamp")).first()["skipped"] == 3
    (src / "f1.docx").write_bytes(DOCX + b"\0")  # other bytes, the same text
    (src / "f3.docx").write_bytes(DOCX)
    job = kb.update(str(src), F.lit("2024-01-03").cast("timestamp")).first()
    assert (job["files"], job["skipped"], job["created"], job["updated"]) == (4, 3, 1, 0)
    assert kb.update(str(src), F.lit("2024-01-04").cast("timestamp")).first()["skipped"] == 4
    assert given == [0, 2, 0]


def test_one_commit_over_all_tables(spark, tmp_path, monkeypatch):
    src, kb = tmp_path / "src", ingest.KnowledgeBase(spark, f"file://{tmp_path}/kb")
    src.mkdir()
    (src / "a.docx").write_bytes(DOCX)
    kb.update(str(src), F.lit("2024-01-01").cast("timestamp"))
    turn, state = kb.commits.current()
    assert set(state) == {"documents", "chunks", "versions", "files", "jobs"} and turn == 1
    (src / "b.docx").write_bytes(DOCX)
    write = ingest.versions.VersionedTable.write

    def crash(self, df, activate=True):
        if self.where.endswith("/jobs"):
            raise RuntimeError("lost")
        return write(self, df, activate)

    monkeypatch.setattr(ingest.versions.VersionedTable, "write", crash)
    try:
        kb.update(str(src), F.lit("2024-01-02").cast("timestamp"))
    except RuntimeError:
        pass
    monkeypatch.undo()
    # The lost run had written chunks and documents; readers see neither.
    assert kb.commits.current() == (turn, state) and kb.read("documents").count() == 1 and kb.read("chunks").select("doc_id").distinct().count() == 1
    kb.commits.advance(1, state)
    try:
        kb.commits.advance(1, {"documents": 9})
        raise AssertionError("two writers followed one turn")
    except OSError:
        pass
    assert kb.commits.current() == (2, state)
    kb.wipe()
    assert kb.read("documents").count() == 0 and kb.commits.current() == (3, {})
    assert kb.update(str(src), F.lit("2024-01-03").cast("timestamp")).first()["created"] == 2
    kb.commits.advance(4, state)  # back to an earlier state
    assert kb.read("documents").count() == 1
    (tmp_path / "kb" / "commits" / "turns" / "00000006").write_bytes(b"")  # a writer that was lost in between
    assert kb.commits.current() == (6, state)


def test_generation(spark):
    q = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "query_id long, text string")
    answer = lambda c: F.when(c.contains("alpha"), F.lit('x [{"query": "alpha", "type": "keyword_only"}, {"query": "beta"}] y')).otherwise(F.lit("none"))
    got = sorted(map(tuple, generation.reformulate(q, answer).collect()))
    assert got == [(1, "keyword_only", "alpha"), (1, "unknown", "beta"), (2, "original", "gamma")]
    docs = spark.createDataFrame([(10, "beta only"), (11, "alpha only"), (12, "gamma")], "doc_id long, text string")
    assert {r["doc_id"] for r in generation.multi_query_search(q, build_index(docs), 2, answer).where("query_id = 1").collect()} == {10, 11}
    embed = lambda c: changes.hash_embed(c, 32)
    found = generation.hyde_search(q, docs.select("doc_id", embed(F.col("text")).alias("vector")), embed, generation.mock, 1)
    assert {r["query_id"]: r["doc_id"] for r in found.collect()}[2] == 12

    def client():
        def run(prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError
            return [p.upper() for p in prompts]

        return run

    p = spark.createDataFrame([("a",), ("bad",), ("c",)], "p string")
    assert [r[0] for r in p.select(generation.pandas_generator(client)(F.col("p"))).collect()] == ["A", None, "C"]
    j = spark.createDataFrame([('{"relevance": 1, "accuracy": 1, "naturalness": 0.8, "diversity": 0.4}',), ("?",)], "answer string")
    assert [(r["overall"], r["passed"]) for r in generation.accepted(j).collect()] == [(0.8, True), (0.0, False)]
    rows = spark.createDataFrame([("a b", "b c", "b c d", "c d")], "question string, answer string, contexts string, truth string")
    r = generation.judge(rows).first()
    assert (r["faithfulness"], r["answer_relevancy"], r["context_recall"]) == (1.0, 0.5, 1.0)
    c = spark.createDataFrame([(1, [("user", "a"), ("assistant", "b"), ("user", "c")]), (2, [("user", "a"), ("user", "b"), ("user", "c")]), (3, [("user", "a")])], "id int, turns array<struct<role:string,content:string>>")
    assert [x["id"] for x in generation.valid_conversations(c).collect()] == [1]
    pairs = spark.range(300).select(F.col("id").alias("chunk_id"), F.concat(F.lit("q"), "id").alias("question"))
    queries, rels = generation.dataset_from_pairs(pairs)
    assert queries.count() == 300 and rels.where("rel = 1").count() == 300 and rels.where("query_id = doc_id and rel = 0").count() == 0
