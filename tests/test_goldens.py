"""Rules that SQL can't express, against plain Python; invariants; sources, versions and streams."""

import io
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from tessaria.functions import text as T
from tessaria.functions import tokens as K
from tessaria.functions import variants as V
from tessaria.operators import changes, chunking, metrics, quality, ranking, vector_index, versions
from tessaria.operators.index import build_index, corpus_fingerprint
from tessaria.plans import files
from tessaria.plans.base import TEXTS
from tessaria.sources import datasets, office, pdf, sinks
from tessaria.streaming import streams

Z = "‌"


SHEETS = [
    (1, 0, "s1", "crm_qa", ["Question", "Answer", "Keyword"], [["q one?", "a\nb", "k1،k2"], ["q two", "", "k"], ["", "x", ""], ["Q one", "later", ""]]),
    (1, 1, "s2", "crm_qa", ["question", "briefanswer", "extra"], [["q three", "b3", "e"], ["q one", "dup", ""]]),
    (2, 0, "", None, ["question", "answer", "answer"], [["q four", "first", "last"]]),
]
SHEET_TYPE = "doc_id long, sheet_no int, name string, schema string, headers array<string>, rows array<array<string>>"


def apply(spark, fn, values):
    df = spark.createDataFrame(list(enumerate(values)), "id int, t string")
    return [r["o"] for r in df.select("id", fn(F.col("t")).alias("o")).orderBy("id").collect()]


def test_text_by_plain_python(spark):
    values = [*TEXTS, None]
    assert apply(spark, T.nfc, values) == [t if t is None else unicodedata.normalize("NFC", t) for t in values]
    assert apply(spark, K.words, TEXTS) == [t.split() for t in TEXTS]
    assert apply(spark, T.strip, TEXTS) == [t.strip() for t in TEXTS]
    assert apply(spark, lambda c: F.regexp_count(c, F.lit(r"\p{L}")), TEXTS) == [sum(map(str.isalpha, t)) for t in TEXTS]
    assert apply(spark, T.clean_text, ["", None, "a  b\n\n\n\nc <!-- x\ny --><b>d</b>  http://x.y/z?q e@f.gh ~$k "]) == ["", None, "a b\n\nc d [URL] [EMAIL]"]


def test_nfc_of_all_characters(spark):
    """Each character alone, and behind a letter that it may join."""
    points = [k for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000 and unicodedata.category(chr(k)) not in ("Cn", "Co")]
    values = [f"{chr(k)} a{chr(k)} \u1100{chr(k)} \u09c7{chr(k)}" for k in points]
    assert apply(spark, T.nfc, values) == [unicodedata.normalize("NFC", t) for t in values]


def test_zwnj(spark):
    assert apply(spark, T.fix_zwnj, [f"a{Z}b", "دوها", f"دو{Z}ها"]) == ["ab", f"دو{Z}ها", f"دو{Z}ها"]
    assert apply(spark, T.fix_zwnj, ["کتابها"]) == [f"ک{Z}تاب{Z}ها"]  # the rule as it stands also splits words
    assert apply(spark, lambda c: T.fix_zwnj(c, "boundary"), ["کتابها کتابهاد"]) == [f"کتاب{Z}ها کتابهاد"]
    with pytest.raises(ValueError):
        T.fix_zwnj(F.col("t"), "other")


def test_normalise_keeps_lines_unless_told(spark):
    assert apply(spark, T.normalise, ["كتاب  a\n\n\n\nb ؛"])[0].count("\n") == 2
    assert apply(spark, lambda c: T.normalise(c, collapse_newlines=True), ["a \n b"]) == ["a b"]


def test_keyword_field(spark):
    df = spark.createDataFrame([("وام، گزارش مدل: حقیقی و حقوقی…", "x"), (None, "این پرسش درباره قرارداد"), ("ab; c; d:e", "q")], "k string, q string")
    assert [r[0] for r in df.select(T.keyword_field(F.col("k"), F.col("q"))).collect()] == ["وام گزارش", "پرسش درباره قرارداد", "ab"]


def test_search_tokens(spark):
    assert apply(spark, K.search_tokens, ["The Report-42 of كتاب", "a", None]) == [["report", "42", "کتاب", "کتا", "تاب"], [], None]


def test_fixed_chunker_rules():
    words = lambda n, w="w": " ".join([w] * n)
    assert chunking.fixed_pieces(f"{words(300)}. {words(10)}.") == [f"{words(300)}.", f"{words(10)}."]
    assert chunking.fixed_pieces(". ".join(words(20, f"s{k}") for k in range(30)), 100, 0) == [". ".join(words(20, f"s{k}") for k in (a, a + 1)) + ("." if a < 28 else "") for a in range(0, 30, 2)]
    assert chunking.absorb_short(["a", "b", words(40), "c"], 64) == [f"a\n\nb\n\n{words(40)}", "c"]
    assert chunking.fixed_pieces("") == []


def test_semantic_rules(spark):
    assert chunking.structural_pieces("# A\ntext\n## B\nmore", least=0) == ["# A\ntext\n", "## B\nmore"]
    long = "x " * 600
    assert "".join(chunking.structural_pieces(long.strip(), 100, 0)) == long.strip()
    docs = spark.createDataFrame([(1, "intro\nQuestion: a\nQuestion: b"), (2, None), (3, "")], "doc_id long, text string")
    got = chunking.chunk(docs, "semantic", doc_type="qa_pair", overlap=2).orderBy("ordinal").collect()
    assert [r["content"] for r in got] == ["intro", f"...{Z}intro{Z}...\nQuestion: a", f"...{Z}a{Z}...\nQuestion: b"]
    with pytest.raises(KeyError):
        chunking.chunk(docs, "none")
    chunking.register_chunker("lines", lambda d, **_: chunking.build(d, "doc_id", F.split("text", "\n")))
    assert chunking.chunk(docs, "lines").count() == 3
    del chunking.CHUNKERS["lines"]


def test_overlap_is_of_plain_chunks(spark):
    df = spark.createDataFrame([(1, k, c) for k, c in enumerate(["a b", "c d", "e"])], "doc_id long, ordinal long, content string")
    got = chunking.with_overlap(df, "doc_id", 2).orderBy("ordinal").collect()
    assert [r["content"] for r in got] == ["a b", "…b…\nc d", "…d…\ne"]


def test_parents_link_by_key(spark):
    kids = chunking.sheet_rows(spark.createDataFrame(SHEETS, SHEET_TYPE))
    by_sheet = {(r["doc_id"], r["parent_key"]): r["child_count"] for r in chunking.parents(kids).collect()}
    assert by_sheet == {(1, "s1"): 2, (1, "s2"): 2, (2, ""): 1}
    assert {r["doc_id"]: r["child_count"] for r in chunking.parents(kids, "document").collect()} == {1: 4, 2: 1}


RUN = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 1, "y"), ("c", 1, "q")]
RELS = [("a", "y", 2), ("a", "w", 1), ("b", "y", 1), ("d", "x", 1)]


def test_rows_of_odd_sheets(spark):
    """Blank cells, columns of one name, line ends in cells, a sheet without name and schema."""
    sheets = spark.createDataFrame(SHEETS, SHEET_TYPE)
    got = {(r["doc_id"], r["sheet_no"], r["row_no"], r["ordinal"], r["content"]) for r in chunking.sheet_rows(sheets).collect()}
    assert got == {
        (1, 0, 0, 0, "سوال: q one?\nپاسخ کامل: a b\nکلیدواژه‌ها: k1،k2"), (1, 0, 3, 1, "سوال: Q one\nپاسخ کامل: later"), (1, 1, 0, 2, "سوال: q three\nپاسخ کوتاه: b3\nextra: e"),
        (1, 1, 1, 3, "سوال: q one\nپاسخ کوتاه: dup"), (2, 0, 0, 0, "سوال: q four\nپاسخ کامل: last"),
    }
    assert {r["question"] for r in chunking.sheet_rows(sheets, dedup=True).collect()} == {"q four", "q one?", "q three", "Q one"}


def test_metrics(spark):
    run, rel = spark.createDataFrame(RUN, "query_id string, rank int, doc_id string"), spark.createDataFrame(RELS, "query_id string, doc_id string, rel int")
    got = {r["query_id"]: r for r in metrics.per_query(run, rel, 2).collect()}
    from math import log2

    assert got["a"]["precision"] == 0.5 and got["a"]["recall"] == 0.5 and got["a"]["rr"] == 0.5 and got["a"]["ap"] == 0.25
    assert abs(got["a"]["ndcg"] - (2 / log2(3)) / (2 + 1 / log2(3))) < 1e-9
    assert got["b"]["ndcg"] == 1 and got["c"]["hit"] == 0 and got["d"]["recall"] == 0
    assert all(0 <= r["ndcg"] <= 1 for r in got.values())
    assert metrics.summary(metrics.per_query(run, rel, 2), drop_empty=True).first()["n_queries"] == 3
    assert metrics.per_query(run, rel, 2, ap_base="min", binary=True).count() == 4


def test_fusion_is_symmetric_and_checks_weights(spark):
    a = spark.createDataFrame([(1, "x", 2.0), (1, "y", 1.0)], "query_id int, doc_id string, score double")
    b = spark.createDataFrame([(1, "y", 9.0), (1, "z", 8.0)], "query_id int, doc_id string, score double")
    one, two = ranking.fuse([a, b]).collect(), ranking.fuse([b, a]).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and one[0]["doc_id"] == "y"
    with pytest.raises(ValueError):
        ranking.fuse([a, b], weights=[1.0])


def test_bm25_without_overlap_and_repeated_terms(spark):
    d = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, "alpha alpha"), (3, "zzz the"), (4, "")], "query_id long, text string")
    got = {r["query_id"]: r for r in ranking.bm25(q, build_index(d), 3).collect()}
    assert set(got) == {1, 2} and abs(got[2]["score"] - 2 * got[1]["score"]) < 1e-12


def test_dense_zero_vectors_and_blocks(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0])], "doc_id long, vector array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0]), (9, [0.0, 1.0])], "query_id long, vector array<double>")
    for block in (1, 100):
        got = ranking.dense(q, v, 2, block).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["doc_id"]) for r in got] == [(7, 1), (7, 4), (9, 3), (9, 1)]


def test_similarity_join_is_whole(spark, sf_dir):
    """All pairs by brute force, in several blocks; a chain of links is one class, and a null or zero vector has no link."""
    import numpy as np

    def brute(rows, threshold):
        ids = [i for i, _ in rows]
        e = np.array([v if v is not None else [0] * len(rows[0][1]) for _, v in rows], float)
        size = np.linalg.norm(e, axis=1, keepdims=True)
        e = e / np.where(size > 0, size, 1)
        link = (e @ e.T >= threshold) & (size > 0) & (size.T > 0) & ~np.eye(len(ids), dtype=bool)
        cls = np.array(ids)
        while True:
            new = np.minimum(cls, np.where(link, cls[None, :], 1 << 62).min(1))
            if (new == cls).all():
                return {(i, int(c), int(n)) for i, c, n in zip(ids, cls, link.sum(1), strict=True)}
            cls = new

    chain = [(100 - k, [float(np.cos(k / 10)), float(np.sin(k / 10))]) for k in range(25)] + [(200, [0.0, 0.0]), (201, None), (202, [-1.0, -0.2])]
    real = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    for rows, threshold, block in ((chain, 0.99, 4), (chain, 0.99, 100), (real, 0.3, 150)):
        df = spark.createDataFrame(rows, "doc_id long, vector array<float>").repartition(3)
        assert {tuple(r) for r in vector_index.similarity_join(df, threshold, block=block).collect()} == brute(rows, threshold)


def test_negatives_are_as_many_as_asked_for(spark):
    """On a ring of few or many questions, none of them its own negative."""
    from tessaria.operators import generation

    for n in (1, 2, 3, 5, 700):
        q = spark.createDataFrame([(f"c{k}", f"question {k}") for k in range(n)], "chunk_id string, question string")
        rel = generation.dataset_from_pairs(q, 3)[1].collect()
        other = {}
        for r in rel:
            assert (r["rel"] == 1) == (r["doc_id"] == r["query_id"])
            if r["rel"] == 0:
                other.setdefault(r["query_id"], set()).add(r["doc_id"])
        assert len(rel) == n * (1 + min(3, n - 1)) and all(len(x) == min(3, n - 1) for x in other.values()) and len(other) == (n if n > 1 else 0)


def test_edits(spark):
    """The last edit of a chunk counts; an edited chunk isn't verified any more, a deleted one keeps its content."""
    from tessaria.operators import edits

    chunks = spark.createDataFrame([(k, f"text {k}", 4, k == 2, "active") for k in range(5)], "id int, content string, token_count int, is_verified boolean, status string")
    done = spark.createDataFrame([(0, "verify", None, 1), (1, "edit", "a", 1), (1, "edit", "a b c", 2), (2, "edit", "new", 1), (3, "verify", None, 1), (3, "delete", None, 2), (9, "edit", "none", 1)], "id int, action string, content string, at int")
    got = {r["id"]: (r["content"], r["token_count"], r["is_verified"], r["status"]) for r in edits.apply_edits(chunks, done, "id").collect()}
    assert got == {0: ("text 0", 4, True, "active"), 1: ("a b c", 6, False, "active"), 2: ("new", 2, False, "active"), 3: ("text 3", 4, False, "deleted"), 4: ("text 4", 4, False, "active")}
    assert edits.apply_edits(chunks, done.limit(0), "id").where("id = 2 and is_verified").count() == 1
    two = spark.createDataFrame([(1, 0, "a. b"), (1, 1, ". "), (1, 2, "c. d")], "doc int, ordinal int, content string")
    assert sorted(map(tuple, edits.split_chunks(two, "doc", r"\. ", F.col("ordinal") < 2).collect())) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c. d")]


def test_metrics_at_many_k_are_those_of_each(spark):
    run = spark.createDataFrame([(q, d, (d * 7 + q) % 9 + 1) for q in range(4) for d in range(9)], "query_id int, doc_id int, rank int")
    rel = spark.createDataFrame([(q, d, (q + d) % 3) for q in range(1, 6) for d in range(0, 9, 2)], "query_id int, doc_id int, rel int")
    for r in metrics.at_many_k(run, rel, (1, 4, 20)).collect():
        m = metrics.per_query(run, rel, r["k"], binary=True, ap_base="min").agg(*[F.round(F.avg(c), 6).alias(n) for c, n in (("hit", "hit"), ("recall", "recall"), ("ap", "map"), ("ndcg", "ndcg"), ("rr", "mrr"))]).first()
        assert all(abs(m[n] - r[n]) < 1e-6 for n in ("hit", "recall", "map", "ndcg", "mrr"))


def test_rank_correlation_and_gain(spark):
    run = lambda rows: spark.createDataFrame(rows, "query_id int, doc_id string, rank int")
    a = run([(1, "p", 1), (1, "q", 2), (1, "r", 3), (1, "s", 4), (2, "p", 1), (2, "q", 2), (3, "p", 1)])
    b = run([(1, "p", 2), (1, "r", 3), (1, "q", 7), (1, "t", 1), (2, "p", 9), (2, "q", 3), (3, "p", 5)])
    got = {r["query_id"]: tuple(r)[1:] for r in metrics.rank_correlation(a, b).collect()}
    assert got == {1: (3, 0.5, pytest.approx(1 / 3)), 2: (2, -1.0, -1.0), 3: (1, None, None)}
    rel = spark.createDataFrame([(1, "p", 1)], "query_id int, doc_id string, rel int")
    r = metrics.fusion_gain(run([(1, "p", 1)]), [run([(1, "q", 1)]), run([(1, "t", 1), (1, "p", 3)])], rel, 10).first()
    assert tuple(r) == (1.0, 0.5, 0.5, 1.0)


def test_index_round_trip_and_fingerprint(spark, tmp_path):
    from tessaria.operators.index import Index

    d = spark.createDataFrame([(k, f"word{k} common") for k in range(50)], "doc_id long, text string")
    build_index(d).write(str(tmp_path / "ix"), 4, 8)
    q = spark.createDataFrame([(1, "word7")], "query_id long, text string")
    back = Index.read(spark, str(tmp_path / "ix"))
    assert ranking.bm25(q, back, 1).first()["doc_id"] == 7
    assert sorted(back.doc_norms().collect()) == sorted(build_index(d).doc_norms().collect())
    both = spark.createDataFrame([(1, "word7 common"), (2, "absent word9")], "query_id long, text string")
    for leg in (ranking.bm25, ranking.tfidf):
        rows = lambda ix: [(r["query_id"], r["doc_id"], round(r["score"], 9), r["rank"]) for r in leg(both, ix, 3).orderBy("query_id", "rank").collect()]  # noqa: B023, E731
        assert rows(back) == rows(build_index(d))
    mark = lambda x: corpus_fingerprint(x, "doc_id", "text").first()["fingerprint"]
    assert mark(d) == mark(d.repartition(7)) != mark(d.where("doc_id > 0"))
    table, there = sinks.load_or_build(d, str(tmp_path / "v"), ["text"], lambda x: x.select("doc_id"))
    assert not there and sinks.load_or_build(d, str(tmp_path / "v"), ["text"], lambda x: 1 / 0)[1] and table.count() == 50


def test_variants_are_stable_and_in_band(spark):
    q = spark.createDataFrame([(k, f"برای ثبت قرارداد شماره {k} کدام مدارک لازم است و گزارش آن کجا ارسال می‌شود؟", None) for k in range(10)], "query_id long, question string, keywords string")
    one, two = V.all_variants(q).collect(), V.all_variants(q.repartition(3)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len(one) == 60
    assert all(r["query"] for r in one) and all(r["similarity"] >= 0.8 for r in one if r["format"] == "verbatim")


def test_recipes(spark):
    text = "برای ثبت قرارداد شماره ۷ کدام مدارک لازم است و گزارش آن کجا ارسال می‌شود؟"
    q = spark.createDataFrame([(k, text, None) for k in range(40)] + [(90, "a b", None), (91, "", None), (92, None, None)], "query_id long, question string, keywords string")
    got = {(r["query_id"], r["format"]): r["query"] for r in V.made(q, 1).collect()}
    assert len(got) == 4 * 42 and len({got[k, "reworded"] for k in range(40)}) > 20
    other = {w for v in V.SYNONYMS.values() for x in v for w in x.split()}
    for k in range(40):
        ws = text.split()
        # Words of a paraphrase are the question's own or synonyms, and as many, between what is put around them.
        inside = [w for w in got[k, "paraphrase"].split() if w in ws or w in other or w.rstrip("؟") in ws]
        assert len(ws) - 1 <= len(inside) <= len(ws) + 12
        kept = [w for w in ws if w in got[k, "reworded"].split()]
        assert len(kept) <= len(ws) - len(ws) * 4 // 10 and any(got[k, "reworded"].startswith(p) for p in V.PREFIXES)
        assert any(got[k, "conversational"].startswith(g) for g in V.GREETINGS) and "میشه" in got[k, "conversational"] and "می‌شود" not in got[k, "conversational"]
        undone = got[k, "typo"]
        for right, wrong in V.TYPOS.items():
            undone = undone.replace(wrong, right)
        assert undone.replace(Z, "") == text.replace(Z, "")
    assert {got[k, "typo"] for k in range(40)} > {text} and got[90, "typo"] == "a b"


def test_validation(spark):
    assert apply(spark, quality.chunk_errors, [None, "  ", "short", "متن فارسی به اندازهٔ کافی بلند است", "x" * 10001]) == [["empty"], ["empty"], ["too_short", "low_persian_ratio"], [], ["too_long", "low_persian_ratio"]]


def test_changes_and_rollback(spark):
    old, new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, h string"), spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "4")], "k string, h string")
    assert {r["k"]: r["status"] for r in changes.change_set(old, new, "k", "h").collect()} == {"a": "removed", "b": "unchanged", "c": "modified", "d": "added"}
    docs = spark.createDataFrame([(1, "t", "d", "c")], "doc_id long, title string, domain string, category string")
    kids = spark.createDataFrame([(1, k, "body", f"c{k}", "", 2) for k in (1, 0)], "doc_id long, ordinal long, chunk_type string, content string, heading_path string, token_count long")
    v = versions.snapshot(docs, kids, F.lit(1))
    target = v.select("doc_id", "version")
    twice = versions.rollback(versions.rollback(v, target), target)
    assert sorted(r["version"] for r in twice.collect()) == [1, 2, 3] and versions.latest(twice).first()["status"] == "rollback"
    back = versions.restored_chunks(twice, twice.where("version = 3").select("doc_id", "version"))
    assert sorted(map(tuple, back.select(kids.columns).collect())) == sorted(map(tuple, kids.collect()))


def test_versioned_table(spark, tmp_path):
    t = versions.VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.current() is None
    assert (t.write(spark.range(3)), t.write(spark.range(5)), t.read().count()) == (1, 2, 5)
    t.activate(1)
    assert t.read().count() == 3 and t.read(2).count() == 5
    assert t.write(spark.range(9), activate=False) == 3 and t.current() == 1
    with pytest.raises(ValueError):
        t.activate(8)


def zipped(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return b.getvalue()


def xlsx(rows):
    cells = "".join(f"<row r='{i}'>" + "".join(f"<c r='{chr(65 + j)}{i}' t='inlineStr'><is><t>{v}</t></is></c>" if isinstance(v, str) else f"<c r='{chr(65 + j)}{i}'><v>{v}</v></c>" for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows, 1))
    return zipped({
        "xl/workbook.xml": "<workbook xmlns:r='r'><sheets><sheet name='S1' r:id='rId1'/></sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships><Relationship Id='rId1' Target='worksheets/sheet1.xml'/></Relationships>", "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>",
    })


W = "xmlns:w='http://w'"
DOCX = zipped({"word/document.xml": f"<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val='Heading2'/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>plain </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/><w:sz w:val='28'/></w:rPr><w:t>Big</w:t></w:r></w:p></w:body></w:document>"})


def test_office_files(spark, tmp_path):
    for name, data in (("a.XLSX", xlsx([["question", "answer", None], ["q", 12.0], [None, None], ["", "x"]])), ("sub/b.docx", DOCX), ("~$lock.docx", b"x"), ("notes.txt", b"x"), ("bad.xlsx", b"broken"), ("one.xlsx", xlsx([["only"], ["x"]]))):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r for r in office.parse_files(office.scan_files(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.XLSX", "b.docx", "bad.xlsx", "one.xlsx"}
    assert got["a.XLSX"]["sheets"][0].rows == [["q", "12"], ["", "x"]] and "question: q | answer: 12" in got["a.XLSX"]["content"]
    assert got["b.docx"]["content"] == "## Head\n\nplain **bold**\n\n## Big" and [s.heading for s in got["b.docx"]["sections"]] == ["Head", "Big"]
    assert got["bad.xlsx"]["error"] and "no sheet" in got["one.xlsx"]["error"]
    with pytest.raises(ValueError):
        office.register_parser("pdf", len)
    office.register_parser(".scan", office.pdf_parser(lambda data: ["p  1", None, "p2"]))
    assert office.PARSERS.pop(".scan")(b"", "x.scan")["content"] == "p 1\n\np2"


PDF = (
    b"%PDF-1.4\n% a comment (\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Type/Pages/Kids[3 0 R 6 0 R 8 0 R]>>endobj 3 0 obj<</Type/Page/Contents[4 0 R]>>endobj "
    b"4 0 obj<</Length 5 0 R>>stream\nBT /F1 9 Tf 1 0 0 1 72 700 Tm (Hel\\(lo\\)) Tj 0 -12 Td [(wo)-50(rld)-400(next)] TJ T* (a\\101\\\nb) ' ET\nendstream endobj 5 0 obj 9 endobj "
    b"6 0 obj<</Type/Page/Contents 7 0 R>>endobj 7 0 obj<</Filter/LZWDecode/Length 3>>stream\nabc\nendstream endobj 8 0 obj<</Type/Page/Contents 9 0 R/Parent 2 0 R>>endobj 9 0 obj<</Length 12>>stream\nBT (last) Tj \nendstream endobj"
)


def test_pdf():
    assert pdf.extract_pages(PDF) == ["Hel(lo)\nworld next\n\naAb", None, "last"]  # the second page's filter isn't known
    assert office.PARSERS[".pdf"](PDF, "x/y.pdf")["content"] == "Hel(lo)\nworld next\n\naAb\n\nlast"
    texts = ["سلام دنیا", "", "é 😀 (x) <y>"]
    assert [p.strip() for p in pdf.extract_pages(files.pdf(texts))] == texts
    table = b"1 begincodespacerange <00> <ff> endcodespacerange 2 beginbfrange <41> <43> <0061> <50> <51> [<0078> <00660066>] endbfrange"
    assert pdf.unicode_table(table) == (1, {0x50: "x", 0x51: "ff"}, [(0x41, 0x43, "a")])
    packed = b"7 0 5 20 <</Type/Page>>  (seven)"
    doc = pdf.Document(b"1 0 obj<</Type/ObjStm/N 2/First 9/Length %d>>stream\n%s\nendstream endobj" % (len(packed), packed))
    assert doc.objects[7] == {"Type": "Page"} and doc.objects[5] is not None
    loop = b"%PDF-1.4 1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Type/Pages/Kids[2 0 R]>>endobj"
    assert pdf.extract_pages(loop) == [] == pdf.extract_pages(b"%PDF-1.4 cut off <<< (((")
    for bad in (b"", b"x", b"%PDF-1.4 trailer<</Encrypt 3 0 R>>"):
        with pytest.raises(ValueError):
            office.PARSERS[".pdf"](bad, "x.pdf")


def test_datasets(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"k": 1, "q": "a", "t": "x", "i": "d1"}, {"k": 2, "q": " ", "t": "y", "i": "d2"}, {"k": 3, "q": "c", "t": "z", "i": "d1"}]')
    rows = datasets.read_json(spark, str(tmp_path / "d.json"), "k long, q string, t string, i string")
    q, c, rel = datasets.retrieval_dataset(rows, "k", "q", "t", "i")
    assert sorted(map(tuple, q.collect())) == [("q_0", "a"), ("q_2", "c")] and list(map(tuple, c.collect())) == [("d1", "z")] and rel.count() == 2


def test_snapshot_folders(spark, tmp_path):
    c = spark.createDataFrame([(1, "qa_pair"), (1, "body"), (2, "qa_pair")], "doc_id long, chunk_type string")
    at = F.lit("2024-01-01").cast("timestamp")
    sinks.write_snapshot(c, str(tmp_path), "v 1", at)
    sinks.write_snapshot(c, str(tmp_path), "v2", at + F.expr("interval 1 day"))
    with pytest.raises(FileExistsError):
        sinks.write_snapshot(c, str(tmp_path), "v 1", at)
    got = sinks.list_snapshots(spark, str(tmp_path)).collect()
    assert [r["version"] for r in got] == ["v2", "v 1"] and got[0]["qa_chunks"] == 2


def test_streams_equal_their_batches(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts")
    src = str(tmp_path / "src")
    events.withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(3, "ts").write.parquet(src)
    batch = spark.read.parquet(src)
    late = "60 days"  # nothing is late; windows end with the stream's last watermark
    stream = streams.read_stream(spark, src, batch.schema, 10)
    streams.run_to_end(streams.windowed(stream, "1 day", late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "ck"))
    done = spark.read.parquet(str(tmp_path / "out"))
    want = streams.windowed(batch, "1 day", late=late)
    assert done.exceptAll(want).count() == 0 and done.count() > 0


def test_incremental_merge(spark, tmp_path):
    schema = spark.createDataFrame([], "path string, text string").schema
    src, state, ck = (str(tmp_path / x) for x in ("src", "state", "ck"))
    for turn, rows in enumerate(([("a", "1"), ("b", "2")], [("a", "1"), ("b", "3"), ("c", "4")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        streams.incremental(streams.read_stream(spark, src, schema), "path", "text", state, ck)
        out = {r["path"]: r["text"] for r in streams.merged(spark, state, "path", spark.createDataFrame([], "path string, text string, content_hash string").schema).collect()}
        assert out == dict(rows)
    assert spark.read.parquet(state).count() == 4  # unchanged rows aren't written again
