"""The other operators against brute force, round trips and held-out accuracy, with nulls, ties and repeated rows."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaria.llm import common, decontaminate, html_extract, language_id, packing, sharding, token_counts, tokens, url_filter

from .conftest import SCHEMA, prose

URLS = [
    "http://Example.com/en/1?x#y", "https://WWW.example.com/en/2", "http://a.b.example.com/en", "http://a.example.com/en/x/y", "http://notexample.com/en/", "http://foo.net/es/a/com/", "http://foo.net/fr/", "http://foo.net/fr",
    "http://net/es/", "ftp://x.com?q=/en/", "http://x.com/", "http://x.com", "no scheme.com/", None, "", "http://", "http://x.org/a.com/b", "http://user@x.com:80/p", "http://İ.COM/é", "//x.com/", "http://x.comx/", "http://" + "a." * 500 + "net/es/" + "b" * 3000,
]


def url_brute(url):
    host = path = ""
    if url and "://" in url:
        rest = re.match(r"[^?#]*", url.split("://", 1)[1]).group()
        host, slash, path = rest.partition("/")
        path = slash + path
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for r, v in url_filter.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls(spark):
    df = spark.createDataFrame([(k, u, "r") for k, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df).collect()}
    assert got == {k: url_brute(u) for k, u in enumerate(URLS * 2)}
    assert url_filter.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("glob, text, ok", [("a*c", "abbc", True), ("a*c", "ac", True), ("a*c", "ab/c", False), ("a**c", "ab/c", True), ("*x*", "yxz", True), ("abc", "abcd", False), ("**", "", True), ("a*b*c**", "aXbYc/Z", True)])
def test_globs(glob, text, ok):
    auto = url_filter.compile_globs(["q" * 70, glob, "zz**"])  # the second begins in one word and ends in the next
    raw = np.frombuffer(text.encode(), np.uint8)
    assert auto.run(raw, np.array([0, len(raw)]))[0, 1] == ok


def test_shards(docs, table_rows):
    got = sharding.shard(docs, shards=5, slots=64, cells=4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in table_rows)
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {r["law"] for r in got} == {"bytes"}


def test_shards_are_even(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    total = [r["b"] for r in sharding.shard(df).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(total) == 24 and max(total) < 1.01 * min(total)


def test_shards_empty(empty):
    assert sharding.shard(empty).count() == 0


def test_slot_map_is_edited(spark, tmp_path):
    size = {s: 100 + s % 7 for s in range(512)}
    old = sharding.assign(size, 8, 512)
    grown = sharding.rebalance(old, size, 9)
    moved = [s for s in old if old[s] != grown[s]]
    assert all(grown[s] == 8 for s in moved) and len(moved) < 512 / 9 + 9
    shrunk = sharding.rebalance(grown, size, 8)
    assert set(shrunk.values()) == set(range(8))
    for m in (old, grown, shrunk):
        total = Counter()
        for s, k in m.items():
            total[k] += size[s]
        assert max(total.values()) <= 1.05 * min(total.values())
    where = f"file://{tmp_path}/map"
    sharding.store_map(spark, old, 1, where)
    sharding.store_map(spark, grown, 2, where)
    assert sharding.load_map(spark, where, 1) == old and sharding.load_map(spark, where, 2) == grown


ITEMS = [(1, prose(1, 14)), (2, "Short Item!"), (3, None), (4, "..."), (5, prose(2, 11).upper()), (5, prose(2, 11)), (12, prose(1, 10)), (None, prose(3, 30)), (6, "漢字 Ünï")]


def leaks_brute(text, window):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    w, hit, ids = word.findall(low(text or "")), set(), set()
    for place, (i, t) in enumerate(ITEMS):
        x = word.findall(low(t or ""))
        n = min(window, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == x[k : k + n]:
                    hit |= set(range(j, j + n))
                    ids.add(str(i) if i is not None else place)  # an item without an id counts by itself
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(i for i in ids if isinstance(i, str))).encode()).hexdigest(), bool(hit)


def test_leaks(spark, docs, table_rows):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    own = spark.createDataFrame([(100 + k, t) for k, t in enumerate(["short item", "a short, ITEM b", "shorts item", "x漢字-ünï", "x 漢字-Ünï y", (prose(2, 11) + " ") * 50, "so " + prose(3, 30) + " short item"])], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(own)
    for most in (decontaminate.BLOCK_WORDS, 20, 11):  # one block, several, and items cut into parts
        got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.decontaminate(both, bench, block_words=most).collect())
        assert got == Counter((r["doc_id"], *leaks_brute(r["text"], 10)) for r in both.collect())
        clean = decontaminate.keep_clean(docs, bench, block_words=most)
        assert clean.columns == docs.columns and clean.count() == sum(not leaks_brute(t, 10)[-1] for _, t, *_ in table_rows)
    assert not decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count()
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_blocks_are_scanned_one_after_another(spark, docs, table_rows, capfd):
    """The plan of the result has no automaton, whatever the number of blocks; hot rows that repeat are judged each."""
    bench = spark.createDataFrame([(k, prose(50 + k, 20)) for k in range(9)] + [(99, prose(1, 12))], "item_id long, text string")
    assert sum(1 for _ in decontaminate.blocks(bench, 10, 25)) == 10
    many = docs.select("doc_id", "text").unionByName(spark.range(300).select(F.lit(1).cast("long").alias("doc_id"), F.lit(prose(1, 400)).alias("text")))
    found = decontaminate.decontaminate(many, bench, block_words=25)
    found.explain()
    assert capfd.readouterr().out.count("MapInArrow") == 1
    whole = decontaminate.decontaminate(many, bench)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(found) == key(whole) and found.where("contaminated").count() > 300
    assert decontaminate.keep_clean(many, bench, block_words=25).count() == decontaminate.keep_clean(many, bench).count() == many.count() - found.where("contaminated").count()


def test_spans_point_into_the_original(spark):
    text = "Ünder the,  SHORT -- Item; (漢字 ünder)"
    auto = decontaminate.build([("2", "short item")])
    hit, _ = auto.scan(decontaminate.word_list(text))
    assert [text[a:b] for a, b in decontaminate.spans(text, hit)] == ["SHORT -- Item"]


def test_a_full_block_stays_small():
    """The automaton at its bound of words, of a large vocabulary, as its own statistics tell."""
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 1 << 16, decontaminate.BLOCK_WORDS)
    items = [(str(k), [b"w%d" % x for x in ids[k : k + 64]]) for k in range(0, len(ids), 64)]
    auto = decontaminate.Windows(items)
    assert auto.auto.get_stats()["total_size"] < 256 << 20
    hit, found = auto.scan([b"x", *items[7][1][3:20], b"w1"])
    assert hit.tolist() == [False, *[True] * 17, False] and found == {7}


def test_ids_are_those_of_the_tokenizer_file(table_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = tokens.encoding()
    for t in {r[1] for r in table_rows if r[1]} | {"  <|endoftext|>\n\n x", "a b\t\t", "😀 é" * 9}:
        assert tokens.ids(enc, t).tolist() == slow.encode(t, add_special_tokens=False).ids


def unpacked(rows, docs_rows, length):
    """Checks that pieces give back every document's ids, and sequences are gapless; returns sequence lengths."""
    enc = tokens.encoding()
    want = Counter()
    for d, t, *_ in docs_rows:
        want[d, len(tokens.ids(enc, t)) + 1] += 1
    got = Counter()
    for r in rows:
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert got == Counter({k: n * k[1] for k, n in want.items()})
    if len(set(d for d, *_ in docs_rows)) == len(docs_rows):
        text = {d: np.append(tokens.ids(enc, t), 1).astype("<u4") for d, t, *_ in docs_rows}
        for r in rows:
            assert zlib.crc32(text[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    seqs = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == seqs.get(r["sequence_id"], 0)
        seqs[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(seqs.values(), default=0) <= length
    return list(seqs.values())


def test_pack(docs, table_rows):
    sizes = unpacked(packing.pack(docs).collect(), table_rows, 2048)
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes)


def test_pack_small_groups(spark):
    rows = [(k, prose(k, 1 + k * 37 % 500)) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes = unpacked(packing.pack(df, length=256, group_docs=20).collect(), rows, 256)
    assert all(n == 256 or n & (n - 1) == 0 for n in sizes)


def test_pack_empty(empty):
    assert packing.pack(empty).count() == 0


def test_first_fit_decreasing():
    assert packing.first_fit_decreasing([4, 8, 1, 4, 2, 1], 10) == [[1, 4], [0, 3, 2, 5]]
    rng = np.random.default_rng(1)
    size = rng.integers(1, 100, 500).tolist()
    bins, free = [], []
    for k in sorted(range(500), key=lambda k: -size[k]):
        b = next((i for i, f in enumerate(free) if f >= size[k]), len(bins))
        if b == len(bins):
            bins.append([])
            free.append(100)
        bins[b].append(k)
        free[b] -= size[k]
    assert packing.first_fit_decreasing(size, 100) == bins


def counted(df):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"], r["n_chars"]) for r in df.collect()}


def test_rollup_follows_deltas(spark, docs, tmp_path):
    r = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    c = token_counts.count_tokens(docs).cache()
    assert r.commit("a", inserts=c) and not r.commit("a", inserts=c)

    def sums(df):
        return counted(df.groupBy("source", "lang", "tokenizer").agg(*[F.sum(x).alias(x) for x in token_counts.SUMS]))

    assert counted(r.totals()) == sums(c)
    gone = c.where("doc_id in (1, 17, 999)")
    assert r.commit("b", deletes=gone)
    left = c.where("doc_id is null or doc_id not in (1, 17)")
    assert counted(r.totals()) == sums(left)
    new = c.where("doc_id in (2, 3)").withColumns({"n_tokens": F.lit(7).cast("long"), "source": F.lit("moved")})
    assert r.commit("c", revised=new) and not r.commit("c", revised=new)
    assert counted(r.totals()) == sums(left.where("doc_id is null or doc_id not in (2, 3)").unionByName(new))
    assert r.batches() == ["a", "b", "c"]
    again = c.where("doc_id in (4, 5) or doc_id is null")  # held already, but for the rows without an id
    assert r.commit("d", inserts=again)
    assert counted(r.totals()) == sums(left.where("doc_id is null or doc_id not in (2, 3)").unionByName(new).unionByName(c.where("doc_id is null")))
    before = counted(r.totals())
    assert r.commit("e", inserts=c.limit(0), deletes=c.limit(0)) and counted(r.totals()) == before


def test_a_taken_name_is_not_renamed_over(spark, tmp_path):
    """Nor is the folder moved into the other one, as a plain renaming does on some file systems."""
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "file").write_text(name)
    assert common.rename_once(spark, f"file://{tmp_path}/one", f"file://{tmp_path}/there")
    assert not common.rename_once(spark, f"file://{tmp_path}/two", f"file://{tmp_path}/there")
    assert (tmp_path / "there" / "file").read_text() == "one" and (tmp_path / "two" / "file").exists() and not (tmp_path / "there" / "two").exists()


def test_counts(docs, table_rows, empty):
    enc = tokens.encoding()
    got = Counter((r["doc_id"], r["n_tokens"], r["n_chars"]) for r in token_counts.count_tokens(docs).collect())
    assert got == Counter((d, len(tokens.ids(enc, t)), len(t or "")) for d, t, *_ in table_rows)
    assert token_counts.count_tokens(empty).count() == 0


def test_language_accuracy_on_held_out(spark):
    d = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id")
    for r in got.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("ok"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect():
        assert r["ok"] > 0.99 and 0 <= r["lo"] <= r["hi"] <= 1
    for r in got.collect()[:50]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_language_edges(spark, docs, empty, monkeypatch):
    got = language_id.identify(docs).collect()
    assert len(got) == docs.count()
    blank = {7, 8, 9, 2**62}
    for r in got:
        if r["doc_id"] in blank:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in ("en", "de", "fr")
    assert language_id.identify(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}
    several = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").when(F.col("doc_id") == 1, "xx").otherwise("de"))
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    assert {r["lang_pred"] for r in language_id.identify(several).collect()} <= {"en", "de", "und"}
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
    assert not {r["doc_id"] for r in kept.collect()} & blank


def test_predictions_see_the_text_alone(spark):
    d = common.table(spark, "/root/testdata/sf0.001", "documents")
    model = language_id.fit(d)
    one = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(d.select("doc_id", "text"), model).collect()}
    two = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(d.select("doc_id", "text").repartition(7).orderBy("text"), model).collect()}
    assert one.keys() == two.keys() and all(one[k][0] == two[k][0] and abs(one[k][1] - two[k][1]) < 1e-9 for k in one)


def test_html_of_the_tables(spark):
    """The main text is what stands in each page's article."""
    from html import unescape

    d = common.table(spark, "/root/testdata/sf0.001", "pages")
    html = {r["page_id"]: r["html"] for r in d.collect()}
    for r in html_extract.extract(d).collect():
        inner = html[r["page_id"]].split("<article>", 1)[1].split("</article>", 1)[0]
        blocks = [" ".join(unescape(re.sub(r"</?b>|<br>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(x for x in blocks if x) and r["n_chars"] == len(r["text"])


def test_html_of_held_out_layouts():
    rng, forest, wrong, total = np.random.default_rng(1234), html_extract.model(), 0, 0
    for _ in range(150):
        html, labels = html_extract.made_page(rng)
        tree = html_extract.parse(html)
        wrong += int((html_extract.decode(tree.parent, forest.odds(html_extract.features(tree)))[1:] != np.array(labels)).sum())
        total += len(labels)
    assert wrong < 0.01 * total


@pytest.mark.parametrize(
    "page, text",
    [
        ("plain text only &amp; more", "plain text only & more"),
        ("first piece</p><p>Second paragraph here, with words.</p>", "first piece\nSecond paragraph here, with words."),
        ("<body>Some text here that is long enough to be read.<br>And more</body>", "Some text here that is long enough to be read. And more"),
        ("<html><body>Text one two three four. More of it.</body></html>", "Text one two three four. More of it."),
        ("<p>One short line.</p><p>And a second one, with words.</p>", "One short line.\nAnd a second one, with words."),
        ("<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><p>A para.</p></article><aside>side</aside><footer>foot</footer></body></html>", "A para."),
        ("<article><p>Real text of it.</p><template><p>tmpl</p></template><svg><text>svg</text></svg><p hidden>hid</p><p>All of it.</p></article>", "Real text of it.\nAll of it."),
        ("<article><p>Real text of it.</p><div style='color: red; display: none'><p>none</p></div><p>seen <span style=\"display:none\">no</span> too</p><div aria-hidden=true>ah</div></article>", "Real text of it.\nseen too"),
    ],
)
def test_html_written_by_hand(page, text):
    assert html_extract.extract_texts([page], html_extract.model()) == [text]


P = [" ".join(f"word{(k * 7 + n) % 23}" for k in range(25)).capitalize() + "." for n in range(6)]
MENU = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul>"


@pytest.mark.parametrize(
    "page, blocks",
    [
        (f"<body><div><div>{P[0]}</div><div>{P[1]}</div></div></body>", P[:2]),
        ("<body><div>" + "".join(f"<div>{p}</div>" for p in P[:4]) + "</div></body>", P[:4]),
        (f"<table><tr><td><h1>Headline</h1><p>{P[0]}<p>{P[1]}</td></tr></table>", ["Headline", *P[:2]]),
        (f"<td><h1>Headline</h1><p>{P[0]}<p>{P[1]}</td>", ["Headline", *P[:2]]),
        (f"<body><div><h1>Head</h1><p>{P[0]}</p><p>{P[1]}</p></div></body>", ["Head", *P[:2]]),
        (f"<html><head><title>x</title></head><body><nav>{MENU}</nav><div><h1>Head line here</h1><div>{P[0]}</div><div>{P[1]}</div><div>{P[2]}</div></div><footer>&copy; 2024</footer></body></html>", ["Head line here", *P[:3]]),
        (f"<html><body><header><h1>Site name</h1></header><section><h2>Title of it</h2><p>{P[3]}</p><p>{P[4]}</p></section><div class=sidebar><p>{P[5]}</p></div></body></html>", ["Title of it", P[3], P[4]]),
        (f"<body><table><tr><td>{MENU}</td><td><h1>Top</h1><p>{P[0]}</p><p>{P[1]}</p></td></tr></table></body>", ["Top", *P[:2]]),
        (f"<p>{P[0]}</p><p>{P[1]}</p>", P[:2]),
    ],
)
def test_html_without_telling_attributes(page, blocks):
    """Pages from outside the generator: blocks that are divs, containers without attributes, tables as layout."""
    assert html_extract.extract_texts([page], html_extract.model())[0].split("\n") == blocks


@pytest.mark.parametrize("page", ["<div>" * 20000 + "</span>" * 20000, "<ul><li><ul>" + "<div>" * 20000 + "<li></li>" * 20000, "<p><li>" + "<span>" * 20000 + "<div></div>" * 20000, "<b>" * 30000 + "</i>" * 30000, "<a '" * 20000])
def test_html_is_parsed_in_linear_time(page):
    began = time.perf_counter()
    html_extract.parse(page)
    assert time.perf_counter() - began < 3


def test_html_edges(spark):
    body = "".join(f"<p>{prose(k, 60)}.</p>" for k in range(4))
    pages = [None, "", "   ", "<", "<<<>>>", "<article", f"<article><p>a &amp; b &lt;c&gt; &#233; x<br>y\n z</p>{body}", f"<html><body><nav><a href='/'>Home</a></nav><main>{body}<form><p>Your name please</p><input></form></main></body>", "<p>" * 3000 + "deep" + "</div>" * 10, "<script>var a='<p>no</p>'"]
    df = spark.createDataFrame([(k, "u", p, "t") for k, p in enumerate(pages)] + [(0, "u", None, "t")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got[0] == got[1] == got[2] == "" and got[9] == ""
    assert got[6].split("\n")[0] == "a & b <c> é x y z" and len(got[6].split("\n")) == 5
    assert got[7] == "\n".join(f"{prose(k, 60)}." for k in range(4))
    assert html_extract.extract(df.limit(0)).count() == 0 and html_extract.extract(df).count() == 11


@pytest.mark.parametrize("odds", [[3, -2, 5, 5], [3, 2, -5, 5], [0.1, -9, 9, 9]])
def test_decoding_never_contradicts(odds):
    """Against all labellings of a small tree."""
    from itertools import product

    parent, o = [-1, 0, 1, 1], np.array(odds, float)
    best = max((x for x in product((False, True), repeat=3) if x[0] or not (x[1] or x[2])), key=lambda x: sum(-np.logaddexp(0, -v) if k else -np.logaddexp(0, v) for k, v in zip(x, o[1:], strict=True)))
    assert tuple(html_extract.decode(parent, o)[1:]) == best


def test_schema_of_edge_rows_is_the_documents_own():
    assert SCHEMA.startswith("doc_id long, text string, lang string, source string, n_chars long")
