"""Exact, near and substring dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessaria.llm import components, exact_dedup, near_dedup, substring_dedup, words

from .conftest import changed, prose


def test_exact(docs, table_rows):
    groups = defaultdict(list)
    for r in table_rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((-len(r[1] or ""), 2**63 if r[0] is None else r[0], r[0]))
    want = Counter()
    for k, g in groups.items():
        keep = min(g)[2]
        for _, _, d in g:
            want[d, keep, len(g), d == keep, hashlib.sha256(k.encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) == want


def test_exact_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("key"))
    routes = exact_dedup.directory(keys, capacity=300, most=12)
    placed = keys.withColumn("cell", exact_dedup.cell(F.col("key"), 12)).join(routes, "cell")
    assert placed.count() == 4000 and routes.count() == 1 << 12
    assert max(r["count"] for r in placed.groupBy("bucket").count().collect()) <= 300
    same = spark.range(100).select(F.lit(5).cast("long").alias("key"))  # equal keys are chained, not split
    depth = {r["cell"]: r["depth"] for r in exact_dedup.directory(same, capacity=10, most=6).collect()}
    assert depth[0] == 6 and depth[1] == 6 and depth[2] == 5 and depth[63] == 1


def test_buckets_have_depths_of_their_own():
    """A full half is split on while the empty one stays one bucket; ranges cover all keys in order."""
    made = exact_dedup.buckets({0: 9, 1: 1, 2: 1}, capacity=4, most=3)
    assert made == [(0, 0, 3), (1, 1, 3), (2, 2, 2), (3, 4, 1)]
    assert exact_dedup.buckets({}, capacity=4, most=3) == [(0, 0, 0)]


def test_index_is_owned_by_buckets(spark, docs):
    """No shuffle between routing and the index; colliding keys are chained and told apart."""
    located = spark.createDataFrame([(k, 77, bytes([k % 3]), 4, 10 + k) for k in range(9)] + [(k, k << 57, b"x", 4, 1) for k in range(20, 60)], "doc_id long, key long, digest binary, bytes int, points long")
    index, _ = exact_dedup.build_index(located, capacity=4, most=8)
    got = {(r["key"], r["place"]): (r["keep_id"], r["group_size"]) for r in index.where("key = 77").collect()}
    assert got == {(77, 1): (6, 3), (77, 2): (7, 3), (77, 3): (8, 3)}
    assert index.count() == 43 and index.groupBy("bucket").agg(F.countDistinct("key").alias("n")).agg(F.max("n")).first()[0] <= 4


def jaccard(a, b):
    a, b = Counter(zip(*[a[i:] for i in range(5)])), Counter(zip(*[b[i:] for i in range(5)]))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_near_finds_copies_and_leaves_others(docs):
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(docs).collect() if r["doc_id"] is not None}
    assert [r["class_id"] for r in near_dedup.near_dedup(docs.where("doc_id is null and text is not null")).collect()] == [None]
    assert got[1]["class_id"] == got[2]["class_id"] == got[3]["class_id"] == 1
    assert got[4]["class_id"] == got[5]["class_id"] == 4
    assert got[6]["class_id"] == got[-5]["class_id"] == -5
    assert got[10]["class_id"] == got[11]["class_id"] == 10 and got[12]["class_id"] == 12
    assert got[17]["class_id"] == got[19]["class_id"] == 17
    for alone in (7, 8, 9, 13, 14, 15, 16, 2**62):
        assert got[alone]["class_id"] == (2**62 if alone == 2**62 else alone)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got.values())
    assert near_dedup.near_dedup(docs).count() == docs.count()


def test_near_empty(empty):
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_equals_brute_force_on_a_cloud_of_copies(spark):
    """A group whose members are similar to some of the others only: chains must hold together."""
    base = prose(11, 200)
    rng = np.random.default_rng(0)
    texts = [base]
    for _ in range(150):
        w = base.split(" ")
        for i in rng.choice(len(w), 6, replace=False):
            w[i] = f"q{rng.integers(1 << 30)}"
        texts.append(" ".join(w))
    texts += [prose(100 + k, 150) for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    idf = near_dedup.document_frequencies(df)
    row, h, w, _ = near_dedup.shingles(pa.array(texts), idf)
    sets = [dict(zip(h[row == k].tolist(), w[row == k].tolist(), strict=True)) for k in range(len(texts))]
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            both = sum(min(v, sets[b][k]) for k, v in sets[a].items() if k in sets[b])
            if both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(df).collect()}
    assert got == {k: find(k) for k in range(len(texts))}


def nodes_of(spark, texts):
    """texts by key, and a broadcast idf."""
    t = spark.createDataFrame([(Decimal(k), t) for k, t in enumerate(texts)], "key decimal(38,0), text string")
    return t, spark.sparkContext.broadcast(near_dedup.document_frequencies(t))


def in_bucket(spark, texts, near=None):
    rows = [(7, Decimal(k), near[k] if near else k, len(t), len(texts), Decimal(0), sum(map(len, texts))) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "bucket long, key decimal(38,0), near long, size long, n long, first decimal(38,0), bytes long")


def exact_links(spark, members, texts, idf, threshold):
    none = spark.createDataFrame([], "node decimal(38,0), component decimal(38,0)")
    mixed = near_dedup._mixed(members, none).cache()
    return [{tuple(sorted(map(int, r))) for r in f(mixed, texts, idf, threshold).collect()} for f in (near_dedup.compare_within_blocks, near_dedup.compare_across_blocks)]


def test_rest_is_compared_exactly(spark):
    """Nodes outside a bucket's largest component are linked by the exact step alone."""
    base = prose(21, 200)
    texts = [base, changed(base, 50), changed(base, 70, "yy"), prose(22, 200), prose(23, 200)]
    t, idf = nodes_of(spark, texts)
    got, across = exact_links(spark, in_bucket(spark, texts), t, idf, 0.75)
    assert {(0, 1), (0, 2)} <= got and not any(3 in p or 4 in p for p in got) and not across


def test_rest_is_compared_across_blocks(spark, monkeypatch):
    """Blocks of three nodes: what the own block doesn't show, the other blocks do."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    base = [prose(200 + k, 60) for k in range(8)]
    texts = [changed(b, 70, "yy") if k else b for b in base for k in (0, 1)]
    t, idf = nodes_of(spark, texts)
    within, across = exact_links(spark, in_bucket(spark, texts), t, idf, 0.8)
    assert within | across == {(k, k + 1) for k in range(0, 16, 2)} and across and not within & across


def test_rest_of_a_bucket_of_three(spark):
    """The star and the chain test a-b and a-c when a stands between b and c: the pair b-c is left to the exact step."""
    base = prose(24, 200)
    texts = [prose(25, 200), base, changed(base, 70)]
    t, idf = nodes_of(spark, texts)
    members = in_bucket(spark, texts, near=[5, 4, 6])
    assert {(int(r.a), int(r.b)) for r in near_dedup.star_and_chain(members).collect()} == {(0, 1), (0, 2)}
    assert exact_links(spark, members, t, idf, near_dedup.THRESHOLD)[0] == {(1, 2)}


def test_more_rows_than_a_sort_takes():
    """Beyond the rows of one sort, each row's shingles stay its own."""
    many = near_dedup.MOST_ROWS + 5
    idf = np.ones(1 << near_dedup.BUCKET_BITS, np.float32)
    row, h, w, digest = near_dedup.shingles(pa.array([f"row {k}" for k in range(many)]), idf)
    assert row.tolist() == list(range(many)) and len(digest) == many and len(np.unique(digest[:, 0])) == many


def test_a_hot_group_of_near_copies(spark, monkeypatch):
    """Most rows are near copies of one text, dealt into many runs, parts and blocks."""
    for name, value in (("RUN", 16), ("HUB", 8), ("BLOCK", 8)):
        monkeypatch.setattr(near_dedup, name, value)
    base = prose(77, 120)
    texts = [" ".join([f"n{k}", *base.split(" ")]) for k in range(90)] + [prose(300 + k, 80) for k in range(20)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)).collect()}
    assert got == {k: 0 if k < 90 else k for k in range(110)}


def test_near_stage_goes_row_by_row(spark, docs, empty):
    """Null and repeated ids: a row goes for its own text only, and exactly one row of each class stays."""
    base, other = prose(500, 120), prose(501, 120)
    more = [(None, base), (None, changed(base, 90)), (None, other), (None, other), (70, prose(502, 90)), (70, changed(base, 80)), (80, prose(503, 90)), (80, prose(503, 90)), (90, None), (90, None), (91, " ")]
    rows = spark.createDataFrame([(i, t, f"l{k}", None, k, None, None, None, None) for k, (i, t) in enumerate(more)], docs.schema)
    stay = sorted((r["doc_id"] or 0, r["text"] or "") for r in near_dedup.keep_one_of_each(rows).collect())
    assert stay == sorted([(0, other), (70, prose(502, 90)), (70, changed(base, 80)), (80, prose(503, 90)), (90, ""), (90, ""), (91, " ")])
    got = near_dedup.near_dedup(rows).collect()
    assert len(got) == len(more) and sum(r["class_id"] is None for r in got) == 2
    assert near_dedup.keep_one_of_each(empty).columns == docs.columns and near_dedup.keep_one_of_each(empty).count() == 0


def test_samples_agree_as_often_as_texts_are_similar():
    base = prose(31, 2000)
    a, b = base, changed(base, 40)
    idf = np.ones(1 << near_dedup.BUCKET_BITS, np.float32)
    old = near_dedup.BANDS
    row, h, w, _ = near_dedup.shingles(pa.array([a, b]), idf)
    s = near_dedup.samples(row, h, w, 2)
    assert near_dedup.BANDS == old
    true = near_dedup.similarities(pa.array([a]), pa.array([b]), idf)[0]
    assert abs((s[0] == s[1]).mean() - true) < 0.3
    assert abs(true - jaccard(a.split(), b.split())) < 1e-6


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (300, 300)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substrings(rows, window):
    """rows: (doc_id, rid, text), rid telling texts of one id apart."""
    seen, out = {}, {}
    for order, rid, text in sorted(set(rows)):
        w = WORD.findall(text)
        cover = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[k : k + window]), (order, rid, k)) != (order, rid, k):
                cover[k : k + window] = [True] * window
        kept = " ".join(x for x, c in zip(w, cover, strict=True) if not c)
        out[order, rid] = (len(w), sum(cover), hashlib.sha256(kept.encode()).hexdigest())
    return out


def check_substrings(df, window):
    d = F.col("doc_id").cast("long")
    ids = df.select("doc_id", F.coalesce(d, F.lit((1 << 63) - 1)).alias("o"), F.xxhash64(d, "text").alias("rid"), F.coalesce("text", F.lit("")).alias("t")).collect()
    want = brute_substrings([(r["o"], r["rid"], r["t"]) for r in ids], window)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(df, window).collect())
    assert got == Counter((r["doc_id"], *want[r["o"], r["rid"]]) for r in ids)


def test_substrings(docs):
    check_substrings(docs, 20)


def test_substrings_short_windows(docs):
    check_substrings(docs, 6)


def test_substrings_empty(empty):
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substrings_in_many_groups(spark, docs, monkeypatch):
    """Small groups, runs and slices, hot anchors and such that aren't."""
    for name, value in (("GROUP_WORDS", 300), ("GROUP_BYTES", 3000), ("RUN", 200), ("RUN_BYTES", 2000), ("HOT", 12)):
        monkeypatch.setattr(substring_dedup, name, value)
    monkeypatch.setattr(words, "SLICE_BYTES", 2000)
    passage = prose(41, 40)
    many = [(k, f"{prose(50 + k, 5)} the same old four {passage if k % 2 else prose(80 + k, 30)} the same old four") for k in range(60)]
    check_substrings(spark.createDataFrame(many, "doc_id long, text string").repartition(4), 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 9))
def test_nodes_are_those_of_the_words(ids, depth):
    """Two suffixes lie under one node exactly if their first words are equal."""
    node = substring_dedup.nodes(np.array(ids, np.int64), depth)
    known = {}
    for k in range(len(ids) - depth + 1):
        assert known.setdefault(tuple(ids[k : k + depth]), node[k]) == node[k]
    assert len(set(known.values())) == len(known)


def test_words_are_told_apart_by_their_bytes():
    data, off = words.buffers(pa.array(["aa b  aa", "b\taab é"], pa.string()))
    _, start, end, _ = words.words(data, off, words.PLAIN)
    assert substring_dedup.word_numbers(data, start, end).tolist() == [0, 1, 0, 1, 2, 3]
    assert substring_dedup.word_numbers(data[:0], start[:0], end[:0]).tolist() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ é漢\n\t.9", max_size=30), max_size=6))
def test_word_hashes(texts):
    """Rows' words are those of a regular expression, and equal words have equal hashes wherever they stand."""
    data, off = words.buffers(pa.array(texts, pa.string()))
    h, start, end, first = words.words(data, off, words.PLAIN)
    raw = data.tobytes()
    found = [raw[a:b].decode() for a, b in zip(start, end, strict=True)]
    assert [found[first[k] : first[k + 1]] for k in range(len(texts))] == [WORD.findall(t) for t in texts]
    seen = {}
    assert all(seen.setdefault(w, x) == x for w, x in zip(found, h.tolist(), strict=True)) and len(set(seen.values())) == len(seen)
