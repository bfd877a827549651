"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A document is its five-word shingles, each weighted by how often it occurs there
times its inverse document frequency: the mean over its words of
1 + ln((1 + N) / (1 + df)) / ln(2 + N), with df counted over all documents in a
fixed number of hashed word buckets. (The df of the shingle itself would measure
how often a document has been copied, so that large groups would fall apart; a
wider spread would take pairs apart that differ in a few rare words.)

Texts with equal words are one node, named by the 126-bit digest of the words.
Consistent samples are banded into buckets. Within a bucket no pairs are
enumerated: nodes are linked to the bucket's first node and to their neighbour
in the order of another band, each link is verified on whole texts, and verified
links are joined into components. Where a bucket still holds several components,
its nodes are dealt into blocks of bounded rows and bytes, and the nodes outside
the largest component are compared exactly: first with the nodes of their own
block, which joins most, and then, those that are still outside, block by block
with the other nodes of the bucket. So every pair of nodes that share a bucket is
verified or already connected. The cost is linear, but for the nodes that stay
outside: each of those is held against its whole bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessaria.llm import words
from tessaria.llm.common import drop, join_spread, keep, small_batches
from tessaria.llm.components import components

U = np.uint64
SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 8, 3
#: Word buckets of the document frequencies: 4 MB, whatever the input.
BUCKET_BITS = 20
#: Nodes of a bucket that are ordered, that meet one copy of the first node's text, and that are compared exactly, in one task; and the latter's bytes.
RUN, HUB, BLOCK, BLOCK_BYTES = 1024, 256, 512, 2 << 20
#: Rows whose shingles are told apart in one sort, as a row takes 16 bits there.
MOST_ROWS = 1 << 15

# --- document frequencies ------------------------------------------------------------------------------------------------


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency by word bucket, as float32; each task sums its own documents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for b in batches:
            for s in words.slices(b, "text"):
                h, _, _, first = words.words(*words.buffers(s.column(0)), words.FOLDED)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first)).astype(U)
                pairs = np.unique((doc << U(BUCKET_BITS)) | (h >> U(64 - BUCKET_BITS)))
                df += np.bincount((pairs & U((1 << BUCKET_BITS) - 1)).astype(np.int64), minlength=1 << BUCKET_BITS)
                n += s.num_rows
        at = np.flatnonzero(df)
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(df[part])], ["bucket", "df"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([n], pa.int64())], ["bucket", "df"])

    total = docs.select("text").mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    got = total.toArrow()  # at most one row per bucket
    bucket, count = got.column("bucket").to_numpy(), got.column("df").to_numpy()
    n = int(count[bucket == -1].sum())
    df = np.zeros(1 << BUCKET_BITS)
    df[bucket[bucket >= 0]] = count[bucket >= 0]
    return (1 + np.log((1 + n) / (1 + df)) / np.log(2 + n)).astype(np.float32)


# --- shingles and samples ------------------------------------------------------------------------------------------------


def shingles(col: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, 48-bit hash, weight of each distinct shingle, by row and hash; 128-bit digest of each row's words, or 0 without any).

    A text of one to four words is one shingle.
    """
    if len(col) > MOST_ROWS:
        parts = [(at, shingles(col.slice(at, MOST_ROWS), idf)) for at in range(0, len(col), MOST_ROWS)]
        return np.concatenate([r + at for at, (r, _, _, _) in parts]), *(np.concatenate([p[k] for _, p in parts]) for k in (1, 2, 3))
    h, _, _, first = words.words(*words.buffers(col), words.FOLDED)
    count = np.diff(first)
    rows = len(count)
    weight = idf[h >> U(64 - BUCKET_BITS)]
    digest = np.zeros((rows, 2), U)
    for k, x in enumerate((h, words.mix(h ^ U(0x5851F42D4C957F2D)))):
        up, down = words.powers(words.GRAM, len(x) + 1)
        sums = np.zeros(len(x) + 1, U)
        np.cumsum(x * up[: len(x)], out=sums[1:])
        digest[:, k] = words.mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] + count.astype(U))
    digest[count == 0] = 0
    doc = np.repeat(np.arange(rows), np.maximum(0, count - SHINGLE + 1))
    at = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(0, count - SHINGLE + 1)) - np.maximum(0, count - SHINGLE + 1), np.maximum(0, count - SHINGLE + 1)) + first[:-1][doc]
    g = words.grams(h, SHINGLE)[at] if len(at) else np.zeros(0, U)
    w = np.zeros(len(at), np.float32)
    for k in range(SHINGLE):
        w += weight[at + k]
    w /= SHINGLE
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        doc = np.concatenate([doc, short])
        g = np.concatenate([g, digest[short, 0]])
        w = np.concatenate([w, np.array([weight[first[d] : first[d + 1]].mean() for d in short], np.float32)])
    key = (doc.astype(U) << U(48)) | (g >> U(16))
    order = np.argsort(key, kind="stable")
    key, w = key[order], w[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    times = np.diff(np.append(start, len(key)))
    return (key[start] >> U(48)).astype(np.int64), key[start] & U((1 << 48) - 1), w[start] * times.astype(np.float32), digest


_rng = np.random.default_rng(20100)
_R = _rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_ODD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)


def samples(row: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """Improved consistent weighted samples: rows x (BANDS * ROWS) hashes of (shingle, t), equal with the probability of the weighted Jaccard similarity."""
    out = np.zeros((rows, BANDS * ROWS), U)
    if not len(h):
        return out
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    log_s, some = np.log(weight), row[start]
    low = U(0xFFFFFFFF)
    for k in range(BANDS * ROWS):
        x = words.mix(h * _ODD[k] + U(k))
        r, log_c = _R[(x & U(0xFFFF)).astype(np.int64)], _LOG_C[((x >> U(16)) & U(0xFFFF)).astype(np.int64)]
        beta = (x >> U(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_s / r + beta)
        log_a = log_c - r * (t - beta) - r
        bits = log_a.view(np.uint32)
        bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(U)  # in the order of the numbers
        what = words.mix(x ^ (t.astype(np.int64).astype(U) * U(0x9E3779B97F4A7C15)))
        out[some, k] = np.minimum.reduceat((bits << U(32)) | (what & low), start) & low
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sig), BANDS), U)
    for b in range(BANDS):
        x = np.full(len(sig), b + 1, U)
        for k in range(ROWS):
            x = words.mix(x * U(words.GRAM) + sig[:, b * ROWS + k])
        out[:, b] = x
    return out


def similarities(a: pa.Array, b: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the texts in each row; 0 where both are without words. At most MOST_ROWS rows."""
    ra, ha, wa, _ = shingles(a, idf)
    rb, hb, wb, _ = shingles(b, idf)
    rows = len(a)
    key = np.concatenate([(ra.astype(U) << U(48)) | ha, (rb.astype(U) << U(48)) | hb])
    w = np.concatenate([wa, wb]).astype(float)
    order = np.argsort(key, kind="stable")
    key, w = key[order], w[order]
    same = np.flatnonzero(key[1:] == key[:-1]) if len(key) else np.zeros(0, np.int64)
    both = np.bincount((key[same] >> U(48)).astype(np.int64), np.minimum(w[same], w[same + 1]), rows)
    total = np.bincount(ra, wa, rows) + np.bincount(rb, wb, rows) - both
    return both / np.where(total > 0, total, 1)


# --- the operator --------------------------------------------------------------------------------------------------------

BAND_NAMES = [f"b{k}" for k in range(BANDS)]
ROW = "doc_id long, oid long, th long, size long"
#: Stands for a null doc_id, after all others.
LAST = (1 << 63) - 1


def rows(docs: DataFrame) -> DataFrame:
    """doc_id, oid and th (they tell rows apart: the id or LAST, and a hash of the text), size, text."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("oid"), F.xxhash64("text").alias("th"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "text")


def _keys(digest: np.ndarray) -> pa.Array:
    """126 bits of each digest as a number; null where a row has no words."""
    halves = digest.copy()
    halves[:, 1] &= U((1 << 62) - 1)
    valid = np.packbits(digest.any(1), bitorder="little").tobytes()
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(digest), [pa.py_buffer(valid), pa.py_buffer(halves.tobytes())])


def signatures(docs: DataFrame, idf) -> DataFrame:
    """The rows without text, with key (of the words, null without any) and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in words.slices(b, "text"):
                row, h, w, digest = shingles(s.column(4), idf.value)
                got = bands(samples(row, h, w, s.num_rows)).view(np.int64)
                cols = [*s.columns[:4], _keys(digest), *[pa.array(got[:, k].copy()) for k in range(BANDS)]]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "oid", "th", "size", "key", *BAND_NAMES])

    return rows(docs).mapInArrow(run, f"{ROW}, key decimal(38,0), " + ", ".join(f"{b} long" for b in BAND_NAMES))


def bucket_members(nodes: DataFrame) -> tuple[DataFrame, str]:
    """bucket, key, near (the node's next band), size; n, first, bytes of the bucket: a row per node and bucket that it shares with others.

    nodes: key, size, bands; a row per node. The buckets' sums are a table of their
    own, so that the join has plain shuffles on both sides and a hot bucket can be split at run time.
    """
    nth = F.posexplode(F.array(*BAND_NAMES)).alias("band", "bucket")
    near = F.expr(f"array({', '.join(BAND_NAMES)})[(band + 1) % {BANDS}]")
    dealt = nodes.select("key", "size", *BAND_NAMES, nth).select("bucket", "key", near.alias("near"), "size")
    full, path = keep(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.sum("size").alias("bytes")).where("n > 1"), "buckets")
    members = keep(dealt.join(full.hint("merge"), "bucket"), "members")
    drop(nodes.sparkSession, path)
    return members


def star_and_chain(members: DataFrame) -> DataFrame:
    """Edges (a, b, part) from each bucket's first node to all others, and between neighbours in the order of ``near``.

    Neighbours are taken within runs of a bucket of bounded size. part tells the
    edges of a hot first node apart, so that its text meets them in many tasks.
    """
    of = lambda most, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.ceil(F.col("n") / most)).cast("int")
    m = members.withColumn("run", of(RUN, 3))
    m = m.withColumn("before", F.lag("key").over(Window.partitionBy("bucket", "run").orderBy("near", "key")))
    both = F.array(F.struct(F.col("first").alias("other"), of(HUB, 5).alias("part")), F.struct(F.col("before").alias("other"), F.lit(0).alias("part")))
    edges = m.select("key", F.explode(both).alias("e")).select("key", "e.*").where("other is not null and other <> key")
    return edges.groupBy(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).agg(F.min("part").alias("part"))


def verified(edges: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """The edges (a, b) whose texts are similar enough. edges: a, b, part; texts: key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for half in words.slices(whole, "ta"):
                for s in words.slices(half, "tb"):
                    ok = pa.array(similarities(s.column(2), s.column(3), idf.value) >= threshold)
                    yield pa.RecordBatch.from_arrays([s.column(0).filter(ok), s.column(1).filter(ok)], ["a", "b"])

    one = edges.select("a", "part").distinct().join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    two = edges.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    return two.join(one.hint("merge"), ["a", "part"]).select("a", "b", "ta", "tb").mapInArrow(run, "a decimal(38,0), b decimal(38,0)")


def compare(here: pd.DataFrame, asked: pd.DataFrame, idf: np.ndarray, threshold: float) -> pd.DataFrame:
    """Links (a, b) of each asked node to the nodes here of its group, one link to each component but its own.

    Both: group, key, component, text. Shingles are made in slices of bounded text; groups are at most 2**16.
    """
    out: list[tuple] = []
    if len(here) and len(asked):
        of = lambda name: np.split(pd.factorize(pd.concat([here[name], asked[name]]))[0], [len(here)])
        (comp, own), (mine, theirs) = of("component"), of("group")
        row, h, w, _ = shingles(pa.array(here["text"], pa.string()), idf)
        total = np.bincount(row, w, len(here))
        h = (mine[row].astype(U) << U(48)) | h
        order = np.argsort(h, kind="stable")
        h, row, w = h[order], row[order], w[order].astype(float)
        ids, qids = here["key"].to_numpy(), asked["key"].to_numpy()
        qrow, qh, qw, _ = shingles(pa.array(asked["text"], pa.string()), idf)
        qh, qw = (theirs[qrow].astype(U) << U(48)) | qh, qw.astype(float)
        lo, hi = np.searchsorted(h, qh, "left"), np.searchsorted(h, qh, "right")
        cut, qtotal = np.searchsorted(qrow, np.arange(len(asked) + 1)), np.bincount(qrow, qw, len(asked))
        for q in range(len(asked)):
            s = slice(cut[q], cut[q + 1])
            n = hi[s] - lo[s]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[s], n)
            seen, place = np.unique(row[at], return_inverse=True)
            both = np.bincount(place, np.minimum(w[at], np.repeat(qw[s], n)), len(seen))
            near = seen[(both >= threshold * (total[seen] + qtotal[q] - both)) & (comp[seen] != own[q])]
            _, once = np.unique(comp[near], return_index=True)
            out += [(qids[q], ids[near[k]]) for k in once]
    return pd.DataFrame(out, columns=["a", "b"], dtype=object)


LINKS = "a decimal(38,0), b decimal(38,0)"


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets of three and more that hold several components (the pair of a smaller one has been verified):
    with their component, whether that is not the bucket's largest (rest), and their block of ``blocks``."""
    placed = members.where("n > 2").join(found, members.key == found.node, "left").select("bucket", "key", "size", "n", "bytes", F.coalesce("component", "key").alias("component"))
    by = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
    mixed = by.groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("bucket", "top.component")
    m = join_spread(placed, mixed.withColumnRenamed("component", "top"), ["bucket"], ["key"])
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES))
    return m.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key", F.lit(4)), "blocks")).withColumn("rest", F.col("component") != F.col("top"))


def _turns(group: Column, rows: int, size: int) -> Column:
    """Small groups share a turn of pandas code, as many as hold some rows or bytes of a block."""
    return F.pmod(F.xxhash64(group), F.lit(max(1, -(-rows // BLOCK), -(-size // BLOCK_BYTES))))


def compare_within_blocks(mixed: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Links between different components, each node outside its bucket's largest one held against its own block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return compare(pdf, pdf[pdf["rest"]], idf.value, threshold)

    rows, size = mixed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    m = mixed.select(F.xxhash64("bucket", "block").alias("group"), "key", "component", "rest").withColumn("turn", _turns(F.col("group"), rows, size))
    return m.join(texts.hint("merge"), "key").groupBy("turn").applyInPandas(run, LINKS)


def compare_across_blocks(mixed: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """The same, each node outside held against the other blocks of its bucket: pairs of blocks, both of bounded size."""

    def run(here: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return compare(here, asked, idf.value, threshold)

    m = mixed.where("blocks > 1")
    outside = m.where("rest").groupBy("bucket").agg(F.count(F.lit(1)).alias("r"), F.sum("size").alias("rb")).select("bucket", F.ceil(F.greatest(F.col("r") / BLOCK, F.col("rb") / BLOCK_BYTES)).alias("turns"))
    m = join_spread(m, outside, ["bucket"], ["key"]).join(texts.hint("merge"), "key")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    group, own = F.xxhash64("bucket", "block", "turn").alias("group"), [F.col(c).alias(c) for c in ("key", "component", "text")]
    here = m.withColumn("turn", upto("turns")).select(group, *own)
    asked = m.where("rest").withColumn("turn", F.pmod(F.xxhash64("key", F.lit(6)), "turns")).withColumn("of", upto("blocks")).where("of <> block")
    asked = asked.withColumn("block", F.col("of")).select(group, *own)
    return here.groupBy("group").cogroup(asked.groupBy("group")).applyInPandas(run, LINKS)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """oid, th, doc_id, key, class_id, rep_id, kept of each row; see :func:`near_dedup`."""
    spark = docs.sparkSession
    docs = small_batches(docs)
    idf = spark.sparkContext.broadcast(document_frequencies(docs))
    sig, sig_path = keep(signatures(docs, idf), "signatures")
    # A node's head is its row with the smallest id, and of those the one with the smallest hash.
    nodes, nodes_path = keep(
        sig.where("key is not null").groupBy("key").agg(F.min(F.struct("oid", "th")).alias("head"), F.max("size").alias("size"), *[F.max(b).alias(b) for b in BAND_NAMES]), "nodes"
    )
    members, members_path = bucket_members(nodes)
    wanted = nodes.join(members.select("key").distinct(), "key", "left_semi").select("key", "head.*")
    # The ids grow with the corpus: they are hashed in shuffled parts at any size, never broadcast, and texts are not sorted.
    texts, texts_path = keep(rows(docs).select("oid", "th", "text").join(wanted.hint("shuffle_hash"), ["oid", "th"]).select("key", "text"), "texts")
    again = texts.groupBy("key").count().where("count > 1").select("key")
    if not again.isEmpty():  # rows repeated in full: one text of each
        texts = texts.join(again, "key", "left_anti").union(texts.join(again, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")))
    links, links_path = keep(verified(star_and_chain(members), texts, idf, threshold), "links")
    found = components(links)
    paths = [members_path, texts_path, links_path]
    for step in (compare_within_blocks, compare_across_blocks):
        mixed, mixed_path = keep(_mixed(members, found), "mixed")
        paths.append(mixed_path)
        if mixed.where("rest" if step is compare_within_blocks else "blocks > 1").isEmpty():
            break
        more, more_path = keep(step(mixed, texts, idf, threshold), "links")
        paths.append(more_path)
        if not more.isEmpty():
            found = components(more.union(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    placed = nodes.select("key", "head").join(found, nodes.key == found.node, "left").select("key", "head", F.coalesce("component", "key").alias("component"))
    tops = placed.groupBy("component").agg(F.min("head").alias("top"))
    named, _ = keep(join_spread(placed, tops, ["component"], ["key"]).select("key", F.col("head.oid").alias("rep"), "top"), "classes")
    drop(spark, *paths, nodes_path)
    some = sig.where("key is not null").select("oid", "th", "doc_id", "key").join(named.hint("merge"), "key")
    id_of = lambda c: F.when(c != LAST, c)
    here = some.select("oid", "th", "doc_id", "key", id_of(F.col("top.oid")).alias("class_id"), id_of(F.col("rep")).alias("rep_id"), ((F.col("oid") == F.col("top.oid")) & (F.col("th") == F.col("top.th"))).alias("kept"))
    alone = sig.where("key is null").select("oid", "th", "doc_id", "key", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"), F.lit(True).alias("kept"))
    return here.union(alone)


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id, rep_id, kept.

    class_id is the smallest doc_id of those that a chain of pairs with a weighted
    Jaccard similarity of ``threshold`` or more connects; rep_id the smallest of those
    with the same words; both null where none has an id. kept marks the row of a
    class that stays: the one with that id, and of several the one whose text has
    the smallest hash. Rows are judged one by one, whatever their ids; rows that
    repeat the id and text of the row that stays are all kept. Null texts and texts
    without a word are similar to nothing, a class each. Other columns are
    ignored; an empty table gives an empty result.
    """
    return classes(docs, threshold).select("doc_id", "class_id", "rep_id", "kept")


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that stay, with their own columns: exactly one of each class, and every row without a word.

    Of rows that repeat the id and text of the one that stays, the one with the smallest hash of the whole row stays.
    """
    stay = classes(docs, threshold).where("kept").groupBy(F.col("oid").alias("_oid"), F.col("th").alias("_th")).agg(F.count("key").alias("_copies"))
    own = [F.col(f"doc.`{c}`") for c in docs.columns]
    wide = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_oid"), F.xxhash64("text").alias("_th"), F.struct(*docs.columns).alias("doc"))
    found = wide.join(stay, ["_oid", "_th"])
    order = Window.partitionBy("_oid", "_th").orderBy("_hash")
    many = found.where("_copies > 1").dropDuplicates().withColumn("_hash", F.xxhash64("doc")).withColumn("_nth", F.row_number().over(order)).where("_nth = 1")
    return found.where("_copies <= 1").select(*own).unionByName(many.select(*own))
