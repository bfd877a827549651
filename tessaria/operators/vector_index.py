"""Search and joins of vectors: exact by blocks, or within the buckets of bands of signed random projections.

Vectors are packed into blocks of bounded size, and a pair of blocks is one
product of matrices, of which only the k best per query, or sums per row,
leave a task. Exact operators hold all blocks against each other. A band index
stores each vector in one bucket per band, named by the signs of a few random
projections: only blocks of one bucket meet, by an equi-join. Buckets of any
size are split into blocks. Candidates are always scored exactly, so that an
index can miss results but never invents one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.operators.components import components, join_spread, kept

#: Most vectors of a block, on average; of the blocks of a join, each pair of which gives at most a row per vector.
BLOCK, JOIN_BLOCK = 2048, 8192
#: Bytes of a block's vectors where a join holds all pairs, two of which a task holds several times over: larger blocks are sent to fewer others. Cells of a product that are held at once.
JOIN_BYTES, CELLS = 8 << 20, 1 << 22
BANDS, BITS, PROBES, SEED = 8, 8, 8, 1


def planes(dims: int, bands: int, bits: int, seed: int) -> np.ndarray:
    """bands x bits x dims: the projections of a band are orthogonal where dims allow."""
    rng = np.random.default_rng(seed)
    out = np.empty((bands, bits, dims))
    for b in range(bands):
        for at in range(0, bits, dims):
            q, _ = np.linalg.qr(rng.normal(size=(dims, dims)))
            out[b, at : at + dims] = q.T[: bits - at]
    return out


def codes(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """rows x bands: the signs of each band's projections as one number."""
    signs = np.einsum("nd,bkd->nbk", v, p) > 0
    return signs.astype(np.int64) @ (1 << np.arange(p.shape[1], dtype=np.int64))


def probes(v: np.ndarray, p: np.ndarray, most: int) -> np.ndarray:
    """rows x bands x most: each band's own bucket, and those that differ in the signs nearest to a flip, by the sum of squared margins."""
    m = np.einsum("nd,bkd->nbk", v, p)
    own = (m > 0).astype(np.int64) @ (1 << np.arange(p.shape[1], dtype=np.int64))
    masks = np.arange(1 << p.shape[1], dtype=np.int64)
    cost = (m * m) @ ((masks[:, None] >> np.arange(p.shape[1])) & 1).T.astype(float)
    near = np.argsort(cost, axis=2, kind="stable")[:, :, :most]
    return own[:, :, None] ^ masks[near]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_col: str) -> DataFrame:
    """id_col and vector of the rows whose vector is neither null nor zero."""
    return vectors.where(F.exists("vector", lambda v: v != 0)).select(id_col, "vector")


def pack(rows: DataFrame, keys: list[str], by: str, name: str, block: int = BLOCK) -> DataFrame:
    """Rows of a key packed into blocks: keys, part, parts, and the other columns as an array of structs ``name``; a key with more rows has more parts.

    Keys are few by construction (a band's buckets), and their sizes are known before rows are dealt.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block)).cast("long").alias("parts")
    dealt = rows.join(F.broadcast(kept(rows.groupBy(*keys).agg(parts), "sizes")), keys) if keys else rows.crossJoin(kept(rows.agg(parts), "sizes"))
    rest = [c for c in rows.columns if c not in keys]
    part = F.pmod(F.xxhash64(by, F.lit(5)), F.col("parts")).alias("part")
    return dealt.select(*keys, "parts", part, F.struct(*rest).alias("row")).groupBy(*keys, "parts", "part").agg(F.collect_list("row").alias(name))


def _members(scalar: pa.Scalar, *names: str) -> list:
    """The fields of a block: ids as an array, vectors as a matrix of unit rows, lists of numbers as matrices."""
    rows = scalar.values
    out = []
    for n in names:
        f = rows.field(n)
        out.append(_unit(_matrix(f)) if n == "vector" else _matrix(f).astype(np.int64) if pa.types.is_list(f.type) else f.to_numpy(zero_copy_only=False))
    return out


def best_of_blocks(pairs: DataFrame, k: int, ids: tuple[str, str]) -> DataFrame:
    """query_id, doc_id, score: of each pair of blocks (queries, members) each query's k best, ties to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, v in zip(b.column(0), b.column(1), strict=True):
                (qid, qv), (vid, vv) = _members(q, "query_id", "vector"), _members(v, "doc_id", "vector")
                order = np.argsort(vid, kind="stable")
                vid, s = vid[order], qv @ vv[order].T
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                cols = [np.repeat(qid, top.shape[1]), vid[top].ravel(), np.take_along_axis(s, top, 1).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "doc_id", "score"])

    return pairs.select("queries", "members").mapInArrow(run, f"query_id {ids[0]}, doc_id {ids[1]}, score double")


def exact_by_blocks(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, doc_id, score: every block of queries is sent to every block of vectors."""
    q, v = pack(usable(queries, "query_id"), [], "query_id", "queries", block), pack(usable(vectors, "doc_id"), [], "doc_id", "members", block)
    v = kept(v.select(F.col("part").alias("vpart"), F.col("parts").alias("vparts"), "members"), "members")
    ids = queries.schema["query_id"].dataType.simpleString(), vectors.schema["doc_id"].dataType.simpleString()
    sent = v.agg(F.coalesce(F.max("vparts"), F.lit(0)).alias("n")).first()["n"]
    copies = q.select("queries", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(sent, 1) - 1).cast("long"))).alias("vpart"))
    return best_of_blocks(copies.join(v, "vpart"), k, ids)


@dataclass
class BandIndex:
    """rows: doc_id, vector, codes (a bucket per band). Buckets are blocks of the rows that share a band's code."""

    rows: DataFrame
    p: np.ndarray

    @staticmethod
    def build(vectors: DataFrame, dims: int, bands: int = BANDS, bits: int = BITS, seed: int = SEED) -> BandIndex:
        """The index of a table (doc_id, vector); null and zero vectors have no place in it."""
        p, kind = planes(dims, bands, bits, seed), f"doc_id {vectors.schema['doc_id'].dataType.simpleString()}, vector {vectors.schema['vector'].dataType.simpleString()}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(codes(_unit(_matrix(b.column(1))), p)), pa.list_(pa.int64()))], ["doc_id", "vector", "codes"])

        return BandIndex(usable(vectors, "doc_id").mapInArrow(run, f"{kind}, codes array<bigint>"), p)

    def buckets(self) -> DataFrame:
        """band, bucket, parts, part, members: every row once in each band."""
        return pack(self.rows.select("doc_id", "vector", F.posexplode("codes").alias("band", "bucket")), ["band", "bucket"], "doc_id", "members")

    def write(self, path: str) -> None:
        """The blocks of all buckets, a folder per band, sorted by bucket, so that a search reads the files whose buckets it probes."""
        self.buckets().repartitionByRange("band", "bucket").sortWithinPartitions("band", "bucket").write.mode("overwrite").partitionBy("band").parquet(f"{path}/buckets")

    def search(self, queries: DataFrame, k: int, most: int = PROBES, written: str | None = None) -> DataFrame:
        """query_id, doc_id, score, rank: the k best among the rows of the buckets that a query probes, ``most`` in each band."""
        from tessaria.operators.ranking import top_k

        p, kind = self.p, queries.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    at = probes(_unit(_matrix(b.column(1))), p, most)
                    band, row = np.broadcast_to(np.arange(p.shape[0])[None, :, None], at.shape), np.broadcast_to(np.arange(len(at))[:, None, None], at.shape)
                    own = pa.array(row.ravel())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(band.ravel(), pa.int32()), pa.array(at.ravel(), pa.int64())], ["query_id", "vector", "band", "bucket"])

        asked = usable(queries, "query_id").mapInArrow(run, f"query_id {kind}, vector {queries.schema['vector'].dataType.simpleString()}, band int, bucket bigint")
        held = self.buckets() if written is None else self.rows.sparkSession.read.parquet(f"{written}/buckets")
        blocks = pack(asked, ["band", "bucket"], "query_id", "queries").select("band", "bucket", "queries")
        found = best_of_blocks(held.select("band", "bucket", "members").join(blocks, ["band", "bucket"]), k, (kind, self.rows.schema["doc_id"].dataType.simpleString()))
        return top_k(found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k)

    def calibrate(self, queries: DataFrame, vectors: DataFrame, k: int, target: float = 0.9, sample: int = 256) -> tuple[int, float]:
        """(probes a band, recall): the probes are doubled until the recall, measured against the exact search on at most ``sample`` queries, reaches the target."""
        from tessaria.operators.ranking import top_k

        some = kept(usable(queries, "query_id").orderBy(F.xxhash64("query_id"), "query_id").limit(sample), "sample")
        truth = kept(top_k(exact_by_blocks(some, vectors, k), k), "truth")
        most = 1
        while True:
            got = recall(self.search(some, k, most), truth)
            if got >= target or most >= 1 << self.p.shape[1]:
                return most, got
            most *= 2


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the true results (query_id, doc_id) that were found; 1 where there are none."""
    r = truth.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r")).first()["r"]
    return 1.0 if r is None else r


def bands_for(threshold: float, bits: int, wanted: float = 0.99) -> int:
    """The bands in which a pair at the threshold's cosine shares a bucket at least once with the wanted chance."""
    same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - wanted) / math.log1p(-same))) if same < 1 else 1


def _join_block(spark: SparkSession, n: int, dims: int) -> int:
    """Vectors of a block where all pairs of blocks are held: JOIN_BYTES at most, and so few that there are some pairs for each core."""
    least = math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism))
    return max(1, min(JOIN_BYTES // (8 * dims), max(JOIN_BLOCK, math.ceil(n / least))))


def similarity_join(vectors: DataFrame, threshold: float, bits: int = 0, wanted: float = 0.99, block: int | None = None, seed: int = SEED) -> DataFrame:
    """Links of a table's vectors (doc_id long, vector): doc_id, class_id, n_links.

    n_links is the number of other rows with a cosine of ``threshold`` or more;
    class_id the smallest doc_id that a chain of links leads to. Ids are unique; a
    null or zero vector has no link. Equal vectors are joined as one with a
    weight, so that copies, however many, are never paired. Blocks are held
    against each other in one pass, each pair once: all of them where ``bits`` is
    0, which is exact and quadratic; else those that share a bucket of a band of so
    many bits, in as many bands as give a pair at the threshold the ``wanted``
    chance. A pair that shares several buckets counts in the first. What leaves a
    pair of blocks are sums per row, and the edges of a forest of its links.
    """
    rows = kept(usable(vectors, "doc_id").groupBy("vector").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("weight")), "vectors")
    dims, n = rows.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    alone = vectors.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    if dims is None:
        return alone
    if bits:
        index = BandIndex.build(rows, dims, bands_for(threshold, bits, wanted), bits, seed)
        coded = kept(index.rows.join(rows.select("doc_id", "weight"), "doc_id"), "coded")
        blocks = pack(coded.select("doc_id", "vector", "weight", "codes", F.posexplode("codes").alias("band", "bucket")), ["band", "bucket"], "doc_id", "members", block or JOIN_BLOCK)
    else:
        none = F.array().cast("array<bigint>")
        blocks = pack(rows.select("doc_id", "vector", "weight", none.alias("codes")), [], "doc_id", "members", block or _join_block(rows.sparkSession, n, dims)).withColumns({"band": F.lit(0), "bucket": F.lit(0).cast("long")})
    files = 4 * math.ceil(n * (len(index.p) if bits else 1) * 8 * dims / JOIN_BYTES)  # of few blocks, as a reader's batch holds all blocks of a file
    blocks = kept(blocks.repartition(files, "band", "bucket", "part"), "blocks")
    pairs = blocks.select("band", F.lit(True).alias("same"), F.col("members").alias("mine"), "members")
    tiles = blocks.agg(F.sum(F.col("parts") - 1 - F.col("part")).alias("n")).first()["n"]
    if tiles:  # of two blocks of one bucket: dealt by both, so that no task has all the pairs of a block
        tasks, keys = min(tiles, 4096), ["band", "bucket", "part", "other"]
        left = blocks.where("part < parts - 1").select("band", "bucket", "part", F.col("members").alias("mine"), F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("other"))
        right = blocks.where("part > 0").select("band", "bucket", "members", F.col("part").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("part") - 1)).alias("part"))
        both = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys)
        pairs = blocks.repartition(tasks, *keys[:3]).select(*pairs.columns[:1], F.lit(True).alias("same"), F.col("members").alias("mine"), "members")
        pairs = pairs.unionByName(both.select("band", F.lit(False).alias("same"), "mine", "members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for band, same, x, y in zip(*b.columns, strict=True):
                yield _linked(band.as_py(), same.as_py(), _members(x, "doc_id", "weight", "codes", "vector"), _members(y, "doc_id", "weight", "codes", "vector"), threshold)

    found = kept(pairs.mapInArrow(run, "doc_id long, n_links long, head long"), "links")
    classes = components(found.where("head < doc_id").select(F.col("doc_id").alias("a"), F.col("head").alias("b")))
    sums = found.groupBy("doc_id").agg(F.sum("n_links").alias("n"))
    per = rows.join(sums, "doc_id", "left").join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    per = per.select("vector", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"))
    own = join_spread(usable(vectors, "doc_id"), per, ["vector"], F.col("doc_id")).select("doc_id", "class_id", "n_links")
    return own.unionByName(alone.join(own.select("doc_id"), "doc_id", "left_anti"))


def _heads(hx: np.ndarray, hy: np.ndarray, i: np.ndarray, j: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The least id that links (i, j) of the rows lead to, from the heads so far."""
    names, ix = np.unique(np.r_[hx, hy], return_inverse=True)
    while True:
        before = hx.copy(), hy.copy()
        np.minimum.at(hx, i, hy[j])
        np.minimum.at(hy, j, hx[i])
        if same:
            hx = hy = np.minimum(hx, hy)
        # Rows that had one head before keep one.
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, ix, np.r_[hx, hy])
        hx, hy = least[ix[: len(hx)]], least[ix[len(hx) :]]
        if (hx == before[0]).all() and (hy == before[1]).all():
            return hx, hy


def _linked(band: int, same: bool, x: list, y: list, threshold: float) -> pa.RecordBatch:
    """Each row's weight of links in a pair of blocks, and the least row of its component there.

    Products of single precision leave out what is surely below the threshold; what they
    can't decide is scored in double precision. CELLS cells are held at once.
    """
    (xid, xw, xc, xv), (yid, yw, yc, yv) = x, y
    nx, ny = np.zeros(len(xid), np.int64), np.zeros(len(yid), np.int64)
    hx, hy = xid.astype(np.int64), yid.astype(np.int64)
    x32, y32 = xv.astype(np.float32), yv.astype(np.float32)
    slack = (xv.shape[1] + 4) * 2.0**-23  # twice what a product of unit vectors can be off by
    step, links, held = max(1, CELLS // max(1, len(yid))), [], 0
    for at in range(0, len(xid), step):
        first = at if same else 0  # a block against itself: its later rows alone
        s = x32[at : at + step] @ y32[first:].T
        cells = np.flatnonzero(s >= threshold - slack)
        i, j = np.divmod(cells, s.shape[1])
        near, i, j = s.ravel()[cells] < threshold + slack, i + at, j + first
        keep = i < j if same else np.ones(len(i), bool)
        if xc.size:
            for c in range(band):  # the pair has counted in the first band in which it meets
                keep &= xc[i, c] != yc[j, c]
        near = np.flatnonzero(near & keep)
        for k in range(0, len(near), 1 << 15):
            some = near[k : k + (1 << 15)]
            keep[some] = np.einsum("nd,nd->n", xv[i[some]], yv[j[some]]) >= threshold
        i, j = i[keep], j[keep]
        if len(i):
            nx += np.bincount(i, yw[j], len(nx)).astype(np.int64)
            ny += np.bincount(j, xw[i], len(ny)).astype(np.int64)
            links, held = [*links, (i, j)], held + len(i)
        if links and (held >= CELLS or at + step >= len(xid)):
            hx, hy = _heads(hx, hy, *(np.concatenate(c) for c in zip(*links, strict=True)), same)
            links, held = [], 0
    ids, n, head = (xid, nx + ny, hx) if same else (np.r_[xid, yid], np.r_[nx, ny], np.r_[hx, hy])
    hit = (n > 0) | (head < ids)
    return pa.RecordBatch.from_arrays([pa.array(c[hit]) for c in (ids, n, head)], ["doc_id", "n_links", "head"])
