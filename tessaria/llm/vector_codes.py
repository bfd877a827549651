"""Vector code compression: product codes whose nearest entries are found by partial-distance search.

A vector is cut into equal consecutive parts, and each part is replaced by the
index of the nearest entry in the part position's codebook. Distances are exact
integers. The search takes a part's dimensions in descending variance over the
codebook, adds up squared differences, and drops an entry, by a mask over a
whole batch of rows, once its sum strictly exceeds the best complete distance
known for the row; an entry that ties stays, and the lowest index wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaria.llm.common import join_spread, keep, small_batches
from tessaria.llm.vectors import extent, integers, matrix, usable

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Entries whose distances are carried side by side before the best complete distance is renewed.
STRIDE = 16
LONG = 2**63 - 1


@dataclass
class Codebook:
    """The entries of one part position, with its dimensions in the order in which they are searched."""

    entries: np.ndarray

    def __post_init__(self):
        e = self.entries.astype(object)
        spread = [len(e) * sum(v * v for v in e[:, d]) - sum(e[:, d]) ** 2 for d in range(e.shape[1])]  # variance times a constant, exact
        self.order = sorted(range(e.shape[1]), key=lambda d: (-spread[d], d))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row of x."""
        n, c = len(x), self.entries
        best, at = np.zeros(n, x.dtype), np.zeros(n, np.int64)
        if not n or not self.order:
            return at, best
        first = self.order[0]
        # The entry nearest in the first dimension gives the first complete distance.
        at = np.abs(x[:, first, None] - c[None, :, first]).argmin(axis=1).astype(np.int64)
        for d in self.order:
            diff = x[:, d] - c[at, d]
            best = best + diff * diff
        for lo in range(0, len(c), STRIDE):
            part = c[lo : lo + STRIDE]
            diff = x[:, first, None] - part[None, :, first]
            diff = diff * diff
            row, k = np.nonzero(diff <= best[:, None])
            sums = diff[row, k]
            for d in self.order[1:]:
                diff = x[row, d] - part[k, d]
                sums = sums + diff * diff
                live = np.nonzero(sums <= best[row])[0]
                row, k, sums = row[live], k[live], sums[live]
            if not len(row):
                continue
            # The survivors' distances are complete, and rows come in order: the least of each, then the lowest index that has it.
            starts = np.nonzero(np.r_[True, row[1:] != row[:-1]])[0]
            least = np.minimum.reduceat(sums, starts)
            own, index = row[starts], np.minimum.reduceat(np.where(sums == np.repeat(least, np.diff(np.r_[starts, len(row)])), k + lo, len(c)), starts)
            better = (least < best[own]) | ((least == best[own]) & (index < at[own]))
            best[own[better]], at[own[better]] = least[better], index[better]
        return at, best


def search(x: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x parts indexes, rows x parts squared distances)."""
    width = x.shape[1] // len(books)
    found = [b.nearest(x[:, p * width : (p + 1) * width]) for p, b in enumerate(books)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


@dataclass
class Quantizer:
    """Learned codebooks; ``width`` components of a vector are coded, ``exact`` says that sums may exceed a long."""

    books: list[Codebook]
    width: int
    exact: bool = False

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.books for entry in b.entries.tolist() for v in entry).encode()).hexdigest()

    def of(self, column: pa.Array) -> np.ndarray:
        x = matrix(column, self.width)
        return x.astype(object) if self.exact else x


def _sums(rows: DataFrame, q: Quantizer) -> DataFrame:
    """part, entry, count and sums of the parts that are nearest to each entry: a row per part and entry from each task, then added up."""
    width = q.width // len(q.books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(b.entries), np.int64) for b in q.books]
        total = [np.zeros((len(b.entries), width), object) for b in q.books]
        for batch in batches:
            x = q.of(batch.column(0))
            at, _ = search(x, q.books)
            for p, b in enumerate(q.books):
                own = np.zeros((len(b.entries), width), x.dtype)
                np.add.at(own, at[:, p], x[:, p * width : (p + 1) * width])
                total[p] += own.astype(object)
                count[p] += np.bincount(at[:, p], minlength=len(b.entries))
        keys = [(p, k) for p in range(len(q.books)) for k in np.nonzero(count[p])[0].tolist()]
        cols = [[p for p, _ in keys], [k for _, k in keys], [int(count[p][k]) for p, k in keys], [[str(v) for v in total[p][k]] for p, k in keys]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["part", "entry", "n", "sums"])

    found = rows.select("x").mapInArrow(run, "part int, entry int, n long, sums array<string>")
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[d].cast("decimal(38,0)")) for d in range(width)]).alias("sums"))


def _prepared(vectors: DataFrame, vector: str, parts: int) -> tuple[DataFrame, int, int, int]:
    """(rows with x, the usable vectors as integers of one width; rows; width; largest magnitude)."""
    good = vectors.where(usable(F.col(vector)))
    n, widest, most = extent(good, vector)
    width = -(-widest // parts) * parts
    return good.withColumn("x", integers(F.col(vector), width)), n, width, most


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector: str = "embedding") -> Quantizer:
    """Codebooks that start as the parts of the vectors of the smallest ids, refined over all vectors in rounds.

    A round assigns every part to the nearest entry, then replaces each entry by
    its parts' componentwise floor(sum / count); unused entries stay. Only the
    starting vectors and one row per part and entry reach the driver. Equal ids
    are ordered by their vectors; null ids come last.
    """
    rows, n, width, most = _prepared(vectors.select(F.col(id_col).alias("i"), F.col(vector).alias("v")), "v", parts)
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    exact = width * (2 * most) ** 2 > LONG  # then sums are Python's integers
    start = [r["x"] for r in rows.select("i", "x").orderBy(F.col("i").asc_nulls_last(), "x").limit(entries).collect()]
    x = np.array(start, np.int64).reshape(len(start), width)
    x, w = x.astype(object) if exact else x, width // parts
    q = Quantizer([Codebook(x[:, p * w : (p + 1) * w]) for p in range(parts)], width, exact)
    for _ in range(rounds if n and w else 0):
        books = [b.entries.copy() for b in q.books]
        for r in _sums(small_batches(rows), q).collect():
            books[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
        q = Quantizer([Codebook(b) for b in books], width, exact)
    return q


def encode(vectors: DataFrame, q: Quantizer, id_col: str = "vec_id", vector: str = "embedding", also: tuple[str, ...] = ()) -> DataFrame:
    """The id and the columns ``also`` with code binary (a byte per part) and error long (null where it exceeds a long), of the rows whose vector is usable."""
    rows = vectors.where(usable(F.col(vector))).select(F.col(id_col), *also, integers(F.slice(F.col(vector), 1, q.width) if q.width else F.array().cast("array<double>"), q.width).alias("x"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, far = search(q.of(b.column(b.num_columns - 1)), q.books)
            error = [e if e <= LONG else None for e in far.sum(axis=1).tolist()]
            code = pa.array([c.tobytes() for c in at.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], code, pa.array(error, pa.int64())], [*b.schema.names[:-1], "code", "error"])

    return small_batches(rows).mapInArrow(run, f"{kind}, code binary, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of a table (vec_id, embedding, label).

    A row whose vector is null or has null, infinite or not-a-number components is
    left out. Vectors shorter than the longest are filled up with zeros, as is the
    length to a multiple of ``parts``. Rows that repeat an id, or a whole row, are
    coded each for itself; null ids are kept. With fewer rows than entries the
    codebooks have an entry per row. An empty table gives an empty result. Other
    columns are ignored. An error that exceeds a long is null (components of
    2^25 and more). label_error adds up a label's errors, those of null labels together.
    """
    q = fit(vectors, parts, entries, rounds)
    coded, _ = keep(encode(vectors, q, also=("label",)), "codes")
    # A label may hold any share of the rows: a row per label is joined to spread parts.
    keyed = coded.withColumns({"_null": F.col("label").isNull(), "_label": F.col("label").cast("string")}).withColumn("_label", F.coalesce("_label", F.lit("")))
    total = keyed.groupBy("_null", "_label").agg(F.sum("error").alias("label_error"))
    both = join_spread(keyed, total, ["_null", "_label"], ["vec_id", "code"])
    return both.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(q.sha256()).alias("codebooks_sha256"))
