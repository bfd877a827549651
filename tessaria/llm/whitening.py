"""Embedding whitening with an exact covariance: digit-slice products, merged as big integers, then an eigendecomposition.

Components are integers. A batch is split into limbs of a few bits, so that
every product of limbs, summed over the batch, is exact in a float64 matrix
product; the products are put together again as big integers and added up over
all tasks. The covariance is therefore exact until its entries are rounded once
to double, and doesn't depend on how rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaria.llm.common import keep, small_batches
from tessaria.llm.vectors import extent, integers, matrix, usable

COMPONENTS = 4
#: Bits of a limb, which lies in -2^(LIMB-1) .. 2^(LIMB-1) - 1.
LIMB = 8
#: A sum of products travels as words of so many bits, whose sums over all tasks stay within a long.
WORD, WORDS = 32, 6
#: An eigenvalue below this share of the largest is taken for none: the vectors don't vary along that component.
RANK = 1e-12
LONG = 2**63 - 1


def limbs(x: np.ndarray, bits: int = LIMB) -> list[np.ndarray]:
    """Signed digits of a matrix of longs as float64, the least first: x = sum of limb k * 2^(bits k)."""
    out, half, rest = [], 1 << (bits - 1), x.astype(np.int64)
    while True:
        low = ((rest + half) & ((1 << bits) - 1)) - half
        out.append(low.astype(np.float64))
        rest = (rest - low) >> bits
        if not rest.any():
            return out


class Gram:
    """The sums of products of the columns of matrices of longs, added up by weights of limbs.

    A batch's products of limbs are exact in float64 while it has at most
    2^(53 - 2 (bits - 1)) rows; sums over batches are longs, and fit while there are 2^(60 - 2 (bits - 1)) rows in all.
    """

    def __init__(self, width: int, bits: int = LIMB):
        self.width, self.bits, self.levels = width, bits, []

    def add(self, x: np.ndarray) -> None:
        most = 1 << 53 - 2 * (self.bits - 1)
        for at in range(0, len(x), most):
            parts = limbs(x[at : at + most], self.bits)
            self.levels += [np.zeros((self.width, self.width), np.int64) for _ in range(2 * len(parts) - 1 - len(self.levels))]
            for a, left in enumerate(parts):
                for b, right in enumerate(parts[: a + 1]):
                    p = (left.T @ right).astype(np.int64)
                    self.levels[a + b] += p if a == b else p + p.T

    def total(self) -> np.ndarray:
        """The limbs' sums put together as Python's integers."""
        return sum((level.astype(object) * (1 << self.bits * k) for k, level in enumerate(self.levels)), np.zeros((self.width, self.width), object))


@dataclass
class Whitening:
    """n vectors with sums S per dimension; the largest eigenvalues of their covariance, falling, their unit vectors (a row each), and the trace."""

    width: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of longs: (x - S / n) projected on each component, over the root of its eigenvalue."""
        mean = np.array([Fraction(s, self.n) // 1 for s in self.sums], object)
        rest = np.array([float(Fraction(s, self.n) % 1) for s in self.sums])  # the whole part is subtracted exactly
        whole = np.array([int(m) for m in mean], np.int64) if self.n else np.zeros(self.width, np.int64)
        return ((x - whole).astype(float) - rest) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact: n^2 sum x^2 - 2 n sum x S + sum S^2, S in limbs of 20 bits."""
        if self.width * int(np.abs(x).max(initial=0)) ** 2 > LONG or int(np.abs(x).max(initial=0)) * self.width > 1 << 42:
            x = x.astype(object)
        square, cross, left, weight = (x * x).sum(axis=1).tolist(), [0] * len(x), list(self.sums), 1
        while any(left):
            low = [s % (1 << 20) for s in left] if any(s not in (0, -1) for s in left) else left
            left = [(s - d) >> 20 for s, d in zip(left, low, strict=True)]
            cross = [c + weight * d for c, d in zip(cross, (x @ np.array(low, x.dtype)).tolist(), strict=True)]
            weight <<= 20
        fixed = sum(s * s for s in self.sums)
        return [self.n * self.n * a - 2 * self.n * b + fixed for a, b in zip(square, cross, strict=True)]


def _words(value: int) -> list[int]:
    """value as WORDS words, the least first; the last has the sign."""
    low = [(value >> WORD * k) & ((1 << WORD) - 1) for k in range(WORDS - 1)]
    return [*low, value >> WORD * (WORDS - 1)]


def exact_gram(rows: DataFrame, column: str, width: int, bits: int = LIMB) -> np.ndarray:
    """The matrix of sums of products of (1, x) over all rows of ``column``, an array of ``width`` longs, as Python's integers.

    Each task adds up its batches; a row per entry of the matrix leaves it, and
    the sums over tasks, whose number depends on the width alone, reach the driver.
    """
    at = [(i, j) for i in range(width + 1) for j in range(i, width + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Gram(width + 1, bits)
        for b in batches:
            x = matrix(b.column(0), width)
            sums.add(np.hstack([np.ones((len(x), 1), np.int64), x]))
        total = sums.total()
        if total[0, 0]:
            cols = list(zip(*[(i, j, *_words(total[i, j])) for i, j in at], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["i", "j", *[f"w{k}" for k in range(WORDS)]])

    made = small_batches(rows).select(column).mapInArrow(run, "i long, j long, " + ", ".join(f"w{k} long" for k in range(WORDS)))
    out = np.zeros((width + 1, width + 1), object)
    for r in made.groupBy("i", "j").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(WORDS)]).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = sum(r[f"w{k}"] << WORD * k for k in range(WORDS))
    return out


def decompose(g: np.ndarray, components: int) -> Whitening:
    """The whitening of a matrix of sums of products of (1, x)."""
    n, width = int(g[0, 0]), len(g) - 1
    if not n:
        return Whitening(width, 0, [0] * width, np.zeros(0), np.zeros((0, width)), 0.0)
    centred = [[n * int(g[i, j]) - int(g[0, i]) * int(g[0, j]) for j in range(1, width + 1)] for i in range(1, width + 1)]
    # An entry is divided once, and rounded once.
    v = np.array([[float(Fraction(c, n * n)) for c in row] for row in centred]).reshape(width, width)
    values, vectors = np.linalg.eigh(v) if width else (np.zeros(0), np.zeros((0, 0)))
    order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > RANK * max(values.max(), 0)]
    trace = float(Fraction(sum(centred[k][k] for k in range(width)), n * n))
    return Whitening(width, n, [int(s) for s in g[0, 1:]], values[order], vectors.T[order], trace)


def _narrow(vectors: DataFrame, vector: str, also: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """The columns ``also`` and x, the usable vectors as integers of one width."""
    good = vectors.where(usable(F.col(vector))).select(*also, F.col(vector).alias("_v"))
    _, width, _ = extent(good, "_v")
    return good.select(*also, integers(F.col("_v"), width).alias("x")), width


def fit(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> tuple[Whitening, DataFrame]:
    """(the whitening, the fit list): every distinct vector once, kept in the shared folder as ``x``."""
    rows, width = _narrow(vectors, vector)
    distinct, _ = keep(rows.distinct(), "fit-list")
    return decompose(exact_gram(distinct, "x", width), components), distinct


def identity_error(model: Whitening, distinct: DataFrame) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity; 0 without components."""
    k = len(model.values)
    if not k:
        return 0.0
    names = [f"c{i}" for i in range(k + k * k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for b in batches:
            w = model.whiten(matrix(b.column(0), model.width))  # centred
            total += np.r_[w.sum(axis=0), (w.T @ w).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([t]) for t in total], names)

    r = small_batches(distinct).mapInArrow(run, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first()
    s = np.array([r[c] for c in names]) / model.n
    return float(np.abs(s[k:].reshape(k, k) - np.outer(s[:k], s[:k]) - np.eye(k)).max())


def apply(vectors: DataFrame, model: Whitening, vector: str = "embedding", also: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The columns ``also`` with whitened array<double>, a value per component, and deviation decimal(38,0) as text, of the rows whose vector is usable."""
    rows = vectors.where(usable(F.col(vector))).select(*also, integers(F.slice(F.col(vector), 1, model.width) if model.width else F.array().cast("array<double>"), model.width).alias("x"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(b.num_columns - 1), model.width)
            cols = [pa.array(list(model.whiten(x)), pa.list_(pa.float64())), pa.array([str(d) for d in model.deviation(x)], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*b.schema.names[:-1], "whitened", "deviation"])

    return small_batches(rows).mapInArrow(run, f"{kind}, whitened array<double>, deviation string")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component.

    A row whose vector is null or has null, infinite or not-a-number components is
    left out. The covariance is over the distinct integer vectors, so that copies,
    however many, weigh once; the result has each row, repeated ones and null ids
    too. Vectors shorter than the longest are filled up with zeros. Components
    along which the vectors don't vary (below RANK of the largest eigenvalue) can't
    be whitened and have no rows: a table of equal vectors, like an empty one,
    gives an empty result. Other columns are ignored. A deviation beyond a long is
    null; ``deviation_digits`` has its digits in any case.
    """
    model, distinct = fit(vectors, components)
    error = identity_error(model, distinct)
    rows = apply(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    explained = F.array(*[F.lit(e) for e in model.explained]) if model.explained else F.array().cast("array<double>")
    return rows.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened",
        F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"), F.col("deviation").alias("deviation_digits"),
    )
