"""Language ID by hierarchical discrimination with linear support vector machines.

A text's features are its hashed byte 2-, 3- and 4-grams (letters folded, other
ASCII as one space) as shares of all grams, so that a machine's output is the
mean weight of the text's grams. First the family is predicted, by one-versus-one
machines between families; then one-versus-one machines separate the languages of
that family alone. Machines are trained on a bounded sample of labelled rows by
dual coordinate descent on the squared hinge loss; every whole text is judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaria.llm import words
from tessaria.llm.common import small_batches

#: ISO 639-1 codes by language family. A code that is missing is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "is", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "turkic": ["az", "kk", "ky", "tr", "uz"],
    "semitic": ["am", "ar", "he", "mt"],
    "uralic": ["et", "fi", "hu"],
}
FAMILY_OF = {c: f for f, cs in FAMILIES.items() for c in cs}
#: At most about so many labelled rows of each language are used for training, chosen by a hash of their id.
SAMPLE_PER_LANGUAGE = 400
BITS, GRAMS = 15, (2, 3, 4)
DIM = len(GRAMS) << BITS
UNKNOWN = "und"
#: At most so many languages are learned, those with most labelled rows, as the machines grow with the square of their number.
MOST_LANGUAGES = 128

_FOLD = np.full(256, 0x20, np.uint8)
for _b in range(256):
    if 0x41 <= _b <= 0x5A:
        _FOLD[_b] = _b + 32
    elif 0x61 <= _b <= 0x7A or _b >= 0x80:
        _FOLD[_b] = _b


def folded(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, lower-cased, each framed by spaces and with single spaces in it; and offsets."""
    data, off = words.buffers(pc.utf8_lower(col.cast(pa.large_string())))
    n = len(off) - 1
    out = np.full(len(data) + 2 * n, 0x20, np.uint8)
    out[np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(off)) + 1] = _FOLD[data]
    new = off + 2 * np.arange(n + 1)
    drop = np.zeros(len(out), bool)
    drop[1:] = (out[1:] == 0x20) & (out[:-1] == 0x20)
    drop[new[:-1]] = False
    return out[~drop], new - np.concatenate([[0], np.cumsum(drop)])[new]


def features(data: np.ndarray, n: int) -> np.ndarray:
    """The number of the feature of each n-gram of bytes, by its first byte."""
    if len(data) < n:
        return np.zeros(0, np.int64)
    x = np.zeros(len(data) - n + 1, np.uint32)
    for k in range(n):
        x = (x << np.uint32(8)) | data[k : len(data) - n + 1 + k]
    x ^= x >> np.uint32(15)
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64) + (GRAMS.index(n) << BITS)


def train_machine(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 4000.0, epochs: int = 20, seed: int = 5) -> np.ndarray:
    """Weights, the bias last: dual coordinate descent for the L2-regularised squared hinge loss."""
    w, alpha, rng = np.zeros(DIM + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    scale = 0.1  # the bias as a feature
    square = np.array([float(v @ v) + scale * scale for _, v in rows]) + 0.5 / cost
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            idx, v = rows[i]
            g = y[i] * (w[idx] @ v + scale * w[DIM]) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - g / square[i], 0.0)
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[idx] += step * v
                w[DIM] += step * scale
                alpha[i] = new
    w[DIM] *= scale
    return w


@dataclass
class Model:
    """Machines as columns of one matrix; each is positive for the first of its two classes."""

    families: list[str]
    languages: dict[str, list[str]]
    family_pairs: list[tuple[int, int, int]]  # (first, second, column)
    pairs: dict[str, list[tuple[int, int, int]]]
    weights: np.ndarray  # float32, columns x DIM
    bias: np.ndarray

    def margins(self, col: pa.Array) -> np.ndarray:
        """Each machine's output for each text (texts x machines)."""
        data, off = folded(col)
        out, total = np.zeros((len(off) - 1, len(self.bias))), np.zeros(len(off) - 1)
        for n in GRAMS:
            idx = features(data, n)
            stop = np.maximum(np.minimum(off[1:], len(data)) - n + 1, off[:-1])
            total += stop - off[:-1]
            for c in range(len(self.bias)):
                sums = np.zeros(len(data) + 1)
                np.cumsum(self.weights[c][idx], out=sums[1 : len(idx) + 1], dtype=float)
                out[:, c] += sums[stop] - sums[off[:-1]]
        return out / np.maximum(total, 1)[:, None] + self.bias

    @staticmethod
    def _vote(m: np.ndarray, classes: int, pairs: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """The class with most wins (ties: the larger sum of margins, then the first), and its smallest margin."""
        wins, sums = np.zeros((len(m), classes)), np.zeros((len(m), classes))
        for a, b, c in pairs:
            wins[:, a] += m[:, c] >= 0
            wins[:, b] += m[:, c] < 0
            sums[:, a] += m[:, c]
            sums[:, b] -= m[:, c]
        best = (wins + 1e-3 * np.tanh(sums / max(1, classes))).argmax(1)
        least = np.full(len(m), np.inf)
        for a, b, c in pairs:
            least = np.where(best == a, np.minimum(least, m[:, c]), np.where(best == b, np.minimum(least, -m[:, c]), least))
        return best, least

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        m = self.margins(col)
        family, margin = self._vote(m, len(self.families), self.family_pairs)
        out: list[str] = [""] * len(m)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            if len(rows):
                lang, least = self._vote(m[rows], len(self.languages[f]), self.pairs[f])
                margin[rows] = np.minimum(margin[rows], least)
                for r, x in zip(rows, lang, strict=True):
                    out[r] = self.languages[f][x]
        with np.errstate(over="ignore"):
            return out, 1 / (1 + np.exp(-4 * np.minimum(margin, 50)))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def training_rows(doc_id: Column) -> Column:
    """Rows that may be learned from; the others are held out."""
    return remainder(doc_id) != 2


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Labelled training rows of the most frequent languages, each kept by a hash of its id at its language's rate."""
    rows = small_batches(docs).where(training_rows(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    by = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(MOST_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in by.collect()}
    if not counts:
        return rows.limit(0)
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n))) for k, n in sorted(counts.items())])
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 62)) < rate * float(1 << 62))


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Trains on a sample; texts become feature counts on the executors. None if nothing is labelled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in words.slices(b, "text"):
                data, off = folded(s.column(1))
                idx, val = [], []
                for k in range(s.num_rows):
                    got = np.concatenate([features(data[off[k] : off[k + 1]], n) for n in GRAMS])
                    i, c = np.unique(got, return_counts=True)
                    idx.append(i.astype("<i4").tobytes())
                    val.append((c / max(1, len(got))).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(idx, pa.binary()), pa.array(val, pa.binary()), s.column(2)], ["lang", "idx", "val", "o"])

    counted = sample(docs, per_language).select("lang", "text", F.xxhash64("doc_id").alias("o")).mapInArrow(count, "lang string, idx binary, val binary, o long")
    # Rows that repeat an id are sampled together: twice what is expected is the most that reaches the driver.
    got = counted.orderBy("o", "lang", "idx").limit(2 * per_language * MOST_LANGUAGES).collect()
    got.sort(key=lambda r: (r["o"], r["lang"], r["idx"]))  # the same order on every run
    rows = [(r["lang"], np.frombuffer(r["idx"], "<i4"), np.frombuffer(r["val"], "<f4")) for r in got if r["idx"]]
    del got
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    of = lambda lang: FAMILY_OF.get(lang, lang)
    families = sorted({of(x) for x in langs})
    languages = {f: [x for x in langs if of(x) == f] for f in families}
    weights: list[np.ndarray] = []

    def machine(first: set[str], second: set[str]) -> int:
        chosen = [r for r in rows if r[0] in first or r[0] in second]
        weights.append(train_machine([r[1:] for r in chosen], np.array([1.0 if r[0] in first else -1.0 for r in chosen])))
        return len(weights) - 1

    family_pairs = [(a, b, machine(set(languages[families[a]]), set(languages[families[b]]))) for a, b in combinations(range(len(families)), 2)]
    pairs = {f: [(a, b, machine({ls[a]}, {ls[b]})) for a, b in combinations(range(len(ls)), 2)] for f, ls in languages.items()}
    both = np.array(weights).reshape(len(weights), DIM + 1)
    return Model(families, languages, family_pairs, pairs, both[:, :DIM].astype(np.float32), both[:, DIM])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score: ``und`` and 0.0 where the text is null or has no letter, or nothing was learned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        at = names.index("text")
        for b in batches:
            for s in words.slices(b, "text"):
                col = s.column(at)
                ok = np.array([has_letter(t.as_py()) for t in col], bool)
                if model is None:
                    ok[:] = False
                    lang, score = [UNKNOWN] * len(ok), np.zeros(len(ok))
                else:
                    lang, score = model.predict(col.fill_null(""))
                lang = [x if o else UNKNOWN for x, o in zip(lang, ok, strict=True)]
                yield pa.RecordBatch.from_arrays([*s.columns, pa.array(lang, pa.string()), pa.array(np.where(ok, score, 0.0))], [*names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learned from text and non-null lang of rows whose crc32(doc_id as text) mod 4
    is not 2; rows without an id are neither learned from nor held out. Predictions
    see the text alone. A null text, or one without a letter, is ``und`` with score
    0, and so is all where nothing is labelled; of more than MOST_LANGUAGES
    values of lang the most frequent are learned; repeated rows are judged one by
    one; other columns are ignored; an empty table gives an empty result.
    """
    model = fit(docs, per_language)
    judged = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return judged.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised, with their own columns; those that are ``und`` go."""
    judged = predict(docs.withColumnsRenamed({c: f"own_{k}" for k, c in enumerate(docs.columns) if c in ("lang_pred", "score")}), fit(docs))
    kept = judged.where(F.col("lang_pred") != UNKNOWN).drop("lang_pred", "score")
    return kept.withColumnsRenamed({f"own_{k}": c for k, c in enumerate(docs.columns) if c in ("lang_pred", "score")})
