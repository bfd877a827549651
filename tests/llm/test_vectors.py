"""Vector codes and whitening against brute force in whole numbers, with nulls, ties, repeated rows and large components."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaria.llm import vector_codes, vectors, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, code string, x string, error string, n string"
NAN, INF = float("nan"), float("inf")


def some(seed, n, width, scale=1.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, width)) * scale).round(3).tolist()


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", "x", "e", "n") for i, v, label in rows], SCHEMA).repartition(3)


def hard_rows(n=90, width=32, scale=1.0):
    rows = [(1000 - i, v, (None, 1, 2)[i % 3]) for i, v in enumerate(some(5, n, width, scale))]
    rows += [(rows[0][0], rows[0][1], 1), (7, rows[3][1], 2), (None, rows[5][1], None), (8, [0.0] * width, 1), (9, [-0.0] * width, 1), (10, [-0.001] + [0.0] * (width - 1), 1)]
    rows += [(1, None, 1), (2, [None] + [1.0] * (width - 1), 1), (3, [NAN] + [1.0] * (width - 1), 1), (4, [1.0] * (width - 1) + [-INF], 1)]
    return rows


def ints(rows):
    good = [(i, [math.floor(Fraction(c) * 256) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(x) for _, x, _ in good), default=0)
    return [(i, x + [0] * (width - len(x)), label) for i, x, label in good]


def codes_brute(rows, parts, entries, rounds):
    good = ints(rows)
    good = [(i, x + [0] * (-len(x) % parts), label) for i, x, label in good]
    w = len(good[0][1]) // parts
    cut = lambda x: [x[p * w : (p + 1) * w] for p in range(parts)]
    start = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(x)[p] for _, x, _ in start] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            own = {}
            for _, x, _ in good:
                own.setdefault(near(p, cut(x)[p])[1], []).append(cut(x)[p])
            for k, xs in own.items():
                new[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
        books = new
    found = [[near(p, c) for p, c in enumerate(cut(x))] for _, x, _ in good]
    error = [sum(f[0] for f in fs) for fs in found]
    total = {}
    for (_, _, label), e in zip(good, error):
        total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, bytes(f[1] for f in fs).hex(), e, total[label], sha) for (i, _, label), fs, e in zip(good, found, error)), key=str)


@pytest.mark.parametrize("width, entries, scale", [(32, 64, 1.0), (33, 5, 1.0), (32, 200, 0.01), (16, 8, 1e6)])
def test_codes(spark, width, entries, scale):
    rows = hard_rows(width=width, scale=scale)
    rows.append((500, rows[0][1][:3], 2))  # shorter than the others
    got = vector_codes.compress(table(spark, rows), 16, entries, 2)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == codes_brute(rows, 16, entries, 2)


def test_large_components_are_searched_in_whole_numbers(spark):
    rows = [(i, v, 1) for i, v in enumerate(some(8, 30, 16, 1e10))]
    q = vector_codes.fit(table(spark, rows), 4, 6, 2)
    assert q.exact and q.sha256() == codes_brute(rows, 4, 6, 2)[0][-1]
    # An error beyond a long is null, the codes stand.
    want = {i: (c, e if e < 2**63 else None) for i, c, e, *_ in codes_brute(rows, 4, 6, 2)}
    assert {r["vec_id"]: (r["code"].hex(), r["error"]) for r in vector_codes.encode(table(spark, rows), q).collect()} == want


@pytest.mark.parametrize("kind", [np.int64, object])
def test_partial_distances_find_the_nearest(kind):
    rng = np.random.default_rng(3)
    for trial in range(60):
        entries = rng.integers(-4, 5, size=(int(rng.integers(1, 60)), int(rng.integers(1, 6)))) * np.array([1, 5, 1, 2, 9][: 1]) if trial % 2 else rng.integers(-200, 200, size=(40, 4))
        x = rng.integers(entries.min() - 3, entries.max() + 4, size=(50, entries.shape[1]))
        at, far = vector_codes.Codebook(entries.astype(kind)).nearest(x.astype(kind))
        d = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        assert at.tolist() == d.argmin(1).tolist() and far.tolist() == d.min(1).tolist()


def test_dimensions_are_taken_by_falling_variance():
    assert vector_codes.Codebook(np.array([[0, 1, 5], [0, -1, -5], [0, 1, 9]])).order == [2, 1, 0]
    assert vector_codes.Codebook(np.array([[3, 3], [-3, -3]])).order == [0, 1]


def test_codes_of_nothing(spark):
    for rows in ([], [(1, None, 1), (2, [NAN], 1)]):
        assert vector_codes.compress(table(spark, rows)).count() == 0
    assert [r["code"] for r in vector_codes.compress(table(spark, [(1, [], 1), (2, [], None)])).collect()] == ["00" * 16] * 2


def test_one_hot_label(spark):
    df = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(*[(F.col("id") % (k + 2)).cast("double") for k in range(16)]).alias("embedding"), F.lit(3).alias("label"))
    got = vector_codes.compress(df, 4, 8, 1)
    assert got.agg(F.sum("error")).first()[0] == got.first()["label_error"] and got.count() == 5000


@pytest.mark.parametrize("bits", [2, 8, 15])
def test_limb_products_are_exact(bits):
    rng = np.random.default_rng(bits)
    for top in (1, 200, 2**31, 2**62):
        x = np.array([[int(v) for v in row] for row in rng.integers(-top, top + 1, size=(40, 5))], np.int64)
        x[0] = top, -top, 0, -1, 1
        assert (sum(p.astype(object).astype(int).astype(object) * 2 ** (bits * k) for k, p in enumerate(whitening.limbs(x, bits))) == x.astype(object)).all()
        g = whitening.Gram(5, bits)
        g.add(x[:17]), g.add(x[17:])
        big = x.astype(object)
        assert (g.total() == big.T @ big).all()
    for value in (0, -1, 5, -(2**150), 2**150 + 12345):
        assert sum(w << whitening.WORD * k for k, w in enumerate(whitening._words(value))) == value


def whiten_brute(rows, components):
    """Sums and deviations in whole numbers, the eigenvectors of the exact covariance."""
    good = ints(rows)
    fit = sorted({tuple(x) for _, x, _ in good})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    v = np.array([[float(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit) / Fraction(n**3)) for j in range(len(s))] for i in range(len(s))])
    values, vecs = np.linalg.eigh(v)
    values, vecs = values[::-1][:components], vecs[:, ::-1][:, :components]
    mean = np.array([float(Fraction(k, n)) for k in s])
    return {(i, tuple(x)): (n, sum((n * a - b) ** 2 for a, b in zip(x, s)), (np.array(x, float) - mean) @ vecs / np.sqrt(values)) for i, x, _ in good}, values / np.trace(v), good


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_whitening(spark, scale):
    rows = hard_rows(width=12, scale=scale)
    want, share, good = whiten_brute(rows, 4)
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 4 * len(good) and {r["component"] for r in got} == {1, 2, 3, 4}
    by = {}
    for r in got:
        assert r["identity_error"] < 1e-9 and abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-9
        by.setdefault((r["vec_id"], int(r["deviation_digits"])), {}).setdefault(r["component"], []).append(r)
    sign = {}
    for (i, _), (n, deviation, w) in want.items():
        for k in range(4):
            rs = by[i, deviation][k + 1]
            assert all(r["n"] == n and r["deviation"] == (deviation if deviation < 2**63 else None) for r in rs)
            flip = sign.setdefault(k, 1 if abs(w[k]) < 1e-3 or abs(rs[0]["whitened"] - w[k]) < abs(rs[0]["whitened"] + w[k]) else -1)
            assert all(abs(flip * r["whitened"] - w[k]) < 1e-7 for r in rs)


def test_deviations_beyond_a_long(spark):
    model = whitening.decompose(whitening.exact_gram(table(spark, [(i, v, 1) for i, v in enumerate(some(1, 20, 3))]).select(vectors.integers(F.col("embedding"), 3).alias("x")), "x", 3), 2)
    model.n, model.sums = 10**11, [3 * 10**13, -5, 2**70]
    x = np.array([[1, -2, 3], [2**40, -(2**40), 7], [0, 0, 0]], np.int64)
    assert model.deviation(x) == [sum((model.n * int(a) - s) ** 2 for a, s in zip(row, model.sums)) for row in x]


def test_whitening_without_variance(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [0.5, 2.0], 1), (2, [0.5, 2.0], 1)])).count() == 0
    assert whitening.whiten(table(spark, [(1, [], 1), (2, None, 1)])).count() == 0
    line = whitening.whiten(table(spark, [(k, [float(k), 2.0 * k, 1.0], 1) for k in range(9)])).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 9 and abs(line[0]["explained"] - 1) < 1e-12 and line[0]["identity_error"] < 1e-9


def test_copies_weigh_once(spark):
    rows = [(k, v, 1) for k, v in enumerate(some(4, 40, 6))]
    once, often = whitening.fit(table(spark, rows))[0], whitening.fit(table(spark, rows + [(99 + k, rows[0][1], 1) for k in range(500)]))[0]
    assert once.n == often.n == 40 and once.sums == often.sums and (once.values == often.values).all()
