"""Whitening against exact fractions and numpy on the whole table."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from amplitract.llm import whitening as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(vectors):
    """n, sums and the covariance of distinct integer vectors, in fractions."""
    n, dim = len(vectors), len(vectors[0])
    sums = [sum(v[i] for v in vectors) for i in range(dim)]
    centred = [[Fraction(n * v[i] - sums[i], n) for i in range(dim)] for v in vectors]
    return n, sums, [[sum(c[i] * c[j] for c in centred) / n for j in range(dim)] for i in range(dim)]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    base = (rng.normal(size=(120, 6)) @ rng.normal(size=(6, 6)) / 4 + 3).astype(np.float32)
    rows = [(k, [float(c) for c in base[k % 100]], k % 3) for k in range(130)]
    rows += [(None, [float(c) for c in base[101]], None), (7, None, 1), (8, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1), (9, [float("nan")] * 6, 0), (10, [1.0, 2.0, 3.0, 4.0, 5.0, float("-inf")], 0), (11, [], 0), (12, [1.0, 2.0], 0), rows[3]]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).persist()


def test_whitening_is_exact(vectors):
    rows = [r for r in vectors.collect() if r.embedding and len(r.embedding) == 6 and all(c is not None and math.isfinite(c) for c in r.embedding)]
    x = {tuple(math.floor(256 * c) for c in r.embedding) for r in rows}
    n, sums, v = exact(sorted(x))
    made, w, error = E.whiten(vectors)
    assert (w.n, w.sums) == (n, sums) and error < 1e-9
    reference = np.array([[float(c) for c in row] for row in v])
    values, components = np.linalg.eigh(reference)
    values, components = values[::-1][:4], components[:, ::-1][:, :4]
    assert np.allclose(w.values, values, rtol=1e-12) and np.allclose(w.explained, values / np.trace(reference), rtol=1e-12)
    assert np.allclose(np.abs((components * w.vectors).sum(axis=0)), 1)
    got = made.collect()
    assert len(got) == len(rows) and made.columns == ["vec_id", "embedding", "label", "deviation", "whitened"]
    for r in got:
        y = [math.floor(256 * c) - Fraction(s, n) for c, s in zip(r.embedding, sums, strict=True)]
        assert int(r.deviation) == n * n * sum(c * c for c in y)
        want = np.array([float(c) for c in y]) @ w.vectors / np.sqrt(w.values)
        assert np.allclose(r.whitened, want, rtol=1e-9, atol=1e-12)


def test_products_of_many_limbs():
    """Integers of up to 90 bits, many vectors and both signs: products are those of Python's integers."""
    rng = np.random.default_rng(1)
    for bits, n in ((3, 20_000), (19, 9_000), (20, 8_192), (33, 700), (62, 300), (90, 40)):
        y = np.array([[int(rng.integers(-(1 << 30), 1 << 30)) * (1 << max(bits - 30, 0)) + int(rng.integers(0, 1 << min(bits, 30))) if bits > 30 else int(rng.integers(-(1 << bits), 1 << bits)) for _ in range(3)] for _ in range(n)], object)
        y[0], y[1] = 1 << bits, -(1 << bits)
        gram = E.Gram(3)
        gram.add(y.astype(np.int64) if bits < 63 else y)
        total = gram.close()
        assert total.tolist() == [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]
        told = [0] * 9
        for r in E.digits(total).to_pylist():
            told[r["at"]] += r["value"] << (E.DIGIT * r["digit"])
        assert told == total.ravel().tolist()


def test_dealing_does_not_matter(spark):
    """A large offset, hidden variance and huge entries: float64 sums would lose it; any partitioning gives the same bits."""
    rng = np.random.default_rng(4)
    rows = [(k, [1e9 + float(a), -3e11 + 2 * float(a) + float(b), float(b) * 1e5]) for k, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    fits = []
    for parts in (1, 7):
        made, w, error = E.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts), n_components=2)
        fits.append((w.sums, w.values.tolist(), w.vectors.tolist()))
        assert error < 1e-6 and made.where("deviation is null").count() == 0
    assert fits[0] == fits[1]
    n, sums, v = exact([[math.floor(256 * c) for c in r[1]] for r in rows])
    assert fits[0][0] == sums
    assert np.allclose(sum(w.values), float(sum(v[i][i] for i in range(3))), rtol=1e-3)


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    made, w, error = E.whiten(none)
    assert made.count() == 0 and w.n == 0 and error == 0
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)
    made, w, _ = E.whiten(one)
    assert w.n == 1 and len(w.values) == 0 and [r.whitened for r in made.collect()] == [[], []]
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0], 0) for k in range(9)], SCHEMA)
    made, w, error = E.whiten(flat.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("x", "p", "whitened", "n", "deviation"))]))
    assert len(w.values) == 1 and abs(w.explained[0] - 1) < 1e-12 and error < 1e-9
    row = made.where("vec_id = 4").first()
    assert (row.x, row.p, row.n) == (0, 1, 3) and abs(row.whitened[0]) < 1e-12
    assert [math.isclose(z, 0, abs_tol=1e-9) for z in np.mean([r.whitened for r in made.collect()], axis=0)] == [True]


def test_query(spark):
    got = E.op11_whitening(spark, "/root/testdata/sf0.001").toPandas()
    assert got.groupby("vec_id")["component"].apply(sorted).map(tuple).unique().tolist() == [(1, 2, 3, 4)]
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    x = np.unique(np.array([np.floor(256 * np.asarray(v, float)) for v in table.embedding]), axis=0)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert (got.n == len(x)).all() and got.identity_error.max() < 1e-9
    for k in range(4):
        z = got[got.component == k + 1]
        assert np.allclose(z.explained, values[k] / values.sum()) and abs(z.whitened.var(ddof=0) - 1) < 0.05
