"""Embedding whitening with exact covariances from a digit-slice GEMM.

Entries become integers (``scale`` steps a unit), and each distinct integer vector is fitted once. Sums S of the n vectors are
exact, so n * x - S is a vector of integers, centred without rounding. Their products are taken by float64 BLAS and yet are
exact: integers are cut into limbs of LIMB bits, and products of two limbs, summed over ROWS vectors, stay below 2 ** 53.
Sums of limb products are recombined as big integers, which tasks hand over as digits of 32 bits; Spark adds the digits of
all tasks, so the matrix is the same however rows are dealt. Only its eigenvectors are rounded.

The driver gets the digits of a matrix of dimension x dimension, whatever the number of rows. ``MAX_DIM`` bounds it.

Defined cases: rows whose vector is null, empty, or holds null, NaN or infinite entries go. Vectors of another length than most rows have
(the longest of equally many) go too. Entries beyond the range of a long take its ends. Repeated vectors are fitted once and
whitened in each row; a null id is kept. Eigenvalues that rounding can't tell from 0 have no component, so one distinct vector
has none, and then, as for an empty table, no row is returned. Of equal eigenvalues any orthonormal vectors may come.
Other columns pass through, and columns with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, freeing, fresh, materialize, others, table

#: Products of limbs are below 2 ** (2 * LIMB), and those of ROWS vectors add up to less than 2 ** 53.
LIMB, ROWS = 20, 8192
DIGIT = 32
MAX_DIM = 4096
N_COMPONENTS, SCALE = 4, 256.0


def integers(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * c) of each entry, or null for a vector that can't be used."""
    usable = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return F.when((F.size(vector) > 0) & usable, F.transform(vector, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")))


def matrix(column: pa.Array) -> np.ndarray:
    """A batch of vectors of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Integers (of a fixed size or Python's) as float64 limbs, least first; the last one carries the sign."""
    parts = []
    while len(y) and max(-int(y.min()) - 1, int(y.max())) >> (LIMB - 1):
        parts.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB
    return [*parts, y.astype(np.float64)]


class Gram:
    """The exact sum of products of all pairs of columns of the integer vectors that are added."""

    def __init__(self, dim: int) -> None:
        self.total = np.zeros((dim, dim), object)
        self.open: dict[int, np.ndarray] = {}
        self.n_open = 0

    def add(self, y: np.ndarray) -> None:
        for at in range(0, len(y), ROWS):
            parts = limbs(y[at : at + ROWS])
            for i, a in enumerate(parts):
                for j, b in enumerate(parts[: i + 1]):
                    product = (a.T @ b).astype(np.int64)  # exact: a sum of integers below 2 ** 53
                    self.open[i + j] = self.open.get(i + j, 0) + (product if i == j else product + product.T)
            self.n_open += len(parts)  # each adds twice 2 ** 53 at most
            if self.n_open >= 256:
                self.close()

    def close(self) -> np.ndarray:
        for k, product in self.open.items():
            self.total += product.astype(object) << (LIMB * k)
        self.open, self.n_open = {}, 0
        return self.total


def digits(total: np.ndarray) -> pa.RecordBatch:
    """Big integers as rows (at, digit, value): value * 2 ** (32 * digit) summed is the number; the last digit carries the sign."""
    flat, k, rows = total.ravel(), 0, []
    at = np.arange(len(flat))
    while len(flat):
        done = np.array([-(1 << 62) <= v < 1 << 62 for v in flat], bool)
        low = np.where(done, flat, flat & ((1 << DIGIT) - 1))
        rows.append((at, np.full(len(at), k), low.astype(np.int64)))
        flat, at, k = flat[~done] >> DIGIT, at[~done], k + 1
    columns = [np.concatenate(x) for x in zip(*rows, strict=True)] or [np.empty(0, np.int64)] * 3
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["at", "digit", "value"])


def exact_sums(vectors: DataFrame, start, add, finish) -> list[int]:
    """Sums over all rows of vectors (x) of what each task gathers: start() begins, add(state, x) takes a batch, finish(state) gives big integers."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            if len(b):
                state = add(start() if state is None else state, matrix(b.column("x")))
        if state is not None:
            yield digits(finish(state))

    parts = vectors.select("x").mapInArrow(freeing(gathered), "at long, digit long, value long")
    # digits are below 2 ** 62, of many tasks more than a long holds
    found = parts.groupBy("at", "digit").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    sums = [0] * (1 + max((r["at"] for r in found), default=-1))
    for r in found:
        sums[r["at"]] += int(r["value"]) << (DIGIT * r["digit"])
    return sums


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, in Python's integers where 64 bits could be too few."""
    most = n * max(-int(x.min()), int(x.max()), 1) + max(abs(s) for s in sums) if x.size else 0
    wide = most >> 62 > 0
    return (x.astype(object) if wide else x) * n - np.array(sums, object if wide else np.int64)


@dataclass
class Whitening:
    """A fit: n distinct vectors, their sums, unit eigenvectors as columns, eigenvalues and their shares of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    scale: float = SCALE

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened coordinates of centred vectors n * x - S."""
        return (y.astype(np.float64) @ self.vectors) / (self.n * np.sqrt(self.values))


def decompose(n: int, sums: list[int], products: list[int], n_components: int, scale: float) -> Whitening:
    """The components of the covariance products / n ** 3, by falling eigenvalue; the entry of largest size in each is positive."""
    dim = len(sums)
    cube = n**3
    v = np.array([p / cube for p in products], np.float64).reshape(dim, dim)  # each is rounded once
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:n_components]
    values, vectors = values[order], vectors[:, order]
    there = values > dim * np.finfo(float).eps * max(values[0], 0) if dim else np.zeros(0, bool)
    values, vectors = values[there], vectors[:, there]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    trace = sum(products[i * (dim + 1)] for i in range(dim)) / cube
    return Whitening(n, sums, vectors, values, values / trace if trace else values, scale)


def fit_list(rows: DataFrame, x: str) -> DataFrame:
    """A written table (x) of the distinct vectors of most rows' length."""
    return materialize(rows.groupBy(F.col(x).alias("x")).agg(F.lit(1).alias("one")).select("x"), "vectors")


def fit(vectors: DataFrame, n_components: int = N_COMPONENTS, scale: float = SCALE) -> Whitening:
    """The whitening of distinct integer vectors (x) of one length."""
    n = vectors.count()
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), scale)

    def add_up(state: list, x: np.ndarray) -> list:
        wide = max(-int(x.min()), int(x.max()), 1) * len(x) >> 62 > 0
        state.append((x.astype(object) if wide else x).sum(axis=0).astype(object))
        return [np.sum(state, axis=0)]

    sums = exact_sums(vectors, list, add_up, lambda s: s[0])
    if len(sums) > MAX_DIM:
        raise ValueError(f"vectors have {len(sums)} entries; a covariance of {MAX_DIM} at most is decomposed")

    def add_products(state: Gram, x: np.ndarray) -> Gram:
        state.add(centred(x, n, sums))
        return state

    products = exact_sums(vectors, lambda: Gram(len(sums)), add_products, Gram.close)
    return decompose(n, sums, products, n_components, scale)


WHITENED = T.StructType([T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])


def projected(w: Whitening):
    """A function of integer vectors: deviation, the sum of squares of n * x - S (null from 10 ** 38 on), and whitened coordinates."""

    @F.arrow_udf(returnType=WHITENED)
    def run(x: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.struct([("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))]))
        y = centred(matrix(x), w.n, w.sums)
        narrow = y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 1 << 63
        squares = ((y if narrow else y.astype(object)) ** 2).sum(axis=1)
        limit = 10**38
        deviation = pa.array([int(s) if s < limit else None for s in squares], pa.decimal128(38, 0))
        z = w.project(y)
        offsets = pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32())
        return pa.StructArray.from_arrays([deviation, pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], names=["deviation", "whitened"])

    return run


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """The largest entry by size of the whitened vectors' own covariance less the identity."""
    k = len(w.values)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    z = vectors.select(projected(w)(F.col("x")).alias("p")).select("p.whitened")
    each = [F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs]
    found = z.agg(*each).first() if pairs else []
    return max((abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True)), default=0.0)


def whiten(rows: DataFrame, vector: str = "embedding", n_components: int = N_COMPONENTS, scale: float = SCALE) -> tuple[DataFrame, Whitening, float]:
    """rows that can be used, with deviation (decimal) and whitened (an array of up to n_components), the fit, and its identity error."""
    x = fresh(rows, "x")
    usable = rows.select("*", integers(rows[vector], scale).alias(x)).where(F.col(x).isNotNull())
    lengths = usable.groupBy(F.size(x).alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    usable = usable.where(F.size(x) == (lengths["length"] if lengths else 0))
    vectors = fit_list(usable, x)
    w = fit(vectors, n_components, scale)
    error = identity_error(vectors, w)
    discard(vectors)
    p = fresh(usable, "p")
    made = usable.select(*others(rows, "deviation", "whitened"), projected(w)(F.col(x)).alias(p))
    names = [f"`{c}`" for c in made.columns[:-1]]
    return made.select(*names, F.col(f"{p}.deviation").alias("deviation"), F.col(f"{p}.whitened").alias("whitened")), w, error


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, w, error = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    explained = F.array(*[F.lit(float(e)) for e in w.explained]).cast("array<double>")
    each = made.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
