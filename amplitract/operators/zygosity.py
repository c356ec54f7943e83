"""Zygosity of a sample's CCG vector, learnt from labelled vectors: linear machines in an error-correcting output code.

Each class has a code word of code_size bits a class, drawn at random with a seed; one machine a bit learns to tell the classes whose
word has it from the others. A vector gets the class whose word is nearest to what the machines say of it. Vectors are normalised to a
length of 1. The machines are Spark's own, fitted on the whole table; what is kept of them are bits x (bins + 1) numbers, so
that classification is a column expression. A bit that all classes share is no machine but a constant.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_A_TASK = 50_000


def l2_normalised(v: Column) -> Column:
    """A vector of length 1; one of zeros stays."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


@dataclass(frozen=True)
class OutputCode:
    """classes and their code words of 1 and -1, and for each bit the weights of the bins and an intercept."""

    classes: list[str]
    words: list[list[int]]
    weights: list[list[float]]
    intercepts: list[float]

    def predict(self, v: Column) -> Column:
        """The class of a vector that needn't be normalised: of least squared distance, the first of the classes if equal."""
        given = l2_normalised(v)
        dot = lambda w: F.aggregate(F.zip_with(given, F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        said = F.array(*[dot(w) + F.lit(float(b)) for w, b in zip(self.weights, self.intercepts, strict=True)])
        apart = lambda word: F.aggregate(F.zip_with(said, F.array(*[F.lit(float(x)) for x in word]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        return F.array_min(F.array(*[F.struct(apart(w).alias("d"), F.lit(c).alias("c")) for c, w in zip(self.classes, self.words, strict=True)]))["c"]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> OutputCode:
        return OutputCode(**json.loads(text))


def train_output_code(training: DataFrame, features: str = "features", label: str = "label", code_size: float = 2, seed: int = 0, loss: str = "logistic", reg: float = 1e-4, max_iter: int = 50) -> OutputCode:
    """Fits the machines on all rows of training with a label (features: an array of numbers). loss is hinge, for support vector
    machines, or logistic, whose smooth loss the library's solver takes to its minimum in fewer passes over the rows."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = training.where(F.col(label).isNotNull()).select(array_to_vector(l2_normalised(F.col(features))).alias("features"), F.col(label).cast("string").alias("label"))
    classes = sorted(r["label"] for r in rows.select("label").distinct().collect())
    if len(classes) < 2:
        raise ValueError(f"two classes at least are asked for, not {classes}")
    draw, words = np.random.RandomState(seed), np.zeros((len(classes), 1), int)
    while len({tuple(w) for w in words.tolist()}) < len(classes):  # until no two classes share a word
        words = np.where(draw.random_sample((len(classes), max(2, int(len(classes) * code_size)))) > 0.5, 1, -1)
    # each iteration of a fit is a job: no more tasks than the rows are worth
    rows = rows.coalesce(1 + rows.count() // ROWS_A_TASK).persist()
    try:
        size = rows.first()["features"].size
        fitted: dict[tuple[int, ...], tuple[list[float], float]] = {}
        for column in words.T.tolist():
            key, turned = tuple(column), tuple(-x for x in column)
            if key in fitted:
                continue
            if len(set(key)) == 1:
                fitted[key] = ([0.0] * size, float(key[0]))
            elif turned in fitted:  # the same machine, turned around
                fitted[key] = ([-x for x in fitted[turned][0]], -fitted[turned][1])
            else:
                positive = F.col("label").isin([c for c, x in zip(classes, key, strict=True) if x > 0]).cast("double")
                kind = {"hinge": LinearSVC, "logistic": LogisticRegression}[loss]
                machine = kind(featuresCol="features", labelCol="y", regParam=reg, maxIter=max_iter, standardization=False).fit(rows.select("features", positive.alias("y")))
                fitted[key] = ([float(x) for x in machine.coefficients], float(machine.intercept))
    finally:
        rows.unpersist()
    machines = [fitted[tuple(c)] for c in words.T.tolist()]
    return OutputCode(classes, words.tolist(), [w for w, _ in machines], [b for _, b in machines])


def confusion(predicted: DataFrame, label: str = "label", found: str = "predicted") -> DataFrame:
    """(label, predicted, n)"""
    return predicted.groupBy(F.col(label).alias("label"), F.col(found).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classified(dense_ccg: DataFrame, code: OutputCode) -> DataFrame:
    """(sample_id, zygosity) of dense CCG bins (sample_id, ccg, n)."""
    v = F.transform(F.array_sort(F.collect_list(F.struct("ccg", "n"))), lambda x: x["n"])
    return dense_ccg.groupBy("sample_id").agg(v.alias("v")).select("sample_id", code.predict(F.col("v")).alias("zygosity"))
