"""The zygosity classifier: planted classes, code words, and the table of training data that it is read from."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from amplitract.operators import zygosity as Z
from amplitract.sources.reads import read_training


def planted(rng, kind):
    """20 bins with one peak, with two, or with one and a long tail."""
    v = [rng.randint(0, 3) for _ in range(20)]
    at = rng.choice([6, 9])
    v[at] += rng.randint(200, 4000)
    v[at - 1] += v[at] // rng.randint(8, 14)
    if kind == "HETERO":
        v[15 - at] += int(v[at] * rng.uniform(0.5, 0.95))
    if kind == "TAIL":
        for k in range(at + 1, 20):
            v[k] += int(v[at] * 0.3 * 0.8 ** (k - at))
    return v


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(4)
    kinds = ["HETERO", "HOMO", "TAIL"] * 60
    path = tmp_path_factory.mktemp("training") / "training.csv"
    lines = [f"{len(kinds)},20,3", ",".join(f"CCG{k}" for k in range(1, 21)), *(",".join([*map(str, planted(rng, k)), k]) for k in kinds)]
    path.write_text("\n".join(lines) + "\n")
    return read_training(spark, str(path), 20)


def test_planted_classes_are_recovered(spark, table):
    code = Z.train_output_code(table)
    assert code.classes == ["HETERO", "HOMO", "TAIL"] and len(code.weights) == 6 and len({tuple(w) for w in code.words}) == 3
    rng = random.Random(9)
    fresh = [(k, planted(rng, k)) for k in ["HETERO", "HOMO", "TAIL"] * 40]
    rows = spark.createDataFrame(fresh, "label string, v array<int>").withColumn("predicted", code.predict(F.col("v")))
    found = {(r.label, r.predicted): r.n for r in Z.confusion(rows).collect()}
    assert sum(n for (a, b), n in found.items() if a == b) >= 0.9 * len(fresh)
    # the expression against plain arithmetic
    for (_, v), r in zip(fresh, rows.collect(), strict=True):
        x = np.array(v) / np.linalg.norm(v)
        said = np.array(code.weights) @ x + np.array(code.intercepts)
        assert r.predicted == code.classes[int(((np.array(code.words) - said) ** 2).sum(axis=1).argmin())]
    assert Z.OutputCode.from_json(code.to_json()) == code


def test_odd_vectors(spark, table):
    code = Z.train_output_code(table.unionByName(table.limit(1).withColumn("label", F.lit(None).cast("string"))), max_iter=20)
    rows = spark.createDataFrame([([0] * 20,)], "v array<int>")
    assert rows.select(code.predict(F.col("v")).alias("p")).first().p in code.classes
    with pytest.raises(ValueError, match="two classes"):
        Z.train_output_code(table.where("label = 'HOMO'"))


def test_constant_and_turned_bits(spark):
    """Bits that all classes share become constants, and the opposite of a bit is its machine turned around."""
    rows = spark.createDataFrame([([float(k % 2), 1.0 - k % 2], "ab"[k % 2]) for k in range(40)], "features array<double>, label string")
    code = Z.train_output_code(rows, code_size=6, seed=3)
    columns = list(zip(*code.words, strict=True))
    assert {len(set(c)) for c in columns} == {1, 2}
    for c, w, b in zip(columns, code.weights, code.intercepts, strict=True):
        assert (set(w) == {0.0} and b == c[0]) if len(set(c)) == 1 else [w, b] == [[x * c[0] for x in code.weights[columns.index((1, -1))]], c[0] * code.intercepts[columns.index((1, -1))]]
    got = rows.select("label", code.predict(F.col("features")).alias("p")).distinct().collect()
    assert {(r.label, r.p) for r in got} == {("a", "a"), ("b", "b")}
