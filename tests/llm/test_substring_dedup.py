"""Substring dedup against a comparison of all windows, and its steps one by one."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import clash, docs, empty, rows, split  # noqa: F401

from amplitract.llm import substring_dedup as S


def plain(rows, min_words):  # noqa: F811
    """(doc_id, n_words, n_removed, kept) of each row, by a dictionary of all windows."""
    least = {}
    for r in rows:
        w = split(r.text)
        for i in range(len(w) - min_words + 1):
            k = tuple(w[i : i + min_words])
            if r.doc_id is not None:
                least[k] = min(least.get(k, r.doc_id), r.doc_id)
    out = []
    for r in rows:
        w = split(r.text)
        gone = set()
        for i in range(len(w) - min_words + 1):
            if r.doc_id is not None and least[tuple(w[i : i + min_words])] < r.doc_id:
                gone |= set(range(i, i + min_words))
        out.append((r.doc_id, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text_kept) for r in df.select("doc_id", "n_words", "n_removed", "text_kept").collect()), key=repr)


@pytest.mark.parametrize(("min_words", "phrase"), [(50, 20), (8, 3), (5, 5)])
def test_against_all_windows(docs, rows, min_words, phrase):  # noqa: F811
    got = found(S.dedup_substrings(docs, min_words=min_words, phrase=phrase))
    assert got == plain(rows, min_words)
    assert sum(x[2] for x in got) > 0


def test_entangled_passages(spark):
    """Few words and many mosaics of the same passages, so that matches end everywhere: with the leader, with others, at a text's ends."""
    rng = random.Random(5)
    passages = [[rng.choice("abc") for _ in range(rng.randint(6, 40))] for _ in range(12)]
    texts = []
    for _ in range(220):
        words = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += p[a : a + rng.randint(3, 30)]
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice("abcX")
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    ids = [rng.randrange(150) for _ in texts]
    made = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(6)
    for min_words, phrase in ((10, 4), (14, 5), (20, 20)):
        assert found(S.dedup_substrings(made, min_words=min_words, phrase=phrase)) == plain(made.collect(), min_words)


def test_rounds_are_linear(spark):
    """A hot group of near copies: each round compares an entry once, and the sum over all rounds stays near the number of entries."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(600):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        texts.append(" ".join(w))
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(S.dedup_substrings(made)) == plain(made.collect(), 50)
    rows = made.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text")  # noqa: F811
    places = S.anchors(rows)
    entries = places.groupBy("p", "c").agg(F.min(F.struct("id", "h", "pos")).alias("m"), F.first("owned").alias("owned"))
    seeds = S.contexts(rows, entries.select("p", "c", F.col("m.id").alias("lo"), "owned", "m.id", "m.h", "m.pos"), 50, 20).persist()
    n_entries, compared, n_rounds = seeds.count(), 0, 0
    while not seeds.isEmpty():
        n_rounds += 1
        out = S.one_round(seeds, 50, 20)
        seeds = out.where("g is not null")
        compared += seeds.count()
    assert compared < 2 * n_entries and n_rounds < 12


def test_extension():
    left = [[1, 2, 3], [], [5, 6], [7], [1, 2, 3]]
    right = [[1, 2, 4], [1], [5, 6, 7], [8], [1, 2, 3]]
    as_bytes = lambda x: pa.array([np.array(w, np.uint64).tobytes() for w in x], pa.binary())
    n, word = S.extended(as_bytes(left), as_bytes(right), 3)
    assert n.tolist() == [2, 0, 2, 0, 3] and word.tolist() == [3, 0, 0, 7, 0]
    sliced = S.extended(as_bytes(left)[1:], as_bytes(right)[1:], 3)
    assert sliced[0].tolist() == [0, 2, 0, 3]


def test_odd_tables(spark, docs):  # noqa: F811
    assert S.dedup_substrings(empty(spark)).count() == 0
    extra = clash(docs).select("*", *[F.lit(k).alias(n) for k, n in enumerate(("cut", "spans", "id", "pos", "bits", "text_kept"))])
    got = S.dedup_substrings(extra, min_words=8, phrase=3)
    assert got.select("cut", "id", "h", "pos").distinct().count() == 1 and got.count() == docs.count()
    assert collections.Counter(found(got)) == collections.Counter(found(S.dedup_substrings(docs, min_words=8, phrase=3)))
    same = " ".join(str(k % 7) for k in range(300))
    made = spark.createDataFrame([(None, same), (None, same), (4, same), (4, same), (4, None), (9, same)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in S.dedup_substrings(made).collect()) == [(0, 300, 0), (0, 300, 0), (4, 0, 0), (4, 300, 0), (4, 300, 0), (9, 300, 300)]
    with pytest.raises(ValueError, match="phrase"):
        S.dedup_substrings(made, min_words=90, phrase=20)
