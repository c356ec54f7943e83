"""Fill-in-middle against a plain scan of each text, by chunks of every size."""

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import clash, docs, empty, rows  # noqa: F401

from amplitract.llm import fill_in_middle as M
from amplitract.llm import words as W

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    if not text or any(s in text for s in M.SENTINELS) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(docs, rows):  # noqa: F811
    made = M.fill_in_middle(docs)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.fim_text, r.back) for r in made.select("*", M.restored(F.col("fim_text"), F.col("form")).alias("back")).collect()), key=repr)
    assert got == sorted(((r.doc_id, *plain(r.doc_id, r.text), r.text or "") for r in rows), key=repr)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}


def test_chunks_of_all_sizes(rows):  # noqa: F811
    """Counts and places don't depend on where chunks and slabs begin, in the middle of a character too."""
    texts = [r.text for r in rows][:40] + ["ends in space  ", "  begins", "日本 語\t😀😀 é", "   not ASCII space"]
    tokens = [TOKEN.findall(t or "") for t in texts]
    for chunk, slab in ((1, 1), (2, 7), (5, 5), (64, 100), (4096, 1 << 20)):
        for at, data, offsets in W.pieces(pa.array(texts), 3000):
            chunks = M.Chunks(data, offsets, chunk, slab)
            mine = tokens[at : at + len(offsets) - 1]
            assert chunks.n.tolist() == [len(x) for x in mine]
            for part in (0, 1, 3):
                ranks = np.array([min(len(x), len(x) * part // 3) for x in mine])
                assert chunks.characters_of(ranks).tolist() == [len("".join(x[:k])) for x, k in zip(mine, ranks, strict=True)]


def test_options_and_odd_tables(spark, docs):  # noqa: F811
    other = M.fill_in_middle(clash(docs).select("*", F.lit(1).alias("cut"), F.lit(2).alias("new"), F.lit("x").alias("form")), fim_percent=100, spm_percent=0, sentinels=("|a|", "(b", "c)"), seed=7)
    found = other.select("*", M.restored(F.col("fim_text"), F.col("form"), ("|a|", "(b", "c)")).alias("back")).collect()
    assert all(r.back == (r.text or "") and r.cut == 1 and r.new == 2 for r in found)
    assert {r.form for r in found if r.text} == {"psm"} and all(r.form == "plain" for r in found if not r.text)
    assert M.fill_in_middle(empty(spark)).count() == 0
    marked = spark.createDataFrame([(k, f"a {s} b") for k, s in itertools.product(range(20), M.SENTINELS)], "doc_id long, text string")
    assert {r.form for r in M.fill_in_middle(marked).collect()} == {"plain"}
    with pytest.raises(ValueError, match="sentinels"):
        M.fill_in_middle(docs, sentinels=("x", "x", "y"))
