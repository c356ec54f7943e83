"""The pipeline stage by stage, each against a plain version on what the stage before kept."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F

from amplitract.llm.shared import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import sentencepiece

    from amplitract.llm.sentencepiece_matching import MODEL

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], SF), name))
    assert all(k.columns == docs.columns for k in kept[:-1])
    rows = [k.collect() for k in kept]
    ids = [{r.doc_id for r in x} for x in rows]
    assert ids[1] <= ids[0] and len(ids[1]) >= 0.97 * len(ids[0])
    assert ids[2] == ids[1] and all(r.n_chars == len(r.text) for r in rows[2])
    before = collections.Counter(k for r in rows[1] for k in {x.strip(" \t\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in r.text.split("\n")} if k)
    assert all(before[x.strip(" \t\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})] < 10 for r in rows[2] for x in r.text.split("\n"))

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {r.doc_id: shingles(r.text) for r in rows[3]}
    some = [s for s in sets.values() if len(s) > 20]
    assert all(len(a & b) < 0.8 * len(a | b) for i, a in enumerate(some) for b in some[:i])
    assert max(collections.Counter(r.doc_id for r in rows[4]).values()) <= 2 and ids[4] <= ids[3]
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in rows[4]}
    assert len(rows[5]) == len(rows[4]) and all(list(r.ids) == lib.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows[5])
    assert kept[5].where(F.col("n_tokens") <= 0).count() == 0
