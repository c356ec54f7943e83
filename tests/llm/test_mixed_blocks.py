"""The mix's own output: blocks of words at the drawn slots."""

import collections

from pyspark.sql import functions as F
from test_operators import docs, empty, rows, split  # noqa: F401

from amplitract.llm import mixing


def test_blocks_hold_the_packed_words(docs, rows):  # noqa: F811
    out = mixing.mixed_blocks(docs, block_words=16, slots_per_shard=20).collect()
    of_source = collections.defaultdict(dict)
    for r in out:
        assert of_source[r.source].setdefault(r.block, list(r.words)) == list(r.words)  # a block is the same at each of its slots
        assert 0 < len(r.words) <= 16
    sized = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", mixing.count_words(docs["text"]).alias("size"))
    src = {r.source: r for r in mixing.source_targets(sized, block_words=16).collect()}
    assert collections.Counter(r.source for r in out) == {k: r.n_slots for k, r in src.items() if r.n_slots}
    taken = mixing.plan_mix(sized, block_words=16).agg(F.sum("taken")).first()[0]
    assert sum(len(r.words) for r in out) == taken
    for source, found in of_source.items():
        if len(found) < src[source].n_blocks:
            continue
        words = [w for b in sorted(found) for w in found[b]]
        assert len(words) == src[source].source_size and collections.Counter(words) == collections.Counter(w for r in rows if r.source == source for w in split(r.text))
        whole = "\n" + "\n".join(words) + "\n"
        assert all("\n" + "\n".join(split(r.text)) + "\n" in whole for r in rows if r.source == source and split(r.text))
    assert any(len(found) == src[s].n_blocks for s, found in of_source.items())
    shards = collections.defaultdict(list)
    for r in out:
        shards[r.shard].append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in shards.values()) and len(shards) > 2


def test_no_words(spark):
    assert mixing.mixed_blocks(empty(spark)).count() == 0
    none = spark.createDataFrame([(1, None, "en", "s", 0), (2, "  ", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert mixing.mixed_blocks(none).count() == 0
