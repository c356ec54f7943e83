"""Substring dedup by seeds that are extended both ways.

Seeds are winnowed anchors: of every window of ``min_words`` words, the place whose next ``phrase`` words hash lowest (the
last of equal ones). Equal windows have theirs at the same offset, so two documents that share a window share its anchor. The
window is known by the anchor and by how many words it begins before it.

1. Anchors whose phrase no second document holds go. Equal contexts (the words around an anchor that its windows reach) become one
   entry, known by the least document that holds it.
2. The entries of a phrase form a group, and each is joined with the group's leader, the entry of the least document. The
   match is extended word by word to the left and to the right; windows inside of a match of min_words words and more are
   repeats of the leader's document, and no lesser document can have them.
3. A window that goes past the match can only repeat in an entry that leaves the leader at the same word for the same
   other word. Those entries are the next round's groups, each with a leader of its own, until no group has two documents.
   Each round extends every match, so rounds end; most entries are settled or alone after two or three.
4. Matches become spans of each document, and their words go.

A group costs one comparison an entry and round: neither pairs nor the members of a group ever meet in one place, and copies
of a passage are one entry however many documents hold it. Leaders are found by a grouped minimum with map-side sums.

Words are runs of other characters than space and tab to carriage return, unchanged, and are compared by their 64-bit hashes.
Defined cases: a null text has no words; a document of fewer than min_words words keeps all;
rows with a null id keep all their words and are nobody's source; rows of equal ids are one document, whose repeats inside
of it stay; other columns pass through, and columns with the names of results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .repeated_passages import slide_argmin
from .shared import discard, freeing, fresh, materialize, others, table
from .words import _WORD_BASE, U64, Words, _runs, mix64, pieces

MIN_WORDS, PHRASE = 50, 20


def anchors(rows: DataFrame, min_words: int = MIN_WORDS, phrase: int = PHRASE) -> DataFrame:
    """(id, h, p, c, pos, owned) of each winnowed anchor of rows (id, h, text): the hashes of its phrase and of its
    context, the word it begins at, and the windows it stands for: bit j for the one that begins j words before it."""
    reach = min_words - phrase

    def winnowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in pieces(b.column(2)):
                w = Words(data, offsets, lower=False)
                several = np.maximum(np.diff(w.edges) - min_words + 1, 0)
                text = np.repeat(np.arange(len(several)), several)
                if not len(text):
                    continue
                begins = w.edges[text] + np.arange(len(text)) - (np.cumsum(several) - several)[text]
                grams = w.grams(phrase)
                place = slide_argmin(grams, reach + 1)[begins]
                new = np.flatnonzero(np.diff(place, prepend=-1) | np.diff(text, prepend=-1))
                last = np.append(new[1:], len(begins)) - 1
                m, t = place[new], text[new]
                lo, hi = np.maximum(m - reach, w.edges[t]), np.minimum(m + min_words, w.edges[t + 1])
                context = mix64(_runs(w.hashes, lo, hi, _WORD_BASE) + ((m - lo) * (min_words + 1) + hi - m).astype(U64))
                owned = (np.int64(1) << (m - begins[new] + 1)) - (np.int64(1) << (m - begins[last]))
                which = pa.array(at + t)
                yield pa.RecordBatch.from_arrays([b.column(0).take(which), b.column(1).take(which), pa.array(grams[m].view(np.int64)), pa.array(context.view(np.int64)), pa.array(m - w.edges[t]), pa.array(owned)], names=["id", "h", "p", "c", "pos", "owned"])

    return rows.select("id", "h", "text").mapInArrow(freeing(winnowed), f"id {dict(rows.dtypes)['id']}, h long, p long, c long, pos long, owned long")


def _binaries(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """values[lo:hi] of each pair, as bytes."""
    ends = np.cumsum(hi - lo)
    flat = values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - np.append(0, ends[:-1]), hi - lo)]
    offsets = np.append(0, ends * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])


def contexts(rows: DataFrame, entries: DataFrame, min_words: int, phrase: int) -> DataFrame:
    """entries (p, c, lo, owned, id, h, pos) as seeds (g, p, c, lo, open, left, right): hashes of the words before an anchor,
    nearest first, and of those from it on; g is the group, and open the windows that aren't settled."""
    reach = min_words - phrase

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in pieces(b.column("text")):
                w = Words(data, offsets, lower=False)
                asked = b.column("asked").slice(at, len(offsets) - 1)
                t = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy())
                seeds = asked.flatten()
                pos = seeds.field("pos").to_numpy() + w.edges[t]
                right = _binaries(w.hashes, pos, np.minimum(pos + min_words, w.edges[t + 1]))
                n = len(w.hashes)
                left = _binaries(w.hashes[::-1], n - pos, n - np.maximum(pos - reach, w.edges[t]))
                for k in range(0, len(pos), 2000):
                    part = slice(k, min(k + 2000, len(pos)))
                    p = seeds.field("p")[part]
                    yield pa.RecordBatch.from_arrays([p, p, seeds.field("c")[part], seeds.field("lo")[part], seeds.field("owned")[part], left[part], right[part]], names=["g", "p", "c", "lo", "open", "left", "right"])

    asked = entries.groupBy("id", "h").agg(F.collect_list(F.struct("p", "c", "lo", "owned", "pos")).alias("asked"))
    found = rows.join(asked.hint("merge"), ["id", "h"]).select("text", "asked")
    return found.mapInArrow(freeing(spelled), f"g long, p long, c long, lo {dict(entries.dtypes)['lo']}, open long, left binary, right binary")


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of word hashes, filled up with zeros to the width, and how many each row has."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // 8
    data = np.append(np.frombuffer(data, U64) if data and data.size else np.empty(0, U64), np.zeros(1, U64))
    size = np.diff(offsets)
    there = np.arange(width) < size[:, None]
    return np.where(there, data[np.where(there, offsets[:-1, None] + np.arange(width), 0)], U64(0)), size


def extended(mine: pa.Array, theirs: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """How many first words the two share in each row, and the hash of the next word of mine (0 where it has none)."""
    (a, n), (b, m) = _matrix(mine, width), _matrix(theirs, width)
    inside = np.arange(width) < np.minimum(n, m)[:, None]
    same = np.concatenate([(a == b) & inside, np.zeros((len(n), 1), bool)], axis=1).argmin(axis=1)
    return same, np.where(same < n, a[np.arange(len(n)), np.minimum(same, width - 1)], U64(0))


def _bits(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Numbers with the bits low to high."""
    one = np.int64(1)
    return np.where(low <= high, (one << np.clip(high + 1, 0, 62)) - (one << np.clip(low, 0, 62)), 0)


def one_round(seeds: DataFrame, min_words: int, phrase: int) -> DataFrame:
    """Compares each seed with its group's leader. Rows without g are (p, c, open): windows that are found in a lesser document;
    the others are the seeds of the next round."""
    reach = min_words - phrase
    by = F.struct("lo", "p", "c")
    leaders = seeds.groupBy("g").agg(F.min("lo").alias("least"), F.max("lo").alias("most"), F.min_by(F.struct("left", "right"), by).alias("leader"))
    leaders = materialize(leaders.where("least < most").select("g", "least", F.col("leader.left").alias("their_left"), F.col("leader.right").alias("their_right")), "leaders")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ["p", "c", "lo", "left", "right"]
        names = ["g", "p", "c", "lo", "left", "right", "open"]
        for b in batches:
            l, left_word = extended(b.column("left"), b.column("their_left"), reach)
            r, right_word = extended(b.column("right"), b.column("their_right"), min_words)
            is_open, g = b.column("open").to_numpy(), b.column("g").to_numpy().view(U64)
            settled = is_open & _bits(min_words - r, l)
            beyond_left = is_open & _bits(l + 1, np.full(len(l), reach))
            beyond_right = is_open & ~settled & ~beyond_left
            later = b.column("later").to_numpy(zero_copy_only=False)  # the least document's other entries can still be the source of others
            for bits, group in ((np.where(later, settled, 0), None), (beyond_left, mix64(mix64(g + U64(1)) + (l.astype(U64) << U64(1))) ^ left_word), (beyond_right, mix64(mix64(g + U64(2)) + (r.astype(U64) << U64(1))) ^ right_word)):
                which = np.flatnonzero(bits)
                at = pa.array(which)
                columns = [b.column(c).take(at) for c in kept]
                if group is None:
                    columns[2:] = [pa.nulls(len(which), x.type) for x in columns[2:]]
                g_column = pa.nulls(len(which), pa.int64()) if group is None else pa.array(mix64(group[which]).view(np.int64))
                yield pa.RecordBatch.from_arrays([g_column, *columns, pa.array(bits[which])], names=names)

    met = seeds.join(leaders.hint("merge"), "g").withColumn("later", F.col("lo") > F.col("least"))
    schema = f"g long, p long, c long, lo {dict(seeds.dtypes)['lo']}, left binary, right binary, open long"
    found = materialize(met.mapInArrow(freeing(compared), schema), "round")
    discard(leaders)
    return found


def repeated_spans(rows: DataFrame, min_words: int = MIN_WORDS, phrase: int = PHRASE) -> DataFrame:
    """A written table (id, h, spans of (pos, bits)): bit j says that the window that begins j words before pos also is in a row of lesser id."""
    kept = materialize(anchors(rows, min_words, phrase), "anchors")
    # tables that are written, so that joins read plain exchanges, and a frequent phrase or passage can be dealt to several tasks
    shared = materialize(kept.groupBy("p").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("p"), "phrases")
    marked = materialize(kept.join(shared.hint("merge"), "p", "left_semi"), "marked")
    discard(kept, shared)
    entries = marked.groupBy("p", "c").agg(F.min(F.struct("id", "h", "pos")).alias("least"), F.max("id").alias("hi"), F.first("owned").alias("owned"))
    entries = materialize(entries.select("p", "c", F.col("least.id").alias("lo"), "hi", "owned", "least.id", "least.h", "least.pos"), "entries")
    contested = materialize(entries.groupBy("p").agg(F.min("lo").alias("a"), F.max("lo").alias("b")).where("a < b").select("p"), "contested")
    seeds = materialize(contexts(rows, entries.join(contested.hint("merge"), "p", "left_semi"), min_words, phrase), "seeds")
    rounds = [seeds]
    while not seeds.isEmpty():
        rounds.append(one_round(seeds, min_words, phrase))
        seeds = rounds[-1].where("g is not null")
    nothing = F.lit(0).cast("long")
    told = entries.select("p", "c", "lo", "hi", nothing.alias("bits"))
    for found in rounds[1:]:
        told = told.unionByName(found.where("g is null").select("p", "c", F.col("open").alias("bits")), allowMissingColumns=True)
    told = told.groupBy("p", "c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_or("bits").alias("bits")).where("lo < hi or bits <> 0")
    told = materialize(told.select("p", "c", "lo", "bits"), "told")
    discard(entries, contested, *rounds)
    bits = F.when(F.col("id") > F.col("lo"), F.col("owned")).otherwise(F.col("bits"))
    places = marked.join(told.hint("merge"), ["p", "c"]).select("id", "h", "pos", bits.alias("bits")).where("bits <> 0")
    spans = materialize(places.groupBy("id", "h").agg(F.collect_set(F.struct("pos", "bits")).alias("spans")), "spans")
    discard(marked, told)
    return spans


KEPT = T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])


def without_spans(min_words: int):
    """A function of texts and their spans: the words that are left, joined by spaces, and how many there were and went."""

    @F.arrow_udf(returnType=KEPT)
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        texts, n_words, n_removed = [], [], []
        for t, found in zip(text.cast(pa.large_binary()), spans, strict=True):
            words = (t.as_py() or b"").split()
            n_words.append(len(words))
            if found.is_valid:
                edges = np.zeros(len(words) + 1, np.int64)
                pos, bits = (found.values.field(k).to_numpy() for k in ("pos", "bits"))
                for j in range(int(bits.max()).bit_length()):
                    begins = pos[(bits >> j & 1) > 0] - j
                    np.add.at(edges, begins, 1)
                    np.subtract.at(edges, begins + min_words, 1)
                words = list(compress(words, np.cumsum(edges[:-1]) == 0))
            n_removed.append(n_words[-1] - len(words))
            texts.append(b" ".join(words))
        kept = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.StructArray.from_arrays([kept, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["kept", "n_words", "n_removed"])

    return cut


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, phrase: int = PHRASE) -> DataFrame:
    """docs with text_kept, n_words and n_removed: every word goes that is in min_words words of a row which also stand in a row of
    lesser key. min_words is 61 at most above the phrase."""
    if not 0 < phrase <= min_words <= phrase + 61:
        raise ValueError("0 < phrase <= min_words <= phrase + 61 is asked for")
    h = F.xxhash64(docs[text])
    rows = docs.where(docs[key].isNotNull() & docs[text].isNotNull()).select(docs[key].alias("id"), h.alias("h"), docs[text].alias("text"))
    spans = repeated_spans(rows, min_words, phrase)
    cut = fresh(docs, "cut")
    joined = docs.join(spans.hint("merge"), (docs[key] == spans["id"]) & (h == spans["h"]), "left")
    columns = others(docs, "text_kept", "n_words", "n_removed")
    made = joined.select(*columns, without_spans(min_words)(docs[text], spans["spans"]).alias(cut))
    names = [f"`{c}`" for c in made.columns[:-1]]
    return made.select(*names, F.col(f"{cut}.kept").alias("text_kept"), F.col(f"{cut}.n_words").alias("n_words"), F.col(f"{cut}.n_removed").alias("n_removed"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text_kept").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS u FROM documents
), windows AS (
  SELECT rid, doc_id, i, md5(array_to_string(u[i:i + 49], ' ')) AS k FROM split, unnest(range(1, len(u) - 48)) AS r(i)
), least AS (
  SELECT k, min(doc_id) AS m FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)
), hits AS (
  SELECT rid, i FROM windows JOIN least USING (k) WHERE m < doc_id
), words AS (
  SELECT rid, unnest(u) AS word, generate_subscripts(u, 1) AS i FROM split
), covered AS (
  SELECT w.rid, w.word, w.i, coalesce(w.i - max(h.i) OVER (PARTITION BY w.rid ORDER BY w.i) < 50, false) AS gone
  FROM words w LEFT JOIN hits h ON w.rid = h.rid AND w.i = h.i
), kept AS (
  SELECT rid, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS t FROM covered GROUP BY rid
)
SELECT doc_id, len(u)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (rid)
"""
