"""Dedup of repeated passages with a sparse suffix array.

Only the suffixes at minimisers are retained: of every window of ``min_words`` words, the place whose next ``phrase``
words hash lowest (the last of equal ones). Equal windows have theirs at the same offset, so that each window has one
suffix that stands for it, and about one word in fifteen begins one. A suffix is known by its context, the up to
min_words words from its place on (right) and the up to ``reach`` = min_words - phrase words before it (left).

1. Suffixes whose phrase occurs once have no neighbour and go. Equal contexts become one entry with a count.
2. Entries that share their phrase with others are range-partitioned and sorted by their words, right words first, and
   neighbours are compared word by word: their common right part, then their match extended to the left. The same is
   done in the order of the left words. Partitions hand over their first and last entry, so that no neighbours are missed.
3. A match of l words to the left and r to the right repeats the windows that begin j <= l words before the place, if
   min_words - j <= r. The longest common parts with any other entry are those with a neighbour, so windows that begin
   further left or end further right repeat nowhere. Those between, which none of the four neighbours settles (their left
   part is one entry's and their right part another's), are looked up among all entries of the phrase by their words.
4. Repeated windows become spans of each text.

No key is hot: a passage that a third of all documents share is one entry, and the entries at its edges, where each
document goes on in its own way, are spread over partitions by their order. Memory is bounded by a batch and the longest text.

Words are runs of other characters than space and tab to carriage return; A-Z are lower-cased. Defined cases: a null
text has no words; an empty table gives no rows. With ``every`` each place of a passage counts, be it in the same document
or in a row of null or equal id. Without it rows without an id are left out, rows that share an id are one document, and
a passage that only one document repeats isn't reported.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, freeing, materialize, table
from .words import _WORD_BASE, LONG, U64, Words, _runs, mix64, pieces

MIN_WORDS, PHRASE = 50, 20


def slide_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """The place of the minimum of each run of width values, the last of equal ones."""
    at, span = np.arange(len(x)), 1
    if len(x) < width:
        return at[:0]
    while 2 * span <= width:
        a, b = at[:-span], at[span:]
        at, span = np.where(x[b] <= x[a], b, a), 2 * span
    if rest := width - span:
        a, b = at[: len(at) - rest], at[rest:]
        at = np.where(x[b] <= x[a], b, a)
    return at


def suffixes(docs: DataFrame, min_words: int = MIN_WORDS, phrase: int = PHRASE) -> DataFrame:
    """(id, row, p, c, pos, owned) of each retained suffix of docs (id, row, text): the hashes of its phrase and of its
    context, the word it begins at, and the windows it stands for: bit j for the window that begins j words before it."""
    reach = min_words - phrase

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in pieces(b.column(2)):
                w = Words(data, offsets)
                grams = w.grams(phrase)
                least = slide_argmin(grams, reach + 1)
                begins = np.concatenate([np.arange(lo, hi - min_words + 1) for lo, hi in zip(w.edges[:-1], w.edges[1:], strict=True)])
                if not len(begins):
                    continue
                at_place = least[begins]
                text = np.searchsorted(w.edges, begins, "right") - 1
                new = np.flatnonzero(np.diff(at_place, prepend=-1) | np.diff(text, prepend=-1))
                last = np.append(new[1:], len(begins)) - 1
                m, t = at_place[new], text[new]
                far, near = m - begins[new], m - begins[last]
                lo, hi = np.maximum(m - reach, w.edges[t]), np.minimum(m + min_words, w.edges[t + 1])
                context = mix64(_runs(w.hashes, lo, hi, _WORD_BASE) + ((m - lo) * (min_words + 1) + hi - m).astype(U64))
                own = (np.int64(1) << (far + 1)) - (np.int64(1) << near)
                which = pa.array(at + t)
                yield pa.RecordBatch.from_arrays([b.column(0).take(which), b.column(1).take(which), pa.array(grams[m].view(np.int64)), pa.array(context.view(np.int64)), pa.array(m - w.edges[t]), pa.array(own)], names=["id", "row", "p", "c", "pos", "owned"])

    kinds = dict(docs.dtypes)
    return docs.select("id", "row", "text").mapInArrow(freeing(kept), f"id {kinds['id']}, row {kinds['row']}, p long, c long, pos long, owned long")


def _spelled(part: bytes) -> list[bytes]:
    """Words; very long ones by their hash, so that contexts stay small."""
    return [w if len(w) <= LONG else b"\0" + xxhash.xxh3_128_hexdigest(w).encode() for w in part.split()]


def contexts(docs: DataFrame, entries: DataFrame, min_words: int, phrase: int) -> DataFrame:
    """entries (p, c, ..., row, pos) with their words: right, and left from right to left; each ends in a space."""
    reach = min_words - phrase
    given = [c for c in entries.columns if c not in ("row", "pos")]

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in pieces(b.column("text")):
                w = Words(data, offsets)
                low = bytes(data).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
                for t in range(len(offsets) - 1):
                    asked = b.column("asked").slice(at + t, 1).flatten()
                    right, left = [], []
                    lo, hi = w.edges[t], w.edges[t + 1]
                    for pos in asked.field("pos").to_numpy() + lo:
                        right.append(b"".join(x + b" " for x in _spelled(low[w.starts[pos] : w.ends[min(pos + min_words, hi) - 1]])).decode())
                        first = max(pos - reach, lo)
                        left.append(b"".join(x + b" " for x in _spelled(low[w.starts[first] : w.starts[pos]])[::-1]).decode())
                    for k in range(0, len(asked), 2000):
                        yield pa.RecordBatch.from_arrays([*(asked.field(c).slice(k, 2000) for c in given), pa.array(right[k : k + 2000], pa.string()), pa.array(left[k : k + 2000], pa.string())], names=[*given, "right", "left"])

    asked = entries.groupBy("row").agg(F.collect_list(F.struct(*given, "pos")).alias("asked"))
    schema = ", ".join(f"{c} {kind}" for c, kind in entries.select(given).dtypes)
    return docs.select("row", "text").join(asked.hint("merge"), "row").select("text", "asked").mapInArrow(freeing(spelled), f"{schema}, right string, left string")


def common(a: str, b: str) -> int:
    """The number of first words that a and b share."""
    n = 0
    for x, y in zip(a.split(" ")[:-1], b.split(" ")[:-1], strict=False):
        if x != y:
            break
        n += 1
    return n


class Neighbours:
    """Compares entries that come in order: what each shares with the one before and the one after it."""

    names = ("p", "c", "bits", "most_right", "most_left", "lo", "hi")

    def __init__(self, by: str, min_words: int, reach: int, every: bool) -> None:
        self.by, self.min_words, self.reach, self.every = by, min_words, reach, every
        self.first = self.last = None
        self.done: list[tuple] = []
        self.state: list = []

    def add(self, entry: tuple) -> None:
        """entry: p, c, lo, hi, right, left"""
        before, self.last = self.last, entry
        if before is None:
            self.first = entry
        elif before[:2] == entry[:2]:  # one entry from two equal rows
            return
        state, old = [0, 0, 0, entry[2], entry[3]], self.state
        if before and before[0] == entry[0]:
            r, l = common(before[4], entry[4]), common(before[5], entry[5])
            ids = [x for x in (before[2], before[3], entry[2], entry[3]) if x is not None]
            if self.every or min(ids) < max(ids):
                a, b = max(0, self.min_words - r), min(l, self.reach)
                bits = (1 << (b + 1)) - (1 << a) if a <= b else 0
            else:
                bits = 0
            for s in (old, state):
                s[1 if self.by == "right" else 2] = max(s[1 if self.by == "right" else 2], r if self.by == "right" else l)
                if bits:
                    s[0] |= bits
                    s[3], s[4] = min(ids, default=None), max(ids, default=None)
        if before:
            self.done.append((*before[:2], *old))
        self.state = state

    def close(self) -> None:
        if self.last:
            self.done.append((*self.last[:2], *self.state))

    def taken(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def compared(words: DataFrame, by: str, min_words: int, phrase: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """The table written, and from it (p, c, bits, most_right, most_left, lo, hi): for each entry, the windows that its neighbours in the order of its right
    or left words repeat, the most words that another entry shares on that side, and the least and greatest id of those."""
    reach = min_words - phrase
    given = ["p", "c", "lo", "hi", "right", "left"]
    id_kind = dict(words.dtypes)["lo"]
    schema = f"p long, c long, bits long, most_right int, most_left int, lo {id_kind}, hi {id_kind}"

    def batch(rows: list[tuple], kinds: list[pa.DataType], names: tuple[str, ...]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch], seams: bool) -> Iterator[pa.RecordBatch]:
        n, task = Neighbours(by, min_words, reach, every), TaskContext.get().partitionId()
        kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()], (*Neighbours.names, "edge", "right", "left")
        none = (None, None, None)
        for b in batches:
            kinds = [*kinds[:5], b.schema.field("lo").type, b.schema.field("lo").type, pa.int64(), pa.string(), pa.string()]
            for entry in zip(*(b.column(c).to_pylist() for c in given), strict=True):
                n.add(entry)
            yield batch([(*x, *none) for x in n.taken()], kinds, names).select(names if seams else Neighbours.names)
        if n.last:
            n.close()
            ends = [(x[0], x[1], 0, 0, 0, x[2], x[3], 2 * task + k, x[4], x[5]) for k, x in enumerate((n.first, n.last))] if seams else []
            yield batch([*((*x, *none) for x in n.taken()), *ends], kinds, names).select(names if seams else Neighbours.names)

    inner: Callable = lambda batches: run(batches, True)
    outer: Callable = lambda batches: run(batches, False)
    order = [F.col("right"), F.col("left")] if by == "right" else [F.substring_index("right", " ", phrase), F.col("left"), F.col("right")]
    parts = words.select(given).repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialize(parts.mapInArrow(inner, f"{schema}, edge long, right string, left string"), f"by-{by}")
    # the ends of the partitions in their order, two rows each
    ends = found.where("edge is not null").select("edge", *given).coalesce(1).sortWithinPartitions("edge").select(given)
    seams = ends.mapInArrow(outer, schema)
    return found, found.where("edge is null").select(list(Neighbours.names)).unionByName(seams)


def _bits(low: Column, high: Column) -> Column:
    """A number with the bits low to high."""
    one = F.lit(1).cast("long")
    return F.when(low <= high, F.call_function("shiftleft", one, high + 1) - F.call_function("shiftleft", one, low)).otherwise(0)


def windows(words: DataFrame, asked: DataFrame, min_words: int) -> DataFrame:
    """(p, c, lo, hi, j, key_a, key_b) of the windows of entries that asked (p, c, bits) names; the keys are of their words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, levels, texts = [], [], []
            for i, (right, left, bits) in enumerate(zip(b.column("right").to_pylist(), b.column("left").to_pylist(), b.column("bits").to_pylist(), strict=True)):
                r, l = right.split(" ")[:-1], left.split(" ")[:-1]
                for j in range(len(l) + 1):
                    if bits >> j & 1:
                        which.append(i)
                        levels.append(j)
                        texts.append(" ".join([*l[:j][::-1], *r[: min_words - j]]))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(which, pa.int64())) for c in ("p", "c", "lo", "hi")), pa.array(levels, pa.int32()), pa.array(texts, pa.string())], names=["p", "c", "lo", "hi", "j", "window"])

    kind = dict(words.dtypes)["lo"]
    found = words.select("p", "c", "lo", "hi", "right", "left").join(asked.hint("merge"), ["p", "c"]).mapInArrow(freeing(cut), f"p long, c long, lo {kind}, hi {kind}, j int, window string")
    return found.select("p", "c", "lo", "hi", "j", F.xxhash64("window").alias("key_a"), F.xxhash64(F.lit("passage"), "window").alias("key_b"))


def repeated_windows(rows: DataFrame, marked: DataFrame, min_words: int, phrase: int, every: bool) -> DataFrame:
    """A written table (p, c, bits, lo, hi): the windows of each context that are repeated, and the least and greatest id of rows with them."""
    several = F.lit(True) if every else F.col("lo") < F.col("hi")
    entries = marked.groupBy("p", "c").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.first("owned").alias("owned"), F.first("row").alias("row"), F.first("pos").alias("pos"))
    entries = materialize(entries.withColumn("bits", F.when((F.col("n") > 1) & several, F.col("owned")).otherwise(0)).drop("n"), "entries")
    contested = materialize(entries.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("p"), "contested")
    words = materialize(contexts(rows, entries.join(contested.hint("merge"), "p", "left_semi"), min_words, phrase), "contexts")
    (right, by_right), (left, by_left) = (compared(words, by, min_words, phrase, every) for by in ("right", "left"))
    zero = F.lit(0).cast("int")
    own = words.select("p", "c", "bits", zero.alias("most_right"), zero.alias("most_left"), "lo", "hi", "owned")
    told = own.unionByName(by_right, True).unionByName(by_left, True)
    told = told.groupBy("p", "c").agg(F.bit_or("bits").alias("bits"), F.max("most_right").alias("r"), F.max("most_left").alias("l"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("owned").alias("owned"))
    may = _bits(F.greatest(F.lit(0), min_words - F.col("r")), F.least(F.lit(min_words - phrase), F.col("l")))
    told = told.withColumn("bits", F.col("bits").bitwiseAND(F.col("owned"))).withColumn("may", may.bitwiseAND(F.col("owned")))
    told = materialize(told.withColumn("open", F.col("may").bitwiseAND(F.bitwise_not("bits"))), "told")
    discard(right, left)
    # windows that no neighbour settles: look at those of all entries of the phrase
    unsettled = materialize(told.groupBy("p").agg(F.bit_or("open").alias("open_p")).where("open_p <> 0"), "unsettled")
    asked = told.join(unsettled.hint("merge"), "p").select("p", "c", "open", F.col("may").bitwiseAND(F.col("open_p")).alias("bits")).where("bits <> 0")
    looked = materialize(windows(words, asked.select("p", "c", "bits"), min_words), "windows")
    met = looked.groupBy("key_a", "key_b").agg(F.min("c").alias("c_lo"), F.max("c").alias("c_hi"), F.min("lo").alias("w_lo"), F.max("hi").alias("w_hi"))
    met = met.where("c_lo < c_hi" if every else "w_lo < w_hi").select("key_a", "key_b", "w_lo", "w_hi")
    more = looked.join(met.hint("merge"), ["key_a", "key_b"]).select("p", "c", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j")).alias("bits"), F.col("w_lo").alias("lo"), F.col("w_hi").alias("hi"))
    names = ["p", "c", "bits", "lo", "hi"]
    all_told = entries.select(names).unionByName(told.select(names)).unionByName(more)
    found = all_told.groupBy("p", "c").agg(F.bit_or("bits").alias("bits"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("bits <> 0")
    found = materialize(found, "repeated-windows")
    discard(entries, contested, words, told, unsettled, looked)
    return found


def spans_of(found: DataFrame, min_words: int) -> DataFrame:
    """(id, start_word, end_word, other) of found (id, places of pos, bits, lo, hi): the windows of a row, merged."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, begins, ends, others = [], [], [], []
            for i, (own, places) in enumerate(zip(b.column("id").to_pylist(), b.column("places").to_pylist(), strict=True)):
                begin = end = other = None
                for p in sorted(places, key=lambda p: p["pos"]):
                    ids = [x for x in (p["lo"], p["hi"]) if x is not None]
                    theirs = next((x for x in ids if x != own), ids[0] if ids else None)
                    for j in range(p["bits"].bit_length() - 1, -1, -1):
                        if p["bits"] >> j & 1:
                            s = p["pos"] - j
                            if end is not None and s >= end:
                                which.append(i), begins.append(begin), ends.append(end), others.append(other)
                                end = None
                            if end is None:
                                begin, end, other = s, s + min_words, theirs
                            end = max(end, s + min_words)
                            if theirs is not None and (other is None or other == own or theirs != own and theirs < other):
                                other = theirs
                if end is not None:
                    which.append(i), begins.append(begin), ends.append(end), others.append(other)
            ids = b.column("id")
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(which, pa.int64())), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), pa.array(others, ids.type)], names=["id", "start_word", "end_word", "other"])

    kind = dict(found.dtypes)["id"]
    return found.mapInArrow(freeing(merged), f"id {kind}, start_word long, end_word long, other {kind}")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, phrase: int = PHRASE, every: bool = False) -> DataFrame:
    """One row for each maximal span of a document whose every word lies in min_words words that another document holds
    too: key, start_word, end_word (exclusive), n_words (long) and other (the key of another such document). With every,
    all places count: those in the same document (other is its own key if no other document has the words) and those in
    rows of null or equal keys, whose spans come for each text (equal rows once; other is null if only they have the words).
    min_words is 62 at most above the phrase."""
    if not 0 < phrase <= min_words <= phrase + 61:
        raise ValueError("0 < phrase <= min_words <= phrase + 61 is asked for")
    row = F.xxhash64(docs[key], docs[text]) if every else docs[key]  # that two rows clash in this hash only merges their spans
    rows = (docs if every else docs.where(docs[key].isNotNull())).select(docs[key].alias("id"), row.alias("row"), docs[text].alias("text"))
    kept = materialize(suffixes(rows, min_words, phrase), "suffixes")
    # written, so that the join reads two plain exchanges, and a frequent phrase can be dealt to several tasks
    again = materialize(kept.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("p"), "phrases")
    marked = materialize(kept.join(again.hint("merge"), "p", "left_semi"), "marked")
    discard(kept, again)
    found = repeated_windows(rows, marked, min_words, phrase, every)
    places = marked.select("id", "row", "p", "c", "pos").join(found.hint("merge"), ["p", "c"])
    places = places.groupBy("id", "row").agg(F.collect_set(F.struct("pos", "bits", "lo", "hi")).alias("places")).select("id", "places")
    spans = spans_of(places, min_words)
    return spans.select(F.col("id").alias(key), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), every=True)
