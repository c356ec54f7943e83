"""MinHash near-dedup by fast similarity sketching.

A document is the set of its word shingles. Fast similarity sketching fills ``bands * rows`` coordinates: in a round
each element is hashed to one bin and a value; a bin keeps the least value of the first round that reached it, and
after as many rounds as there are bins, the rounds that follow throw all elements at one bin each, so that every
coordinate is filled. Two sets agree in a coordinate with the probability of their Jaccard similarity, and because one
round spreads one set over many bins, the share of equal coordinates is concentrated more closely than with independent hashes.

With 52 bands of 6 rows a pair at similarity 0.8 shares no band with probability 2e-7 (1e-7 of those at 0.82). Candidates
aren't paired with each other. Each bucket of a band has one leader, its set with the most company over all bands (in a
group of near copies that is the text they come from), and each set is compared with its leaders on full sets. Sets that
aren't in their leader's component after that are strays. Let d(x) be the elements in which x and leader l differ: sets x
and y are linked if |d(x)| + |d(y)| - 2 |d(x) & d(y)| <= f (|x| + |y|), f = 1/9 at 0.8, which is exact and needs those few
elements only. Strays are compared with the leader's other sets in blocks, of which a task holds two, and only links
leave it. So no link of a bucket between two components is lost, a set costs a comparison with each of its leaders, and
a stray one of differences with each of its leader's sets.
Joins of tables that grow with the documents ask for a merge, as a broadcast fits small inputs only.

Equal sets are one class throughout (by 128 bits of hash), so that exact copies cost one row each.

Defined cases: a null or blank text is empty, linked with nothing; a text of fewer words than a shingle has its whole
sequence as its one shingle; a null id is linked to others but never gives a component its id (without other ids the
component is null and the row is kept); rows that share an id are kept or dropped together; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import content_key, discard, freeing, materialize, table
from .words import _WORD_BASE, U64, Words, _runs, mix64, pieces

BANDS, ROWS = 52, 6
#: Sets of one leader that a task compares.
SPLIT = 512
KINDS = (0xD6E8FEB86659FD93, 0x9E6C63D0876A9A47)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offsets in pieces(column):
        w = Words(data, offsets)
        grams = w.grams(words)
        for lo, hi in zip(w.edges[:-1], w.edges[1:], strict=True):
            if hi - lo >= words:
                yield np.unique(grams[lo : hi - words + 1])
            elif hi > lo:
                yield mix64(_runs(w.hashes[lo:hi], np.array([0]), np.array([hi - lo]), _WORD_BASE) + U64(hi - lo))
            else:
                yield np.empty(0, U64)


def sketch(values: np.ndarray, size: int) -> np.ndarray:
    """The fast similarity sketch of a set of 64-bit hashes that isn't empty."""
    out = np.full(size, np.iinfo(np.uint64).max, U64)
    at, step = 0, max(1, math.ceil(1.2 * size * math.log(size + 1) / len(values)))
    while at < 2 * size:
        to = min(at + step, size if at < size else 2 * size)
        rounds = np.arange(at, to, dtype=U64)
        h = mix64(values[None, :] ^ mix64(rounds + U64(0x5851F42D4C957F2D))[:, None])
        free = (h >> U64(32)) * U64(size) >> U64(32)
        bins = free if at < size else np.broadcast_to((rounds - U64(size))[:, None], h.shape)
        np.minimum.at(out, bins.ravel().astype(np.intp), (rounds[:, None] << U64(32) | (h & U64(0xFFFFFFFF))).ravel())
        if out.max() < np.iinfo(np.uint64).max:
            break
        at = to
    return out


def band_hashes(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of each sketch; the band's number is part of it."""
    parts = sketches.reshape(len(sketches), bands, rows)
    h = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=U64)), parts.shape[:2])
    for r in range(rows):
        h = mix64(h ^ parts[:, :, r])
    return h


def sketch_table(docs: DataFrame, key: str, text: str, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(rid, id, key_a, key_b, class_a, class_b, n, bands): a number of the row, the text's content key, that of its
    shingle set, the set's size, and its band hashes (none for an empty set)."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = list(shingle_sets(part.column("text"), words))
                n = np.array([len(s) for s in sets], np.int64)
                kinds = [pa.array(np.array([int(mix64(s ^ U64(k)).sum(dtype=U64)) for s in sets], U64).view(np.int64)) for k in KINDS]
                full = np.array([sketch(s, bands * rows) for s in sets if len(s)], U64).reshape(-1, bands * rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * bands)]), pa.int32()), pa.array(band_hashes(full, bands, rows).ravel().view(np.int64)))
                given = ["rid", "id", "key_a", "key_b"]
                yield pa.RecordBatch.from_arrays([*map(part.column, given), *kinds, pa.array(n), lists], names=[*given, "class_a", "class_b", "n", "bands"])

    kind = dict(docs.dtypes)[key]
    asked = docs.select(F.monotonically_increasing_id().alias("rid"), docs[key].alias("id"), docs[text].alias("text"), *content_key(docs[text]))
    return asked.mapInArrow(freeing(sketched), f"rid long, id {kind}, key_a long, key_b long, class_a long, class_b long, n long, bands array<bigint>")


def class_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(class, shingles) of the wanted (class, id, key_a, key_b): of the row that has this id and content."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = list(shingle_sets(part.column(1), words))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["class", "shingles"])

    theirs = docs.select(docs[key].alias("id"), docs[text].alias("text"), *content_key(docs[text]))
    named = theirs.where("id is not null").join(wanted.hint("merge"), ["id", "key_a", "key_b"]).select("class", "text")
    unnamed = theirs.where("id is null").drop("id").join(wanted.where("id is null").drop("id").hint("merge"), ["key_a", "key_b"])
    unnamed = unnamed.groupBy("class").agg(F.first("text").alias("text"))
    return materialize(named.unionByName(unnamed).mapInArrow(freeing(listed), "class long, shingles array<bigint>"), "shingle-sets")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with of_a and of_b, their shingles. A set b in many pairs is sent to as many tasks as it needs."""
    often = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("parts"))
    dealt = pairs.join(often.hint("merge"), "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    with_a = dealt.hint("merge").join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("of_a")), "a")
    spread = sets.join(often.hint("merge"), sets["class"] == often["b"]).select("b", F.col("shingles").alias("of_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return with_a.join(spread.hint("merge"), ["b", "part"]).drop("part")


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with both (elements in both sets), n_a and n_b."""
    counted = _with_sets(pairs, sets).select("a", "b", F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("both"), F.size("of_a").cast("long").alias("n_a"), F.size("of_b").cast("long").alias("n_b"))
    return materialize(counted.distinct(), "compared")


def crowded_buckets(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """(h, class, n): the classes of each bucket that holds several, and how many."""
    first = sketches.join(classes.select(F.col("class").alias("rid")).hint("merge"), "rid", "left_semi")
    entries = first.select(F.col("rid").alias("class"), F.explode("bands").alias("h"))
    return materialize(entries.join(entries.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").hint("merge"), "h").select("h", "class", "n"), "buckets")


def stars(crowded: DataFrame) -> DataFrame:
    """(a, b): each class with the leaders b of its buckets."""
    company = crowded.groupBy("class").agg(F.sum("n").alias("company"))
    leaders = crowded.join(company.hint("merge"), "class").groupBy("h").agg(F.max(F.struct("company", "class")).alias("top"))
    led = crowded.join(leaders.hint("merge"), "h").select(F.col("class").alias("a"), F.col("top.class").alias("b"))
    return materialize(led.where("a <> b").distinct(), "stars")


def strayed(compared: DataFrame, root: DataFrame) -> DataFrame:
    """(a, b, root_a, stray) of the leaders b whose sets lie in several components, some of them not in b's."""
    rooted = _rooted(_rooted(compared.select("a", "b"), root, "a"), root, "b")
    rooted = rooted.withColumn("stray", F.col("root_a") != F.col("root_b"))
    mixed = rooted.groupBy("b").agg(F.max("stray").alias("any"), F.min("root_a").alias("least"), F.max("root_a").alias("most"))
    return rooted.join(mixed.where("any and least < most").select("b").hint("merge"), "b", "left_semi").select("a", "b", "root_a", "stray")


def stray_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the links between a leader's strays and its sets of other components. Blocks of strays are compared with blocks of
    sets, by what they differ in from the leader; a task holds one block of each, and only links leave it."""
    near, far = 100 + percent, 100 - percent  # f is far / near
    differ = F.concat(F.array_except("of_a", "of_b"), F.array_except("of_b", "of_a"))
    d = materialize(_with_sets(members, sets).select("b", "a", "root_a", "stray", F.size("of_a").cast("long").alias("n"), differ.alias("d")), "differences")
    blocks = d.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("parts"), F.ceil(F.count_if("stray") / SPLIT).cast("int").alias("stray_parts"))
    dealt = d.join(blocks.hint("merge"), "b")
    block = lambda parts: F.pmod(F.xxhash64("a"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    cells = dealt.select("*", block("parts").alias("x"), every("stray_parts").alias("y"), F.lit(False).alias("asks"))
    cells = cells.unionByName(dealt.where("stray").select("*", every("parts").alias("x"), block("stray_parts").alias("y"), F.lit(True).alias("asks")))

    def compared(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        a, root, n = (cell.column(c).to_numpy() for c in ("a", "root_a", "n"))
        asks, lists = cell.column("asks").to_numpy(zero_copy_only=False), cell.column("d").combine_chunks()
        nd, values = np.diff(lists.offsets.to_numpy()), lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
        row = np.repeat(np.arange(len(a)), nd)
        held = ~asks[row]
        order = np.argsort(values[held], kind="stable")
        known, where = values[held][order], row[held][order]
        out = []
        begins = np.cumsum(nd) - nd
        for i in np.flatnonzero(asks):
            own = values[begins[i] : begins[i] + nd[i]]
            lo, hi = np.searchsorted(known, own), np.searchsorted(known, own, "right")
            at = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())
            shared = np.bincount(where[at], minlength=len(a))
            linked = (2 * near * shared >= near * (nd[i] + nd) - far * (n[i] + n)) & ~asks & (root != root[i])
            out += [(max(a[i], a[k]), min(a[i], a[k])) for k in np.flatnonzero(linked)]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    found = materialize(cells.select("b", "x", "y", "a", "root_a", "n", "d", "asks").groupBy("b", "x", "y").applyInArrow(compared, "a long, b long").distinct(), "stray-links")
    discard(d)
    return found


def near_links(sketches: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int = 80) -> DataFrame:
    """Links (a, b) between classes that connect all classes whose sets are similar enough."""
    linked = F.col("both") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    crowded = crowded_buckets(sketches, classes)
    led = stars(crowded)
    discard(crowded)
    named = led.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    wanted = sketches.join(named.hint("merge"), "rid", "left_semi").select(F.col("rid").alias("class"), "id", "key_a", "key_b")
    sets = class_sets(docs, wanted, key, text, words)
    compared = _compare(led, sets)
    discard(led)
    links = materialize(compared.where(linked).select("a", "b"), "star-links")
    # a set that isn't in the component of its leader may still be linked to another set that has the leader
    root = components(links, "a", "b")
    members = materialize(strayed(compared, root), "strayed")
    discard(compared, root)
    more = stray_links(members, sets, percent)
    discard(members, sets)
    both = materialize(links.unionByName(more), "near-links")
    discard(links, more)
    return both


def _rooted(rows: DataFrame, root: DataFrame, column: str) -> DataFrame:
    """rows with root_<column>, the root of the component of a class."""
    of = root.select(F.col("node").alias(column), F.col("root").alias(f"root_{column}"))
    return rows.join(of.hint("merge"), column, "left").withColumn(f"root_{column}", F.coalesce(f"root_{column}", column))


def _resolved(docs: DataFrame, key: str, text: str, words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """A written table: id, key_a, key_b, n, component_id, kept for each row of docs."""
    sketches = materialize(sketch_table(docs, key, text, words, bands, rows), "sketches")
    same = ["class_a", "class_b"]
    classes = materialize(sketches.where("n > 0").groupBy(*same).agg(F.min("rid").alias("class"), F.min("id").alias("least")), "classes")
    links = near_links(sketches, classes, docs, key, text, words, percent)
    roots = components(links, "a", "b")
    grouped = _rooted(classes, roots, "class")
    whole = grouped.join(grouped.groupBy("root_class").agg(F.min("least").alias("component_id")).hint("merge"), "root_class").select(*same, "component_id")
    out = sketches.select("id", "key_a", "key_b", *same, "n").join(whole.hint("merge"), same, "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    out = materialize(out.select("id", "key_a", "key_b", "n", component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept")), "resolved")
    discard(sketches, classes, links, roots)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each row of docs: key, n_shingles, component_id (the least key that links reach) and kept (it has that key)."""
    found = _resolved(docs, key, text, words, percent, bands, rows)
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", "kept")


def dedup_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs without those that aren't kept; the columns are those of docs."""
    gone = _resolved(docs, key, text, words, percent, bands, rows).where(~F.col("kept"))
    gone = gone.select("id", "key_a", "key_b").distinct()
    key_a, key_b = content_key(docs[text])
    return docs.join(gone.hint("merge"), docs[key].eqNullSafe(gone["id"]) & (key_a == gone["key_a"]) & (key_b == gone["key_b"]), "left_anti")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2)
