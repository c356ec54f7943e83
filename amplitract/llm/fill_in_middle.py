"""Fill-in-middle transformation by overlapping chunks.

A text is cut, at two ranks drawn from its id, into prefix, middle and suffix of whole tokens; a token is white space with
the word after it, or the white space at the end. Where a token ends is a predicate on two adjacent characters, so it needs
no scan from the left: texts are laid out in chunks that overlap by the one byte which the predicate of a chunk's last
byte looks at. Each chunk counts the tokens that end in it and its characters; prefix sums over the chunks give the number of
tokens and say which chunk owns each cut rank, and the owning chunks alone are scanned again for the place.

White space is ASCII, so bytes of UTF-8 serve as characters. Chunks of all texts of an Arrow batch are counted together, at
most SLAB bytes at a time: a text of any length takes a few numbers a chunk beside itself. Only the text goes to Python and
only numbers come back; the parts are put together in the JVM. Nothing is shuffled.

Defined cases: a null text is empty; an empty text, and one that holds a sentinel, stay plain; a null id draws as the
empty string, so that rows of equal ids draw alike; extra columns pass through, and columns with the names of results are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, others, table
from .words import _SPACE, pieces

#: What marks the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
CHUNK, SLAB = 4096, 1 << 20
CUTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "prefix_chars", "middle_chars")])


def _token_ends(data: np.ndarray, lo: int, hi: int, stops: np.ndarray) -> np.ndarray:
    """Whether a token ends with each byte from lo to hi: a word's last byte before white space, or a text's last byte."""
    space = _SPACE[data[lo : hi + 1]]
    ends = np.zeros(hi - lo, bool)
    ends[: len(space) - 1] = ~space[:-1] & space[1:]
    ends[stops[np.searchsorted(stops, lo, "right") : np.searchsorted(stops, hi, "right")] - 1 - lo] = True
    return ends


def _starts_character(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


class Chunks:
    """The chunks of some texts with their counts: chunk c covers bytes begins[c]:begins[c + 1], text t has chunks first[t]:first[t + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK, slab: int = SLAB) -> None:
        self.data, self.stops = data, offsets[1:]
        each = -(-np.diff(offsets) // chunk)
        self.first = np.concatenate([[0], np.cumsum(each)])
        of_text = np.repeat(np.arange(len(each)), each)
        self.begins = np.append(offsets[of_text] + (np.arange(len(of_text)) - self.first[of_text]) * chunk, offsets[-1])
        tokens, characters = np.zeros(len(of_text), np.int64), np.zeros(len(of_text), np.int64)
        at = 0
        while at < len(of_text):
            to = max(at + 1, int(np.searchsorted(self.begins, self.begins[at] + slab, "right")) - 1)
            lo, hi = self.begins[at], self.begins[to]
            cuts = self.begins[at:to] - lo
            tokens[at:to] = np.add.reduceat(_token_ends(data, lo, hi, self.stops).view(np.uint8), cuts, dtype=np.int64)
            characters[at:to] = np.add.reduceat(_starts_character(data[lo:hi]).view(np.uint8), cuts, dtype=np.int64)
            at = to
        self.tokens, self.characters = (np.concatenate([[0], np.cumsum(x)]) for x in (tokens, characters))
        self.n = self.tokens[self.first[1:]] - self.tokens[self.first[:-1]]

    def characters_of(self, ranks: np.ndarray) -> np.ndarray:
        """For each text: the characters of its first ranks[t] tokens."""
        found = np.zeros(len(ranks), np.int64)
        asked = np.flatnonzero(ranks > 0)
        goal = self.tokens[self.first[asked]] + ranks[asked]
        owner = np.searchsorted(self.tokens, goal, "left") - 1
        for t, c, k in zip(asked, owner, goal - self.tokens[owner], strict=True):
            lo, hi = self.begins[c], self.begins[c + 1]
            last = np.flatnonzero(_token_ends(self.data, lo, hi, self.stops))[k - 1]
            found[t] = self.characters[c] - self.characters[self.first[t]] + np.count_nonzero(_starts_character(self.data[lo : lo + last + 1]))
        return found


@F.arrow_udf(returnType=CUTS)
def token_cuts(text: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    """The number of tokens of each text, and the characters before and between its cuts, after one % (n + 1) and other % (n + 1) tokens."""
    one, other = (np.asarray(x.cast(pa.int64())) for x in (one, other))
    found = []
    for at, data, offsets in pieces(text):
        chunks = Chunks(data, offsets)
        drawn = [x[at : at + len(chunks.n)] % (chunks.n + 1) for x in (one, other)]
        before, upto = (chunks.characters_of(f(*drawn)) for f in (np.minimum, np.maximum))
        found.append((chunks.n, before, upto - before))
    parts = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.empty(0, np.int64)] * 3
    return pa.StructArray.from_arrays([pa.array(x) for x in parts], names=["n", "prefix_chars", "middle_chars"])


def draws(key: Column, seed: int, count: int) -> list[Column]:
    """The first 32-bit numbers of the hash of the seed and a row's key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs with n (tokens), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and fim_text.

    fim_percent percent of the texts are rearranged, spm_percent of those with the suffix first."""
    if len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are asked for")
    whole, cut = F.coalesce(docs[text], F.lit("")), fresh(docs, "cut")
    h1, h2, h3, h4 = draws(docs[key], seed, 4)
    stays = (whole == "") | (h3 % 100 >= fim_percent)
    for s in sentinels:
        stays |= F.contains(whole, F.lit(s))
    form = F.when(stays, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    kept = others(docs, "n", "form", "prefix_chars", "middle_chars", "fim_text")
    new, whole_as, form_as = fresh(docs, "new"), fresh(docs, "whole"), fresh(docs, "form_of")
    given = docs.select(F.struct(*kept).alias(new), whole.alias(whole_as), form.alias(form_as), token_cuts(whole, h1, h2).alias(cut))
    before, middle = F.col(f"{cut}.prefix_chars"), F.col(f"{cut}.middle_chars")
    text_of, is_plain = F.col(whole_as), F.col(form_as) == "plain"
    prefix, mid = text_of.substr(F.lit(1), before.cast("int")), text_of.substr((before + 1).cast("int"), middle.cast("int"))
    suffix = text_of.substr((before + middle + 1).cast("int"), F.length(text_of))
    p, s, m = (F.lit(x) for x in sentinels)
    out = F.when(is_plain, text_of).when(F.col(form_as) == "spm", F.concat(s, suffix, p, prefix, m, mid)).otherwise(F.concat(p, prefix, s, suffix, m, mid))
    return given.select(f"{new}.*", F.col(f"{cut}.n").alias("n"), F.col(form_as).alias("form"), F.when(~is_plain, before).alias("prefix_chars"), F.when(~is_plain, middle).alias("middle_chars"), out.alias("fim_text"))


def restored(fim_text: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that fill_in_middle had, from what it made and its form."""
    parts = F.split(fim_text, "|".join(re.escape(s) for s in sentinels), -1)
    first, second, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(fim_text)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("fim_text")).alias("output_sha256"), digest(restored(F.col("fim_text"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents
), cuts AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS prefix, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS middle,
         array_to_string(u[greatest(x, y) + 1:n], '') AS suffix FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
