"""Line dedup with DataFrame functions only.

The lines of a text are normalised, hashed and exploded; a hash counts the documents that hold it; lines over the
threshold go, and what stays is put together again by position.

Only hashes are shuffled, never lines. Each document explodes the distinct keys it holds, so that a plain count (with
map-side partial sums) is the number of distinct documents, however often a key repeats in one text or in the corpus.
The positions to drop depend on the text alone, so they come back under the text's content key: copies of a text share
one row of the answer, and the texts themselves are joined to it once.

Defined cases: a null or empty text is one empty line; an empty key is never counted and never dropped (``min_chars``
is 1 at least); each row counts as a document, null and repeated ids too; other columns stay as they are, and
a text that loses all of its lines becomes an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, content_key, discard, materialize, others, strip_spaces, table


def line_keys(text: Column) -> Column:
    """The normalised lines of a text, in order."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), strip_spaces)


def _hashed(keys: Column, min_chars: int) -> Column:
    """A struct of two hashes for each key that counts, null for each that is too short."""
    pair = lambda x: F.struct(F.xxhash64(x).alias("a"), F.crc32(x).alias("b"))
    return F.transform(keys, lambda x: F.when(F.length(x) >= max(1, min_chars), pair(x)))


def frequent_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(a, b, n_docs) of each line key that at least min_docs documents hold."""
    keys = F.array_distinct(line_keys(F.coalesce(docs[text], F.lit(""))))
    held = docs.select(F.explode(_hashed(keys, min_chars)).alias("h")).where("h is not null").select("h.a", "h.b")
    return held.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)


def _marked(docs: DataFrame, text: str, min_docs: int, min_chars: int) -> tuple[DataFrame, Column, Column, Column]:
    """docs with the positions to drop joined on; the kept text, the number of lines and of dropped lines."""
    # tables that are written, so that joins read plain exchanges, and a frequent line or copy can be dealt to several tasks
    drop = materialize(frequent_lines(docs, text, min_docs, min_chars).select("a", "b"), "frequent-lines")
    whole = F.coalesce(docs[text], F.lit(""))
    at = docs.select(*content_key(whole), F.posexplode(_hashed(line_keys(whole), min_chars)).alias("pos", "h"))
    at = at.where("h is not null").select("key_a", "key_b", "pos", "h.a", "h.b")
    lost = at.join(drop.hint("merge"), ["a", "b"], "left_semi").groupBy("key_a", "key_b").agg(F.collect_set("pos").alias("gone"))
    gone = materialize(lost, "lines-gone")
    discard(drop)

    key_a, key_b = content_key(whole)
    out = docs.join(gone.hint("merge"), (key_a == gone["key_a"]) & (key_b == gone["key_b"]), "left")
    lines, lost = F.split(whole, "\n", -1), F.coalesce(gone["gone"], F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
    kept = F.when(F.size(lost) == 0, whole).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return out, kept, F.size(lines).cast("long"), F.size(lost).cast("long")


def mark_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with lines_kept (text), n_lines and n_dropped (long); columns of these names are replaced."""
    out, kept, n_lines, n_dropped = _marked(docs, text, min_docs, min_chars)
    return out.select(*others(docs, "lines_kept", "n_lines", "n_dropped"), kept.alias("lines_kept"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with the frequent lines taken out of the text; the columns are those of docs."""
    out, kept, _, _ = _marked(docs, text, min_docs, min_chars)
    return out.select(*[kept.alias(c) if c == text else docs[f"`{c}`"] for c in docs.columns])


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("lines_kept").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = """
WITH lines AS (
  SELECT doc_id, rid, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM lines
), often AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(o.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often o ON keyed.k = o.k
GROUP BY doc_id, rid
"""
