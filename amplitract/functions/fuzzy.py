"""What built-in functions can't express: similarity of short strings, and labels of novel sequences."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIRST, SECOND = "CAACAG", "CCGCCA"
# The sequences between the tracts that a rotated or once substituted sequence is read as.
KNOWN = ("CAACAG", "CCGCCA", "CAACAGCAACAGCCGCCA", "CAACAGCCGCCACCGCCA")


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp, without regard to case."""
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def rotates(s: str, target: str, most: int = 1) -> bool:
    twice = s + s
    return len(s) == len(target) and any(sum(x != y for x, y in zip(twice[k:], target, strict=False)) <= most for k in range(len(target)))


def motif_label(middle: str) -> tuple[str, str]:
    """The counts of both motifs in a sequence between the tracts; a star marks one that isn't where, or what, it should be."""
    s = next((k for k in reversed(KNOWN) if rotates(middle, k)), middle)
    counts, stars, at = [], [], 0
    for number, motif in enumerate((FIRST, SECOND)):
        count, star = s.count(motif), False
        if count:
            star = s.find(motif) != at
            at = s.find(motif) + 6 * count
        else:
            shift = len(s) % 6
            candidate = s[at + shift : at + shift + 6] if shift else s[at : at + 6]
            if len(candidate) == 6 and len(s) > 6 and similarity(candidate, motif) >= 0.5:
                count, star, at = s.count(candidate), True, at + shift + 6
            elif len(s) == 6:
                halves = (motif[:3], motif[3:])
                count = int(any(h in s and rotates(s.replace(h, "", 1), halves[1 - i], 0) for i, h in enumerate(halves)))
        counts.append(count)
        stars.append(star)
    if not s.count(FIRST) and not s.count(SECOND):
        counts = [0, 0]
    if len(s) > 12 and s[s.rfind(SECOND) + 6 :] and SECOND in s:
        stars[1] = True
    return tuple(f"{c}{'*' if x else ''}" for c, x in zip(counts, stars, strict=True))


SHAPE = T.StructType([T.StructField("caacag", T.StringType()), T.StructField("ccgcca", T.StringType())])


def label_parts(rows: DataFrame, middle: str = "intervening") -> DataFrame:
    """rows with caacag and ccgcca. The few distinct sequences are labelled, then joined back."""

    @F.udf(SHAPE, useArrow=True)
    def parts(s: str | None):
        return motif_label(s or "")

    known = rows.select(F.col(middle).alias("_m")).distinct().withColumn("_p", parts("_m"))
    return rows.join(known, rows[middle].eqNullSafe(known["_m"]), "left").select(*[rows[c] for c in rows.columns], "_p.caacag", "_p.ccgcca")


def nearest_contig(wanted: DataFrame, contigs: DataFrame) -> DataFrame:
    """(sample_id, label, contig): the sample's contig whose name is most alike, the first in order if equal."""
    alike = F.udf(lambda a, b: similarity(a, b), T.DoubleType(), useArrow=True)
    pairs = wanted.join(contigs, "sample_id").withColumn("alike", alike("label", "contig"))
    best = F.max(F.struct("alike", F.col("n").alias("n"), "contig"))["contig"]
    return pairs.groupBy("sample_id", "label").agg(best.alias("contig"))


def register_sql(spark: SparkSession) -> None:
    """SQL functions: similarity(a, b) and motif_label(s)."""
    spark.udf.register("similarity", F.udf(lambda a, b: similarity(a or "", b or ""), T.DoubleType(), useArrow=True))
    spark.udf.register("motif_label", F.udf(lambda s: motif_label(s or ""), SHAPE, useArrow=True))
