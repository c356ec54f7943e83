"""The literal structure of each read: where its CAG, CCG and CCT tracts lie and what stands between and around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amplitract.functions.exprs import framed, let, mask_flags, rotation_match
from amplitract.sources.reads import TYPICAL

#: The three frames of each repeat.
MASKS = {"cag": ("CAG", "AGC", "GCA"), "ccg": ("CCG", "CGC", "GCC"), "cct": ("CCT", "CTC", "TCC")}
#: A tract starts with three windows of its mask; a lone other window is inside if a match stands before and two behind it.
TRACT = "111+(?:011+)*"


def distinct_reads(reads: DataFrame) -> DataFrame:
    """(sample_id, mate, seq, n): amplicon reads repeat, so each distinct sequence of a sample is scanned once."""
    return reads.where("mapq >= 1").groupBy("sample_id", "mate", "seq").agg(F.count(F.lit(1)).alias("n"))


def _best(frames: Column, masks: tuple[str, ...]) -> Column:
    """(n, k, start) of the longest tract of any mask; of equal ones, that of the first mask."""
    tract = lambda k: lambda f: F.struct(F.length(F.regexp_extract(f, TRACT, 0)).alias("n"), F.lit(-k).alias("k"), (F.instr(f, "111") - 1).alias("start"))
    return F.array_max(F.array(*[let(mask_flags(frames, mask), tract(k)) for k, mask in enumerate(masks)]))


def _following(frames: Column, after: Column, masks: tuple[str, ...]) -> Column:
    """(n, k, start) of the longest first run of any mask behind a window."""
    run = lambda k: lambda f: F.struct(F.length(F.regexp_extract(f, "1+", 0)).alias("n"), F.lit(-k).alias("k"), (after + F.instr(f, "1") - 1).alias("start"))
    rest = lambda mask: F.substring(mask_flags(frames, mask), after + 1, F.length(frames))
    return F.array_max(F.array(*[let(rest(mask), run(k)) for k, mask in enumerate(masks)]))


def _windows(frames: Column, start: Column, n: Column) -> Column:
    """The text of n windows from one on."""
    return F.replace(F.substring(frames, start * 4 + 1, F.greatest(n, F.lit(0)) * 4), F.lit(" "), F.lit(""))


def _structure(frames: Column) -> Column:
    def around(s: Column) -> Column:
        a, c, t = s["a"], s["c"], s["t"]
        a_end, t_end = a["start"] + a["n"], t["start"] + t["n"]
        return F.struct(
            a["n"].alias("cag"), c["n"].alias("ccg"), t["n"].alias("cct"), _windows(frames, a_end, c["start"] - a_end).alias("intervening"),
            _windows(frames, F.lit(0), a["start"] - 1).alias("five"), _windows(frames, t_end, F.length(frames)).alias("three"),
        )

    tracts = F.struct(_best(frames, MASKS["cag"]).alias("a"), _best(frames, MASKS["ccg"]).alias("c"))
    three = let(tracts, lambda s: F.struct(s["a"].alias("a"), s["c"].alias("c"), _following(frames, s["c"]["start"] + s["c"]["n"], MASKS["cct"]).alias("t")))
    return let(three, around)


def scan_tracts(reads: DataFrame, keep_seq: bool = False) -> DataFrame:
    """(sample_id, mate, n, cag, ccg, cct, intervening, five, three; seq if kept) of each distinct sequence with all three tracts. The
    structure is generated rather than projected, so that a filter on it isn't worked out a second time below."""
    return with_structure(distinct_reads(reads), ["sample_id", "mate", "n", *(["seq"] if keep_seq else [])])


def with_structure(rows: DataFrame, kept: list[str]) -> DataFrame:
    """The kept columns and the structure of each row's seq; rows without all three tracts go."""
    found = F.filter(F.array(let(framed(F.col("seq")), _structure)), lambda s: (s["cag"] > 0) & (s["ccg"] > 0) & (s["cct"] > 0))
    return rows.select(*kept, F.explode(found).alias("s")).select(*kept, "s.*")


def assign_contigs(scanned: DataFrame) -> DataFrame:
    """Adds the library contig (contig_cag, contig_ccg) that a length-preserving aligner picks: three bases more between
    the tracts count as one CCG more. Reads outside of the library are unmapped (null)."""
    ccg = F.col("ccg") + F.floor((F.length("intervening") - len(TYPICAL)) / 3).cast("int")
    inside = F.col("cag").between(1, 200) & ccg.between(1, 20)
    return scanned.withColumns({"contig_cag": F.when(inside, F.col("cag")), "contig_ccg": F.when(inside, ccg)})


def normalised_intervening(s: Column) -> Column:
    """The typical sequence if s is it but for a rotation and one substitution, else s."""
    return F.when(s == TYPICAL, s).when(rotation_match(s, TYPICAL), F.lit(TYPICAL)).otherwise(s)
