"""Reports and jitter of intervals on hand-written rows, line by line."""

import zlib

from pyspark.sql import functions as F

from amplitract.operators import metrics as M
from amplitract.operators import report as T

INTERVALS = "sample_id int, allele string, call int, lo int, hi int, interval string"


def test_simplified_report(spark):
    labels = spark.createDataFrame([(1, "PRI", "17_1_1_7_2"), (1, "SEC", "42_1_1_7_2"), (2, "PRI", "20_1_1_10_2"), (3, "SEC", "9_1_1_7_2")], "sample_id int, allele string, genotype string")
    intervals = spark.createDataFrame([(1, "PRI", 17, 16, 17, "16-17"), (1, "SEC", 42, 41, 43, "41-43"), (3, "SEC", 9, 9, 9, "9-9")], INTERVALS)
    got = {tuple(r) for r in T.simplified_report(labels, intervals).collect()}
    assert got == {(1, "17_1_1_7_2", "16-17", "42_1_1_7_2", "41-43"), (2, "20_1_1_10_2", "FAIL", "FAIL", "FAIL"), (3, "FAIL", "FAIL", "9_1_1_7_2", "9-9")}


def plain_text(lo, hi, n):
    if lo == hi:
        return f"{lo}-{n}" if abs(hi - n) > 1 else f"{n}-{n}" if abs(hi - n) == 1 else f"{lo}-{hi}"
    return f"{lo}-{n}" if n > hi else f"{lo}-{hi}"


def test_jitter_of_intervals(spark):
    rows = [(k, who, 17 + k % 4, 16, 17 + k % 2, "") for k in range(12) for who in ("PRI", "SEC")]
    scores = [(k, who, 49 if (k + (who == "SEC")) % 3 == 0 else 50) for k in range(11) for who in ("PRI", "SEC")]  # the last sample has none
    got = {(r.sample_id, r.allele): (r.lo, r.hi, r.interval) for r in M.jittered_interval(spark.createDataFrame(rows, INTERVALS), spark.createDataFrame(scores, "sample_id int, allele string, confidence int")).collect()}
    low = {(k, who) for k, who, c in scores if c < 50}
    for k, who, call, lo, hi, _ in rows:
        if (k, who) in low:
            lo, hi = lo - 1 - zlib.crc32(str(k).encode()) % 2, hi + 1
        assert got[k, who] == (lo, hi, plain_text(lo, hi, call))
    assert low and len({16 - got[x][0] for x in low}) == 2


def scored(spark, inspection=True):
    """One allele with all that reports tell."""
    values = {
        "genotype": "17_1_1_7_2", "ccg_uncertain": True, "status": "Typical", "typical_pcnt": 98.5, "atypical_pcnt": 1.5, "contig_reads": 900, "recalls": 2, "state": "neighbouring", "diminished": False, "slippage": 0.25, "mosaicism": None,
        "slippage_overwrite": False, "interpolated": None, "fod_overwrite": True, "alignment_warning": False, "fatal_low": True, "vicinity": 0.9, "nminus": 0.5, "nplus": None, "minus_level": 3, "plus_level": 0, "ccg_threshold": 0.5, "threshold": 0.38, "fod_ccg": 7, "unexpected": False,
    }
    kinds = {str: "string", bool: "boolean", float: "double", int: "int"}
    schema = "sample_id int, allele string, inspection boolean, " + ", ".join(f"{c} {kinds.get(type(v), 'double')}" for c, v in values.items())
    return spark.createDataFrame([(4, "PRI", inspection, *values.values())], schema)


def test_allele_report(spark):
    rows = scored(spark)
    got = T.allele_reports(rows, rows.select("sample_id", "allele", F.lit(81).alias("confidence"))).first()
    assert got.report.split("\n") == [
        "Allele Report>> 4", "", "Summary Information>>", "Genotype: 17_1_1_7_2", "Confidence: 81", "CCG Uncertain: True", "Structure Status: Typical", "Typical Pcnt: 98.5", "Atypical Pcnt: 1.5", "Total Reads: 900", "",
        "Flags>>", "Recall Count: 2", "Homozygous Haplotype: False", "Neighbouring Peaks: True", "Diminished Peaks: False", "Backwards Slippage: 0.25", "Somatic Mosaicism: FAIL", "Slippage Overwritten: False", "Peak Interpolation Warning: True",
        "Peak Interpolation Distance: FAIL", "Peak DSP Overwritten: True", "Low read-count alignment: False", "Fatal low read-count: True", "",
        "Data Quality>>", "Reads (%) surrounding peak: 0.9", "Immediate Dropoffs: [0.5, FAIL]", "N-1 Warning Level: 3", "N+1 Warning Level: 0", "CCG Threshold: 0.5", "CAG Threshold: 0.38",
    ]
    without = T.allele_reports(rows, rows.select("sample_id", "allele", F.lit(81).alias("confidence")).where("false")).first()
    assert "Confidence: FAIL" in without.report


def test_inspection_log(spark):
    assert T.inspection_logs(scored(spark, inspection=False)).count() == 0
    log = T.inspection_logs(scored(spark)).first().log.split("\n")
    assert log == [
        ">> Peak Inspection Failure  Intermediate results log", "Investigating CCG: 7", "Interpolation warning: True", "Interpolation distance: FAIL", "Reads (%) surrounding peak: 0.9", "Peak dropoff: [0.5, FAIL]", "NMinus ratio: 0.5",
        "NMinus warning: 3", "NPlus ratio: FAIL", "NPlus warning: 0", "Unexpected Peaks: False",
    ]
