"""Reviews of calls on hand-written vectors: each flag true and false; recalls of both alleles from one budget; outcomes."""

import pytest
from pyspark.sql import functions as F

from amplitract.operators import evidence as E
from amplitract.operators import genotype as G
from amplitract.operators import report as T

TYPICAL = "CAACAGCCGCCA"
LONG = "CAACAGCAACAGCCGCCA"
ALLELES = "sample_id int, allele string, cag int, ccg int, est_cag int, est_ccg int, est_cct int, intervening string, status string, neighbouring boolean"


def vector(**at):
    v = [0] * 20
    for k, n in at.items():
        v[int(k[1:]) - 1] = n
    return v


def review(spark, samples):
    """samples: {id: (ccg of both, own vectors (R2, R1) of both, classified, state, statuses, est_ccg of both)}"""
    alleles, rv, fw, zygosity, valid = [], [], [], [], []
    for k, s in samples.items():
        for i, who in enumerate(("PRI", "SEC")):
            alleles.append((k, who, 17, s["ccg"][i], 17, s.get("est", s["ccg"])[i], 2, LONG if s.get("odd", (0, 0))[i] else TYPICAL, "Atypical" if s.get("odd", (0, 0))[i] else "Typical", s.get("beside", False)))
            rv += [(k, who, b + 1, n) for b, n in enumerate(s["rv"][i])]
            fw += [(k, who, b + 1, n) for b, n in enumerate(s.get("fw", s["rv"])[i])]
            valid.append((k, who, s.get("state", "heterozygous")))
        zygosity.append((k, s["seen"]))
    bins = "sample_id int, allele string, ccg int, n long"
    out = E.ccg_review(spark.createDataFrame(rv, bins), spark.createDataFrame(fw, bins), spark.createDataFrame(alleles, ALLELES), spark.createDataFrame(zygosity, "sample_id int, zygosity string"), spark.createDataFrame(valid, "sample_id int, allele string, state string"))
    return {(r.sample_id, r.allele): r for r in out.collect()}


def test_ccg_review(spark):
    two, one = vector(_7=1000, _10=800), vector(_7=1000)
    crowded = vector(_7=1000, _8=900, _9=500)
    got = review(spark, {
        1: {"ccg": (7, 10), "rv": (two, two), "seen": "HETERO"},
        2: {"ccg": (7, 7), "rv": (one, one), "seen": "HOMO"},
        3: {"ccg": (4, 10), "rv": (two, two), "seen": "HETERO"},  # the first isn't among the reverse reads' peaks
        4: {"ccg": (7, 9), "rv": (crowded, crowded), "seen": "HOMO"},
        5: {"ccg": (7, 9), "rv": (crowded, crowded), "seen": "HOMO", "beside": True},
        6: {"ccg": (7, 7), "rv": (vector(_14=1000), vector(_14=1000)), "seen": "HOMO"},  # no maximum near the call
        7: {"ccg": (7, 10), "rv": (vector(_14=1000), vector(_14=1000)), "seen": "HOMO"},
        8: {"ccg": (7, 7), "rv": (vector(_6=90, _7=1000, _8=90, _12=90, _13=600, _14=90),) * 2, "seen": "HOMO"},  # two clean peaks taken for one
        9: {"ccg": (7, 7), "rv": (one, one), "fw": (two, two), "seen": "HOMO", "state": "homozygous"},
        10: {"ccg": (9, 7), "est": (7, 7), "odd": (1, 0), "rv": (vector(_7=1000), vector(_9=600, _10=500)), "seen": "HETERO"},
    })
    flags = lambda k, c: tuple(getattr(got[k, who], c) for who in ("PRI", "SEC"))
    assert flags(1, "ccg") == flags(1, "fod_ccg") == (7, 10) and flags(1, "zygosity") == ("HETERO",) * 2 and flags(1, "ratio") == (0.8, 0.8)
    assert all(flags(k, "overwritten") == (k == 3, False) for k in range(1, 10)) and flags(3, "ccg") == (7, 10)
    assert flags(4, "uncertain") == (True, True) and flags(5, "uncertain") == flags(2, "uncertain") == (False, False) and flags(9, "uncertain") == (True, True)
    assert flags(6, "continuous") == flags(6, "matched") == (False, False) and flags(2, "continuous") == flags(2, "matched") == (True, True)
    assert flags(6, "ccg_passes") == (True, True) and flags(7, "ccg_passes") == (False, False)
    # an atypical allele is looked at in its own library, and peaks against the stated sizes fail the classifier
    assert flags(10, "ccg") == (7, 9) and flags(10, "overwritten") == (False, True) and flags(10, "svm_failure") == (True, True)
    assert flags(1, "svm_failure") == flags(2, "svm_failure") == (False, False)
    assert flags(8, "continuous") == (True, True)


def test_smoothing_of_a_called_bin(spark):
    """Each branch of smoothing, by hand."""
    cases = [
        (vector(_7=1000, _8=400, _10=400), 7, False, vector(_7=1000, _8=90, _10=90)),
        (vector(_7=1000, _8=400, _12=400), 7, False, vector(_7=1000, _8=90, _12=400)),
        (vector(_7=1000, _10=600), 7, True, vector(_7=1000, _10=150)),
        (vector(_7=1000, _10=600), 10, True, vector(_7=245, _10=600)),  # second, and over half: five more go
        (vector(_7=1000, _10=400), 10, True, vector(_7=12, _10=400)),  # second and under half: the first loses 95 percent
        (vector(_7=9000, _10=600), 7, True, vector(_7=9000, _10=90)),
        (vector(_7=20000, _10=600), 7, True, vector(_7=20000, _10=30)),
    ]
    rows = spark.createDataFrame([(k, v, call, het) for k, (v, call, het, _) in enumerate(cases)], "k int, v array<long>, call int, het boolean")
    got = {r.k: list(r.s) for r in rows.select("k", E.smoothed(F.col("v"), F.col("call"), F.col("het")).alias("s")).collect()}
    assert [got[k] for k in range(len(cases))] == [w for *_, w in cases]


def test_peak_review(spark):
    """Slippage up, down and both ways, a second high peak, and the top of the parabola."""
    shapes = {
        1: ("heterozygous", "HOMO", {17: 1000, 16: 300, 18: 200}),
        2: ("heterozygous", "HOMO", {17: 1000, 16: 960, 18: 850}),  # up: the bin before is no 0.80
        3: ("heterozygous", "HOMO", {17: 1000, 16: 800, 18: 700}),  # down: the bin after is no 0.85
        4: ("heterozygous", "HOMO", {17: 1000, 16: 800, 18: 850}),  # both: it stays
        5: ("homozygous", "HOMO", {17: 1000, 16: 960, 18: 850}),
        6: ("heterozygous", "HETERO", {17: 1000, 16: 100, 18: 100, 25: 500}),
        7: ("heterozygous", "HETERO", {17: 1000, 16: 100, 18: 100, 25: 300}),
        8: ("heterozygous", "HETERO", {17: 1000, 19: 900}),
        9: ("heterozygous", "HOMO", {17: 1000, 16: 500, 18: 500}),
    }
    bins = [(k, "PRI", c, shape.get(c, 0)) for k, (_, _, shape) in shapes.items() for c in range(1, 201)]
    valid = spark.createDataFrame([(k, "PRI", s, 17) for k, (s, _, _) in shapes.items()], "sample_id int, allele string, state string, fod int")
    seen = spark.createDataFrame([(k, "PRI", z) for k, (_, z, _) in shapes.items()], "sample_id int, allele string, zygosity string")
    got = {r.sample_id: r for r in E.peak_review(spark.createDataFrame(bins, "sample_id int, allele string, cag int, smooth long"), valid, seen).collect()}
    assert [got[k].fod for k in range(1, 10)] == [17, 18, 16, 17, 17, 17, 17, 17, 17]
    assert [k for k in got if got[k].slippage_overwrite] == [2, 3, 4] and [k for k in got if got[k].unexpected] == [6]
    assert got[8].interpolated is None and got[9].interpolated == 0 and got[1].interpolated > 0


def slices(spark, samples):
    """samples: {id: ((call, expected, {cag: n}) of both)}"""
    rows = [(k, who, call, expected, False, False, c, n.get(c, 0)) for k, both in samples.items() for who, (call, expected, n) in zip(("PRI", "SEC"), both, strict=True) for c in range(1, 201)]
    return spark.createDataFrame(rows, "sample_id int, allele string, call int, expected int, beside boolean, spread boolean, cag int, smooth long")


def test_recalls_come_from_one_budget(spark):
    """The first allele's recalls count before the second's, and more than eight fail the sample."""
    low = lambda share: {10: 1000, 30: int(1000 * share)}  # noqa: E731  a call of 30 that needs a lower rung
    got = {}
    made = {
        1: ((17, 1, {17: 100}), (30, 1, {10: 1000, 20: 990, 30: 330})),
        2: ((30, 1, {10: 1000, 20: 990, 30: 210}), (30, 1, {10: 1000, 20: 990, 30: 210})),  # five each
        3: ((17, 1, {200: 100}), (17, 1, {17: 100})),  # a peak in the last bin is none
        4: ((30, 1, {10: 1000, 20: 990, 30: 270}), (30, 1, {10: 1000, 20: 990, 30: 270})),  # four each
        5: ((17, 2, low(0.9)), (30, 2, low(0.3))),
    }
    budget = G.recall_budget(slices(spark, made)).persist()
    for r in budget.collect():
        got[r.sample_id, r.allele] = r
    spent = {k: [(got[k, w].recalls, got[k, w].spent, got[k, w].failed) for w in ("PRI", "SEC")] for k in made}
    assert spent[1] == [(0, 0, False), (3, 3, False)] and spent[2] == [(5, 5, False), (5, 10, True)] and spent[3] == [(9, 9, True), (0, 9, True)] and spent[4] == [(4, 4, False), (4, 8, False)]
    assert spent[5] == [(0, 0, False), (4, 4, False)] and list(got[5, "PRI"].peaks) == [10, 30]
    assert got[3, "PRI"].peaks is None and got[3, "PRI"].fod is None and list(got[1, "SEC"].peaks) == [30]
    assert {r.sample_id for r in G.cag_calls(budget).collect()} == {1, 4, 5}


def test_a_realigned_allele_has_its_own_bins(spark):
    """An atypical allele's reads are counted in a library of its structure: its call moves from the typical bin to its own."""
    alleles = spark.createDataFrame([(1, "PRI", 17, 9, 17, 7, 2, LONG, "Atypical", False), (1, "SEC", 23, 10, 23, 10, 2, TYPICAL, "Typical", False)], ALLELES)
    hist = spark.createDataFrame([(1, 9, 17, 500), (1, 10, 23, 300), (1, 10, 22, 30)], "sample_id int, ccg int, cag int, n long")
    own = spark.createDataFrame([(1, "PRI", 7, 17, 500), (1, "PRI", 7, 16, 80), (1, "PRI", 8, 23, 300)], "sample_id int, allele string, ccg int, cag int, n long")
    got = {(r.allele, r.cag): r for r in G.slices(alleles, hist, own).where("n > 0").collect()}
    assert {k: (r.ccg, r.call, r.n) for k, r in got.items()} == {("PRI", 17): (7, 17, 500), ("PRI", 16): (7, 17, 80), ("SEC", 23): (10, 23, 300), ("SEC", 22): (10, 23, 30)}


@pytest.mark.parametrize("known", [True, False])
def test_every_sample_is_reported(spark, known):
    """A sample that failed has a row of FAIL with its stage, even if something was scored."""
    columns = {"genotype": "17_1_1_7_2", "status": "Typical", "intervening": TYPICAL, "state": "heterozygous"}
    numbers = ["fw_count", "fw_mapped", "fw_purged", "rv_count", "rv_mapped", "rv_purged", "slippage", "mosaicism"]
    flags = ["diminished", "novel", "alignment_warning", "atypical_warning", "ccg_rewritten", "zygosity_rewritten", "ccg_uncertain", "cct_uncertain", "svm_failure", "diff_confuse", "missed_expansion", "heuristic_ok", "inspection", "low_reads", "fatal_low"]
    scored = spark.createDataFrame([(k, who) for k in (1, 2) for who in ("PRI", "SEC")], "sample_id int, allele string")
    scored = scored.select("*", *[F.lit(v).alias(c) for c, v in columns.items()], *[F.lit(1.5).alias(c) for c in numbers], *[F.lit(False).alias(c) for c in flags])
    confidence = scored.select("sample_id", "allele", F.lit(90).alias("confidence"))
    outcomes = spark.createDataFrame([(1, None, None), (2, "DSP", "too few reads in a contig"), (3, "Genotype", "recalls are used up")], "sample_id int, stage string, reason string")
    report = {r.sample_id: r.asDict() for r in T.instance_report(scored, confidence, None, outcomes if known else None).collect()}
    if not known:
        assert set(report) == {1, 2} and report[2]["exception"] == "False"
        return
    assert {k: r["exception"] for k, r in report.items()} == {1: "N/A", 2: "DSP", 3: "Genotype"} and report[1]["pri_genotype"] == "17_1_1_7_2"
    assert all(v == "FAIL" for k in (2, 3) for c, v in report[k].items() if c not in ("sample_id", "exception"))
