"""Many adapters against brute force, the table function against the native scan, a stream with repeated and late reads."""

import random

import pytest
from pyspark.sql import functions as F

from amplitract.functions.scan import register_scan, structure
from amplitract.operators import adapters as A
from amplitract.operators.histogram import histogram
from amplitract.operators.tracts import assign_contigs, scan_tracts
from amplitract.sources.reads import FIVE_PRIME, THREE_PRIME, TYPICAL
from amplitract.streaming.histogram import counted, keep_counts, latest

READ = "sample_id int, read_id long, mate string, mapq int, seq string, quality int"


def mutated(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        p, x = rng.randrange(len(s)), rng.random()
        if x < 0.4:
            s[p] = rng.choice("ACGT")
        elif x < 0.7:
            del s[p]
        else:
            s.insert(p, rng.choice("ACGT"))
    return "".join(s)


def planted_reads(rng, pairs, count):
    reads = []
    for k in range(count):
        _, five, three = rng.choice(pairs)
        body = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 60)))
        reads.append("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 9))) + mutated(rng, five, k % 4) + body + mutated(rng, three, k % 3) + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 9))))
    return [*reads, "", "ACGT", pairs[0][2] + pairs[0][1]]


@pytest.mark.parametrize("error_rate", [0.0, 0.12, 0.25])
def test_fifty_pairs_against_brute_force(spark, error_rate):
    rng = random.Random(8)
    any_of = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    pairs = [(f"p{k}", any_of(rng.randint(9, 20)), any_of(rng.randint(9, 20))) for k in range(48)]
    pairs += [("same five", pairs[0][1], any_of(12)), ("like p1", mutated(rng, pairs[1][1], 1), pairs[1][2])]
    reads = planted_reads(rng, pairs, 120)
    want = {}
    for read in reads:
        best = None
        for k, (_, five, three) in enumerate(pairs):
            a, b = A.best_match(read, five, int(error_rate * len(five))), A.best_match(read, three, int(error_rate * len(three)))
            if a and b and b[2] >= a[1]:
                found = (a[0] + b[0], k, a[1], b[2])
                best = found if best is None else min(best, found)
        if best:
            want[read] = (pairs[best[1]][0], read[best[2] : best[3]], best[0])
    df = spark.createDataFrame([(k % 3, k, "R1", 60, s, 30) for k, s in enumerate([*reads, reads[0], None])], READ)
    got = A.demultiplex_pairs(df, pairs, error_rate).collect()
    assert {r.seq: (r.pair, r.part, r.edits) for r in got} == want and len(got) == len(want) + (reads[0] in want)
    assert len(want) > 10


def test_an_adapter_of_errors_is_refused():
    with pytest.raises(ValueError, match="all errors"):
        A.Adapters(["ACG"], 1.0)


def random_reads(rng, count):
    reads = []
    for _ in range(count):
        mid = rng.choice([TYPICAL, "CAACAG", "", "CAACAGCTGCTA"])
        s = rng.choice(["", "A", "AC"]) + FIVE_PRIME + "CAG" * rng.randint(2, 30) + mid + "CCG" * rng.randint(2, 12) + "CCT" * rng.randint(0, 3) + THREE_PRIME
        reads.append(mutated(rng, s, rng.choice([0, 0, 1, 3])))
    return [*reads, "", "AC", "CAGCAGCAG", "CCGCCGCCG" * 5]


def test_table_function_agrees_with_the_native_scan(spark):
    register_scan(spark)
    reads = random_reads(random.Random(2), 150)
    df = spark.createDataFrame([(0, k, "R1", 60, s, 30) for k, s in enumerate(reads)], READ)
    columns = ["seq", "cag", "ccg", "cct", "intervening", "five", "three"]
    native = {tuple(r) for r in scan_tracts(df, keep_seq=True).select(columns).collect()}
    assert {(s, *x) for s in reads if (x := structure(s))} == native and len(native) > 60
    df.createOrReplaceTempView("scan_reads")
    assert {tuple(r) for r in spark.sql("SELECT seq, t.* FROM scan_reads, LATERAL scan_tracts(seq) t").collect()} == native
    some = spark.sql("SELECT seq, t.* FROM scan_reads, LATERAL scan_tracts(seq, 'cct, cag') t")
    assert some.columns == ["seq", "cct", "cag"] and {tuple(r) for r in some.collect()} == {(x[0], x[3], x[1]) for x in native}
    assert spark.sql("SELECT * FROM scan_tracts(CAST(NULL AS STRING))").count() == 0
    with pytest.raises(Exception, match="no column flank"):
        spark.sql("SELECT * FROM scan_tracts('CAG', 'flank')")


def test_stream_of_repeated_and_late_reads(spark, tmp_path):
    """Batches that repeat reads, whole or in part, and reads that come late within the delay, give the histogram of all reads once."""
    rng = random.Random(7)
    rows = [(k % 2, k, rng.choice(["R1", "R2"]), rng.choice([0, 60, 60]), FIVE_PRIME + "CAG" * rng.randint(15, 18) + TYPICAL + "CCG" * rng.choice([7, 10]) + "CCTCCT" + THREE_PRIME, 30) for k in range(240)]
    kind = READ + ", ts timestamp"
    stamp = lambda k: F.timestamp_seconds(F.lit(1_700_000_000) + F.lit(k))
    batches = [(rows[:100], 0), (rows[50:150], 600), (rows[:100], 900), (rows[150:200], 1200), (rows[200:], 100)]  # the last one is late
    folder = f"file://{tmp_path}"
    made = lambda part, k: spark.createDataFrame(part, READ).withColumn("ts", stamp(k))
    for n, (part, k) in enumerate(batches):
        made(part, k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        query = keep_counts(counted(stream), f"{folder}/out", f"{folder}/state")
        query.awaitTermination()
        seen = {r[1]: r for p, _ in batches[: n + 1] for r in p}
        want = histogram(assign_contigs(scan_tracts(spark.createDataFrame(list(seen.values()), READ))))
        key = ["sample_id", "mate", "ccg", "cag", "n"]
        assert sorted(map(tuple, latest(spark, f"{folder}/out").select(key).collect())) == sorted(map(tuple, want.select(key).collect())), n


def test_stream_of_reads_scanned_by_batch(spark, tmp_path):
    """Reads that come twice count once in the histograms of batches, those of one id that differ are several, and the ids are kept on disk."""
    from amplitract.streaming import histogram as S

    rng = random.Random(8)
    rows = [(k % 2, k // 3, "R1", 60, FIVE_PRIME + "CAG" * rng.randint(15, 18) + TYPICAL + "CCG" * 7 + "CCTCCT" + THREE_PRIME, k % 3) for k in range(120)]
    folder = f"file://{tmp_path}"
    for part in (rows[:80], rows[40:], rows[:10]):
        spark.createDataFrame(part, READ).withColumn("ts", F.timestamp_seconds(F.lit(600))).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(READ + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    before = [spark.conf.get(k, None) for k in S.ON_DISK]
    S.add_batches(S.once(stream, key=("sample_id", "mate", "read_id", "quality")), f"{folder}/out", f"{folder}/state").awaitTermination()
    assert [spark.conf.get(k, None) for k in S.ON_DISK] == before
    want = histogram(assign_contigs(scan_tracts(spark.createDataFrame(rows, READ))))
    key = ["sample_id", "mate", "ccg", "cag", "n"]
    assert sorted(map(tuple, S.total(spark, f"{folder}/out").select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    assert "RocksDBStateStoreProvider" in (tmp_path / "state/offsets/0").read_text()


def test_configuration_is_obeyed(spark):
    """Errors that are tolerated, adapters at either end, demultiplexing, bins by scores, realignment and the quality of variants."""
    from amplitract.plans import run
    from amplitract.sources import config, reads

    xml = '<c><instance_flags demultiplex="True"/><demultiplex_flags forward_adapter="ACGT" reverse_adapter="TTTT" error_rate="0" min_overlap="10" max_length="90"/><trim_flags adapter_flag="-b" forward_adapter="GG"/><alignment_flags indel_penalty="7,8" gap_extend_penalty="2"/></c>'
    found = config.read_config(xml)
    assert (found.demultiplex, found.ends(), found.forward_adapter, found.adapter_flag, found.demultiplex_max_length) == (True, ("ACGT", "TTTT"), "GG", "-b", 90)
    assert found.scoring().gap_open == (7, 8) and found.scoring().gap_extend == (2, 2)
    for wrong in ({"adapter_flag": "-x"}, {"demultiplex": True}, {"snp_cutoff": -1.0}, {"band_width": 0}, {"demultiplex_reverse_adapter": "AXA"}, {"alignment": False}):
        with pytest.raises(ValueError, match="."):
            config.Config(**wrong)
    seqs = ["AAAACCCCGGGG", "CCCCGGGGAAAA", "AAAACCCAGGGG", "AAAA"]
    df = spark.createDataFrame([(0, k, mate, 60, s, 30, [30] * len(s)) for k, s in enumerate(seqs) for mate in ("R1", "R2")], READ + ", q array<int>")
    off = {"alignment": False, "genotyping": False, "snp_calling": False, "trim_type": "Adapter", "forward_adapter": "CCCCGGGG", "reverse_adapter": "CCCCGGGG"}
    removed = lambda **more: {r.mate: r.bases_removed for r in run.run(df, config.Config(**off | more))["trimming"].collect()}
    assert removed(error_tolerance=0.0) == {"R1": 20, "R2": 20} and removed(error_tolerance=0.2) == {"R1": 28, "R2": 28}
    assert removed(adapter_flag="-b") == {"R1": 16, "R2": 16} and removed(adapter_flag="-b", reverse_adapter="") == {"R1": 16, "R2": 0}
    assert removed(adapter_flag="-a$") == {"R1": 8, "R2": 8} and removed(adapter_flag="-g^") == {"R1": 8, "R2": 8}
    rows = reads.synth_reads(spark, "/root/testdata/sf0.01").where("sample_id IN (3, 4, 10)")
    cut = config.Config(quality_control=False, demultiplex=True, demultiplex_forward_adapter=reads.FIVE_PRIME[-12:], demultiplex_reverse_adapter=reads.THREE_PRIME[:12], alignment=False, genotyping=False, snp_calling=False)
    assert run.run(rows, cut)["demultiplexed"].agg(F.sum("n")).first()[0] == rows.count()
    out = run.run(rows, config.Config(quality_control=False, rescoring=True))
    bins = {(r.sample_id, r.cag, r.ccg) for r in out["histogram"].where("n > 100").collect()}
    assert {(3, 17, 7), (4, 20, 10), (10, 19, 7)} <= bins and out["instance_report"].count() == 3
    assert out["variants"].where("sample_id = 4 AND allele = 'PRI'").select("pos").collect() == [(26,)]
    assert run.run(rows, config.Config(quality_control=False, snp_cutoff=1e9))["variants"].count() == 0
    own, typical = (run.run(rows.where("sample_id = 10"), config.Config(quality_control=False, snp_calling=False, atypical_realignment=x))["labels"].where("allele = 'PRI'").first().genotype for x in (True, False))
    assert own == "17_2_1_7_2" != typical
