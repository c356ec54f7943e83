"""The registered queries of the genotyping engine, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from amplitract.operators import consensus as K
from amplitract.operators import histogram as H
from amplitract.operators import peaks as P
from amplitract.operators.tracts import assign_contigs, scan_tracts
from amplitract.operators import genotype as G
from amplitract.operators import metrics as M
from amplitract.operators import qc as Q
from amplitract.operators import reference as R
from amplitract.operators import report as T
from amplitract.operators import variants as V
from amplitract.operators import evidence as E
from amplitract.oracles import CALLS, CONSENSUS, METRICS, OUTCOMES, PAIRS, READS, REVIEW, SCORED, SLICES, TOP, VARIANTS, peaks_cte, query, SCAN
from amplitract.plans import cohort as C
from amplitract.registry import QUERIES, SQL, register
from amplitract.sources.reads import FIVE_PRIME, THREE_PRIME, TYPICAL, synth_reads

def oracles() -> dict[str, str]:
    return dict(SQL)


@register("read_counts", query("SELECT sample_id, mate, count(*) AS total, count(*) FILTER (WHERE mapq >= 1) AS mapped, round(100.0 * count(*) FILTER (WHERE mapq >= 1) / count(*), 4) AS percent FROM reads GROUP BY ALL", READS))
def read_counts(spark, sf):
    mapped = F.count_if(F.col("mapq") >= 1)
    return synth_reads(spark, sf).groupBy("sample_id", "mate").agg(F.count(F.lit(1)).alias("total"), mapped.alias("mapped"), F.round(F.try_divide(mapped * 100.0, F.count(F.lit(1))), 4).alias("percent"))


@register("tract_scan", query("SELECT sample_id, mate, cag, ccg, cct, intervening, five, three, sum(n)::BIGINT AS n FROM scanned GROUP BY ALL"))
def tract_scan(spark, sf):
    return scan_tracts(synth_reads(spark, sf)).groupBy("sample_id", "mate", "cag", "ccg", "cct", "intervening", "five", "three").agg(F.sum("n").alias("n"))


@register("histogram", query("SELECT * FROM hist"))
def histogram(spark, sf):
    return C.histogram(spark, sf)


@register("modal_genotype", query("SELECT sample_id, cag, ccg, n, total FROM (SELECT *, sum(n) OVER (PARTITION BY sample_id)::BIGINT AS total FROM fw) QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, ccg, cag) = 1"))
def modal_genotype(spark, sf):
    return C.modal_genotype(spark, sf)


@register("ccg_collapse", query("SELECT sample_id, mate, ccg, sum(n)::BIGINT AS n FROM hist GROUP BY ROLLUP (sample_id, mate, ccg) HAVING mate IS NOT NULL"))
def ccg_collapse(spark, sf):
    return H.collapse_ccg(C.histogram(spark, sf))


@register("densify", query("SELECT sample_id, ccg, n, call FROM dense"))
def densify(spark, sf):
    return C.called_ccg(spark, sf)


@register("smooth_homozygous", query("SELECT *, CASE WHEN ccg <> call AND abs(ccg - call) <= 3 THEN trunc(n - n / 100.0::DOUBLE * 77.5)::BIGINT ELSE n END AS smooth FROM dense"))
def smooth_homozygous(spark, sf):
    return H.smooth_homozygous(C.called_ccg(spark, sf))


@register("smooth_heterozygous", query("""
, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, ccg) AS r FROM dense),
s AS (SELECT *, max(n) FILTER (WHERE r = 1) OVER w AS top, max(n) FILTER (WHERE r = 2) OVER w AS second, max(n) FILTER (WHERE ccg = call) OVER w AS called,
      max(r) FILTER (WHERE ccg = call) OVER w AS cr FROM r WINDOW w AS (PARTITION BY sample_id)),
t AS (SELECT *, cr = 2 AND 100 * second / nullif(top, 0) > 0 AND 100 * second / nullif(top, 0) < 50 AS rescue FROM s),
u AS (SELECT *, CASE WHEN rescue AND r = 1 THEN trunc(n - n / 100.0::DOUBLE * 95) ELSE n END::BIGINT AS f,
      CASE WHEN called BETWEEN 1 AND 6000 THEN 75.0 WHEN called BETWEEN 6001 AND 12000 THEN 85.0 ELSE 95.0 END AS pct FROM t)
SELECT sample_id, ccg, n, call, CASE WHEN ccg = call THEN n ELSE greatest(0, trunc(f - f / 100.0::DOUBLE * pct::DOUBLE)::BIGINT - CASE WHEN cr = 2 AND NOT rescue THEN 5 ELSE 0 END) END AS smooth FROM u""").replace(")\n, r AS", "),\nr AS").replace("\n\n, r AS", ",\nr AS").replace("\n, r AS", ",\nr AS"))
def smooth_heterozygous(spark, sf):
    return H.smooth_heterozygous(C.called_ccg(spark, sf))


@register("top_contigs", query("SELECT * FROM top3", TOP))
def top_contigs(spark, sf):
    return C.top_contigs(C.forward(spark, sf))


@register("read_warnings", query("SELECT sample_id, a_n, b_n, t_n, least(a_n, b_n, t_n) < 20 AS few, t_n IS NULL OR a_n < 200 OR b_n < 100 OR (t_n < 50 AND NOT t_n BETWEEN 45 AND 55) AS failed FROM ranked", TOP))
def read_warnings(spark, sf):
    return K.read_warnings(C.ranked(spark, sf))


@register("contig_summary", query("SELECT * FROM summary", CONSENSUS))
def contig_summary(spark, sf):
    return C.summary(spark, sf)


@register("allele_pair", query("SELECT * FROM pair", PAIRS))
def allele_pair(spark, sf):
    return K.choose_pair(C.ranked(spark, sf))


@register("genotype_label", query("SELECT sample_id, allele, label, status, intervening FROM alleles", PAIRS))
def genotype_label(spark, sf):
    return C.alleles(spark, sf).select("sample_id", "allele", "label", "status", "intervening")


@register("label_fuzzy")
def label_fuzzy(spark, sf):
    from amplitract.functions.fuzzy import label_parts

    return label_parts(C.alleles(spark, sf)).select("sample_id", "allele", "est_cag", "caacag", "ccgcca", "est_ccg", "est_cct")


@register("distinct_maxima", query("""SELECT sample_id, max(n) FILTER (WHERE r = 1) AS max1, max(n) FILTER (WHERE r = 2) AS max2, max(n) FILTER (WHERE r = 3) AS max3
FROM (SELECT sample_id, n, dense_rank() OVER (PARTITION BY sample_id ORDER BY n DESC) AS r FROM dense) GROUP BY sample_id"""))
def distinct_maxima(spark, sf):
    return H.distinct_maxima(C.called_ccg(spark, sf), ["sample_id"])


@register("fold_expanded", query("SELECT sample_id, mate, ccg, least(cag, 31) AS cag, sum(n)::BIGINT AS n FROM hist GROUP BY ALL"))
def fold_expanded(spark, sf):
    return H.fold_expanded(C.histogram(spark, sf))


@register("ccg_peaks", query("SELECT * FROM ccg_pk", SCAN + "," + peaks_cte("ccg_pk", "dense", "sample_id", "ccg", "n", 0.5)))
def ccg_peaks(spark, sf):
    return P.find_peaks(C.called_ccg(spark, sf), ["sample_id"], "ccg", "n", 0.5)


@register("peaks_min_distance", query("SELECT * FROM bin_pk p WHERE height = (SELECT max(height) FROM bin_pk q WHERE q.sample_id = p.sample_id AND q.allele = p.allele AND abs(q.peak - p.peak) <= 2)", SLICES + "," + peaks_cte("bin_pk", "bins", "sample_id, allele", "cag", "n", 0.05)))
def peaks_min_distance(spark, sf):
    return P.find_peaks(C.genotyped(spark, sf).bins, G.SLICE, "cag", "n", 0.05, min_distance=2)


@register("zygosity", query("SELECT s.sample_id, coalesce(k, 0)::BIGINT AS peaks, CASE WHEN k >= 2 THEN 'HETERO' ELSE 'HOMO' END AS zygosity FROM (SELECT DISTINCT sample_id FROM dense) s LEFT JOIN (SELECT sample_id, count(*) AS k FROM zy GROUP BY 1) USING (sample_id)", SCAN + "," + peaks_cte("zy", "dense", "sample_id", "ccg", "n", 0.15)))
def zygosity(spark, sf):
    return G.zygosity(C.called_ccg(spark, sf))


@register("smooth_cag", query("SELECT sample_id, allele, cag, n, smooth FROM bins WHERE n > 0", SLICES))
def smooth_cag(spark, sf):
    return C.genotyped(spark, sf).bins.where("n > 0").select("sample_id", "allele", "cag", "n", "smooth")


@register("smooth_interval", query("SELECT sample_id, allele, cag, n, CASE WHEN abs(cag - call) <= 10 THEN n ELSE trunc(n - n / 100.0::DOUBLE * 85)::BIGINT END AS smooth FROM bins WHERE n > 0", SLICES))
def smooth_interval(spark, sf):
    return H.smooth_interval(C.genotyped(spark, sf).bins.where("n > 0").drop("smooth")).select("sample_id", "allele", "cag", "n", "smooth")


@register("n_aligned", query("SELECT sample_id, allele, (cag - call)::INT AS off, n FROM bins", SLICES))
def n_aligned(spark, sf):
    return H.align_to_call(C.genotyped(spark, sf).bins)


@register("aligned_distributions", query("SELECT sample_id, allele, repeat('-,', (203 - call)::INT) || string_agg(n || '.00000', ',' ORDER BY cag) || repeat(',-', call::INT) AS dist FROM bins GROUP BY sample_id, allele, call", SLICES))
def aligned_distributions(spark, sf):
    return H.anchored_rows(C.genotyped(spark, sf).bins)


@register("cag_call", query("SELECT sample_id, allele, call, recalls, threshold, array_to_string(peaks, ',') AS peaks, fod FROM calls", CALLS))
def cag_call(spark, sf):
    return C.genotyped(spark, sf).calls.withColumn("peaks", F.concat_ws(",", F.col("peaks").cast("array<string>")))


@register("recall_budget", query("SELECT sample_id, allele, recalls, spent, spent > 8 AS failed FROM budget", CALLS))
def recall_budget(spark, sf):
    """What both alleles' recalls use up of the eight that a sample has."""
    return C.genotyped(spark, sf).budget.select("sample_id", "allele", "recalls", "spent", "failed")


@register("outcomes", query("SELECT * FROM outcome", CALLS + "," + OUTCOMES))
def outcomes(spark, sf):
    """Every sample, with the stage and the reason of its failure, if it fails."""
    return C.outcomes(C.genotyped(spark, sf))


@register("validate_calls", query("SELECT * EXCLUDE (peaks) FROM valid", CALLS))
def validate_calls(spark, sf):
    return C.genotyped(spark, sf).valid.drop("peaks")


@register("final_genotype", query("""SELECT sample_id, state, pri, CASE WHEN state = 'homozygous' THEN pri ELSE sec END AS sec, pri_fod, CASE WHEN state = 'homozygous' THEN pri_fod ELSE sec_fod END AS sec_fod FROM (
SELECT v.sample_id, state, max(label) FILTER (WHERE v.allele = 'PRI') AS pri, max(label) FILTER (WHERE v.allele = 'SEC') AS sec, max(fod) FILTER (WHERE v.allele = 'PRI') AS pri_fod, max(fod) FILTER (WHERE v.allele = 'SEC') AS sec_fod
FROM valid v JOIN alleles a ON a.sample_id = v.sample_id AND a.allele = v.allele GROUP BY ALL)""", CALLS))
def final_genotype(spark, sf):
    c = C.genotyped(spark, sf)
    return G.final_genotype(c.valid, c.alleles)


@register("peak_metrics", query("SELECT * FROM mets", METRICS))
def peak_metrics(spark, sf):
    return M.peak_metrics(C.genotyped(spark, sf).bins)


@register("confidence_interval", query("""
, w AS (SELECT sample_id, allele, call, cag, CASE WHEN abs(cag - call) <= 10 THEN n ELSE trunc(n - n / 100.0::DOUBLE * 85)::BIGINT END AS w FROM bins),
s AS (SELECT sample_id, allele, call, sum(w)::BIGINT AS n, sum(w * cag)::BIGINT AS sx, sum(w * cag * cag)::BIGINT AS sxx, sum(w * cag)::DOUBLE / sum(w)::DOUBLE AS m FROM w GROUP BY ALL HAVING sum(w) > 1),
h AS (SELECT *, sqrt(greatest(0.0, (sxx - n * m * m) / (n - 1)) / n) * (1.959964::DOUBLE + ((1.959964::DOUBLE ** 3 + 1.959964::DOUBLE) / 4) / (n - 1) + ((5 * 1.959964::DOUBLE ** 5 + 16 * 1.959964::DOUBLE ** 3 + 3 * 1.959964::DOUBLE) / 96) / ((n - 1)::DOUBLE * (n - 1))) AS half FROM s),
r AS (SELECT *, round_even(m - half, 0)::INT AS lo, round_even(m + half, 0)::INT AS hi FROM h)
SELECT sample_id, allele, call, round(m, 6) AS mean, lo, hi, CASE WHEN lo = hi THEN CASE WHEN abs(hi - call) > 1 THEN lo || '-' || call WHEN abs(hi - call) = 1 THEN call || '-' || call ELSE lo || '-' || hi END
  WHEN call > hi THEN lo || '-' || call ELSE lo || '-' || hi END AS interval FROM r""", SLICES).replace("\n\n, w AS", ",\nw AS"))
def confidence_interval(spark, sf):
    return M.confidence_interval(C.genotyped(spark, sf).bins)


def _scored(spark, sf, starred=True):
    c = C.genotyped(spark, sf)
    return C.scored(c, C.evidence(c, starred))


@register("ccg_review", query("SELECT * FROM review", REVIEW))
def ccg_review(spark, sf):
    return C.ccg_review(C.genotyped(spark, sf))


@register("peak_review", query("SELECT * FROM peak", REVIEW))
def peak_review(spark, sf):
    c = C.genotyped(spark, sf)
    return E.peak_review(c.bins, c.valid, C.ccg_review(c))


@register("final_labels", query("SELECT * FROM labels", REVIEW))
def final_labels(spark, sf):
    """Without the stars of new sequences, which SQL can't find; starred_genotype has them."""
    c = C.genotyped(spark, sf)
    review = C.kept(C.ccg_review(c))
    return E.final_labels(c.alleles, c.valid, review, E.peak_review(c.bins, c.valid, review)).drop("novel")


@register("starred_genotype")
def starred_genotype(spark, sf):
    return C.evidence(C.genotyped(spark, sf)).labels


@register("penalty_events", query("SELECT * FROM events", SCORED))
def penalty_events(spark, sf):
    return M.penalty_events(_scored(spark, sf, starred=False))


@register("confidence", query("SELECT s.sample_id, s.allele, CASE WHEN status = 'Atypical' AND abs(fod - est_cag) > 1 THEN 0 ELSE greatest(0, least(100, 100 + coalesce(d, 0))) END::INT AS confidence FROM scored s LEFT JOIN (SELECT sample_id, allele, sum(delta) AS d FROM events GROUP BY ALL) e USING (sample_id, allele)", SCORED))
def confidence(spark, sf):
    return M.confidence(_scored(spark, sf, starred=False))


@register("confidence_subsampled", query("""
, f AS (SELECT *, CASE WHEN all_reads > 20000 THEN 0.35 WHEN all_reads > 15000 THEN 0.45 WHEN all_reads > 10000 THEN 0.55 WHEN all_reads > 5000 THEN 0.65 ELSE 0.2 END AS share, total / all_reads::DOUBLE AS q FROM scored),
e AS (SELECT sample_id, allele, sum(delta) FILTER (WHERE rule NOT IN (SELECT rule FROM late)) AS early, sum(delta) FILTER (WHERE rule IN (SELECT rule FROM late)) AS last FROM events GROUP BY ALL),
g AS (SELECT f.sample_id, f.allele, status, fod, est_cag, 100 + coalesce(early, 0) AS score, coalesce(last, 0) AS last, state,
  CASE WHEN all_reads > 10000 THEN 1 WHEN all_reads >= 5000 THEN CASE WHEN share <= 0.3 THEN 0.75 WHEN share <= 0.6 THEN 0.85 ELSE 0.95 END WHEN all_reads >= 2000 THEN CASE WHEN share <= 0.3 THEN 0.55 WHEN share <= 0.6 THEN 0.65 ELSE 0.70 END ELSE CASE WHEN share <= 0.3 THEN 0.35 WHEN share <= 0.6 THEN 0.40 ELSE 0.45 END END::DOUBLE AS factor,
  CASE WHEN abs(q - 0.55) <= 0.0500055 THEN 1 WHEN abs(q - 0.45) <= 0.0500045 THEN 5 WHEN abs(q - 0.35) <= 0.0500035 THEN 5 WHEN abs(q - 0.25) <= 0.0500025 THEN 7 WHEN abs(q - 0.15) <= 0.0500015 THEN 10 WHEN abs(q - 0.05) <= 0.0500005 THEN 15 ELSE 0 END AS minus FROM f LEFT JOIN e USING (sample_id, allele))
SELECT sample_id, allele, CASE WHEN status = 'Atypical' AND abs(fod - est_cag) > 1 THEN 0 ELSE trunc(greatest(0, least(100, CASE WHEN state = 'heterozygous' THEN score * factor - minus ELSE score END + last))) END::INT AS confidence FROM g""", SCORED).replace(")\n\n, f AS", "),\nf AS"))
def confidence_subsampled(spark, sf):
    """Scores as if the scan had kept the share of reads that its steps ask for, and a fifth of small samples."""
    reads = F.col("all_reads")
    share = F.lit(0.2)
    for least, kept in reversed(Q.SCAN_STEPS):
        share = F.when(reads > least, kept / 1000).otherwise(share)
    return M.confidence(_scored(spark, sf, starred=False).withColumn("share", share), "share")


_BASES = READS + """,
same AS (SELECT mate, seq, quality, count(*) AS n FROM reads GROUP BY ALL),
bases AS (SELECT mate, pos, base, quality AS q, sum(n)::BIGINT AS n FROM (SELECT mate, quality, n, generate_subscripts(string_split(seq, ''), 1) AS pos, unnest(string_split(seq, '')) AS base FROM same) GROUP BY ALL)"""


@register("base_quality", query("""SELECT mate, pos::INT AS pos, round(sum(q * n)::DOUBLE / sum(n), 6) AS mean, """ + ", ".join(f"min(q) FILTER (WHERE upto * 100 >= alls * {p}) AS p{p}" for p in (10, 25, 50, 75, 90)) + """
FROM (SELECT *, sum(n) OVER (PARTITION BY mate, pos ORDER BY q ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY mate, pos) AS alls FROM (SELECT mate, pos, q, sum(n) AS n FROM bases GROUP BY ALL)) GROUP BY mate, pos""", _BASES))
def base_quality(spark, sf):
    return Q.base_quality(Q.per_base(synth_reads(spark, sf)))


@register("base_content", query("SELECT mate, pos::INT AS pos, round(100.0::DOUBLE * coalesce(sum(n) FILTER (WHERE base = 'N'), 0) / sum(n), 6) AS n_pcnt, round(100.0::DOUBLE * coalesce(sum(n) FILTER (WHERE base IN ('G', 'C')), 0) / sum(n), 6) AS gc_pcnt FROM bases GROUP BY mate, pos", _BASES))
def base_content(spark, sf):
    return Q.base_content(Q.per_base(synth_reads(spark, sf)))


@register("length_histogram", query("SELECT mate, length(seq)::INT AS length, count(*) AS n FROM reads GROUP BY ALL", READS))
def length_histogram(spark, sf):
    return Q.length_histogram(synth_reads(spark, sf))


@register("basic_statistics", query("""SELECT *, CASE WHEN total < 100 THEN 'fail' WHEN gc NOT BETWEEN 30 AND 70 THEN 'warn' ELSE 'pass' END AS status FROM (
SELECT sample_id, mate, count(*) AS total, min(length(seq))::INT AS shortest, max(length(seq))::INT AS longest, round(100.0::DOUBLE * sum(length(seq) - length(translate(seq, 'GC', ''))) / sum(length(seq)), 6) AS gc FROM reads GROUP BY ALL)""", READS))
def basic_statistics(spark, sf):
    return Q.basic_statistics(synth_reads(spark, sf))


@register("quality_trim", """WITH r AS (SELECT row_number() OVER () AS rid, l_partkey, l_suppkey FROM lineitem),
v AS (SELECT rid, i, (l_partkey * 7 + i * l_suppkey) % 41 AS q FROM r, range(1, 21) g(i)),
s AS (SELECT *, sum(20 - q) OVER (PARTITION BY rid ORDER BY i DESC) AS t FROM v),
w AS (SELECT *, min(t) OVER (PARTITION BY rid ORDER BY i DESC) AS low FROM s),
b AS (SELECT rid, coalesce(arg_max(i - 1, t * 100 + i) FILTER (WHERE low >= 0 AND t > 0), 20)::INT AS kept FROM w GROUP BY ALL)
SELECT kept, count(*) AS n FROM b GROUP BY kept""")
def quality_trim(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey")
    quality = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: ((F.col("l_partkey") * 7 + i * F.col("l_suppkey")) % 41).cast("int"))
    return rows.select(quality.alias("q")).select(Q.quality_cut(F.col("q"), 20).alias("kept")).groupBy("kept").agg(F.count(F.lit(1)).alias("n"))


@register("adapter_trim", query(f"SELECT sample_id, mate, count(*) FILTER (WHERE instr(seq, '{THREE_PRIME[:16]}') > 0) AS reads_trimmed, sum(CASE WHEN instr(seq, '{THREE_PRIME[:16]}') > 0 THEN length(seq) - instr(seq, '{THREE_PRIME[:16]}') + 1 ELSE 0 END)::BIGINT AS bases_removed FROM reads GROUP BY ALL", READS))
def adapter_trim(spark, sf):
    return Q.trim_report(Q.trim_adapter(synth_reads(spark, sf), three=THREE_PRIME[:16]))


@register("adapter_trim_fuzzy")
def adapter_trim_fuzzy(spark, sf):
    return Q.trim_report(Q.trim_adapter_fuzzy(synth_reads(spark, sf), THREE_PRIME[:16]))


@register("demultiplex", query(f"SELECT sample_id, length(part)::INT AS length, count(*) AS n FROM (SELECT sample_id, substr(seq, instr(seq, '{FIVE_PRIME[-12:]}') + 12, instr(seq, '{THREE_PRIME[:12]}') - instr(seq, '{FIVE_PRIME[-12:]}') - 12) AS part FROM reads WHERE instr(seq, '{FIVE_PRIME[-12:]}') > 0) WHERE length(part) BETWEEN 80 AND 160 GROUP BY ALL", READS))
def demultiplex(spark, sf):
    parts = Q.demultiplex(synth_reads(spark, sf), FIVE_PRIME[-12:], THREE_PRIME[:12], 80, 160)
    return parts.groupBy("sample_id", F.length("part").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def _shares(steps):
    return "CASE " + " ".join(f"WHEN count(*) >= {least} THEN {kept}" for least, kept in steps) + " ELSE 1000 END"


@register("subsample", query(f"SELECT r.sample_id, mate, count(*) AS n FROM reads r JOIN (SELECT sample_id, {_shares([(1000, 500), (500, 750)])} AS share FROM reads GROUP BY 1) s USING (sample_id) WHERE ('0x' || substr(md5(read_id::VARCHAR), 1, 8))::BIGINT % 1000 < share GROUP BY ALL", READS))
def subsample(spark, sf):
    return Q.subsample(synth_reads(spark, sf), [(1000, 500), (500, 750)]).groupBy("sample_id", "mate").agg(F.count(F.lit(1)).alias("n"))


@register("reference_library", f"SELECT cag::INT AS cag, ccg::INT AS ccg, cag || '_1_1_' || ccg || '_2' AS label, md5('{FIVE_PRIME}' || repeat('CAG', cag) || '{TYPICAL}' || repeat('CCG', ccg) || 'CCTCCT{THREE_PRIME}') AS seq_md5 FROM range(1, 201) a(cag), range(1, 21) c(ccg)")
def reference_library(spark, sf):
    return R.typical_library(spark).select("cag", "ccg", "label", F.md5("seq").alias("seq_md5"))


@register("realign_atypical", query("SELECT al.sample_id, al.allele, a.mate, (a.ccg + floor((length(a.intervening) - length(al.intervening)) / 3.0))::INT AS ccg, a.cag, sum(a.n)::BIGINT AS n FROM assigned a JOIN alleles al ON al.sample_id = a.sample_id AND al.status = 'Atypical' WHERE a.cag BETWEEN 1 AND 200 AND (a.ccg + floor((length(a.intervening) - length(al.intervening)) / 3.0)) BETWEEN 1 AND 20 GROUP BY ALL", PAIRS))
def realign_atypical(spark, sf):
    """Histograms of atypical alleles, to a library of their own."""
    return R.realign(C.assigned(spark, sf), C.alleles(spark, sf))


_PILE = SCAN + """,
rd AS (SELECT sample_id || '_' || contig_cag || '_' || contig_ccg AS contig, seq, sum(n)::BIGINT AS k FROM (SELECT t.sample_id, t.seq, t.n, t.a[1] AS cag, (c[1] + floor((length(replace(substr(frames, ((a[2] + a[1]) * 4 + 1)::BIGINT, (greatest(c[2] - a[2] - a[1], 0) * 4)::BIGINT), ' ', '')) - 12) / 3.0))::INT AS ccg2,
   a[1]::INT AS contig_cag, (c[1] + floor((length(replace(substr(frames, ((a[2] + a[1]) * 4 + 1)::BIGINT, (greatest(c[2] - a[2] - a[1], 0) * 4)::BIGINT), ' ', '')) - 12) / 3.0))::INT AS contig_ccg FROM three t WHERE t.t[1] > 0)
   WHERE cag BETWEEN 1 AND 200 AND ccg2 BETWEEN 1 AND 20 GROUP BY ALL),
md AS (SELECT contig, seq AS ref_seq FROM rd QUALIFY row_number() OVER (PARTITION BY contig ORDER BY k DESC, seq) = 1)"""


@register("pileup", query("""SELECT contig, pos::INT AS pos, substr(ref_seq, pos, 1) AS ref, substr(seq, pos, 1) AS alt, sum(k)::BIGINT AS n FROM (
 SELECT u.contig, u.seq, u.k, ref_seq, unnest(range(1, length(u.seq) + 1)) AS pos FROM rd u JOIN md USING (contig) WHERE length(u.seq) = length(ref_seq) AND u.seq <> ref_seq)
WHERE substr(seq, pos, 1) <> substr(ref_seq, pos, 1) GROUP BY ALL HAVING sum(k) >= 2""", _PILE))
def pileup(spark, sf):
    """Against the consensus of each contig of each sample."""
    reads = assign_contigs(scan_tracts(synth_reads(spark, sf), keep_seq=True)).where("contig_cag IS NOT NULL")
    same = reads.groupBy(F.concat_ws("_", "sample_id", "contig_cag", "contig_ccg").alias("contig"), "seq").agg(F.sum("n").alias("k"))
    modal = same.groupBy("contig").agg(F.min(F.struct(-F.col("k"), "seq"))["seq"].alias("seq"))
    return V.pileup(same, modal)


_REPORT = ["genotype", "status", "fw_count", "fw_mapped", "fw_purged", "rv_count", "rv_mapped", "rv_purged", "slippage", "mosaicism", "intervening", "confidence"]
_FLAGS = {"homozygous_haplotype": "state = 'homozygous'", "neighbouring_peaks": "state = 'neighbouring'", "diminished_peaks": "diminished", "alignment_warning": "alignment_warning", "atypical_alignment_warning": "atypical_warning",
          "ccg_rewritten": "ccg_rewritten", "ccg_zygosity_rewritten": "zygosity_rewritten", "ccg_uncertainty": "ccg_uncertain", "cct_uncertainty": "cct_uncertain", "svm_failure": "svm_failure", "differential_confusion": "diff_confuse",
          "missed_expansion": "missed_expansion", "heuristic_success": "heuristic_ok", "peak_inspection": "minus_level = 6 OR plus_level = 6 OR unexpected", "low_distribution_reads": "low_reads", "low_peak_reads": "fatal_low"}


def _report_sql():
    name = {"fw_count": "map_fw", "fw_mapped": "map_fw_pcnt", "fw_purged": "purged_fw", "rv_count": "map_rv", "rv_mapped": "map_rv_pcnt", "rv_purged": "purged_rv"}
    value = lambda c: f"round({c}, 3)" if c.endswith("mapped") else c
    columns = ", ".join(f"coalesce(max({value(c)}::VARCHAR) FILTER (WHERE allele = '{who}'), 'FAIL') AS {who.lower()}_{name.get(c, c)}" for who in ("PRI", "SEC") for c in _REPORT)
    text = ", ".join(f"coalesce(max(v.text) FILTER (WHERE allele = '{who}'), 'FAIL') AS {who.lower()}_variant_call, coalesce(round(max(v.score) FILTER (WHERE allele = '{who}'), 4)::VARCHAR, 'FAIL') AS {who.lower()}_variant_score" for who in ("PRI", "SEC"))
    flags = ", ".join(f"CASE WHEN bool_or({c}) THEN 'True' ELSE 'False' END AS {n}" for n, c in _FLAGS.items())
    conf = "conf AS (SELECT s.sample_id, s.allele, CASE WHEN status = 'Atypical' AND abs(fod - est_cag) > 1 THEN 0 ELSE greatest(0, least(100, 100 + coalesce(d, 0))) END::INT AS confidence FROM scored s LEFT JOIN (SELECT sample_id, allele, sum(delta) AS d FROM events GROUP BY ALL) e USING (sample_id, allele))"
    own = VARIANTS[len(PAIRS) :]  # what it has besides the alleles
    ctes = SCORED + own + f",\nvt AS (SELECT sample_id, allele, string_agg(ref || '->' || alt || '@' || pos, '   ' ORDER BY qual DESC, pos) AS text, max(qual) AS score FROM k GROUP BY ALL),\n{conf},{OUTCOMES},\nrep AS (SELECT sample_id, {columns}, {text}, {flags} FROM scored JOIN conf USING (sample_id, allele) LEFT JOIN vt v USING (sample_id, allele) WHERE sample_id IN (SELECT sample_id FROM outcome WHERE stage IS NULL) GROUP BY sample_id)"
    return query("SELECT o.sample_id, coalesce(stage, 'N/A') AS exception, coalesce(COLUMNS(r.* EXCLUDE (sample_id)), 'FAIL') FROM outcome o LEFT JOIN rep r USING (sample_id)", ctes)


@register("instance_report", _report_sql())
def instance_report(spark, sf):
    """By exact counts, as SQL can't find the stars of new sequences; sample_reports has them."""
    c = C.genotyped(spark, sf)
    scored = C.kept(C.scored(c, C.evidence(c, False)).withColumns({c: F.round(c, 3) for c in ("fw_mapped", "rv_mapped")}))
    variants = V.variant_text(C.allele_variants(c, 20.0)).withColumn("score", F.round("score", 4))
    return T.instance_report(scored, M.confidence(scored), variants, C.outcomes(c)).drop("novel_atypical")


@register("sample_reports")
def sample_reports(spark, sf):
    c = C.genotyped(spark, sf)
    scored = C.kept(C.scored(c, C.evidence(c)))
    return T.instance_report(scored, M.confidence(scored), V.variant_text(C.allele_variants(c, 20.0)), C.outcomes(c))


@register("simplified_report")
def simplified_report(spark, sf):
    c = C.genotyped(spark, sf)
    return T.simplified_report(C.evidence(c).labels, M.confidence_interval(c.bins))


@register("allele_reports")
def allele_reports(spark, sf):
    scored = C.kept(_scored(spark, sf))
    return T.allele_reports(scored, M.confidence(scored))


@register("inspection_logs")
def inspection_logs(spark, sf):
    return T.inspection_logs(_scored(spark, sf))


@register("cohort_sizes", query("SELECT t.tract, g.size::INT AS size, count(a.size) AS n FROM (VALUES ('cag', 200), ('ccg', 20)) t(tract, most) JOIN range(1, 201) g(size) ON g.size <= most LEFT JOIN (SELECT 'cag' AS tract, est_cag AS size FROM alleles UNION ALL SELECT 'ccg', est_ccg FROM alleles) a ON a.tract = t.tract AND a.size = g.size GROUP BY ALL", PAIRS))
def cohort_sizes(spark, sf):
    return T.cohort_sizes(C.alleles(spark, sf))


@register("sample_documents", query("""SELECT sample_id, '[' || string_agg('{"allele":"' || allele || '","label":"' || label || '","status":"' || status || '"}', ',' ORDER BY allele) || ']' AS document FROM alleles GROUP BY sample_id""", PAIRS))
def sample_documents(spark, sf):
    return T.sample_documents(C.alleles(spark, sf))


@register("l2_normalise", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS squares, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def l2_normalise(spark, sf):
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.round(squares, 4).alias("squares"), F.round(F.get("embedding", 0).cast("double") / F.sqrt(squares), 6).alias("first"))


@register("fullest_ccg", query("SELECT sample_id, arg_max(ccg, total * 1000 - ccg) AS ccg, max(total) AS total FROM (SELECT sample_id, allele, ccg, sum(n)::BIGINT AS total FROM (SELECT b.*, a.ccg FROM bins b JOIN asked a USING (sample_id, allele)) GROUP BY ALL) GROUP BY sample_id", SLICES))
def fullest_ccg(spark, sf):
    """The CCG of the two alleles' slices that holds more reads; the lower if equal."""
    totals = C.genotyped(spark, sf).bins.groupBy("sample_id", "allele", "ccg").agg(F.sum("n").alias("total"))
    best = totals.groupBy("sample_id").agg(F.max(F.struct("total", (-F.col("ccg")).alias("k"))).alias("m"))
    return best.select("sample_id", (-F.col("m.k")).alias("ccg"), F.col("m.total").alias("total"))


@register("contig_view", query("SELECT sample_id, mate, read_id, length(seq)::INT AS length FROM reads QUALIFY row_number() OVER (PARTITION BY sample_id, mate ORDER BY read_id, mapq, quality, seq) BETWEEN 2 AND 44", READS))
def contig_view(spark, sf):
    """What a page shows of the reads of each sample and mate: the second to the 44th."""
    w = Window.partitionBy("sample_id", "mate").orderBy("read_id", "mapq", "quality", "seq")
    return synth_reads(spark, sf).withColumn("k", F.row_number().over(w)).where("k BETWEEN 2 AND 44").select("sample_id", "mate", "read_id", F.length("seq").alias("length"))


@register("custom_library", query("SELECT origin, cag::INT AS cag, ccg::INT AS ccg, cag || '_' || k1 || '_' || k2 || '_' || ccg || '_' || cct AS label, md5('" + FIVE_PRIME + "' || repeat('CAG', cag) || mid || repeat('CCG', ccg) || repeat('CCT', cct) || '" + THREE_PRIME + "') AS seq_md5 FROM (SELECT *, len(regexp_extract_all(mid, 'CAACAG')) AS k1, len(regexp_extract_all(replace(mid, 'CAACAG', ''), 'CCGCCA')) AS k2 FROM (SELECT DISTINCT 'custom' AS origin, intervening AS mid, est_cct AS cct FROM alleles WHERE status = 'Atypical' UNION ALL SELECT 'typical', 'CAACAGCCGCCA', 2)), range(1, 201) a(cag), range(1, 21) c(ccg)", PAIRS))
def custom_library(spark, sf):
    return R.whole_library(spark, C.alleles(spark, sf)).select("origin", "cag", "ccg", "label", F.md5("seq").alias("seq_md5"))


@register("label_numbers", query("SELECT sample_id, allele, split_part(label, '_', 1)::INT AS cag, split_part(label, '_', 2)::INT AS caacag, split_part(label, '_', 3)::INT AS ccgcca, split_part(label, '_', 4)::INT AS ccg, split_part(label, '_', 5)::INT AS cct FROM alleles", PAIRS))
def label_numbers(spark, sf):
    """The sizes that a label tells, whatever stars it has."""
    part = lambda k: F.regexp_extract(F.split_part("label", F.lit("_"), F.lit(k)), r"\d+", 0).cast("int")
    return C.alleles(spark, sf).select("sample_id", "allele", *[part(k).alias(n) for k, n in enumerate(("cag", "caacag", "ccgcca", "ccg", "cct"), 1)])


@register("motif_spans", query("SELECT sample_id, allele, len(regexp_extract_all(intervening, 'CCGCCA')) AS n, instr(intervening, 'CCGCCA') - 1 AS first, CASE WHEN contains(intervening, 'CCGCCA') THEN length(regexp_extract(intervening, '.*CCGCCA')) ELSE 0 END AS past FROM alleles", PAIRS))
def motif_spans(spark, sf):
    """How often a motif stands in the sequence between the tracts, where it first begins (-1: nowhere) and where it last ends."""
    m = F.col("intervening")
    return C.alleles(spark, sf).select("sample_id", "allele", F.regexp_count(m, F.lit("CCGCCA")).cast("long").alias("n"), (F.instr(m, "CCGCCA") - 1).cast("long").alias("first"), F.length(F.regexp_extract(m, ".*CCGCCA", 0)).cast("long").alias("past"))


@register("mates_together", query("SELECT sample_id, ccg, sum(n)::BIGINT AS n FROM (SELECT s.sample_id, g.ccg::INT AS ccg, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT sample_id FROM hist) s CROSS JOIN range(1, 21) g(ccg) LEFT JOIN hist h ON h.sample_id = s.sample_id AND h.ccg = g.ccg) GROUP BY ALL"))
def mates_together(spark, sf):
    """Both mates' CCG vectors, added bin by bin."""
    ccgs = C.histogram(spark, sf).groupBy("sample_id", "mate", "ccg").agg(F.sum("n").alias("n"))
    vector = lambda mate: E.vector(H.densify(ccgs.where(F.col("mate") == mate).drop("mate"), ["sample_id"], "ccg", 20), ["sample_id"], "ccg", "n", mate)
    none = F.array_repeat(F.lit(0).cast("long"), 20)
    both = vector("R1").join(vector("R2"), "sample_id", "full").select("sample_id", F.zip_with(F.coalesce("R1", none), F.coalesce("R2", none), lambda a, b: a + b).alias("v"))
    return both.select("sample_id", F.posexplode("v").alias("i", "n")).select("sample_id", (F.col("i") + 1).alias("ccg"), "n")


@register("slice_maps", query("SELECT sample_id, ccg, sum(n)::BIGINT AS n FROM fw GROUP BY ALL"))
def slice_maps(spark, sf):
    """Each CCG's slice of a sample is an entry of one map; here summed again."""
    slices = C.forward(spark, sf).groupBy("sample_id", "ccg").agg(F.sum("n").alias("n"))
    maps = slices.groupBy("sample_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ccg", "n")))).alias("m"))
    return maps.select("sample_id", F.explode("m").alias("ccg", "n"))


@register("distinct_labels", query("SELECT label, min(sample_id * 2 + CASE allele WHEN 'PRI' THEN 0 ELSE 1 END)::INT AS first FROM alleles GROUP BY label", PAIRS))
def distinct_labels(spark, sf):
    """The labels of a cohort, with the place at which each first occurs."""
    place = F.col("sample_id") * 2 + F.when(F.col("allele") == "PRI", 0).otherwise(1)
    return C.alleles(spark, sf).groupBy("label").agg(F.min(place).cast("int").alias("first"))


@register("demultiplex_fuzzy")
def demultiplex_fuzzy(spark, sf):
    parts = Q.demultiplex_fuzzy(synth_reads(spark, sf), FIVE_PRIME[-12:], THREE_PRIME[:12], 80, 160)
    return parts.groupBy("sample_id", F.length("part").alias("length")).agg(F.count(F.lit(1)).alias("n"))


@register("trim_both", query(f"""SELECT mate, length(CASE WHEN instr(s, '{THREE_PRIME[:16]}') > 0 THEN substr(s, 1, instr(s, '{THREE_PRIME[:16]}') - 1) ELSE s END)::INT AS length, count(*) AS n FROM (
SELECT mate, substr(seq, 1, CASE WHEN quality < 20 THEN 0 ELSE length(seq) END) AS s FROM reads) GROUP BY ALL""", READS))
def trim_both(spark, sf):
    """Quality first, then the adapter. A read of one quality stays or goes whole."""
    reads = synth_reads(spark, sf).groupBy("mate", "seq", "quality").agg(F.count(F.lit(1)).alias("n")).withColumn("q", F.array_repeat("quality", F.length("seq")))
    return Q.trim(reads, "Both", 20, three=THREE_PRIME[:16]).groupBy("mate", F.length("trimmed").alias("length")).agg(F.sum("n").alias("n"))


@register("trim_anchored", query(f"SELECT sample_id, mate, count(*) FILTER (WHERE seq LIKE '{FIVE_PRIME[:10]}%') AS reads_trimmed, (10 * count(*) FILTER (WHERE seq LIKE '{FIVE_PRIME[:10]}%'))::BIGINT AS bases_removed FROM reads GROUP BY ALL", READS))
def trim_anchored(spark, sf):
    return Q.trim_report(Q.trim_adapter(synth_reads(spark, sf), five=FIVE_PRIME[:10], anchored=True))


@register("trim_either", query(f"SELECT sample_id, mate, count(*) FILTER (WHERE k > 0) AS reads_trimmed, sum(CASE k WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE length(seq) - k + 1 END)::BIGINT AS bases_removed FROM (SELECT *, instr(seq, CASE mate WHEN 'R1' THEN '{FIVE_PRIME[:10]}' ELSE '{THREE_PRIME[:10]}' END) AS k FROM reads) GROUP BY ALL", READS))
def trim_either(spark, sf):
    """An adapter of each mate, at whichever end it is."""
    return Q.trim_report(Q.trim_by_flag(synth_reads(spark, sf), "-b", FIVE_PRIME[:10], THREE_PRIME[:10]))


@register("trim_mates", query(f"SELECT sample_id, mate, count(*) FILTER (WHERE instr(seq, a) > 0) AS reads_trimmed, sum(CASE WHEN instr(seq, a) > 0 THEN length(seq) - instr(seq, a) + 1 ELSE 0 END)::BIGINT AS bases_removed FROM (SELECT *, CASE mate WHEN 'R1' THEN '{THREE_PRIME[:16]}' ELSE '{THREE_PRIME[8:24]}' END AS a FROM reads) GROUP BY ALL", READS))
def trim_mates(spark, sf):
    return Q.trim_report(Q.trim_mates(synth_reads(spark, sf), THREE_PRIME[:16], THREE_PRIME[8:24]))


@register("interval_jitter")
def interval_jitter(spark, sf):
    c = C.genotyped(spark, sf)
    return M.jittered_interval(M.confidence_interval(c.bins), M.confidence(C.scored(c, C.evidence(c)))).select("sample_id", "allele", "lo", "hi", "interval")


@register("library_counts", query("SELECT h.sample_id, h.mate, h.cag || '_1_1_' || h.ccg || '_2' AS label, length('" + FIVE_PRIME + TYPICAL + THREE_PRIME + "CCTCCT') + 3 * (h.cag + h.ccg) AS length, h.n FROM hist h"))
def library_counts(spark, sf):
    """Reads of each library entry, by an equi-join of bins with the library."""
    entries = R.typical_library(spark).select("cag", "ccg", "label", F.length("seq").cast("long").alias("length"))
    return C.histogram(spark, sf).join(entries, ["cag", "ccg"]).select("sample_id", "mate", "label", "length", "n")


@register("scan_subsample", query(f"SELECT r.sample_id, mate, count(*) AS n FROM reads r JOIN (SELECT sample_id, {_shares([(2000, 350), (1500, 450), (1000, 550), (500, 650)])} AS share FROM reads GROUP BY 1) s USING (sample_id) WHERE ('0x' || substr(md5(read_id::VARCHAR), 1, 8))::BIGINT % 1000 < share GROUP BY ALL", READS))
def scan_subsample(spark, sf):
    """The steps of a scan's subsample, at a tenth of their numbers of reads."""
    steps = [(least // 10, kept) for least, kept in Q.SCAN_STEPS]
    return Q.subsample(synth_reads(spark, sf), steps).groupBy("sample_id", "mate").agg(F.count(F.lit(1)).alias("n"))


@register("nearest_contig")
def nearest_contig(spark, sf):
    """For each allele's label the contig of its sample whose name is most like it."""
    from amplitract.functions.fuzzy import nearest_contig as nearest

    wanted = C.alleles(spark, sf).select("sample_id", "label").distinct()
    contigs = C.forward(spark, sf).select("sample_id", F.concat_ws("_", "cag", F.lit("1_1"), "ccg", F.lit("2")).alias("contig"), "n")
    return nearest(wanted, contigs)


@register("sample_defaults", query("SELECT a.sample_id, a.allele, coalesce(CASE WHEN status = 'Atypical' THEN at_call END, whole)::BIGINT AS mapped FROM valid v JOIN alleles a USING (sample_id, allele) JOIN (SELECT sample_id, sum(n) AS whole FROM fw GROUP BY 1) s ON s.sample_id = a.sample_id", CALLS))
def sample_defaults(spark, sf):
    """Mapped reads: an atypical allele's own, the sample's for a typical one."""
    c = C.genotyped(spark, sf)
    own = c.valid.join(c.alleles.select(*G.SLICE, "status"), G.SLICE).select(*G.SLICE, F.when(F.col("status") == "Atypical", F.col("at_call")).alias("mapped"))
    return T.with_sample_values(own, c.hist.groupBy("sample_id").agg(F.sum("n").alias("mapped")), ["mapped"])


from amplitract import aligned_queries, learned_queries, more_queries  # noqa: E402,F401  they register themselves
