"""DuckDB SQL for the registered queries: shared CTEs, put in front of a query's own SELECT."""

from __future__ import annotations

from amplitract.sources.reads import FIVE_PRIME, FIVE_PRIME_SNPS, SAMPLE_COLUMNS, SAMPLES, THREE_PRIME, THREE_PRIME_SNP, TYPICAL, sample_values, slip_case

READS = f"""
truth AS (SELECT * FROM (VALUES {sample_values()}) t({SAMPLE_COLUMNS})),
picked AS (
  SELECT *, (l_suppkey % {len(SAMPLES)})::INT AS sid, l_orderkey % 100 < split AS one, l_partkey % 100 AS p,
    l_orderkey % 100 < split AND (l_suppkey % {len(SAMPLES)} = 4 OR (l_suppkey % {len(SAMPLES)} = 17 AND l_orderkey % 2 = 0)) AS snps
  FROM lineitem JOIN truth ON sample_id = l_suppkey % {len(SAMPLES)} WHERE (l_partkey * 31 + l_orderkey) % 100 < present
),
reads AS (
  SELECT sid AS sample_id, l_orderkey * 10 + l_linenumber AS read_id, CASE WHEN l_linenumber % 4 = 0 THEN 'R2' ELSE 'R1' END AS mate,
    CASE WHEN l_partkey % 50 = 7 THEN 0 ELSE 60 END AS mapq, l_quantity::INT AS quality,
    (CASE WHEN sid = 18 THEN repeat('A', (l_linenumber % 3)::INT) ELSE '' END) || CASE WHEN snps THEN '{FIVE_PRIME_SNPS}' WHEN l_partkey % 50 = 3 THEN '{FIVE_PRIME[:9]}A{FIVE_PRIME[10:]}' ELSE '{FIVE_PRIME}' END ||
    repeat('CAG', (CASE WHEN one THEN cag1 + {slip_case("slip1", "p")} ELSE cag2 + {slip_case("slip2", "p")} END)::BIGINT) ||
    (CASE WHEN one THEN mid1 ELSE mid2 END) || repeat('CCG', CASE WHEN one THEN ccg1 ELSE ccg2 END + CASE WHEN l_linenumber % 4 <> 0 THEN 0 WHEN one THEN rv1 ELSE rv2 END) ||
    repeat('CCT', CASE WHEN one THEN cct1 ELSE cct2 END) || CASE WHEN snps THEN '{THREE_PRIME_SNP}' ELSE '{THREE_PRIME}' END AS seq
  FROM picked
)"""


def _flags(mask: str) -> str:
    return f"regexp_replace(replace(frames, '{mask} ', '1'), '[A-Z]{{3}} ', '0', 'g')"


def _tract(name: str, masks: tuple[str, ...]) -> str:
    one = lambda k, m: f"SELECT length(regexp_extract({_flags(m)}, '111+(?:011+)*')) AS n, {k} AS k, instr({_flags(m)}, '111') - 1 AS start"
    return f"(SELECT [n, start] FROM ({' UNION ALL '.join(one(k, m) for k, m in enumerate(masks))}) ORDER BY n DESC, k LIMIT 1) AS {name}"


def _after(masks: tuple[str, ...]) -> str:
    rest = lambda m: f"substr({_flags(m)}, (c[1] + c[2] + 1)::BIGINT)"
    one = lambda k, m: f"SELECT length(regexp_extract({rest(m)}, '1+')) AS n, {k} AS k, c[1] + c[2] + instr({rest(m)}, '1') - 1 AS start"
    return f"(SELECT [n, start] FROM ({' UNION ALL '.join(one(k, m) for k, m in enumerate(masks))}) ORDER BY n DESC, k LIMIT 1) AS t"


def scan_of(source: str) -> str:
    """Reads of a table or subquery, scanned, with their bins."""
    return (
        READS
        + f""",
uniq AS (SELECT sample_id, mate, seq, count(*) AS n FROM {source} WHERE mapq >= 1 GROUP BY ALL),
framed AS (SELECT *, regexp_replace(substr(seq, 1, length(seq) - length(seq) % 3), '(...)', '\\1 ', 'g') AS frames FROM uniq),
two AS (SELECT *, {_tract("a", ("CAG", "AGC", "GCA"))}, {_tract("c", ("CCG", "CGC", "GCC"))} FROM framed),
three AS (SELECT *, {_after(("CCT", "CTC", "TCC"))} FROM two WHERE a[1] > 0 AND c[1] > 0),
scanned AS (
  SELECT sample_id, mate, n, a[1]::INT AS cag, c[1]::INT AS ccg, t[1]::INT AS cct,
    replace(substr(frames, ((a[2] + a[1]) * 4 + 1)::BIGINT, (greatest(c[2] - a[2] - a[1], 0) * 4)::BIGINT), ' ', '') AS intervening,
    replace(substr(frames, 1, (greatest(a[2] - 1, 0) * 4)::BIGINT), ' ', '') AS five,
    replace(substr(frames, ((t[2] + t[1]) * 4 + 1)::BIGINT), ' ', '') AS three
  FROM three WHERE t[1] > 0
),
placed AS (SELECT *, (ccg + floor((length(intervening) - {len(TYPICAL)}) / 3.0))::INT AS ccg2 FROM scanned),
assigned AS (SELECT *, CASE WHEN cag BETWEEN 1 AND 200 AND ccg2 BETWEEN 1 AND 20 THEN cag END AS contig_cag,
                       CASE WHEN cag BETWEEN 1 AND 200 AND ccg2 BETWEEN 1 AND 20 THEN ccg2 END AS contig_ccg FROM placed),
hist AS (SELECT sample_id, mate, contig_ccg AS ccg, contig_cag AS cag, sum(n)::BIGINT AS n FROM assigned WHERE contig_cag IS NOT NULL GROUP BY ALL),
fw AS (SELECT sample_id, ccg, cag, n FROM hist WHERE mate = 'R1'),
ccgs AS (SELECT sample_id, ccg, sum(n)::BIGINT AS n FROM fw GROUP BY ALL),
modal AS (SELECT sample_id, ccg AS call FROM ccgs QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, ccg) = 1),
dense AS (SELECT s.sample_id, b.ccg::INT AS ccg, coalesce(c.n, 0)::BIGINT AS n, m.call
          FROM (SELECT DISTINCT sample_id FROM ccgs) s CROSS JOIN range(1, 21) b(ccg) LEFT JOIN ccgs c ON c.sample_id = s.sample_id AND c.ccg = b.ccg JOIN modal m ON m.sample_id = s.sample_id)"""
    )


SCAN = scan_of("reads")


def query(select: str, ctes: str = SCAN) -> str:
    return f"WITH {ctes.strip()}\n{select}"


def _rank_cte(name: str, column: str) -> str:
    return f"""
{name}_k AS (SELECT sample_id, cag, ccg, {column} AS v, sum(n)::BIGINT AS k FROM crows GROUP BY ALL),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, cag, ccg ORDER BY k DESC, v) AS r FROM {name}_k),
{name} AS (SELECT sample_id, cag, ccg, max(v) FILTER (WHERE r = 1) AS v1, max(k) FILTER (WHERE r = 1) AS n1, max(v) FILTER (WHERE r = 2) AS v2, max(k) FILTER (WHERE r = 2) AS n2 FROM {name}_r GROUP BY ALL)"""


def _rotations(s: str) -> str:
    hit = [f"(SELECT count(*) FROM range(1, 13) g(i) WHERE substr({s} || {s}, (i + {k})::BIGINT, 1) <> substr('{TYPICAL}', i, 1)) <= 1" for k in range(12)]
    return f"(length({s}) = 12 AND ({' OR '.join(hit)}))"


TOP = (
    SCAN
    + """,
top3 AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, cag, ccg) AS rank FROM fw QUALIFY rank <= 3),
ranked AS (SELECT sample_id, """
    + ", ".join(f"max({c}) FILTER (WHERE rank = {r}) AS {x}_{c}" for r, x in ((1, "a"), (2, "b"), (3, "t")) for c in ("cag", "ccg", "n"))
    + " FROM top3 GROUP BY sample_id)"
)

CONSENSUS = (
    TOP
    + f""",
crows0 AS (SELECT a.sample_id, contig_cag AS cag, contig_ccg AS ccg, a.cag AS ea, a.ccg AS ec, cct AS et, intervening AS m, five AS ef, three AS eh, sum(a.n)::BIGINT AS n
  FROM assigned a JOIN top3 p ON p.sample_id = a.sample_id AND p.cag = contig_cag AND p.ccg = contig_ccg WHERE mate = 'R1' GROUP BY ALL),
crows AS (SELECT *, CASE WHEN {_rotations("m")} THEN '{TYPICAL}' ELSE m END AS mid FROM crows0),
ctotal AS (SELECT sample_id, cag, ccg, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE mid = '{TYPICAL}'), 0)::BIGINT AS typical FROM crows GROUP BY ALL),"""
    + ",".join(_rank_cte(n, c) for n, c in (("ra", "ea"), ("rc", "ec"), ("rt", "et"), ("rm", "mid"), ("rf", "ef"), ("rh", "eh")))
    + """,
summary0 AS (SELECT t.*, total - typical AS atypical, ra.v1 AS est_cag, rc.v1 AS est_ccg, rf.v1 AS five, rh.v1 AS three, rt.n1 < 0.6::DOUBLE * total AS cct_uncertain,
    CASE WHEN abs(rt.n1 / rt.n2 - 2.0) <= 0.30002 THEN 2 ELSE rt.v1 END AS est_cct, rm.v1 AS m1, rm.v2 AS m2, rm.n1 AS k1, rm.n2 AS k2
  FROM ctotal t JOIN ra USING (sample_id, cag, ccg) JOIN rc USING (sample_id, cag, ccg) JOIN rt USING (sample_id, cag, ccg) JOIN rm USING (sample_id, cag, ccg)
  JOIN rf USING (sample_id, cag, ccg) JOIN rh USING (sample_id, cag, ccg)),
summary1 AS (SELECT *, CASE WHEN atypical > typical OR est_cct <> 2 THEN 'Atypical' ELSE 'Typical' END AS status FROM summary0),
summary AS (SELECT sample_id, cag, ccg, total, typical, atypical, round(typical * 100.0::DOUBLE / total, 2) AS typical_pcnt, round(atypical * 100.0::DOUBLE / total, 2) AS atypical_pcnt,
    est_cag, est_ccg, est_cct,
    CASE WHEN length(m1) = 15 AND substr(m1, 1, 3) SIMILAR TO '(CA[^G]|C[^A]G|[^C]AG|CG.|.CA|A?AG.|.CG|AG.)' AND 100.0 * (k1 - k2) / k1 < 30 THEN 'CAACAGCCGCCA'
         WHEN status = 'Typical' AND k1 = 1 THEN 'CAACAGCCGCCA'
         WHEN status = 'Atypical' THEN m1
         WHEN m2 IS NULL THEN m1
         WHEN length(m2) > length(m1) THEN m2
         ELSE 'CAACAGCCGCCA' END AS intervening,
    five, three, status, abs(typical - atypical) <= 0.05 * typical AS balance_failed, cct_uncertain FROM summary1)"""
)


#: Written from the decision table, apart from the operator's own list of rules.
PAIRS = (
    CONSENSUS
    + """,
diffs AS (SELECT *, a_ccg = b_ccg AND b_ccg = t_ccg AS u, abs(a_cag - b_cag) AS dab, abs(b_cag - t_cag) AS dbt, abs(a_cag - t_cag) AS dat, abs(a_n - b_n) / a_n AS pab, abs(b_n - t_n) / b_n AS pbt FROM ranked WHERE t_n IS NOT NULL),
fired AS (
  SELECT sample_id, 101 AS no, 'u1a' AS rule, 'b' AS target, true AS near, false AS mixed FROM diffs WHERE u AND dab = 1 AND dbt <> 1 AND dat = 1 AND pbt BETWEEN 0.6499925 AND 0.8500075
  UNION ALL SELECT sample_id, 102, 'u1b', 'copy', false, pab < 0.199997 OR pab > 0.400003 FROM diffs WHERE u AND dab = 1 AND dbt <> 1 AND dat = 1 AND pbt > 0 AND pbt <= 0.64
  UNION ALL SELECT sample_id, 103, 'u1c', 't', false, false FROM diffs WHERE u AND dab = 1 AND dbt <> 1 AND dat <> 1
  UNION ALL SELECT sample_id, 104, 'u2a', 'b', false, false FROM diffs WHERE u AND dab <> 1 AND dbt = 1 AND ((pbt >= 0.55 AND pbt < 1) OR pbt BETWEEN 0.3499955 AND 0.5500045)
  UNION ALL SELECT sample_id, 105, 'u2b', 'b', false, true FROM diffs WHERE u AND dab <> 1 AND dbt = 1 AND pbt <= 0.15
  UNION ALL SELECT sample_id, 106, 'u3a', 'copy', false, false FROM diffs WHERE u AND dab = 1 AND dbt = 1 AND pab >= 0.55 AND pab < 1
  UNION ALL SELECT sample_id, 107, 'u3b', 'b', false, pab < 0.3499955 AND pab < 0.20 AND pbt <= 0.50 FROM diffs WHERE u AND dab = 1 AND dbt = 1 AND pab < 0.55
  UNION ALL SELECT sample_id, 108, 'u4', 'b', false, pbt <= 0.4 FROM diffs WHERE u AND dat = 1
  UNION ALL SELECT sample_id, 109, 'u5', 'b', false, pbt <= 0.4 AND dbt <> 1 FROM diffs WHERE u AND dab > 1 AND dbt <= 5
  UNION ALL SELECT sample_id, 201, 'n1', 'b', false, pbt BETWEEN 0.0499985 AND 0.2500015 FROM diffs WHERE NOT u AND b_ccg = t_ccg AND dbt = 1
  UNION ALL SELECT sample_id, 202, 'n2', 'b', false, dbt <> 1 AND pbt <= 0.4 FROM diffs WHERE NOT u AND b_ccg = t_ccg AND dbt <= 6
  UNION ALL SELECT sample_id, 203, 'n3a', 't', false, false FROM diffs WHERE b_ccg <> t_ccg AND a_ccg = b_ccg AND dab = 1 AND pab >= 0.4999925 AND pbt <= 0.3000015
  UNION ALL SELECT sample_id, 204, 'n3b', 'copy', false, pab < 0.4 FROM diffs WHERE b_ccg <> t_ccg AND a_ccg = b_ccg AND dab = 1 AND pab >= 0.4999925 AND pbt > 0.3000015
  UNION ALL SELECT sample_id, 205, 'n4', 't', false, false FROM diffs WHERE b_ccg <> t_ccg AND a_ccg = b_ccg AND dab = 1 AND pab BETWEEN 0.25 AND 0.49
  UNION ALL SELECT sample_id, 206, 'n5', 'b', false, true FROM diffs WHERE b_ccg <> t_ccg AND a_ccg = b_ccg AND dab = 1 AND pab < 0.4999925 AND pab NOT BETWEEN 0.25 AND 0.49
  UNION ALL SELECT sample_id, 207, 'n6', 'b', false, false FROM diffs WHERE a_ccg <> b_ccg AND a_ccg = t_ccg AND dat = 1
  UNION ALL SELECT sample_id, 208, 'n7', 'b', false, false FROM diffs WHERE a_ccg <> b_ccg AND b_ccg <> t_ccg AND a_ccg <> t_ccg AND dat <= 5 AND abs(a_ccg - t_ccg) <= 2
),
last AS (SELECT sample_id, arg_max(rule, no) AS rule, arg_max(target, no) AS target FROM fired GROUP BY sample_id),
flags AS (SELECT sample_id, bool_or(near) AS near, bool_or(mixed) AS mixed FROM fired f JOIN last l USING (sample_id) WHERE f.target = l.target AND (f.target <> 'copy' OR f.rule = l.rule) GROUP BY sample_id),
pair AS (SELECT d.sample_id, a_cag, a_ccg, coalesce(rule, 'none') AS rule,
    CASE target WHEN 'b' THEN b_cag WHEN 't' THEN t_cag ELSE a_cag END AS s_cag, CASE target WHEN 'b' THEN b_ccg WHEN 't' THEN t_ccg ELSE a_ccg END AS s_ccg,
    coalesce(near, false) AS neighbouring, coalesce(mixed, false) AS diff_confuse, rule IS NOT NULL AS heuristic_ok
  FROM diffs d LEFT JOIN last USING (sample_id) LEFT JOIN flags USING (sample_id)),
alleles0 AS (SELECT x.*, s.* EXCLUDE (sample_id, cag, ccg) REPLACE (CASE status WHEN 'Typical' THEN 'CAACAGCCGCCA' ELSE intervening END AS intervening)
  FROM (SELECT sample_id, 'PRI' AS allele, a_cag AS cag, a_ccg AS ccg, neighbouring, diff_confuse, heuristic_ok FROM pair UNION ALL SELECT sample_id, 'SEC', s_cag, s_ccg, neighbouring, diff_confuse, heuristic_ok FROM pair) x
  JOIN summary s USING (sample_id, cag, ccg)),
alleles AS (SELECT *, est_cag || '_' || len(regexp_extract_all(intervening, 'CAACAG')) || '_' || len(regexp_extract_all(replace(intervening, 'CAACAG', ''), 'CCGCCA')) || '_' || est_ccg || '_' || est_cct AS label FROM alleles0)"""
)


def peaks_cte(name: str, source: str, keys: str, bin: str, n: str, threshold: float) -> str:
    """Peaks of a dense histogram: runs of equal counts above both neighbours and the threshold."""
    return f"""
{name}_s AS (SELECT {keys}, {bin} AS b, {n} AS h, coalesce(({n} <> lag({n}) OVER (PARTITION BY {keys} ORDER BY {bin}))::INT, 0) AS turn FROM {source}),
{name}_r AS (SELECT *, sum(turn) OVER (PARTITION BY {keys} ORDER BY b) AS run, min(h) OVER (PARTITION BY {keys}) AS low, max(h) OVER (PARTITION BY {keys}) AS high FROM {name}_s),
{name}_g AS (SELECT {keys}, run, low, high, min(b) AS lo, max(b) AS hi, min(h) AS height FROM {name}_r GROUP BY ALL),
{name}_n AS (SELECT *, lag(height) OVER w AS before, lead(height) OVER w AS after FROM {name}_g WINDOW w AS (PARTITION BY {keys} ORDER BY run)),
{name} AS (SELECT {keys}, floor((lo + hi) / 2)::INT AS peak, height, low, high FROM {name}_n WHERE height > before AND height > after AND height > {threshold}::DOUBLE * (high - low) + low)"""


SLICES = (
    PAIRS
    + """,
mine AS (SELECT sample_id, allele, CASE status WHEN 'Atypical' THEN est_ccg ELSE ccg END AS ccg, CASE status WHEN 'Atypical' THEN est_cag ELSE cag END AS call FROM alleles),
own AS (SELECT al.sample_id, al.allele, a.mate, (a.ccg + floor((length(a.intervening) - length(al.intervening)) / 3.0))::INT AS ccg, a.cag, sum(a.n)::BIGINT AS n
  FROM assigned a JOIN alleles al ON al.sample_id = a.sample_id AND al.status = 'Atypical' WHERE a.cag BETWEEN 1 AND 200 AND (a.ccg + floor((length(a.intervening) - length(al.intervening)) / 3.0)) BETWEEN 1 AND 20 GROUP BY ALL),
asked AS (SELECT sample_id, allele, ccg, call, CASE WHEN min(ccg) OVER w = max(ccg) OVER w THEN 2 ELSE 1 END AS expected,
  min(ccg) OVER w = max(ccg) OVER w AND max(call) OVER w - min(call) OVER w <= 1 AS beside, min(ccg) OVER w = max(ccg) OVER w AND max(call) OVER w - min(call) OVER w > 5 AS spread FROM mine WINDOW w AS (PARTITION BY sample_id)),
counts AS (SELECT f.sample_id, a.allele, f.ccg, f.cag, f.n FROM fw f JOIN alleles a ON a.sample_id = f.sample_id AND a.status <> 'Atypical' UNION ALL SELECT sample_id, allele, ccg, cag, n FROM own WHERE mate = 'R1'),
bins0 AS (SELECT a.*, g.cag::INT AS cag, coalesce(n, 0)::BIGINT AS n FROM asked a CROSS JOIN range(1, 201) g(cag) LEFT JOIN counts k ON k.sample_id = a.sample_id AND k.allele = a.allele AND k.ccg = a.ccg AND k.cag = g.cag),
bins AS (SELECT sample_id, allele, ccg, call, expected, cag, n, CASE WHEN expected = 2 OR cag = call THEN n ELSE trunc(n - n / 100.0::DOUBLE * 85)::BIGINT END AS smooth FROM bins0)"""
)
CALLS = (
    SLICES
    + ","
    + peaks_cte("pk0", "bins", "sample_id, allele", "cag", "smooth", 0.05)
    + """,
pk AS (SELECT p.* FROM pk0 p JOIN asked a USING (sample_id, allele) WHERE NOT spread OR NOT EXISTS (SELECT 1 FROM pk0 q WHERE q.sample_id = p.sample_id AND q.allele = p.allele AND abs(q.peak - p.peak) <= 2 AND q.height > p.height)),
ladder AS (SELECT * FROM (VALUES (0, 0.50::DOUBLE), (1, 0.44::DOUBLE), (2, 0.38::DOUBLE), (3, 0.32::DOUBLE), (4, 0.26::DOUBLE), (5, 0.20::DOUBLE), (6, 0.14::DOUBLE), (7, 0.08::DOUBLE), (8, 0.05::DOUBLE)) t(recalls, threshold)),
rung AS (SELECT p.sample_id, p.allele, a.call, a.expected, a.beside, recalls, threshold, list(peak ORDER BY peak) AS peaks
  FROM pk p JOIN asked a USING (sample_id, allele) CROSS JOIN ladder WHERE height > threshold * (high - low) + low GROUP BY ALL),
hit AS (SELECT * FROM rung WHERE len(peaks) = expected OR list_contains(peaks, call) OR beside QUALIFY row_number() OVER (PARTITION BY sample_id, allele ORDER BY recalls) = 1),
budget AS (SELECT a.sample_id, a.allele, coalesce(recalls, 9)::INT AS recalls, (sum(coalesce(recalls, 9)) OVER (PARTITION BY a.sample_id ORDER BY a.allele))::INT AS spent FROM asked a LEFT JOIN hit h ON h.sample_id = a.sample_id AND h.allele = a.allele),
calls0 AS (SELECT sample_id, allele, call, recalls, threshold, CASE WHEN len(peaks) <> expected AND list_contains(peaks, call) THEN [call] ELSE peaks END AS peaks FROM hit WHERE sample_id NOT IN (SELECT sample_id FROM budget WHERE spent > 8)),
calls AS (SELECT *, coalesce(list_filter(peaks, lambda p: abs(p - call) <= 1)[-1], peaks[1]) AS fod FROM calls0),
val0 AS (SELECT c.*, b.ccg, b.n AS at_call FROM calls c JOIN bins b ON b.sample_id = c.sample_id AND b.allele = c.allele AND b.cag = b.call),
val1 AS (SELECT *, max(at_call) FILTER (WHERE allele = 'PRI') OVER w AS n1, max(at_call) FILTER (WHERE allele = 'SEC') OVER w AS n2, max(ccg) FILTER (WHERE allele = 'PRI') OVER w AS c1, max(ccg) FILTER (WHERE allele = 'SEC') OVER w AS c2,
   max(call) FILTER (WHERE allele = 'PRI') OVER w AS a1, max(call) FILTER (WHERE allele = 'SEC') OVER w AS a2 FROM val0 WINDOW w AS (PARTITION BY sample_id)),
valid AS (SELECT sample_id, allele, ccg, call, recalls, threshold, peaks, fod, abs(fod - call) <= 1 AS dsp_agrees,
   CASE WHEN NOT (c1 = c2 AND abs(a1 - a2) <= 1) OR c2 IS NULL THEN 'heterozygous' WHEN n1 <> n2 AND abs(n1 - n2) / greatest(n1, 1) <= 0.30 THEN 'neighbouring' ELSE 'homozygous' END AS state, at_call, at_call < 250 AS fatal_low FROM val1)"""
)
METRICS = (
    CALLS
    + """,
mets AS (SELECT sample_id, allele, call, round(back / nullif(smooth, 0)::DOUBLE, 6) AS slippage, round(ahead / nullif(n, 0)::DOUBLE, 6) AS mosaicism, round(minus / nullif(smooth, 0)::DOUBLE, 6) AS nminus,
   round(plus / nullif(smooth, 0)::DOUBLE, 6) AS nplus, round(around / nullif(alls, 0)::DOUBLE, 6) AS vicinity, total::BIGINT AS total FROM (
  SELECT *, coalesce(sum(smooth) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS back, coalesce(sum(n) OVER (w ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), 0) AS ahead,
    sum(smooth) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS around, coalesce(lag(smooth) OVER w, 0) AS minus, coalesce(lead(smooth) OVER w, 0) AS plus,
    sum(smooth) OVER (PARTITION BY sample_id, allele) AS alls, sum(n) OVER (PARTITION BY sample_id, allele) AS total FROM bins WINDOW w AS (PARTITION BY sample_id, allele ORDER BY cag)) WHERE cag = call)"""
)


def smooth_sql(v: str, call: str, hetero: str) -> str:
    """A list of CCG bins smoothed around a call, as SQL."""
    d = f"list_sort(list_distinct({v}), 'DESC')"
    second = f"{v}[{call}] = coalesce({d}[2], 0)"
    rescue = f"({second} AND 100.0 * coalesce({d}[2], 0) / nullif({d}[1], 0) > 0 AND 100.0 * coalesce({d}[2], 0) / nullif({d}[1], 0) < 50)"
    percent = f"CASE WHEN {v}[{call}] BETWEEN 1 AND 6000 THEN 75 WHEN {v}[{call}] BETWEEN 6001 AND 12000 THEN 85 ELSE 95 END"
    start = f"CASE WHEN {rescue} AND i = list_position({v}, {d}[1]) THEN trunc(x - x / 100.0::DOUBLE * 95)::BIGINT ELSE x END"
    two = f"CASE WHEN i = {call} THEN {start} ELSE greatest(0, trunc(({start}) - ({start}) / 100.0::DOUBLE * ({percent}))::BIGINT - CASE WHEN {second} AND NOT {rescue} THEN 5 ELSE 0 END) END"
    one = f"CASE WHEN i <> {call} AND abs(i - {call}) <= 3 THEN trunc(x - x / 100.0::DOUBLE * 77.5)::BIGINT ELSE x END"
    return f"list_transform({v}, lambda x, i: CASE WHEN {hetero} THEN {two} ELSE {one} END)"


def _clean_sql(v: str, b: str) -> str:
    return f"({b} BETWEEN 2 AND 19 AND {v}[{b} - 1] > 0 AND {v}[{b} - 1] / {v}[{b}]::DOUBLE < 0.2 AND {v}[{b} + 1] > 0 AND {v}[{b} + 1] / {v}[{b}]::DOUBLE < 0.2)"


REVIEW = (
    CALLS
    + """,
mccg AS (SELECT sample_id, mate, ccg, sum(n)::BIGINT AS n FROM hist GROUP BY ALL),
mdense AS (SELECT s.sample_id, s.mate, b.ccg::INT AS ccg, coalesce(c.n, 0)::BIGINT AS n FROM (SELECT DISTINCT sample_id, mate FROM mccg) s CROSS JOIN range(1, 21) b(ccg) LEFT JOIN mccg c ON c.sample_id = s.sample_id AND c.mate = s.mate AND c.ccg = b.ccg),
rdense AS (SELECT * FROM mdense WHERE mate = 'R2'),
accg AS (SELECT m.sample_id, a.allele, m.mate, m.ccg, m.n FROM mccg m JOIN alleles a ON a.sample_id = m.sample_id AND a.status <> 'Atypical' UNION ALL SELECT sample_id, allele, mate, ccg, sum(n)::BIGINT FROM own GROUP BY ALL),
adense AS (SELECT s.*, b.ccg::INT AS ccg, coalesce(c.n, 0)::BIGINT AS n FROM (SELECT DISTINCT sample_id, allele, mate FROM accg) s CROSS JOIN range(1, 21) b(ccg) LEFT JOIN accg c ON c.sample_id = s.sample_id AND c.allele = s.allele AND c.mate = s.mate AND c.ccg = b.ccg),
vec AS (SELECT * FROM (SELECT sample_id, allele, list(n ORDER BY ccg) FILTER (WHERE mate = 'R2') AS rv, list(n ORDER BY ccg) FILTER (WHERE mate = 'R1') AS fw FROM adense GROUP BY sample_id, allele) WHERE rv IS NOT NULL AND fw IS NOT NULL),"""
    + peaks_cte("rz", "rdense", "sample_id", "ccg", "n", 0.15)
    + """,
class AS (SELECT s.sample_id, CASE WHEN coalesce(k, 0) >= 2 THEN 'HETERO' ELSE 'HOMO' END AS classified FROM (SELECT DISTINCT sample_id FROM rdense) s LEFT JOIN (SELECT sample_id, count(*) AS k FROM rz GROUP BY 1) USING (sample_id)),
e1 AS (SELECT a.sample_id, a.allele, i.ccg AS scanned, a.ccg AS bin, est_ccg, est_cag, est_cct, status, neighbouring, label, rv, fw, classified, state, v.fod AS fod0,
    list_sort(list_distinct(rv), 'DESC') AS d FROM alleles a JOIN mine i USING (sample_id, allele) JOIN vec USING (sample_id, allele) JOIN class USING (sample_id) JOIN valid v ON v.sample_id = a.sample_id AND v.allele = a.allele),
e2 AS (SELECT *, d[1] AS top1, coalesce(d[2], 0) AS top2, coalesce(d[3], 0) AS top3, list_position(rv, d[1]) AS bin1, list_position(rv, coalesce(d[2], 0)) AS bin2, coalesce(d[2], 0) / nullif(d[1], 0)::DOUBLE AS ratio,
    max(scanned) FILTER (WHERE allele = 'PRI') OVER w AS pri, max(scanned) FILTER (WHERE allele = 'SEC') OVER w AS sec FROM e1 WINDOW w AS (PARTITION BY sample_id)),
e3 AS (SELECT *, NOT neighbouring AND ((abs(bin1 - bin2) = 1 AND abs(top2 - top3) <= 0.8 * top2 + 0.00001 * top3) OR top2 = rv[scanned]) AS unsure FROM e2),
e4 AS (SELECT *, NOT neighbouring AND NOT unsure AND ratio >= 0.05 AND scanned NOT IN (bin1, bin2) AS wrong FROM e3),
e5 AS (SELECT *, max(CASE WHEN wrong THEN CASE WHEN bin1 NOT IN (pri, sec) THEN bin1 WHEN bin2 NOT IN (pri, sec) THEN bin2 ELSE scanned END ELSE scanned END) FILTER (WHERE allele = 'PRI') OVER (PARTITION BY sample_id) AS pri_new FROM e4),
e6 AS (SELECT *, CASE WHEN allele = 'PRI' THEN pri_new WHEN wrong THEN CASE WHEN bin1 NOT IN (pri_new, sec) THEN bin1 WHEN bin2 NOT IN (pri_new, sec) THEN bin2 ELSE scanned END ELSE scanned END AS ccg FROM e5),
e7 AS (SELECT *, """
    + smooth_sql("rv", "ccg", "classified = 'HETERO'")
    + """ AS sm FROM e6),
e8 AS (SELECT *, list_sort(list_distinct(sm), 'DESC') AS sd FROM e7),
e9 AS (SELECT *, list_position(sm, sd[1]) AS b1, list_position(sm, coalesce(sd[2], 0)) AS b2 FROM e8),
e10 AS (SELECT *, CASE WHEN classified <> 'HETERO' AND abs(b1 - b2) BETWEEN 2 AND 9 AND ratio >= 0.05 AND """
    + _clean_sql("sm", "b1")
    + " AND "
    + _clean_sql("sm", "b2")
    + """ AND coalesce(sd[2], 0) / nullif(sd[1], 0)::DOUBLE >= 0.15 THEN 'HETERO' ELSE classified END AS seen FROM e9),
ebins AS (SELECT sample_id, allele, generate_subscripts(sm, 1)::INT AS bin, unnest(sm) AS n FROM e10),
fbins AS (SELECT sample_id, generate_subscripts(fw, 1)::INT AS bin, unnest(fw) AS n FROM vec WHERE allele = 'PRI'),
pbins AS (SELECT * FROM ebins WHERE allele = 'PRI'),"""
    + peaks_cte("ep", "ebins", "sample_id, allele", "bin", "n", 0.5)
    + ","
    + peaks_cte("fp", "fbins", "sample_id", "bin", "n", 0.15)
    + ","
    + peaks_cte("pp", "pbins", "sample_id", "bin", "n", 0.15)
    + """,
e11 AS (SELECT e.*, coalesce(f, []) AS found, CASE seen WHEN 'HETERO' THEN 2 ELSE 1 END AS wanted FROM e10 e LEFT JOIN (SELECT sample_id, allele, list(peak ORDER BY peak) AS f FROM ep GROUP BY ALL) p ON p.sample_id = e.sample_id AND p.allele = e.allele),
e12 AS (SELECT *, len(found) <> wanted AND NOT list_contains(found, ccg) AND len(found) > 2 AND seen <> 'HETERO' AS crowd FROM e11),
e13 AS (SELECT *, CASE WHEN len(found) <> wanted AND list_contains(found, ccg) THEN [ccg] WHEN crowd THEN [b1] ELSE found END AS pk FROM e12),
e14 AS (SELECT *, list_contains(pk, ccg) AS matched, CASE WHEN len(pk) > 1 AND allele = 'SEC' THEN pk[2] ELSE pk[1] END AS fod_ccg,
   bool_and(abs(b1 - ccg) <= 1 OR (seen = 'HETERO' AND abs(b2 - ccg) <= 1)) OVER (PARTITION BY sample_id) AS continuous FROM e13),
e15 AS (SELECT *, CASE WHEN max(CASE WHEN matched THEN ccg END) FILTER (WHERE allele = 'PRI') OVER w IS NOT DISTINCT FROM max(CASE WHEN matched THEN ccg END) FILTER (WHERE allele = 'SEC') OVER w THEN 'HOMO' ELSE 'HETERO' END AS local,
   abs(max(ccg) FILTER (WHERE allele = 'PRI') OVER w - max(ccg) FILTER (WHERE allele = 'SEC') OVER w) AS apart,
   CASE WHEN max(est_ccg) FILTER (WHERE allele = 'PRI') OVER w = max(est_ccg) FILTER (WHERE allele = 'SEC') OVER w THEN 'HOMO' ELSE 'HETERO' END AS stated, bool_or(status = 'Atypical') OVER w AS odd,
   CASE WHEN max(fod_ccg) FILTER (WHERE allele = 'PRI') OVER w IS NOT DISTINCT FROM max(fod_ccg) FILTER (WHERE allele = 'SEC') OVER w THEN 'HOMO' ELSE 'HETERO' END AS zygosity,
   max(b1) FILTER (WHERE allele = 'PRI') OVER w AS pri_b1, max(list_position(fw, list_max(fw))) FILTER (WHERE allele = 'PRI') OVER w AS pri_fw, bool_or(crowd) OVER w AS crowded FROM e14 WINDOW w AS (PARTITION BY sample_id)),
review AS (SELECT e.sample_id, e.allele, ccg::INT AS ccg, ccg <> scanned AS overwritten, round(ratio, 6) AS ratio,
   unsure OR (state = 'homozygous' AND pri_fw = pri_b1 AND coalesce(nf, 0) <> coalesce(nr, 0)) AS uncertain, continuous, matched, fod_ccg::INT AS fod_ccg, local,
   local = CASE apart WHEN 0 THEN 'HOMO' ELSE 'HETERO' END OR apart = 1 AS ccg_passes, zygosity, crowded OR zygosity <> CASE WHEN odd THEN stated ELSE local END AS svm_failure
  FROM e15 e LEFT JOIN (SELECT sample_id, count(*) AS nf FROM fp GROUP BY 1) f ON f.sample_id = e.sample_id LEFT JOIN (SELECT sample_id, count(*) AS nr FROM pp GROUP BY 1) r ON r.sample_id = e.sample_id),
tg AS (SELECT sample_id, allele, list(smooth ORDER BY cag) AS t FROM bins GROUP BY ALL),
p1 AS (SELECT v.sample_id, v.allele, state, fod, zygosity, t, CASE WHEN fod > 1 THEN t[fod - 1] END AS nm, t[fod] AS n0, t[fod + 1] AS np, list_sort(list_distinct(t), 'DESC') AS d FROM valid v JOIN tg USING (sample_id, allele) JOIN review r ON r.sample_id = v.sample_id AND r.allele = v.allele),
p2 AS (SELECT *, coalesce(state = 'heterozygous' AND abs(np / nullif(n0, 0)::DOUBLE - 0.85) <= 0.0750085 AND nm / nullif(n0, 0)::DOUBLE > 0.65, false) AS up, coalesce(state = 'heterozygous' AND abs(nm / nullif(n0, 0)::DOUBLE - 0.80) <= 0.150008 AND np / nullif(n0, 0)::DOUBLE > 0.65, false) AS down,
   zygosity = 'HETERO' AND abs(list_position(t, d[1]) - list_position(t, coalesce(d[2], 0))) > 2 AND d[1] - coalesce(d[2], 0) <= 0.55 * d[1] + 0.00001 * coalesce(d[2], 0) AS unexpected FROM p1),
peak AS (SELECT sample_id, allele, (fod + up::INT - down::INT)::INT AS fod, up OR down AS slippage_overwrite, unexpected,
   CASE WHEN nm > 0 AND n0 > 0 AND np > 0 THEN round(abs((ln(nm) - ln(np)) / nullif(2 * (ln(nm) - 2 * ln(n0) + ln(np)), 0)), 6) END AS interpolated FROM p2),
g1 AS (SELECT e.sample_id, e.allele, e.status, e.state, e.est_cag, e.est_ccg, e.est_cct, e.bin AS scanned, split_part(label, '_', 2) AS m1, split_part(label, '_', 3) AS m2, k.fod, k.slippage_overwrite, r.zygosity, coalesce(r.fod_ccg, e.est_ccg) AS fccg,
   r.overwritten OR k.fod <> e.est_cag OR coalesce(r.fod_ccg, e.est_ccg) <> e.est_ccg AS fod_overwrite
  FROM e15 e JOIN review r ON r.sample_id = e.sample_id AND r.allele = e.allele JOIN peak k ON k.sample_id = e.sample_id AND k.allele = e.allele),
g2 AS (SELECT *, fod || '_' || m1 || '_' || m2 || '_' || fccg || '_' || est_cct AS gt, max(scanned) FILTER (WHERE allele = 'PRI') OVER w <> max(scanned) FILTER (WHERE allele = 'SEC') OVER w AS bins_differ,
   max(est_ccg) FILTER (WHERE allele = 'PRI') OVER w <> max(est_ccg) FILTER (WHERE allele = 'SEC') OVER w AS ccgs_differ, bool_or(scanned <> est_ccg) OVER w AS moved, bool_or(status = 'Atypical' AND scanned <> est_ccg) OVER w AS rewritten,
   bool_or(status = 'Atypical' AND scanned = est_ccg) OVER w AS kept, bool_or(fod_overwrite) OVER w AS any_over FROM g1 WINDOW w AS (PARTITION BY sample_id)),
labels AS (SELECT sample_id, allele, CASE WHEN state = 'homozygous' AND allele = 'SEC' THEN max(gt) FILTER (WHERE allele = 'PRI') OVER (PARTITION BY sample_id) ELSE gt END AS genotype, fod_overwrite, slippage_overwrite,
   zygosity <> 'HETERO' AND state <> 'homozygous' AND any_over AS missed_expansion, rewritten AS ccg_rewritten, kept OR (bins_differ AND NOT ccgs_differ AND rewritten) OR (moved AND NOT bins_differ) AS zygosity_rewritten FROM g2)"""
)


#: Levels are those of the last range that holds the ratio; past the last bound 6. Written apart from the operator's steps.
_MINUS = "CASE WHEN nminus > 0.75 THEN 6 WHEN nminus >= 0.6999925 THEN 5 WHEN nminus BETWEEN 0.549994 AND 0.650006 THEN 4 WHEN nminus BETWEEN 0.3999955 AND 0.5000045 THEN 3 WHEN nminus BETWEEN 0.3099965 AND 0.3900035 THEN 2 WHEN nminus BETWEEN 0.2299975 AND 0.2700025 THEN 1 ELSE 0 END"
_PLUS = "CASE WHEN nplus > 0.65 THEN 6 WHEN nplus >= 0.5999935 THEN 5 WHEN nplus BETWEEN 0.3199963 AND 0.4200037 THEN 4 WHEN nplus BETWEEN 0.2399973 AND 0.3000027 THEN 3 WHEN nplus BETWEEN 0.1199985 AND 0.1800015 THEN 2 WHEN nplus BETWEEN 0.0299995 AND 0.0700005 THEN 1 ELSE 0 END"

SCORED = (
    REVIEW
    + ","
    + METRICS[len(CALLS) :].strip().removeprefix(",")
    + f""",
mapped AS (SELECT sample_id, 100.0::DOUBLE * count(*) FILTER (WHERE mapq >= 1 AND mate = 'R1') / nullif(count(*) FILTER (WHERE mate = 'R1'), 0) AS fw_mapped,
   100.0::DOUBLE * count(*) FILTER (WHERE mapq >= 1 AND mate = 'R2') / nullif(count(*) FILTER (WHERE mate = 'R2'), 0) AS rv_mapped,
   count(*) FILTER (WHERE mapq >= 1 AND mate = 'R1') AS fw_count, count(*) FILTER (WHERE mapq >= 1 AND mate = 'R2') AS rv_count, count(*) FILTER (WHERE mapq < 1 AND mate = 'R1') AS fw_purged, count(*) FILTER (WHERE mapq < 1 AND mate = 'R2') AS rv_purged, count(*) AS all_reads FROM reads GROUP BY sample_id),
slice1 AS (SELECT sample_id, sum(n) AS whole, max(n) FILTER (WHERE cag = call) AS own FROM bins WHERE allele = 'PRI' GROUP BY 1),
hid0 AS (SELECT b.sample_id, count(DISTINCT ccg) AS ccgs, max(call) FILTER (WHERE allele = 'PRI') AS c1, max(call) FILTER (WHERE allele = 'SEC') AS c2, max(n) FILTER (WHERE allele = 'PRI' AND cag = call) AS n1, max(n) FILTER (WHERE allele = 'SEC' AND cag = call) AS n2, sum(n) FILTER (WHERE allele = 'PRI') AS whole
   FROM (SELECT bins.*, a.ccg FROM bins JOIN asked a USING (sample_id, allele)) b GROUP BY 1),
tail AS (SELECT b.sample_id, cag, n FROM bins b JOIN slice1 USING (sample_id) WHERE b.allele = 'PRI' AND cag > call + 5 AND whole > 100 AND own < 0.65 * whole),"""
    + peaks_cte("dim", "tail", "sample_id", "cag", "n", 0.05)
    + f""",
hid AS (SELECT DISTINCT h.sample_id FROM hid0 h JOIN dim USING (sample_id) WHERE ccgs = 1 AND c1 <> c2 AND n1 + n2 < (0.65 - 0.175) * whole AND least(n1, n2) < 750 AND height > 100 AND abs(peak - c2) > 1
   AND h.sample_id NOT IN (SELECT sample_id FROM alleles WHERE status = 'Atypical')),
warn AS (SELECT sample_id, least(a_n, b_n, t_n) < 20 AS few FROM ranked),
scored AS (SELECT v.sample_id, v.allele, (sum(recalls) OVER (PARTITION BY v.sample_id))::INT AS recalls, v.state, coalesce(h.sample_id IS NOT NULL, false) OR missed_expansion AS diminished, al.status, al.typical_pcnt, al.atypical_pcnt, al.total AS contig_reads, m.total, vicinity, slippage, mosaicism, threshold,
   CASE WHEN v.state <> 'heterozygous' THEN 2 ELSE {_MINUS} END AS minus_level, CASE WHEN v.state <> 'heterozygous' THEN 2 ELSE {_PLUS} END AS plus_level, nminus, nplus,
   fw_mapped, rv_mapped, fw_count, rv_count, fw_purged, rv_purged, all_reads, fatal_low, diff_confuse, heuristic_ok, k.fod, est_cag, r.uncertain AS ccg_uncertain, r.svm_failure, r.fod_ccg, k.unexpected, k.interpolated, few AS alignment_warning, cct_uncertain, al.intervening,
   l.* EXCLUDE (sample_id, allele), al.total < 750 AS low_reads, al.status = 'Atypical' AND coalesce(at_call, 0) = 0 AS atypical_warning
  FROM valid v JOIN mets m USING (sample_id, allele) JOIN alleles al ON al.sample_id = v.sample_id AND al.allele = v.allele JOIN mapped p ON p.sample_id = v.sample_id JOIN warn ON warn.sample_id = v.sample_id
  JOIN review r ON r.sample_id = v.sample_id AND r.allele = v.allele JOIN peak k ON k.sample_id = v.sample_id AND k.allele = v.allele JOIN labels l ON l.sample_id = v.sample_id AND l.allele = v.allele LEFT JOIN hid h ON h.sample_id = v.sample_id),
levels AS (SELECT sample_id, allele, 'below the peak' AS rule, minus_level AS level FROM scored UNION ALL SELECT sample_id, allele, 'above the peak', plus_level FROM scored),
shares AS (SELECT sample_id, allele, 'forward mapped' AS rule, fw_mapped AS share FROM scored UNION ALL SELECT sample_id, allele, 'reverse mapped', rv_mapped FROM scored),
flagged AS (SELECT sample_id, allele, unnest(['diminished peak', 'overwritten genotype', 'missed expansion', 'slippage overwrite', 'peak inspection', 'uncertain CCG', 'alignment warning', 'atypical alignment warning', 'fatally few reads', 'differential confusion', 'no second allele']) AS rule,
   unnest([diminished, fod_overwrite, fod_overwrite AND missed_expansion, slippage_overwrite, minus_level = 6 OR plus_level = 6 OR unexpected, ccg_uncertain, alignment_warning, atypical_warning, fatal_low, diff_confuse, NOT heuristic_ok]) AS raised,
   unnest([-10, -20, -50, -25, -10, -15, -15, -50, -25, -30, -20]) AS delta FROM scored),
events AS (
  SELECT sample_id, allele, rule, delta FROM flagged WHERE raised
  UNION ALL SELECT sample_id, allele, 'recall count', CASE WHEN recalls = 7 THEN -25 WHEN recalls > 4 THEN -15 ELSE -5 END FROM scored WHERE recalls IN (1, 2, 3, 5, 6, 7)
  UNION ALL SELECT sample_id, allele, 'zygosity', CASE state WHEN 'homozygous' THEN -25 ELSE -15 END FROM scored WHERE state <> 'heterozygous'
  UNION ALL SELECT sample_id, allele, 'atypical', CASE status WHEN 'Atypical' THEN -5 ELSE 1 END FROM scored
  UNION ALL SELECT sample_id, allele, 'mixed structure', -30 FROM scored WHERE CASE status WHEN 'Atypical' THEN atypical_pcnt ELSE typical_pcnt END BETWEEN 44.9995 AND 55.0005
  UNION ALL SELECT sample_id, allele, 'clear structure', 15 FROM scored WHERE status = 'Atypical' AND atypical_pcnt >= 59.9992
  UNION ALL SELECT sample_id, allele, 'clear structure', 2 FROM scored WHERE status = 'Typical' AND typical_pcnt BETWEEN 64.9992 AND 95.0008
  UNION ALL SELECT sample_id, allele, 'total reads', CASE WHEN total > 10000 THEN 5 WHEN total >= 1000 THEN 1 ELSE -15 END FROM scored
  UNION ALL SELECT sample_id, allele, 'vicinity', d FROM (SELECT *, CASE WHEN 100 * vicinity > 85 THEN 1 WHEN 100 * vicinity > 65 AND 100 * vicinity < 84.99 THEN -10 WHEN 100 * vicinity > 45 AND 100 * vicinity < 64.99 THEN -15 WHEN 100 * vicinity > 0 AND 100 * vicinity < 44.99 THEN -20 END AS d FROM scored) WHERE d IS NOT NULL
  UNION ALL SELECT sample_id, allele, 'slippage', CASE WHEN slippage < 0.1 THEN 5 WHEN slippage < 0.25 THEN 1 ELSE -1 END FROM scored WHERE slippage > 0 AND slippage NOT IN (0.1, 0.25)
  UNION ALL SELECT sample_id, allele, 'mosaicism', CASE WHEN mosaicism < 0.01 THEN 10 WHEN mosaicism < 0.015 THEN 5 ELSE -1 END FROM scored WHERE mosaicism > 0 AND mosaicism NOT IN (0.01, 0.015)
  UNION ALL SELECT sample_id, allele, 'CCG threshold', 1 FROM scored
  UNION ALL SELECT sample_id, allele, 'threshold', CASE WHEN threshold = 0.5 THEN 1 WHEN threshold > 0.3 THEN -5 ELSE -10 END FROM scored WHERE threshold <> 0.3
  UNION ALL SELECT sample_id, allele, rule, CASE level WHEN 0 THEN 5 WHEN 1 THEN -5 WHEN 2 THEN -7 WHEN 3 THEN -15 WHEN 4 THEN -15 ELSE -10 END FROM levels
  UNION ALL SELECT sample_id, allele, rule, CASE WHEN share > 90 THEN 2 WHEN share > 85 AND share < 90 THEN 1 ELSE -2 END FROM shares),
late AS (SELECT unnest(['peak inspection', 'uncertain CCG', 'alignment warning', 'atypical alignment warning', 'fatally few reads', 'differential confusion', 'no second allele', 'forward mapped', 'reverse mapped']) AS rule)"""
)


def _entries(structures: str) -> str:
    """The library entry of each distinct read: the one of its length, set at its right end, from which fewest bases differ. (No gap is worth
    its price in reads whose tracts are whole, so the best alignment is one without.)"""
    flanks = len(FIVE_PRIME) + len(THREE_PRIME)
    return f"""
structs AS ({structures}),
useq AS (SELECT sample_id, mate, seq, quality, count(*) AS n FROM reads WHERE mapq >= 1 GROUP BY ALL),
tries AS (SELECT *, FIVE || repeat('CAG', cag) || mid || repeat('CCG', ccg) || repeat('CCT', cct) || THREE AS ref FROM (
  SELECT t.*, s.mid, s.cct::BIGINT AS cct, cag, ((length(seq) - {flanks} - length(mid) - 3 * s.cct) // 3 - cag)::BIGINT AS ccg, '{FIVE_PRIME}' AS FIVE, '{THREE_PRIME}' AS THREE
  FROM (SELECT DISTINCT sample_id, seq FROM useq) t JOIN structs s USING (sample_id), range(1, 201) a(cag)) WHERE ccg BETWEEN 1 AND 20),
entries AS (SELECT sample_id, seq, mid, cct, cag, ccg, ref, hamming(right(seq, length(ref)), ref) AS d, length(seq) - length(ref) AS ahead FROM tries
  QUALIFY row_number() OVER (PARTITION BY sample_id, seq ORDER BY d, mid, cct, ccg, cag) = 1)"""


RESCORED = READS + "," + _entries(f"SELECT DISTINCT sample_id, '{TYPICAL}' AS mid, 2 AS cct FROM reads")

#: Reads against the typical entries and those of their sample's alleles, what they show at each position, and the calls.
VARIANTS = (
    PAIRS
    + ","
    + _entries(f"SELECT sample_id, '{TYPICAL}' AS mid, 2 AS cct FROM reads GROUP BY ALL UNION SELECT sample_id, intervening, est_cct FROM alleles")
    + """,
shown AS (SELECT sample_id, mid, cct, cag, ccg, pos, substr(ref, pos, 1) AS ref, substr(seq, pos + ahead, 1) AS base, quality AS q, sum(n)::BIGINT AS n
  FROM useq JOIN entries USING (sample_id, seq), unnest(range(1, length(ref) + 1)) x(pos) GROUP BY ALL),
alts AS (SELECT sample_id, mid, cct, cag, ccg, pos, base AS alt, sum(n)::BIGINT AS alt_depth FROM shown WHERE base <> ref GROUP BY sample_id, mid, cct, cag, ccg, pos, base
  QUALIFY row_number() OVER (PARTITION BY sample_id, mid, cct, cag, ccg, pos ORDER BY sum(n) DESC, base) = 1),
likely AS (SELECT sample_id, mid, cct, cag, ccg, pos, ref, alt, alt_depth, sum(n)::BIGINT AS depth,
  sum(n * log10(pr)) + log10(1 - 1.5::DOUBLE * 0.001) AS g0, sum(n * log10((pr + pa) / 2)) + log10(0.001::DOUBLE) AS g1, sum(n * log10(pa)) + log10(0.0005::DOUBLE) AS g2 FROM (
  SELECT *, CASE WHEN base = ref THEN 1 - e ELSE e / 3 END AS pr, CASE WHEN base = alt THEN 1 - e ELSE e / 3 END AS pa FROM (
  SELECT *, least(0.75, pow(10.0::DOUBLE, -q / 10.0::DOUBLE)) AS e FROM shown JOIN alts USING (sample_id, mid, cct, cag, ccg, pos) WHERE alt_depth >= 2)) GROUP BY ALL),
called AS (SELECT *, greatest(g0, g1, g2) AS m FROM likely WHERE g1 > g0 OR g2 > g0),
records AS (SELECT sample_id, cag || '_' || len(regexp_extract_all(mid, 'CAACAG')) || '_' || len(regexp_extract_all(replace(mid, 'CAACAG', ''), 'CCGCCA')) || '_' || ccg || '_' || cct AS chrom, pos::INT AS pos, ref, alt,
  CASE WHEN m = g2 THEN '1/1' ELSE '0/1' END AS gt, round(-10 * (g0 - (m + log10(w))), 3) AS qual,
  round(-10 * log10(greatest(CASE WHEN m = g2 THEN p0 + p1 ELSE p0 + p2 END / w, 1e-300)), 3) AS gq, depth, alt_depth
  FROM (SELECT *, p0 + p1 + p2 AS w FROM (SELECT *, pow(10.0::DOUBLE, g0 - m) AS p0, pow(10.0::DOUBLE, g1 - m) AS p1, pow(10.0::DOUBLE, g2 - m) AS p2 FROM called))),
v AS (SELECT r.*, a.allele, a.status = 'Atypical' AS atypical, a.label FROM records r JOIN alleles a USING (sample_id)),
t AS (SELECT *, CASE WHEN atypical THEN regexp_replace(chrom, '_?CAG.*$', '') ELSE chrom END = label AS target FROM v),
k AS (SELECT * FROM (SELECT *, min(pos) OVER (PARTITION BY sample_id, allele) AS lo, max(pos) OVER (PARTITION BY sample_id, allele) AS hi FROM t WHERE target AND qual > 20) WHERE abs(pos - lo) > 5 AND abs(pos - hi) > 5)"""
)


#: Why each sample that fails does, and at which stage.
OUTCOMES = """
outcome AS (SELECT sample_id, CASE WHEN reason = 'recalls are used up' THEN 'Genotype' WHEN reason IS NOT NULL THEN 'DSP' END AS stage, reason FROM (
  SELECT s.sample_id, CASE WHEN r.sample_id IS NULL THEN 'no read of a known size' WHEN t_n IS NULL THEN 'fewer than three contigs' WHEN a_n < 200 OR b_n < 100 OR (t_n < 50 AND t_n NOT BETWEEN 45 AND 55) THEN 'too few reads in a contig'
    WHEN s.sample_id IN (SELECT sample_id FROM summary WHERE balance_failed) THEN 'typical and atypical reads are even' WHEN s.sample_id IN (SELECT sample_id FROM budget WHERE spent > 8) THEN 'recalls are used up' END AS reason
  FROM (SELECT DISTINCT sample_id FROM reads) s LEFT JOIN ranked r USING (sample_id)))"""
