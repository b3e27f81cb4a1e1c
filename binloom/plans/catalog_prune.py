"""Pruning of boundaries as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.operators import prune, resample, segments
from binloom.operators.segments import PLACE
from binloom.functions.shared import written
from binloom.sources.genome import Genome

from .catalog import MAX_BINS, REPLICATES, SRD_REF, _draws, labelled, query

#: Cutoffs at which some boundaries of this data go, and the grid around them.
PRUNE_TAU, PRUNE_STAB = 0.2, 0.8
TAUS, STABS = (0.12, PRUNE_TAU, 0.3), (0.5, PRUNE_STAB, 0.95)
#: Log2 ratio of rates that makes a side strong in this data.
EFFECT = 0.05


def _boots(g: Genome) -> DataFrame:
    return prune.replicate_profiles(g.with_sources(g.signal), resample.bootstrap_weights(g.membership, REPLICATES), REPLICATES)


def _decisions(g: Genome, taus: tuple[float, ...] = (PRUNE_TAU,), stabs: tuple[float, ...] = (PRUNE_STAB,)) -> DataFrame:
    return prune.prune(g.profile, written(_boots(g)), g.boundaries, taus, stabs, MAX_BINS)


def _summaries(g: Genome) -> DataFrame:
    return segments.segment_summaries(labelled(g))


_BOOT = f"""{_draws(REPLICATES)}, boot AS (SELECT w.source, w.rep, s.g, sum(s.x * w.w) AS y FROM signal AS s JOIN weights AS w USING (cell) GROUP BY ALL),
 med AS (SELECT l.source, l.chrom, l.seg, r.rep, median(coalesce(b.y, 0) / n_cells) AS m FROM lab AS l JOIN n_cells USING (source) CROSS JOIN (SELECT unnest(range(1, {REPLICATES + 1})) AS rep) AS r LEFT JOIN boot AS b ON b.source = l.source AND b.rep = r.rep AND b.g = l.g GROUP BY ALL),
 again AS (SELECT a.source, a.chrom, a.seg, count(*) FILTER (a.m > 0 AND b.m > 0) AS n_valid, avg(CASE WHEN abs(log2(a.m / nullif(b.m, 0))) < {PRUNE_TAU} THEN 1::DOUBLE ELSE 0::DOUBLE END) AS share FROM med AS a JOIN med AS b ON b.source = a.source AND b.chrom = a.chrom AND b.rep = a.rep AND b.seg = a.seg + 1 GROUP BY ALL)"""
query("m25_boundary_scores", "source chrom:i bin:i left_bins:i right_bins:i candidate delta:r under:r n_valid:i guard:r eligible first_reason", f"""{_BOOT} SELECT *, first_reason = 'eligible' AS eligible FROM (SELECT a.source, a.chrom, b.s AS bin, a.n AS left_bins, b.n AS right_bins, a.seg > 0 AND b.seg < k - 1 AND least(a.n, b.n) <= {MAX_BINS} AS candidate,
 CASE WHEN a.median > 0 AND b.median > 0 THEN log2(a.median / b.median) END AS delta, CASE WHEN a.median > 0 AND b.median > 0 THEN n_valid ELSE {REPLICATES} END AS n_valid, CASE WHEN a.median > 0 AND b.median > 0 AND n_valid = {REPLICATES} THEN share END AS under, CASE WHEN a.median > 0 AND b.median > 0 THEN abs(log2(a.median) - log2(b.median)) END AS guard,
 CASE WHEN a.seg = 0 OR b.seg = k - 1 THEN 'terminal_unchanged' WHEN least(a.n, b.n) > {MAX_BINS} THEN 'long_long_not_candidate' WHEN NOT (a.median > 0 AND b.median > 0) THEN 'observed_median_zero' WHEN n_valid < {REPLICATES} THEN 'invalid_replicates'
 WHEN abs(log2(a.median / b.median)) >= {PRUNE_TAU} THEN 'effect_ge_tau' WHEN share < {PRUNE_STAB} THEN 'stability_below_cutoff' ELSE 'eligible' END AS first_reason
 FROM st AS a JOIN st AS b ON b.source = a.source AND b.chrom = a.chrom AND b.seg = a.seg + 1 JOIN again AS r ON r.source = a.source AND r.chrom = a.chrom AND r.seg = a.seg JOIN (SELECT source, chrom, count(*) AS k FROM st GROUP BY ALL) AS z ON z.source = a.source AND z.chrom = a.chrom)""")(_decisions)


def pruned_sql(taus: tuple[float, ...] = (PRUNE_TAU,), stabs: tuple[float, ...] = (PRUNE_STAB,), steps: int = 20) -> str:
    """Table decided in SQL: one boundary of each chromosome and setting goes in each step; a merged segment's medians are taken anew, the others are kept.  Steps beyond the last merge change nothing."""
    key = "tau, stab, source, chrom"
    out = f"""{_BOOT}, dense AS MATERIALIZED (SELECT p.source, p.chrom, p.i, p.x, rep, coalesce(b.y, 0) / n_cells AS v FROM profile AS p JOIN n_cells USING (source) CROSS JOIN (SELECT unnest(range(1, {REPLICATES + 1})) AS rep) LEFT JOIN boot AS b USING (source, rep, g)),
 s0 AS MATERIALIZED (SELECT tau, stab, st.source, st.chrom, st.seg AS first, st.seg AS last, st.s, st.e, st.median AS m, ms, CASE WHEN st.median > 0 THEN log2(st.median) END AS lo, CASE WHEN st.median > 0 THEN log2(st.median) END AS hi, st.median > 0 AS ok
 FROM st JOIN (SELECT source, chrom, seg, list(m ORDER BY rep) AS ms FROM med GROUP BY ALL) AS q ON q.source = st.source AND q.chrom = st.chrom AND q.seg = st.seg CROSS JOIN (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in taus)}]) AS tau) CROSS JOIN (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in stabs)}]) AS stab))"""
    for k in range(steps + 1):
        out += f""", e{k} AS MATERIALIZED (SELECT *, CASE WHEN plain <> '' THEN plain WHEN NOT (ok AND nok) OR greatest(hi, nhi) - least(lo, nlo) >= tau THEN 'chain_guard' ELSE '' END AS reason FROM (
 SELECT *, CASE WHEN NOT (m > 0 AND nm > 0) THEN 'observed_median_zero' WHEN valid < {REPLICATES} THEN 'invalid_replicates' WHEN abs(delta) >= tau THEN 'effect_ge_tau' WHEN under < stab THEN 'stability_below_cutoff' ELSE '' END AS plain FROM (
 SELECT *, CASE WHEN m > 0 AND nm > 0 THEN log2(m / nm) END AS delta, len(list_filter(list_zip(ms, nms), lambda z: z[1] > 0 AND z[2] > 0)) AS valid, pos > 1 AND pos + 1 < segs AS inner_, least(e - s, ne - e) <= {MAX_BINS} AS small,
  len(list_filter(list_zip(ms, nms), lambda z: z[1] > 0 AND z[2] > 0 AND abs(log2(z[1] / z[2])) < tau))::DOUBLE / {REPLICATES} AS under FROM (
 SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY {key}) AS segs, {", ".join(f"lead({c}) OVER w AS n{c}" for c in ("first", "last", "e", "m", "ms", "lo", "hi", "ok"))} FROM s{k} WINDOW w AS (PARTITION BY {key} ORDER BY s)) WHERE nfirst IS NOT NULL)))"""
        if k < steps:
            out += f""", c{k} AS MATERIALIZED (SELECT * FROM e{k} WHERE inner_ AND small AND reason = '' QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY round(abs(delta), 10), e) = 1),
 s{k + 1} AS MATERIALIZED (SELECT z.* FROM s{k} AS z LEFT JOIN c{k} AS c USING ({key}) WHERE c.first IS NULL OR (z.first <> c.first AND z.first <> c.nfirst)
 UNION ALL SELECT {key}, any_value(c.first), any_value(nlast), any_value(c.s), any_value(ne), any_value(obs), list(mid ORDER BY rep), any_value(least(lo, nlo)), any_value(greatest(hi, nhi)), any_value(ok AND nok) FROM (
  SELECT tau, stab, c.source, c.chrom, rep, median(x) AS obs, median(v) AS mid FROM c{k} AS c JOIN dense AS d ON d.source = c.source AND d.chrom = c.chrom AND d.i >= c.s AND d.i < c.ne GROUP BY ALL) AS n JOIN c{k} AS c USING ({key}) GROUP BY {key})"""
    gone = " UNION ALL ".join(f"SELECT {key}, last AS id, {k + 1} AS pass FROM c{k}" for k in range(steps))
    failed = " UNION ALL ".join(f"SELECT {key}, last AS id, {k} AS k, reason FROM e{k} WHERE inner_ AND small AND reason <> ''" for k in range(steps + 1))
    return f"""{out}, decided AS MATERIALIZED (SELECT e0.tau, e0.stab, e0.source, e0.chrom, e0.last AS id, e0.e AS bin, e0.inner_ AND e0.small AS candidate, e0.delta, CASE WHEN e0.m > 0 AND e0.nm > 0 AND e0.valid = {REPLICATES} THEN e0.under END AS under, e0.inner_ AND e0.small AND e0.plain = '' AS eligible,
 g.pass IS NOT NULL AS removed, g.pass, CASE WHEN g.pass IS NOT NULL THEN 'removed_iter' || lpad(g.pass::VARCHAR, 2, '0') WHEN NOT z.inner_ THEN 'terminal_unchanged' WHEN f.reason IS NOT NULL THEN f.reason WHEN NOT z.small THEN 'long_long_not_candidate' ELSE 'never_candidate' END AS reason
 FROM e0 LEFT JOIN ({gone}) AS g ON g.tau = e0.tau AND g.stab = e0.stab AND g.source = e0.source AND g.chrom = e0.chrom AND g.id = e0.last
 LEFT JOIN (SELECT {key}, id, arg_max(reason, k) AS reason FROM ({failed}) GROUP BY {key}, id) AS f ON f.tau = e0.tau AND f.stab = e0.stab AND f.source = e0.source AND f.chrom = e0.chrom AND f.id = e0.last
 LEFT JOIN e{steps} AS z ON z.tau = e0.tau AND z.stab = e0.stab AND z.source = e0.source AND z.chrom = e0.chrom AND z.last = e0.last)"""


_GRID = f"{pruned_sql(TAUS, STABS)}, counted AS (SELECT source, chrom, tau, stab, count(*) AS n_boundaries, count(*) FILTER (removed) AS n_merged, count(*) FILTER (NOT removed) AS n_retained, count(*) FILTER (NOT removed) + 1 AS n_segments FROM decided GROUP BY ALL)"
query("m22_pruned_boundaries", "source chrom:i bin:i removed pass:i reason", f"{pruned_sql()} SELECT * FROM decided")(_decisions)
query("m26_sensitivity", "source chrom:i tau:r stab:r n_boundaries:i n_merged:i n_retained:i n_segments:i", f"{_GRID} SELECT * FROM counted")(lambda g: prune.sensitivity(_decisions(g, TAUS, STABS)))
query("a21_merged_by_cutoffs", "tau:r low:i middle:i high:i", f"{_GRID} SELECT tau, {', '.join(f'sum(n_merged) FILTER (stab = {v}) AS {c}' for v, c in zip(STABS, ('low', 'middle', 'high')))} FROM counted GROUP BY tau")(lambda g: prune.merged_by_cutoffs(_decisions(g, TAUS, STABS), STABS).toDF("tau", "low", "middle", "high"))
query("a26_prototype_summary", "source chrom:i n_segments:i n_boundaries:i n_nominated:i n_eligible:i n_merged:i least_delta:r median_delta:r largest_under:r", f"""{pruned_sql()} SELECT source, chrom, count(*) + 1 AS n_segments, count(*) AS n_boundaries, count(*) FILTER (candidate) AS n_nominated, count(*) FILTER (eligible) AS n_eligible, count(*) FILTER (removed) AS n_merged,
 min(abs(delta)) FILTER (candidate) AS least_delta, median(abs(delta)) FILTER (candidate) AS median_delta, max(under) FILTER (candidate) AS largest_under FROM decided GROUP BY ALL""")(lambda g: prune.review_summary(_decisions(g)))
_SIMPLE = f"""{pruned_sql()}, kept AS (SELECT source, chrom, bin FROM decided WHERE NOT removed), marked AS (SELECT st.source, st.chrom, st.seg AS original, st.s, st.e, CASE WHEN st.median > 0 THEN log2(st.median) END AS level, sum(CASE WHEN k.bin IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY st.source, st.chrom ORDER BY st.s) AS seg
 FROM st LEFT JOIN kept AS k ON k.source = st.source AND k.chrom = st.chrom AND k.bin = st.s)
 SELECT source, chrom, seg, min(s) AS bin_start, max(e) AS bin_end, count(*) AS n_original, min(original) AS first_original, count(*) > 1 AS merged, CASE WHEN count(*) = count(level) THEN max(level) - min(level) END AS range FROM marked GROUP BY source, chrom, seg"""


@query("m31_simplified_segments", "source chrom:i seg:i bin_start:i bin_end:i n_original:i first_original:i merged range:r", _SIMPLE)
def m31_simplified(g: Genome) -> DataFrame:
    sizes = g.profile.groupBy(*PLACE).agg(F.count("*").alias("n"))
    return prune.simplified_segments(written(_decisions(g)), sizes, _summaries(g))


_OPEN = f"""{pruned_sql()} SELECT st.source, st.chrom, st.seg, st.s, st.e, st.median, l.removed AS merged_left, l.reason AS reason_left, r.removed AS merged_right, r.reason AS reason_right, NOT l.removed AND NOT r.removed AS standalone
 FROM st JOIN decided AS l ON l.source = st.source AND l.chrom = st.chrom AND l.bin = st.s JOIN decided AS r ON r.source = st.source AND r.chrom = st.chrom AND r.bin = st.e WHERE st.e - st.s <= {MAX_BINS}"""
query("m31_unresolved_segments", "source chrom:i seg:i s:i e:i median:r merged_left reason_left merged_right reason_right standalone", _OPEN)(lambda g: prune.unresolved_segments(written(_decisions(g)), _summaries(g), MAX_BINS))
_SIDE = "round(log2((\"sum\" / n + 1e-12) / (s{0} / n{0} + 1e-12)), 4)"
_CANDIDATES = f"""SELECT *, CASE proposal WHEN 'merge_left' THEN s WHEN 'merge_right' THEN e END AS proposed FROM (SELECT *, CASE WHEN strong_left AND strong_right THEN CASE WHEN sign(srd_left) = sign(srd_right) AND sign(srd_left) <> 0 THEN 'keep_focal' ELSE 'ambiguous_keep' END WHEN strong_right THEN 'merge_left' WHEN strong_left THEN 'merge_right'
 WHEN abs(log2fc_left) <= abs(log2fc_right) THEN 'merge_left' ELSE 'merge_right' END AS proposal FROM (SELECT *, abs(srd_left) >= {SRD_REF} AND abs(log2fc_left) >= {EFFECT} AS strong_left, abs(srd_right) >= {SRD_REF} AND abs(log2fc_right) >= {EFFECT} AS strong_right
 FROM (SELECT source, chrom, seg, s, e, round(srd_left, 4) AS srd_left, round(srd_right, 4) AS srd_right, {_SIDE.format("l")} AS log2fc_left, {_SIDE.format("r")} AS log2fc_right FROM sd WHERE n <= {MAX_BINS})))"""
query("m28_small_candidates", "source chrom:i seg:i srd_left:r srd_right:r log2fc_left:r log2fc_right:r strong_left strong_right proposal proposed:i conflict", f"SELECT *, proposed IS NOT NULL AND count(proposed) OVER (PARTITION BY source, chrom, proposed) > 1 AS conflict FROM ({_CANDIDATES})")(
    lambda g: prune.small_candidates(_summaries(g), MAX_BINS, SRD_REF, EFFECT)
)


@query("m29_first_pass", "source chrom:i bin:i", f"SELECT DISTINCT source, chrom, CASE proposal WHEN 'merge_left' THEN s WHEN 'merge_right' THEN e WHEN 'ambiguous_keep' THEN CASE WHEN abs(srd_left) <= abs(srd_right) THEN s ELSE e END END AS bin FROM ({_CANDIDATES}) WHERE proposal <> 'keep_focal'")
def m29_first(g: Genome) -> DataFrame:
    return prune.converge(g.profile, g.boundaries, MAX_BINS, SRD_REF, EFFECT).where("pass = 0")




def converged_sql(passes: int = 12) -> str:
    """The boundaries that go in each pass in SQL, a pass after another; more passes than are needed propose nothing."""
    side = "sign(y / n - {0}y / {0}n) * sqrt(greatest(2 * ((CASE WHEN y > 0 THEN y * ln(y / (n * (y + {0}y) / (n + {0}n))) ELSE 0 END) + (CASE WHEN {0}y > 0 THEN {0}y * ln({0}y / ({0}n * (y + {0}y) / (n + {0}n))) ELSE 0 END)), 0::DOUBLE))"
    scores = ", ".join(f"round(CASE WHEN y + {k}y = 0 THEN 0 ELSE {side.format(k)} END, 4) AS {k}r, round(log2((y / n + 1e-12) / ({k}y / {k}n + 1e-12)), 4) AS {k}f" for k in "lr")
    out = "b0 AS (SELECT source, chrom, bin FROM boundaries)"
    for k in range(passes):
        out += f""", g{k} AS MATERIALIZED (SELECT source, chrom, seg, min(i) AS s, max(i) + 1 AS e, sum(x) AS y, count(*)::DOUBLE AS n FROM (SELECT p.source, p.chrom, p.i, p.x, sum(CASE WHEN b.bin IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.source, p.chrom ORDER BY p.i) AS seg
 FROM profile AS p LEFT JOIN b{k} AS b ON b.source = p.source AND b.chrom = p.chrom AND b.bin = p.i) GROUP BY source, chrom, seg),
 p{k} AS MATERIALIZED (SELECT DISTINCT source, chrom, {k} AS pass, bin FROM (SELECT source, chrom, CASE WHEN ls AND rs THEN CASE WHEN sign(lr) <> sign(rr) OR lr = 0 THEN CASE WHEN abs(lr) <= abs(rr) THEN s ELSE e END END WHEN ls THEN e WHEN rs THEN s WHEN abs(lf) <= abs(rf) THEN s ELSE e END AS bin FROM (
 SELECT *, abs(lr) >= {SRD_REF} AND abs(lf) >= {EFFECT} AS ls, abs(rr) >= {SRD_REF} AND abs(rf) >= {EFFECT} AS rs FROM (SELECT *, {scores} FROM (SELECT *, lag(y) OVER w AS ly, lag(n) OVER w AS ln, lead(y) OVER w AS ry, lead(n) OVER w AS rn FROM g{k} WINDOW w AS (PARTITION BY source, chrom ORDER BY seg)) WHERE ln IS NOT NULL AND rn IS NOT NULL AND n <= {MAX_BINS}))) WHERE bin IS NOT NULL),
 b{k + 1} AS MATERIALIZED (SELECT source, chrom, bin FROM b{k} ANTI JOIN p{k} USING (source, chrom, bin))"""
    return f"WITH {out} " + " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(passes))


query("m29_converged", "source chrom:i pass:i bin:i", converged_sql())(lambda g: prune.converge(g.profile, g.boundaries, MAX_BINS, SRD_REF, EFFECT))
