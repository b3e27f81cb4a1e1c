"""Scans for breakpoints and the event index as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.operators import allelic, kernels, scan
from binloom.operators.permute import permutations_sql
from binloom.operators.segments import PLACE
from binloom.sources.genome import Genome

from .catalog import allele_counts, labelled, query


def curves_sql(rows: str, keys: str) -> str:
    """The Anderson-Darling curve of each key's values along i, in SQL: running counts for each distinct value."""
    return f"""SELECT {keys}, i + 1 AS cut, (n - 1) / n * (1 / c + 1 / (n - c)) * sum(CASE WHEN d > 0 THEN l / n * power(n * m - c * ba, 2) / d ELSE 0::DOUBLE END) AS ad
 FROM (SELECT {keys}, i, l, ba, n, ba * (n - ba) - n * l / 4 AS d, count(*) OVER w AS c, sum(CASE WHEN x < z THEN 1::DOUBLE WHEN x = z THEN 0.5::DOUBLE ELSE 0::DOUBLE END) OVER w AS m
 FROM {rows} AS p JOIN (SELECT *, sum(l) OVER (PARTITION BY {keys} ORDER BY z) - l / 2 AS ba, sum(l) OVER (PARTITION BY {keys}) AS n FROM (SELECT {keys}, x AS z, count(*)::DOUBLE AS l FROM {rows} GROUP BY ALL)) AS v USING ({keys})
 WINDOW w AS (PARTITION BY {keys}, z ORDER BY i)) WHERE c < n GROUP BY {keys}, i, c, n"""


def depth_track(g: Genome) -> DataFrame:
    """The profile; every bin is kept."""
    return g.profile.withColumn("kept", F.lit(True))


def allelic_track(g: Genome) -> DataFrame:
    """The share's excess in bins of five reads and more; bins without reads aren't kept."""
    rows = allelic.signals(allele_counts(g), 5)
    return g.profile.drop("x").join(rows, [*PLACE, "i"], "left").withColumns({"kept": F.coalesce("kept", F.lit(False)), "x": F.col("shrunk_abs_dbaf")})


def planted_track(g: Genome) -> DataFrame:
    """The profile with two steps planted into a third of the chromosomes: half as much again for a while, and half at the end."""
    number = F.when(F.col("source") == "all", 2).otherwise(F.substring("source", 8, 3).cast("int"))
    planted = (F.col("chrom") + number) % 3 == 0
    factor = F.when(planted & F.col("i").between(120, 199), 1.5).when(planted & (F.col("i") >= 260), 0.5).otherwise(1.0)
    return g.profile.withColumns({"x": F.col("x") * factor, "kept": F.lit(True)})


def planted_allelic_track(g: Genome) -> DataFrame:
    """The allelic track with a stretch of imbalance in a third of the chromosomes."""
    number = F.when(F.col("source") == "all", 2).otherwise(F.substring("source", 8, 3).cast("int"))
    more = F.when(((F.col("chrom") + number) % 3 == 1) & F.col("i").between(100, 219), 0.25).otherwise(0.0)
    return allelic_track(g).withColumn("x", F.col("x") + more)


_NUMBER = "(CASE WHEN source = 'all' THEN 2 ELSE try_cast(substr(source, 8) AS INT) END)"
PLANTED = f"SELECT source, chrom, i, x * CASE WHEN (chrom + {_NUMBER}) % 3 = 0 AND i BETWEEN 120 AND 199 THEN 1.5::DOUBLE WHEN (chrom + {_NUMBER}) % 3 = 0 AND i >= 260 THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS x FROM profile"
PLANTED_ALLELIC = f"SELECT source, chrom, i, shrunk_abs_dbaf + CASE WHEN (chrom + {_NUMBER}) % 3 = 1 AND i BETWEEN 100 AND 219 THEN 0.25::DOUBLE ELSE 0::DOUBLE END AS x FROM sig WHERE kept"


def scan_sql(track: str, pool: str = "genome", s: scan.Settings = scan.Settings()) -> str:
    """Tables scanned (AUDIT) and tr (kept bins with their places) of a track (source, chrom, i, x) in SQL: a level of nodes after another."""
    by = "source" if pool == "genome" else "source, chrom"
    short = "".join(f", CASE WHEN {test} THEN '{name}' END" for test, name in (
        (f"cut < {s.min_child}", "left_child_too_short"), (f"lo = 0 AND cut < {s.min_terminal}", "left_terminal_too_short"),
        (f"hi - lo - cut < {s.min_child}", "right_child_too_short"), (f"hi = n AND hi - lo - cut < {s.min_terminal}", "right_terminal_too_short")))
    out = f"""tr AS MATERIALIZED (SELECT source, chrom, row_number() OVER (PARTITION BY source, chrom ORDER BY i) - 1 AS k, i, x FROM ({track})),
 pl AS MATERIALIZED (SELECT source, chrom, row_number() OVER (PARTITION BY {by} ORDER BY x) - 1 AS i, x FROM tr), whole AS MATERIALIZED (SELECT source, chrom, count(*) AS n FROM tr GROUP BY ALL),
 n0 AS (SELECT source, chrom, 0 AS lo, n AS hi FROM whole WHERE n > 1)"""
    for d in range(s.depths):
        out += f""", m{d} AS MATERIALIZED (SELECT t.source, t.chrom, lo, hi, k - lo AS i, x, '{s.seed}:' || t.source || ':' || t.chrom || ':' || lo || ':' || hi AS name FROM n{d} AS v JOIN tr AS t ON t.source = v.source AND t.chrom = v.chrom AND k >= lo AND k < hi),
 c{d} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER w AS rank, coalesce(sum(CASE WHEN reasons = '' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
  SELECT *, concat_ws(';'{short}) AS reasons FROM ({curves_sql(f"m{d}", "source, chrom, lo, hi, name")}) JOIN whole USING (source, chrom)) WINDOW w AS (PARTITION BY name ORDER BY round(ad, 9) DESC, cut)) WHERE before = 0),
 t{d} AS MATERIALIZED (SELECT *, hi - lo AS size, ad AS observed FROM c{d} WHERE reasons = ''), pa{d} AS MATERIALIZED ({permutations_sql(f"(SELECT name, size, cut, observed FROM t{d})", f"(SELECT name, i, x FROM m{d})", "name", s.permutations, False)}),
 pb{d} AS MATERIALIZED ({permutations_sql(f"(SELECT t{d}.name || ':pool' AS name, {by}, size, cut, observed FROM t{d} JOIN pa{d} USING (name) WHERE p < {s.alpha})", f"(SELECT {by}, i, x FROM pl)", by, s.permutations, True)}),
 r{d} AS MATERIALIZED (SELECT source, chrom, {d} AS depth, lo AS node_start, hi AS node_end, rank, lo + c{d}.cut AS cut, tr.i AS bin, ad, c{d}.cut AS left_bins, hi - lo - c{d}.cut AS right_bins, reasons = '' AS valid, reasons, reasons = '' AS tested,
  pa{d}.p AS p_local, pb{d}.p AS p_global, coalesce(pb{d}.p < {s.alpha}, false) AS accepted FROM c{d} JOIN tr USING (source, chrom) LEFT JOIN pa{d} ON pa{d}.name = c{d}.name AND reasons = '' LEFT JOIN pb{d} ON pb{d}.name = c{d}.name || ':pool' AND reasons = '' WHERE tr.k = lo + c{d}.cut
  UNION ALL SELECT source, chrom, {d}, lo, hi, NULL, NULL, NULL, NULL, NULL, NULL, false, 'no_valid_candidate', false, NULL, NULL, false FROM n{d} WHERE NOT EXISTS (SELECT 1 FROM t{d} WHERE t{d}.source = n{d}.source AND t{d}.chrom = n{d}.chrom AND t{d}.lo = n{d}.lo)),
 n{d + 1} AS (SELECT * FROM (SELECT source, chrom, node_start AS lo, cut AS hi FROM r{d} WHERE accepted UNION ALL SELECT source, chrom, cut, node_end FROM r{d} WHERE accepted) WHERE hi - lo > 1)"""
    return out + ", scanned AS (" + " UNION ALL ".join(f"SELECT * FROM r{d}" for d in range(s.depths)) + ")"


query("g8_ad_curve", "source chrom:i cut:i ad:r", curves_sql("profile", "source, chrom"))(lambda g: kernels.ad_curves(g.profile))
_TOPS = "SELECT source, chrom, cut, round(ad, 9) AS ad FROM (SELECT *, lag(round(ad, 9)) OVER w AS p, lead(round(ad, 9)) OVER w AS q FROM ({curves}) WINDOW w AS (PARTITION BY source, chrom ORDER BY cut)) WHERE (p IS NULL OR round(ad, 9) >= p) AND (q IS NULL OR round(ad, 9) > q)"
_PEAKS = """WITH RECURSIVE tops AS (SELECT *, row_number() OVER (PARTITION BY source, chrom ORDER BY ad DESC, cut) AS k FROM ({tops})),
 walk AS (SELECT source, chrom, 0::BIGINT AS k, false AS won, []::BIGINT[] AS chosen, NULL::BIGINT AS position, NULL::DOUBLE AS value FROM (SELECT DISTINCT source, chrom FROM tops)
 UNION ALL SELECT source, chrom, k, free, CASE WHEN free THEN list_append(chosen, cut) ELSE chosen END, cut, ad
 FROM (SELECT w.source, w.chrom, t.k, len(list_filter(w.chosen, lambda c: abs(c - t.cut) < 60)) = 0 AS free, w.chosen, t.cut, t.ad FROM walk AS w JOIN tops AS t ON t.source = w.source AND t.chrom = w.chrom AND t.k = w.k + 1 WHERE len(w.chosen) < 5))
 SELECT source, chrom, len(chosen) AS rank, position, value FROM walk WHERE won"""
query("w10_greedy_peaks", "source chrom:i rank:i position:i value:r", _PEAKS.format(tops=_TOPS.format(curves=curves_sql("profile", "source, chrom"))))(lambda g: kernels.greedy_peaks(kernels.ad_curves(g.profile)))
_AUDIT = "source chrom:i depth:i node_start:i node_end:i rank:i cut:i bin:i ad:r left_bins:i right_bins:i valid reasons tested p_local:r p_global:r accepted"
query("g18_genome_pool_audit", _AUDIT, f"WITH {scan_sql('SELECT source, chrom, i, x FROM profile')} SELECT * FROM scanned")(lambda g: scan.candidates(depth_track(g)))
_CHILD = "CASE WHEN cut < 20 THEN 'left_child_too_short' END, CASE WHEN cut < 50 THEN 'left_terminal_too_short' END, CASE WHEN n - cut < 20 THEN 'right_child_too_short' END, CASE WHEN n - cut < 50 THEN 'right_terminal_too_short' END"


@query("g12_root_candidates", "source chrom:i rank:i bin:i ad:r valid reasons", f"""SELECT *, cut AS bin, reasons = '' AS valid FROM (SELECT *, row_number() OVER w AS rank, coalesce(sum(CASE WHEN reasons = '' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM (SELECT source, chrom, cut, ad, concat_ws(';', {_CHILD}) AS reasons FROM ({curves_sql("profile", "source, chrom")}) JOIN (SELECT chrom, count(*) AS n FROM bins GROUP BY chrom) USING (chrom)) WINDOW w AS (PARTITION BY source, chrom ORDER BY round(ad, 9) DESC, cut)) WHERE before = 0""")
def g12_candidates(g: Genome) -> DataFrame:
    """What the scan looks at in each chromosome's root, up to the candidate that is tested; none of it hangs on permutations."""
    return scan.candidates(depth_track(g), settings=scan.Settings(depths=1, permutations=1)).where("rank IS NOT NULL")


def _scanned(track: DataFrame, settings: scan.Settings = scan.Settings()) -> DataFrame:
    return scan.breakpoints(scan.candidates(track, settings=settings), track)


#: The settings of the planted depth scan: a level of the planted track has ten times the global tests of the others.
QUICK = scan.Settings(permutations=200, alpha=0.01)


_BREAKS = "source chrom:i bin:i gap_start:i gap_end:i depth:i ad:r p_local:r p_global:r"
_FOUND = """found AS (SELECT s.source, s.chrom, bin, CASE WHEN bin - q.i > 1 THEN q.i + 1 END AS gap_start, CASE WHEN bin - q.i > 1 THEN bin END AS gap_end, depth, ad, p_local, p_global
 FROM scanned AS s JOIN tr AS q ON q.source = s.source AND q.chrom = s.chrom AND q.k = s.cut - 1 WHERE accepted)"""
query("g12_scan_breakpoints", _BREAKS, f"WITH {scan_sql(PLANTED, s=QUICK)}, {_FOUND} SELECT * FROM found")(lambda g: _scanned(planted_track(g), QUICK))
_ENDED = "SELECT source, chrom, depth, node_start AS start, node_end AS \"end\", bin, ad, p_local, p_global, accepted, CASE WHEN NOT tested THEN reasons WHEN accepted THEN '' WHEN p_global IS NULL THEN 'p_local' ELSE 'p_global' END AS reason FROM scanned WHERE tested OR rank IS NULL"
query("g11_recursive_breakpoints", "source chrom:i depth:i start:i end:i bin:i ad:r p_local:r p_global:r accepted reason", f"WITH {scan_sql(PLANTED, 'chromosome')} {_ENDED}")(lambda g: kernels.recursive_breakpoints(planted_track(g)))
query("l4_allelic_breakpoints", _BREAKS, f"WITH {scan_sql(PLANTED_ALLELIC)}, {_FOUND} SELECT * FROM found")(lambda g: _scanned(planted_allelic_track(g)))
_SEGMENTS = f"""WITH {scan_sql(PLANTED_ALLELIC)}, {_FOUND}, every AS (SELECT p.source, p.chrom, p.i, coalesce(sig.kept, false) AS kept, t.x, ha, hb, sum(CASE WHEN f.bin IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.source, p.chrom ORDER BY p.i) AS seg
 FROM profile AS p LEFT JOIN sig ON sig.source = p.source AND sig.chrom = p.chrom AND sig.i = p.i LEFT JOIN tr AS t ON t.source = p.source AND t.chrom = p.chrom AND t.i = p.i LEFT JOIN found AS f ON f.source = p.source AND f.chrom = p.chrom AND f.bin = p.i)
 SELECT source, chrom, seg, min(i) AS bin_start, max(i) AS bin_end, count(*) AS n_bins, count(*) FILTER (kept) AS kept_bins, avg(x) FILTER (kept) AS mean, median(x) FILTER (kept) AS median, sum(ha) FILTER (kept) AS ha_sum, sum(hb) FILTER (kept) AS hb_sum FROM every GROUP BY ALL"""
query("l4_allelic_segments", "source chrom:i seg:i bin_start:i bin_end:i n_bins:i kept_bins:i mean:r median:r ha_sum:i hb_sum:i", _SEGMENTS)(lambda g: scan.scanned_segments(planted_allelic_track(g), _scanned(planted_allelic_track(g)), ("ha", "hb")))


@query("g12_segment_statistics", "source chrom:i seg:i bin_start:i bin_end:i n_bins:i kept_bins:i mean:r median:r ha_sum:i hb_sum:i", """SELECT lab.source, lab.chrom, lab.seg, min(lab.i) AS bin_start, max(lab.i) AS bin_end, count(*) AS n_bins, count(*) FILTER (sig.kept) AS kept_bins,
 avg(shrunk_abs_dbaf) FILTER (sig.kept) AS mean, median(shrunk_abs_dbaf) FILTER (sig.kept) AS median, sum(ha) FILTER (sig.kept) AS ha_sum, sum(hb) FILTER (sig.kept) AS hb_sum FROM lab LEFT JOIN sig ON sig.source = lab.source AND sig.chrom = lab.chrom AND sig.i = lab.i GROUP BY ALL""")
def g12_statistics(g: Genome) -> DataFrame:
    """The statistics of given segments over the allelic track's kept bins."""
    return scan.scanned_segments(allelic_track(g), g.boundaries, ("ha", "hb"))


@query("g12_gaps", "source chrom:i bin:i gap_start:i gap_end:i", """SELECT sig.source, sig.chrom, sig.i AS bin, CASE WHEN sig.i - p > 1 THEN p + 1 END AS gap_start, CASE WHEN sig.i - p > 1 THEN sig.i END AS gap_end
 FROM (SELECT *, lag(i) OVER (PARTITION BY source, chrom ORDER BY i) AS p FROM sig WHERE kept) AS sig JOIN boundaries AS b ON b.source = sig.source AND b.chrom = sig.chrom AND b.bin = sig.i""")
def g12_gaps(g: Genome) -> DataFrame:
    """The gaps of breakpoints that are given, where their bins are kept."""
    columns = {"accepted": F.lit(True), "depth": F.lit(0), "ad": F.lit(0.0), "p_local": F.lit(0.0), "p_global": F.lit(0.0)}
    return scan.breakpoints(g.boundaries.withColumns(columns), allelic_track(g))


query("g15_split_trees", "source chrom:i side depth:i start:i end:i cut:i ad:r p_local:r p_global:r hypothetical accepted")(lambda g: scan.split_trees(depth_track(g)))
_FAILED = "CASE WHEN reasons <> '' THEN reasons WHEN p_local >= 0.001 THEN 'local permutation p = ' || round(p_local, 6) || ' >= 0.001' WHEN p_global >= 0.001 THEN 'global permutation p = ' || round(p_global, 6) || ' >= 0.001' WHEN tested AND NOT accepted THEN 'not accepted' END"
query("g19_rejections", "source chrom:i bin:i reason", f"WITH {scan_sql('SELECT source, chrom, i, x FROM profile')} SELECT * FROM (SELECT source, chrom, bin, {_FAILED} AS reason FROM scanned) WHERE reason IS NOT NULL")(lambda g: scan.candidates(depth_track(g)).withColumn("reason", scan.rejection_reason()).where("reason IS NOT NULL"))


def cell_cuts(g: Genome) -> DataFrame:
    """Each cell's breakpoints: those of its cluster."""
    return g.membership.where("source <> 'all'").join(g.boundaries, "source").select("cell", "chrom", "bin")


def _events(g: Genome) -> DataFrame:
    return scan.event_index(g.signal, g.bins, cell_cuts(g))


_DENSE = "(SELECT c.cell, b.chrom, b.i, coalesce(s.x, 0)::DOUBLE AS x FROM cells AS c CROSS JOIN bins AS b LEFT JOIN signal AS s ON s.cell = c.cell AND s.g = b.g)"
_BEST = "SELECT *, row_number() OVER (PARTITION BY cell, chrom, node ORDER BY round(ad, 9) DESC, cut) AS k FROM"
_EVENTS = f"""WITH dense AS {_DENSE}, root AS (SELECT * FROM ({_BEST} (SELECT *, 'root' AS node FROM ({curves_sql("dense", "cell, chrom")}))) WHERE k = 1),
 halves AS (SELECT dense.cell, dense.chrom, CASE WHEN dense.i < root.cut THEN 'left' ELSE 'right' END AS node, dense.i, dense.x FROM dense JOIN root USING (cell, chrom)),
 side AS (SELECT * FROM ({_BEST} ({curves_sql("halves", "cell, chrom, node")})) WHERE k = 1),
 own AS (SELECT 'cluster' || (cell % 5) AS source, cell FROM cells), known AS (SELECT DISTINCT cell, chrom, bin FROM own JOIN boundaries USING (source)),
 marked AS (SELECT r.cell, r.chrom, r.cut, r.ad, r.node, b.bin IS NOT NULL AS accepted FROM root AS r LEFT JOIN known AS b ON b.cell = r.cell AND b.chrom = r.chrom AND b.bin = r.cut),
 size AS (SELECT cell, chrom, node, min(i) AS lo, max(i) + 1 AS hi FROM halves GROUP BY ALL), whole AS (SELECT chrom, count(*) AS n FROM bins GROUP BY chrom)
 SELECT cell, chrom, node, cut AS bin, ad, accepted, true AS parent_accepted, cut AS n_left, n - cut AS n_right FROM marked JOIN whole USING (chrom)
 UNION ALL SELECT s.cell, s.chrom, s.node, s.cut, s.ad, m.accepted AND b.bin IS NOT NULL, m.accepted, s.cut - z.lo, z.hi - s.cut FROM side AS s JOIN marked AS m ON m.cell = s.cell AND m.chrom = s.chrom JOIN size AS z ON z.cell = s.cell AND z.chrom = s.chrom AND z.node = s.node
 LEFT JOIN known AS b ON b.cell = s.cell AND b.chrom = s.chrom AND b.bin = s.cut"""
query("g14_event_index", "cell:i chrom:i node bin:i ad:r accepted parent_accepted n_left:i n_right:i", _EVENTS)(_events)
query("p5_event_cells", "cell:i", f'SELECT DISTINCT cell FROM ({_EVENTS}) AS v JOIN bins AS q ON q.chrom = v.chrom AND q.i = v.bin WHERE q."start" >= 800000001 AND q."start" <= 1000000001')(
    lambda g: scan.event_rule(_events(g), g.bins, "any", 800000001, 1000000001)
)
