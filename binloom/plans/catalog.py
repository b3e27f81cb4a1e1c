"""The engine's operators as queries over the genome view, with the same in SQL.

Each entry names the columns of both sides once: plain, :i for long, :r for rounded to six decimals.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from binloom.functions import stats
from binloom.plans import rounds
from binloom.operators import allelic, calls, cohort, kernels, ordering, resample, segments, tracks
from binloom.operators.segments import PLACE
from binloom.plans.rules import Condition, ConditionRule, FlankRule, RuleSet, evaluate, flank_rule
from binloom.sources.genome import Genome

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

GENOME = """
WITH lines AS (SELECT l_suppkey AS cell, l_shipdate::DATE AS dt, l_quantity AS x, l_linestatus AS status FROM lineitem),
bins AS (SELECT row_number() OVER (ORDER BY dt) - 1 AS g, year(dt) AS chrom, row_number() OVER (PARTITION BY year(dt) ORDER BY dt) - 1 AS i,
  (dt - DATE '1970-01-01') * 100000 + 1 AS "start", (dt - DATE '1970-01-01') * 100000 + 100000 AS "end", dt FROM (SELECT DISTINCT dt FROM lines)),
signal AS (SELECT cell, g, chrom, i, sum(x) AS x FROM lines JOIN bins USING (dt) GROUP BY ALL),
membership AS (SELECT DISTINCT 'cluster' || (cell % 5) AS source, cell FROM signal UNION ALL SELECT DISTINCT 'all', cell FROM signal),
n_cells AS (SELECT source, count(*) AS n_cells FROM membership GROUP BY source),
totals AS (SELECT source, g, sum(x) AS total FROM signal JOIN membership USING (cell) GROUP BY ALL),
profile AS (SELECT n.source, b.chrom, b.g, b.i, b."start", b."end", b.dt, coalesce(t.total, 0) / n.n_cells AS x FROM bins AS b CROSS JOIN n_cells AS n LEFT JOIN totals AS t ON t.source = n.source AND t.g = b.g),
boundaries AS (SELECT source, chrom, i AS bin FROM (SELECT *, lag(month(dt)) OVER (PARTITION BY source, chrom ORDER BY i) AS pm FROM profile)
  WHERE i > 0 AND ((month(dt) <> pm AND (source = 'all' OR (month(dt) + try_cast(substr(source, 8) AS INT)) % 3 <> 0)) OR (day(dt) = 10 AND month(dt) % 3 = 0))),
lab AS (SELECT p.*, sum(CASE WHEN b.bin IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.source, p.chrom ORDER BY p.i)::BIGINT AS seg
  FROM profile AS p LEFT JOIN boundaries AS b ON b.source = p.source AND b.chrom = p.chrom AND b.bin = p.i),
st AS (SELECT source, chrom, seg, min(i) AS s, max(i) + 1 AS e, min("start") AS "start", max("end") AS "end", sum(x) AS "sum", count(*) AS n, avg(x) AS mean,
  quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, stddev_samp(x) AS std, var_pop(x) AS v,
  avg(CASE WHEN x = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS zero_fraction FROM lab GROUP BY ALL),
it AS (SELECT source, chrom, seg, avg(x) AS iqr_mean, count(*) AS retained FROM lab JOIN st USING (source, chrom, seg)
  WHERE round(x - q1 + 1.5::DOUBLE * (q3 - q1), 9) >= 0 AND round(x - q3 - 1.5::DOUBLE * (q3 - q1), 9) <= 0 GROUP BY ALL),
summ AS (SELECT st.*, it.iqr_mean, coalesce(it.retained, 0) AS retained, CASE WHEN mean > 0 THEN std / mean END AS cv FROM st LEFT JOIN it USING (source, chrom, seg)),
phi AS (SELECT source, chrom, sum(CASE WHEN n >= 2 AND mean > 0 THEN v * n / mean END) / sum(CASE WHEN n >= 2 AND mean > 0 THEN n - 1 END) AS phi FROM st GROUP BY ALL),
fl AS (SELECT summ.*, phi, lag("sum") OVER w AS sl, lead("sum") OVER w AS sr, lag(n) OVER w AS nl, lead(n) OVER w AS nr, lag("end") OVER w AS el, lead("start") OVER w AS str_,
  lag(mean) OVER w AS mean_l, lead(mean) OVER w AS mean_r, lag(median) OVER w AS median_l, lead(median) OVER w AS median_r, lag(iqr_mean) OVER w AS iqr_l, lead(iqr_mean) OVER w AS iqr_r
  FROM summ JOIN phi USING (source, chrom) WINDOW w AS (PARTITION BY source, chrom ORDER BY seg)),
dv AS (SELECT *, ("sum" + sl) / (n + nl) AS rl, ("sum" + sr) / (n + nr) AS rr FROM fl WHERE nl IS NOT NULL AND nr IS NOT NULL),
sd AS (SELECT *, CASE WHEN "sum" + sl = 0 THEN 0::DOUBLE ELSE sign("sum" / n - sl / nl) * sqrt(greatest(2 * ((CASE WHEN "sum" = 0 THEN 0::DOUBLE ELSE "sum" * ln("sum" / (n * rl)) END) + (CASE WHEN sl = 0 THEN 0::DOUBLE ELSE sl * ln(sl / (nl * rl)) END)), 0::DOUBLE)) END AS srd_left,
  CASE WHEN "sum" + sr = 0 THEN 0::DOUBLE ELSE sign("sum" / n - sr / nr) * sqrt(greatest(2 * ((CASE WHEN "sum" = 0 THEN 0::DOUBLE ELSE "sum" * ln("sum" / (n * rr)) END) + (CASE WHEN sr = 0 THEN 0::DOUBLE ELSE sr * ln(sr / (nr * rr)) END)), 0::DOUBLE)) END AS srd_right FROM dv),
hs AS (SELECT source, chrom, seg, s, e, n, mean, median, iqr_mean, phi, srd_left, srd_right, CASE WHEN phi > 0 THEN srd_left / sqrt(phi) END AS srd_phi_left, CASE WHEN phi > 0 THEN srd_right / sqrt(phi) END AS srd_phi_right,
  CASE WHEN mean > 0 AND mean_l > 0 THEN log2(mean / mean_l) END AS delta_mean_left, CASE WHEN mean > 0 AND mean_r > 0 THEN log2(mean / mean_r) END AS delta_mean_right,
  CASE WHEN median > 0 AND median_l > 0 THEN log2(median / median_l) END AS delta_median_left, CASE WHEN median > 0 AND median_r > 0 THEN log2(median / median_r) END AS delta_median_right,
  CASE WHEN iqr_mean > 0 AND iqr_l > 0 THEN log2(iqr_mean / iqr_l) END AS delta_iqr_mean_left, CASE WHEN iqr_mean > 0 AND iqr_r > 0 THEN log2(iqr_mean / iqr_r) END AS delta_iqr_mean_right,
  "start" > el + 1 AS gap_left, str_ > "end" + 1 AS gap_right FROM sd),
base AS (SELECT source, quantile_cont(x, 0.5) AS med FROM profile GROUP BY source),
states AS (SELECT st.*, CASE WHEN med > 0 THEN (CASE WHEN mean / med >= 0.9::DOUBLE THEN 0.5::DOUBLE ELSE 0::DOUBLE END) + (CASE WHEN mean / med >= 0.96::DOUBLE THEN 0.5::DOUBLE ELSE 0::DOUBLE END) + (CASE WHEN mean / med >= 1.04::DOUBLE THEN 0.5::DOUBLE ELSE 0::DOUBLE END) + (CASE WHEN mean / med >= 1.1::DOUBLE THEN 0.5::DOUBLE ELSE 0::DOUBLE END) END AS state FROM st JOIN base USING (source)),
cells AS (SELECT cell, sum(x) AS coverage, count(*) AS n_seen, cell % 7 AS other FROM signal GROUP BY ALL),
al AS (SELECT source, chrom, i, count(*) FILTER (status = 'F') AS ha, count(*) FILTER (status = 'O') AS hb FROM lines JOIN bins USING (dt) JOIN membership USING (cell) GROUP BY ALL),
sig AS (SELECT *, ha + hb AS at_, CASE WHEN ha + hb > 0 THEN (ha - hb)::DOUBLE / (ha + hb) END AS dbaf, abs(ha - hb)::DOUBLE / (ha + hb + 2) AS shrunk_abs_dbaf, ha + hb >= 5 AS kept FROM al)
"""

#: Thresholds under which this data has rows of every outcome; the rules' own defaults are for real profiles.
TAU, SRD_REF, MAX_BINS = 0.06, 0.4, 31
STATE_CUTS = (0.9, 0.96, 1.04, 1.1)


def _parts(spec: str) -> list[tuple[str, str]]:
    return [(c.partition(":")[0], c.partition(":")[2]) for c in spec.split()]


def tidy(df: DataFrame, spec: str) -> DataFrame:
    return df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if k == "r" else F.col(c).cast("long").alias(c) if k == "i" else F.col(c) for c, k in _parts(spec)])


def query(name: str, spec: str, body: str | None = None):
    """Registers a function of a Genome as a query; body is SQL after the shared tables."""
    def add(f: Callable[[Genome], DataFrame]) -> Callable[[Genome], DataFrame]:
        _queries[name] = lambda spark, sf_dir: tidy(f(Genome(spark, sf_dir)), spec)
        if body:
            columns = ", ".join(f'round("{c}"::DOUBLE, 6) AS "{c}"' if k == "r" else f'"{c}"::BIGINT AS "{c}"' if k == "i" else f'"{c}"' for c, k in _parts(spec))
            _sql[name] = f"{GENOME}\nSELECT {columns} FROM ({body}) AS t_"
        return f

    return add


def labelled(g: Genome) -> DataFrame:
    return segments.labelled(g.profile, g.boundaries)


def scores(g: Genome) -> DataFrame:
    return segments.flank_scores(labelled(g))


def states(g: Genome) -> DataFrame:
    base = g.profile.groupBy("source").agg(F.percentile("x", F.lit(0.5)).alias("med"))
    rows = segments.segment_summaries(labelled(g)).join(base, "source")
    return rows.withColumn("state", F.when(F.col("med") > 0, calls.state_by_ratio(F.col("mean") / F.col("med"), STATE_CUTS)))


def cells(g: Genome) -> DataFrame:
    return g.signal.groupBy("cell").agg(F.sum("x").alias("coverage"), F.count("*").alias("n_seen")).withColumn("other", F.col("cell") % 7)


def allele_counts(g: Genome) -> DataFrame:
    rows = g.with_sources(g.daily).join(g.bins, "day")
    return rows.groupBy("source", "chrom", "i").agg(F.sum("ha").alias("ha"), F.sum("hb").alias("hb"))


# scans and integrity

query("s2_bins", "g:i chrom:i i:i start:i end:i", "SELECT * FROM bins")(lambda g: g.bins)
query("s5_signal", "cell:i g:i x:r", "SELECT * FROM signal")(lambda g: g.signal)
query("s4_cell_row", "cell:i g:i x:r", "SELECT 7 AS cell, b.g, coalesce(s.x, 0) AS x FROM bins AS b LEFT JOIN (SELECT * FROM signal WHERE cell = 7) AS s USING (g)")(
    lambda g: g.bins.join(g.signal.where("cell = 7").select("g", "x"), "g", "left").select(F.lit(7).alias("cell"), "g", F.coalesce("x", F.lit(0.0)).alias("x"))
)
query("s6_decoded_categories", "name n:i", "SELECT coalesce(n_name, '') AS name, count(*) AS n FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")(
    lambda g: g.read("supplier").join(g.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.coalesce("n_name", F.lit("")).alias("name")).agg(F.count("*").alias("n"))
)
query("s7_breakpoint_index", "source chrom:i n:i bins", "SELECT source, chrom, count(*) AS n, string_agg(bin::VARCHAR, ',' ORDER BY bin) AS bins FROM boundaries GROUP BY ALL")(
    lambda g: g.boundaries.groupBy(*PLACE).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("bin")), ",").alias("bins"))
)
query("z2_chromosomes", "chrom:i offset:i n:i start_bp:i end_bp:i contiguous", 'SELECT chrom, min(g) AS "offset", count(*) AS n, min("start") AS start_bp, max("end") AS end_bp, max(g) - min(g) + 1 = count(*) AS contiguous FROM bins GROUP BY chrom')(
    lambda g: g.chroms.join(g.bins.groupBy("chrom").agg((F.max("g") - F.min("g") + 1 == F.count("*")).alias("contiguous")), "chrom")
)

# projections and filters

query("p1_chromosome_slice", "source chrom:i i:i x:r", "SELECT * FROM profile WHERE chrom = 1997")(lambda g: g.profile.where("chrom = 1997"))
query("p2_region_overlap", "chrom:i g:i", 'SELECT chrom, g FROM bins WHERE "end" >= 980000000 AND "start" <= 1000000000')(lambda g: g.bins.where("end >= 980000000 AND start <= 1000000000"))


@query("p3_cohort_filter", "cell:i coverage:r tercile", """SELECT * FROM (SELECT cell, coverage, CASE WHEN coverage < t1 THEN 'low' WHEN coverage < t2 THEN 'mid' ELSE 'high' END AS tercile
 FROM cells CROSS JOIN (SELECT l[n // 3 + 1] AS t1, l[2 * n // 3 + 1] AS t2 FROM (SELECT list(coverage ORDER BY coverage) AS l, count(*) AS n FROM cells))) WHERE cell::VARCHAR LIKE '%1%' AND tercile IN ('low', 'high') AND coverage >= 100""")
def p3(g: Genome) -> DataFrame:
    return cohort.cohort_filter(cohort.terciles(cells(g), "coverage"), "1", ["low", "high"], 100)


def _cell_states(g: Genome) -> DataFrame:
    """Each cell's states; a task holds the means of its cells and never sorts their signal."""
    mean = g.signal.groupBy("cell").agg(F.avg("x").alias("mean"))
    return g.signal.join(mean.hint("shuffle_hash"), "cell").join(g.bins.select("g", "start"), "g").withColumn("state", F.when(F.col("x") > F.col("mean"), 2.0).otherwise(0.0))


_EVENT = """SELECT cell, count(*) FILTER (s BETWEEN {0} AND {1}) AS n_bins, count(*) FILTER (s BETWEEN {0} AND {1} AND x > mean) AS n_match FROM (SELECT c.cell, c.x, avg(c.x) OVER (PARTITION BY c.cell) AS mean, b."start" AS s FROM signal AS c JOIN bins AS b USING (g)) GROUP BY cell"""
_VERDICT = "CASE WHEN n_bins > 0 THEN n_match > 0 AND n_match / n_bins >= {0}::DOUBLE END AS matches"
_REGIONS = ((900_000_000, 950_000_000, 0.45), (1_000_000_000, 1_001_000_000, 0.5))
query("p4_event_rule", "cell:i n_bins:i n_match:i matches", f"SELECT *, {_VERDICT.format(_REGIONS[1][2])} FROM ({_EVENT.format(*_REGIONS[1][:2])})")(
    lambda g: cohort.region_event(_cell_states(g), *_REGIONS[1][:2], [2.0], _REGIONS[1][2])
)


@query("p6_combined_rules", "cell:i n_ready:i n_match:i selected", "SELECT cell, count(matches) AS n_ready, count(*) FILTER (matches) AS n_match, count(matches) > 0 AND count(*) FILTER (matches) = count(matches) AS selected FROM ("
       + " UNION ALL ".join(f"SELECT cell, {_VERDICT.format(r[2])} FROM ({_EVENT.format(*r[:2])})" for r in _REGIONS) + ") GROUP BY cell")
def p6(g: Genome) -> DataFrame:
    return cohort.combine_events([cohort.region_event(_cell_states(g), r[0], r[1], [2.0], r[2]).select("cell", "matches") for r in _REGIONS], "all")


query("p5_breakpoint_rule", "source", "SELECT DISTINCT source FROM membership WHERE source IN (SELECT source FROM boundaries JOIN bins ON bins.chrom = boundaries.chrom AND bins.i = boundaries.bin WHERE \"start\" BETWEEN 960000000 AND 970000000)")(
    lambda g: g.membership.select("source").distinct().join(g.boundaries.join(g.bins.withColumnRenamed("i", "bin"), ["chrom", "bin"]).where("start BETWEEN 960000000 AND 970000000"), "source", "left_semi")
)
query("p9_small_segments", "source chrom:i seg:i n:i", "SELECT * FROM st WHERE n <= 31")(lambda g: segments.segment_summaries(labelled(g)).where(F.col("n") <= MAX_BINS))
query("p12_window_sides", "source chrom:i left_n:i right_n:i left_mean:r right_mean:r", "SELECT source, chrom, count(*) FILTER (i < 100) AS left_n, count(*) FILTER (i >= 100) AS right_n, avg(x) FILTER (i < 100) AS left_mean, avg(x) FILTER (i >= 100) AS right_mean FROM profile WHERE i BETWEEN 80 AND 119 GROUP BY ALL")(
    lambda g: g.profile.where("i BETWEEN 80 AND 119").groupBy(*PLACE).agg(F.count_if(F.expr("i < 100")).alias("left_n"), F.count_if(F.expr("i >= 100")).alias("right_n"), F.avg(F.when(F.col("i") < 100, F.col("x"))).alias("left_mean"), F.avg(F.when(F.col("i") >= 100, F.col("x"))).alias("right_mean"))
)

# aggregates

query("a1_pseudobulk", "source chrom:i g:i x:r", "SELECT * FROM profile")(lambda g: g.profile)


@query("a4_regional_log2", "cell:i score:r", """SELECT cell, CASE WHEN a > 0 AND b > 0 THEN log2(a / b) END AS score FROM (SELECT cell, coalesce(sum(x) FILTER (i BETWEEN 60 AND 119), 0) / (SELECT count(*) FROM bins WHERE i BETWEEN 60 AND 119) AS a,
 coalesce(sum(x) FILTER (i BETWEEN 10 AND 49), 0) / (SELECT count(*) FROM bins WHERE i BETWEEN 10 AND 49) AS b FROM signal GROUP BY cell)""")
def a4(g: Genome) -> DataFrame:
    sizes = g.bins.agg(F.count_if(F.expr("i BETWEEN 60 AND 119")).alias("na"), F.count_if(F.expr("i BETWEEN 10 AND 49")).alias("nb"))
    sums = g.signal.groupBy("cell").agg(*[F.sum(F.when(F.col("i").between(*r), F.col("x")).otherwise(0.0)).alias(n) for n, r in (("a", (60, 119)), ("b", (10, 49)))])
    return sums.join(F.broadcast(sizes)).select("cell", stats.log2_ratio(F.col("a") / F.col("na"), F.col("b") / F.col("nb")).alias("score"))


query("a5_zero_fraction", "cell:i zero_fraction:r", "SELECT cell, 1 - count(*) FILTER (x <> 0)::DOUBLE / (SELECT count(*) FROM bins) AS zero_fraction FROM signal GROUP BY cell")(
    lambda g: g.signal.groupBy("cell").agg(F.count_if(F.expr("x <> 0")).alias("k")).join(F.broadcast(g.bins.agg(F.count("*").alias("n")))).select("cell", (1 - F.col("k") / F.col("n")).alias("zero_fraction"))
)


@query("a6_baselines", "source median:r trimmed:r zero_fraction:r retained:i", """SELECT source, any_value(q2) AS median, avg(x) FILTER (x >= 0 AND round(x - q3 - 1.5::DOUBLE * (q3 - q1), 9) <= 0) AS trimmed, avg(CASE WHEN x = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS zero_fraction,
 count(*) FILTER (x >= 0 AND round(x - q3 - 1.5::DOUBLE * (q3 - q1), 9) <= 0) AS retained FROM profile JOIN (SELECT source, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM profile GROUP BY source) USING (source) GROUP BY source""")
def a6(g: Genome) -> DataFrame:
    rows = stats.with_quartiles(g.profile, ["source"], "x")
    keep = stats.inside_fences("x", lower=False)
    return rows.groupBy("source").agg(F.first("q2").alias("median"), stats.mean_where("x", keep).alias("trimmed"), F.avg(F.when(F.col("x") == 0, 1.0).otherwise(0.0)).alias("zero_fraction"), F.count_if(keep).alias("retained"))


query("a8_level_summary", "source chrom:i seg:i n:i mean:r median:r iqr_mean:r retained:i std:r cv:r zero_fraction:r", "SELECT * FROM summ")(lambda g: segments.level_summary(labelled(g), [*PLACE, "seg"]))
query("a9_descriptive", "source chrom:i n:i mean:r std:r cv:r lag1:r", """SELECT source, chrom, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std, CASE WHEN avg(x) <> 0 THEN stddev_pop(x) / avg(x) END AS cv, corr(x, p) AS lag1
 FROM (SELECT *, lag(x) OVER (PARTITION BY source, chrom ORDER BY i) AS p FROM profile) GROUP BY ALL""")(
    lambda g: g.profile.withColumn("p", F.lag("x").over(tracks.along())).groupBy(*PLACE).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.when(F.avg("x") != 0, F.stddev_pop("x") / F.avg("x")).alias("cv"), stats.guarded_corr("x", "p").alias("lag1"))
)
query("a11_autocorrelation", "source chrom:i lag:i r:r", " UNION ALL ".join(f"SELECT source, chrom, {k} AS lag, corr(x, p) AS r FROM (SELECT *, lag(x, {k}) OVER (PARTITION BY source, chrom ORDER BY i) AS p FROM profile) GROUP BY ALL" for k in range(1, 11)))(
    lambda g: tracks.autocorrelation(g.profile)
)


@query("a12_spearman", "source r:r", """SELECT source, CASE WHEN count(*) >= 3 AND var_pop(ra) > 0 AND var_pop(rb) > 0 THEN corr(ra, rb) END AS r FROM (SELECT source, rank() OVER (PARTITION BY source ORDER BY coverage) + (count(*) OVER (PARTITION BY source, coverage) - 1) / 2::DOUBLE AS ra,
 rank() OVER (PARTITION BY source ORDER BY n_seen) + (count(*) OVER (PARTITION BY source, n_seen) - 1) / 2::DOUBLE AS rb FROM cells JOIN membership USING (cell)) GROUP BY source""")
def a12(g: Genome) -> DataFrame:
    rows = cells(g).join(g.membership, "cell")
    for x, name in (("coverage", "ra"), ("n_seen", "rb")):
        rows = ordering.with_average_rank(rows, ["source"], x, name)
    return rows.groupBy("source").agg(stats.guarded_corr("ra", "rb").alias("r"))


@query("a14_box", "source q1:r q2:r q3:r low:r high:r skew:r", """SELECT source, any_value(q1) AS q1, any_value(q2) AS q2, any_value(q3) AS q3, min(x) FILTER (x >= q1 - 1.5::DOUBLE * (q3 - q1)) AS low, max(x) FILTER (x <= q3 + 1.5::DOUBLE * (q3 - q1)) AS high,
 avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5) AS skew FROM (SELECT * FROM profile JOIN (SELECT source, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3, avg(x) AS m FROM profile GROUP BY source) USING (source)) GROUP BY source""")
def a14(g: Genome) -> DataFrame:
    rows, iqr = stats.with_quartiles(g.profile, ["source"], "x"), F.col("q3") - F.col("q1")
    return rows.groupBy("source").agg(*[F.first(q).alias(q) for q in ("q1", "q2", "q3")], F.min(F.when(F.col("x") >= F.col("q1") - 1.5 * iqr, F.col("x"))).alias("low"), F.max(F.when(F.col("x") <= F.col("q3") + 1.5 * iqr, F.col("x"))).alias("high"), stats.population_skewness("x").alias("skew"))


query("a15_ecdf", "source cell:i ecdf:r", "SELECT source, cell, row_number() OVER (PARTITION BY source ORDER BY coverage, cell) / count(*) OVER (PARTITION BY source) AS ecdf FROM cells JOIN membership USING (cell)")(
    lambda g: tracks.empirical_distribution(cells(g).join(g.membership, "cell"), ["source"], "coverage", "cell")
)
query("a16_cluster_summary", "source n:i coverage:r n_seen:r", "SELECT source, count(*) AS n, median(coverage) AS coverage, median(n_seen) AS n_seen FROM cells JOIN membership USING (cell) GROUP BY source")(
    lambda g: cells(g).join(g.membership, "cell").groupBy("source").agg(F.count("*").alias("n"), F.percentile("coverage", F.lit(0.5)).alias("coverage"), F.percentile("n_seen", F.lit(0.5)).alias("n_seen"))
)
query("a17_terciles", "tercile n:i lowest:r highest:r", "SELECT CASE WHEN coverage < t1 THEN 'low' WHEN coverage < t2 THEN 'mid' ELSE 'high' END AS tercile, count(*) AS n, min(coverage) AS lowest, max(coverage) AS highest FROM cells CROSS JOIN (SELECT l[n // 3 + 1] AS t1, l[2 * n // 3 + 1] AS t2 FROM (SELECT list(coverage ORDER BY coverage) AS l, count(*) AS n FROM cells)) GROUP BY 1")(
    lambda g: cohort.terciles(cells(g), "coverage").groupBy("tercile").agg(F.count("*").alias("n"), F.min("coverage").alias("lowest"), F.max("coverage").alias("highest"))
)
query("a18_upper_median", "source v:r", "SELECT source, (list(coverage ORDER BY coverage))[count(*) // 2 + 1] AS v FROM cells JOIN membership USING (cell) GROUP BY source")(
    lambda g: cells(g).join(g.membership, "cell").transform(ordering.upper_medians, ["source"], "coverage")
)
query("a19_histogram", "source bucket:i n:i", "SELECT source, least(floor(x / 0.5::DOUBLE), 49) AS bucket, count(*) AS n FROM profile GROUP BY ALL")(
    lambda g: g.profile.groupBy("source", F.least(F.floor(F.col("x") / 0.5), F.lit(49)).alias("bucket")).agg(F.count("*").alias("n"))
)
query("a20_volcano", "source small_strong:i big_weak:i", "SELECT source, count(*) FILTER (abs(delta_mean_left) < 0.06 AND abs(srd_phi_left) >= 0.4) AS small_strong, count(*) FILTER (abs(delta_mean_left) >= 0.06 AND abs(srd_phi_left) < 0.4) AS big_weak FROM hs GROUP BY source")(
    lambda g: scores(g).groupBy("source").agg(F.count_if(F.expr(f"abs(delta_mean_left) < {TAU} AND abs(srd_phi_left) >= {SRD_REF}")).alias("small_strong"), F.count_if(F.expr(f"abs(delta_mean_left) >= {TAU} AND abs(srd_phi_left) < {SRD_REF}")).alias("big_weak"))
)


@query("a21_sensitivity", "tau:r n_02:i n_04:i n_08:i", "SELECT tau, " + ", ".join(f"count(*) FILTER (least(abs(delta_mean_left), abs(delta_mean_right)) < tau AND least(abs(srd_phi_left), abs(srd_phi_right)) < {r}) AS n_{n}" for r, n in ((0.2, "02"), (0.4, "04"), (0.8, "08"))) + " FROM hs CROSS JOIN (VALUES (0.03::DOUBLE), (0.06::DOUBLE), (0.12::DOUBLE)) AS v(tau) GROUP BY tau")
def a21(g: Genome) -> DataFrame:
    weak = lambda m: F.least(F.abs(f"{m}_left"), F.abs(f"{m}_right"))
    rows = scores(g).select(weak("delta_mean").alias("d"), weak("srd_phi").alias("p"), F.explode(F.array(*map(F.lit, (0.03, 0.06, 0.12)))).alias("tau"), F.lit(1).alias("one"))
    rows = rows.withColumn("ref", F.explode(F.array(*map(F.lit, ("02", "04", "08"))))).withColumn("hit", F.when((F.col("d") < F.col("tau")) & (F.col("p") < F.col("ref").cast("double") / 10), 1).otherwise(0))
    wide = rows.groupBy("tau").pivot("ref", ["02", "04", "08"]).agg(F.sum("hit"))
    return wide.select("tau", *[F.col(c).alias(f"n_{c}") for c in ("02", "04", "08")])


@query("a22_cell_segment_sums", "cell:i chrom:i seg:i total:r", "SELECT s.cell, s.chrom, l.seg, sum(s.x) AS total FROM signal AS s JOIN lab AS l ON l.g = s.g AND l.source = 'all' GROUP BY ALL")
def a22(g: Genome) -> DataFrame:
    return g.signal.join(labelled(g).where("source = 'all'").select("g", "seg"), "g").groupBy("cell", "chrom", "seg").agg(F.sum("x").alias("total"))


query("a23_weighted_mean", "g:i x:r", "SELECT g, sum(n_cells * x) / sum(n_cells) AS x FROM profile JOIN n_cells USING (source) WHERE source <> 'all' GROUP BY g")(
    lambda g: g.profile.where("source <> 'all'").join(g.membership.groupBy("source").agg(F.count("*").alias("w")), "source").groupBy("g").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
)
query("a24_segment_table", "source chrom:i seg:i s:i e:i start:i end:i sum:r mean:r median:r ratio:r", "SELECT st.*, CASE WHEN med > 0 THEN mean / med END AS ratio FROM st JOIN base USING (source)")(
    lambda g: states(g).withColumn("ratio", F.when(F.col("med") > 0, F.col("mean") / F.col("med")))
)
query("a26_review_summary", "source chrom:i n_segments:i n_eligible:i min_delta:r median_delta:r", "SELECT source, chrom, count(*) AS n_segments, count(*) FILTER (least(abs(delta_mean_left), abs(delta_mean_right)) < 0.06) AS n_eligible, min(least(abs(delta_mean_left), abs(delta_mean_right))) AS min_delta, median(least(abs(delta_mean_left), abs(delta_mean_right))) AS median_delta FROM hs GROUP BY ALL")(
    lambda g: scores(g).withColumn("d", F.least(F.abs("delta_mean_left"), F.abs("delta_mean_right"))).groupBy(*PLACE).agg(F.count("*").alias("n_segments"), F.count_if(F.col("d") < TAU).alias("n_eligible"), F.min("d").alias("min_delta"), F.percentile("d", F.lit(0.5)).alias("median_delta"))
)
query("a27_selection_geometry", "source chrom:i bins:i bp:i gaps:i", 'SELECT source, chrom, count(*) AS bins, sum("end" - "start" + 1) AS bp, count(*) FILTER ("start" > pe + 1) AS gaps FROM (SELECT *, lag("end") OVER (PARTITION BY source, chrom ORDER BY i) AS pe FROM profile WHERE i BETWEEN 30 AND 200) GROUP BY ALL')(
    lambda g: tracks.gap_flags(g.profile.where("i BETWEEN 30 AND 200")).groupBy(*PLACE).agg(F.count("*").alias("bins"), F.sum(F.col("end") - F.col("start") + 1).alias("bp"), F.count_if("gap").alias("gaps"))
)

# joins

query("j5_neighbours", "source chrom:i seg:i left_seg:i right_seg:i", "SELECT source, chrom, seg, coalesce(lag(seg) OVER w, -1) AS left_seg, coalesce(lead(seg) OVER w, -1) AS right_seg FROM st WINDOW w AS (PARTITION BY source, chrom ORDER BY seg)")(
    lambda g: segments.with_flanks(segments.segment_summaries(labelled(g)), ["seg"]).withColumns({"left_seg": F.coalesce("seg_left", F.lit(-1)), "right_seg": F.coalesce("seg_right", F.lit(-1))})
)


def _partition(g: Genome, source: str | None = None) -> DataFrame:
    sizes = g.bins.groupBy("chrom").agg(F.count("*").alias("n")).withColumn("source", F.explode(F.array(*map(F.lit, g.sources)))).select("source", "chrom", "n")
    found = segments.flat_partition(g.boundaries, sizes)
    return found.where(F.col("source") == source) if source else found


query("j6_segment_bins", "source chrom:i i:i seg:i", "SELECT * FROM lab")(labelled)
_PAIRS = "chrom:i a_source b_source "
query("j7_interval_overlap", _PAIRS + "a_s:i b_s:i shared:i", "SELECT a.chrom, a.source AS a_source, b.source AS b_source, a.s AS a_s, b.s AS b_s, least(a.e, b.e) - greatest(a.s, b.s) AS shared FROM st AS a JOIN st AS b ON a.source < b.source AND a.chrom = b.chrom AND a.s < b.e AND b.s < a.e")(
    lambda g: cohort.overlap_join(*(_sides(g, segments.segment_summaries(labelled(g)).select(*PLACE, F.col("s").alias(f"{k}_s"), F.col("e").alias(f"{k}_e")), k) for k in "ab"), ["chrom", "a_source", "b_source"])
)


def _sides(g: Genome, rows: DataFrame, side: str) -> DataFrame:
    """rows of each source as one side of all its pairs with other sources, the lesser name first."""
    others = F.explode(F.array(*map(F.lit, g.sources))).alias("other")
    pairs = rows.select("*", others).where("source < other" if side == "a" else "other < source")
    return pairs.withColumnsRenamed({"source": f"{side}_source", "other": "b_source" if side == "a" else "a_source"})


def _paired(g: Genome, side: str) -> DataFrame:
    """The boundaries of one side of all pairs of sources, with both names as their source."""
    return _sides(g, g.boundaries, side).select(F.concat_ws("|", "a_source", "b_source").alias("source"), "chrom", "bin")


def greedy_sql(near: str) -> str:
    """Greedy matching of pairs (source, chrom, a_bin, b_bin, distance) in SQL: one pair after another."""
    return f"""WITH RECURSIVE near AS (SELECT *, row_number() OVER (PARTITION BY source, chrom ORDER BY distance, a_bin, b_bin) AS k FROM ({near})),
 walk AS (SELECT source, chrom, 0::BIGINT AS k, false AS won, []::BIGINT[] AS as_, []::BIGINT[] AS bs, NULL::BIGINT AS a_bin, NULL::BIGINT AS b_bin, NULL::BIGINT AS distance FROM (SELECT DISTINCT source, chrom FROM near)
 UNION ALL SELECT source, chrom, k, free, CASE WHEN free THEN list_append(as_, a_bin) ELSE as_ END, CASE WHEN free THEN list_append(bs, b_bin) ELSE bs END, a_bin, b_bin, distance
 FROM (SELECT w.source, w.chrom, n.k, NOT list_contains(w.as_, n.a_bin) AND NOT list_contains(w.bs, n.b_bin) AS free, w.as_, w.bs, n.a_bin, n.b_bin, n.distance FROM walk AS w JOIN near AS n ON n.source = w.source AND n.chrom = w.chrom AND n.k = w.k + 1))
 SELECT source, chrom, a_bin, b_bin, distance FROM walk WHERE won"""


query("j8_band_matching", "source chrom:i a_bin:i b_bin:i distance:i", greedy_sql("SELECT a.source || '|' || b.source AS source, a.chrom, a.bin AS a_bin, b.bin AS b_bin, abs(a.bin - b.bin) AS distance FROM boundaries AS a JOIN boundaries AS b ON a.source < b.source AND a.chrom = b.chrom AND abs(a.bin - b.bin) <= 30"))(
    lambda g: kernels.match_one_to_one(_paired(g, "a"), _paired(g, "b"), 30)
)
query("j9_kept_breakpoints", "source chrom:i bin:i", "SELECT * FROM boundaries WHERE (source, chrom, bin) IN (SELECT source, chrom, s FROM st WHERE n <= 31)")(
    lambda g: g.boundaries.join(segments.segment_summaries(labelled(g)).where(F.col("n") <= MAX_BINS).select(*PLACE, F.col("s").alias("bin")), [*PLACE, "bin"], "left_semi")
)
query("j12_contingency", "source other:i n:i n_a:i n_b:i largest", "SELECT source, other, n, sum(n) OVER (PARTITION BY source) AS n_a, sum(n) OVER (PARTITION BY other) AS n_b, row_number() OVER (PARTITION BY source ORDER BY n DESC, other) = 1 AS largest FROM (SELECT source, other, count(*) AS n FROM cells JOIN membership USING (cell) WHERE source <> 'all' GROUP BY ALL)")(
    lambda g: cohort.contingency(cells(g).join(g.membership.where("source <> 'all'"), "cell"), "source", "other")
)


@query("j13_nearest_boundary", "id:i boundary:i", """SELECT id, CASE WHEN i IS NULL THEN 0 ELSE i + CASE WHEN bp > ("start" + "end") / 2::DOUBLE THEN 1 ELSE 0 END END AS boundary FROM (SELECT o_orderkey AS id, year(o_orderdate) AS chrom, (o_orderdate::DATE - DATE '1970-01-01') * 100000 + (o_orderkey * 7919) % 100000 AS bp FROM orders) AS o
 ASOF LEFT JOIN bins ON o.chrom = bins.chrom AND o.bp >= bins."start" """)
def j13(g: Genome) -> DataFrame:
    day = F.to_date("o_orderdate")
    asked = g.read("orders").select(F.col("o_orderkey").alias("id"), F.year(day).alias("chrom"), (F.unix_date(day).cast("long") * 100000 + (F.col("o_orderkey") * 7919) % 100000).alias("bp"))
    return cohort.nearest_boundary(asked, g.bins)


# windows

query("w1_rolling_mean", "source chrom:i i:i v:r", "SELECT source, chrom, i, CASE WHEN count(x) OVER w >= 8 THEN avg(x) OVER w END AS v FROM profile WINDOW w AS (PARTITION BY source, chrom ORDER BY i ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)")(
    lambda g: g.profile.withColumn("v", tracks.rolling_mean())
)
query("w2_smoothed", "source chrom:i i:i v:r", "SELECT source, chrom, i, CASE WHEN count(x) OVER w >= 3 THEN avg(x) OVER w END AS v FROM profile WINDOW w AS (PARTITION BY source, chrom ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)")(
    lambda g: g.profile.withColumn("v", tracks.smoothed(window=9))
)


@query("w3_log2_track", "source chrom:i i:i v:r status", "SELECT source, chrom, i, CASE WHEN NOT med > 0 THEN NULL WHEN x <= 0 THEN -4::DOUBLE ELSE greatest(-4, least(4, log2(x / med))) END AS v, CASE WHEN NOT med > 0 THEN 'undefined' WHEN x <= 0 THEN 'zero' ELSE 'ok' END AS status FROM profile JOIN base USING (source)")
def w3(g: Genome) -> DataFrame:
    base = g.profile.groupBy("source").agg(F.percentile("x", F.lit(0.5)).alias("med"))
    value, status = tracks.log2_track(F.col("x"), F.col("med"))
    return g.profile.join(base, "source").withColumns({"v": value, "status": status})


query("w5_gaps", "source chrom:i i:i gap wide_gap", """SELECT source, chrom, i, coalesce("start" > pe + 1, false) AS gap, coalesce("start" - ps > 3 * m, false) AS wide_gap FROM (SELECT *, lag("end") OVER w AS pe, lag("start") OVER w AS ps FROM profile WINDOW w AS (PARTITION BY source, chrom ORDER BY i))
 JOIN (SELECT source, chrom, (list(d ORDER BY d))[count(*) // 2 + 1] AS m FROM (SELECT source, chrom, "start" - lag("start") OVER (PARTITION BY source, chrom ORDER BY i) AS d FROM profile) WHERE d IS NOT NULL GROUP BY ALL) USING (source, chrom)""")(
    lambda g: tracks.gap_flags(g.profile)
)
query("w10_local_maxima", "source chrom:i i:i x:r", "SELECT * FROM (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS q FROM profile WINDOW w AS (PARTITION BY source, chrom ORDER BY i)) WHERE (p IS NULL OR x >= p) AND (q IS NULL OR x > q)")(lambda g: tracks.local_maxima(g.profile))
query("w11_candidate_rank", "source chrom:i i:i rank:i", "SELECT source, chrom, i, row_number() OVER (PARTITION BY source, chrom ORDER BY round(x, 6) DESC, i) AS rank FROM profile")(lambda g: tracks.ranked(g.profile.withColumn("v", F.round("x", 6)), "v", "i"))
query("w12_first_argmax", "source chrom:i i:i", "SELECT source, chrom, min(i) AS i FROM (SELECT *, max(round(x, 6)) OVER (PARTITION BY source, chrom) AS m FROM profile) WHERE round(x, 6) = m GROUP BY ALL")(
    lambda g: g.profile.groupBy(*PLACE).agg(F.min_by("i", F.struct(-F.round("x", 6), "i")).alias("i"))
)
query("w14_edge_rank", "source chrom:i seg:i rank:i", "SELECT h.source, h.chrom, h.seg, 1 + count(o.seg) AS rank FROM hs AS h LEFT JOIN hs AS o ON o.source = h.source AND o.chrom = h.chrom AND round(abs(o.srd_left), 6) > round(abs(h.srd_left), 6) GROUP BY ALL")(
    lambda g: scores(g).withColumn("rank", F.rank().over(W.partitionBy(*PLACE).orderBy(F.desc(F.round(F.abs("srd_left"), 6)))))
)

# order, top-k and sets

query("k2_cell_order", "cell:i place:i", "SELECT cell, row_number() OVER (ORDER BY coverage DESC, cell) AS place FROM cells")(lambda g: ordering.running_total(cells(g), [], [F.desc("coverage"), "cell"]).withColumn("place", F.col("before") + 1))


@query("k3_top_neighbours", "chrom:i cell:i rank:i x:r", "SELECT chrom, cell, rank, x FROM (SELECT chrom, cell, x, row_number() OVER (PARTITION BY chrom ORDER BY x DESC, cell) AS rank FROM (SELECT chrom, cell, sum(x) AS x FROM signal GROUP BY ALL)) WHERE rank <= 15")
def k3(g: Genome) -> DataFrame:
    return cohort.top_k(g.signal.groupBy("chrom", "cell").agg(F.sum("x").alias("x")), ["chrom"], "x", "cell", 15)


@query("u1_interval_union", "source chrom:i s:i e:i", """SELECT source, chrom, min(s) AS s, max(e) AS e FROM (SELECT *, sum(o) OVER (PARTITION BY source, chrom ORDER BY s, e) AS k FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY source, chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o
 FROM (SELECT source, chrom, s, e + 3 AS e FROM st WHERE n <= 15))) GROUP BY source, chrom, k""")
def u1(g: Genome) -> DataFrame:
    return tracks.coalesced_intervals(_partition(g).where("e - s <= 15").select(*PLACE, "s", (F.col("e") + 3).alias("e")), PLACE)


query("u2_set_difference", "chrom:i bin:i", "SELECT chrom, bin FROM boundaries WHERE source = 'cluster0' EXCEPT SELECT chrom, bin FROM boundaries WHERE source = 'cluster1'")(
    lambda g: g.boundaries.where("source = 'cluster0'").select("chrom", "bin").subtract(g.boundaries.where("source = 'cluster1'").select("chrom", "bin"))
)

# partitions, scores and rules

query("g1_flat_partition", "source chrom:i seg:i s:i e:i", "SELECT * FROM st")(_partition)
query("g3_genome_labels", "source g:i label:i", "SELECT source, g, 1 + sum(CASE WHEN i = 0 OR b.bin IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.source ORDER BY g) - 1 AS label FROM profile AS p LEFT JOIN boundaries AS b USING (source, chrom) WHERE false UNION ALL SELECT source, g, dense_rank() OVER (PARTITION BY source ORDER BY chrom, seg) AS label FROM lab")(
    lambda g: labelled(g).withColumn("label", F.dense_rank().over(W.partitionBy("source").orderBy("chrom", "seg")))
)
query("g10_geometry", "source chrom:i bin:i valid", "SELECT b.source, b.chrom, b.bin, b.bin >= 50 AND n - b.bin >= 50 AS valid FROM boundaries AS b JOIN (SELECT chrom, count(*) AS n FROM bins GROUP BY chrom) USING (chrom)")(
    lambda g: g.boundaries.join(g.chroms.select("chrom", "n"), "chrom").withColumn("valid", (F.col("bin") >= 50) & (F.col("n") - F.col("bin") >= 50))
)
query("m4_pooled_phi", "source chrom:i phi:r", "SELECT * FROM phi")(lambda g: segments.pooled_phi(labelled(g)))
_SCORES = "source chrom:i seg:i s:i e:i phi:r srd_left:r srd_right:r srd_phi_left:r srd_phi_right:r delta_mean_left:r delta_mean_right:r delta_median_left:r delta_median_right:r delta_iqr_mean_left:r delta_iqr_mean_right:r gap_left gap_right"
query("m7_hatch_scores", _SCORES, "SELECT * FROM hs")(scores)
_WEAKER = "CASE WHEN abs({0}_left) < abs({0}_right) THEN 'left' WHEN abs({0}_right) < abs({0}_left) THEN 'right' WHEN {0}_left IS NOT NULL AND {0}_right IS NOT NULL THEN 'tie' END"


@query("m8_transitions", "source chrom:i seg:i mismatch weaker eligible_left eligible_right weaker_eligible ambiguity", f"""SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN 'undefined' WHEN a = 'tie' OR b = 'tie' THEN 'no_unique_preference' WHEN a = b THEN 'consistent' ELSE 'ambiguous' END AS ambiguity,
 CASE WHEN eligible_left AND eligible_right THEN CASE WHEN b = 'tie' THEN 'both' ELSE b END WHEN eligible_left THEN 'left' WHEN eligible_right THEN 'right' END AS weaker_eligible FROM (SELECT *, coalesce(srd_phi_left * srd_phi_right < 0, false) AS mismatch, {_WEAKER.format("srd_phi")} AS a, {_WEAKER.format("srd_phi")} AS weaker, {_WEAKER.format("delta_mean")} AS b,
 coalesce(abs(delta_mean_left) < {TAU}, false) AS eligible_left, coalesce(abs(delta_mean_right) < {TAU}, false) AS eligible_right FROM hs)""")
def m8(g: Genome) -> DataFrame:
    srd, delta = [(F.col(f"{m}_left"), F.col(f"{m}_right")) for m in ("srd_phi", "delta_mean")]
    left, right, side = segments.merge_proposal(*delta, TAU)
    return scores(g).withColumns({"mismatch": segments.sign_mismatch(*srd), "weaker": segments.weaker_side(*srd), "eligible_left": left, "eligible_right": right, "weaker_eligible": side, "ambiguity": segments.ambiguity(srd, delta)})


_RULE0 = FlankRule(tau=TAU, srd_ref=SRD_REF, max_bins=MAX_BINS)
_ANY = FlankRule(tau=TAU, srd_ref=SRD_REF, max_bins=MAX_BINS, combine="any", merge_signs_only=True, id="any")


def _rule_sql(rule: FlankRule) -> str:
    """A rule on hs in SQL, for two criteria."""
    f = {c: f"least(abs({c}_left), abs({c}_right)) / {rule.threshold(c)}::DOUBLE" for c in rule.criteria}
    right = {c: f"(abs({c}_right) < abs({c}_left) OR ({c}_left IS NULL AND {c}_right IS NOT NULL))" for c in rule.criteria}
    a, b = rule.criteria
    first = f"(fa < fb OR (fa = fb AND NOT ra))" if rule.combine == "all" else "(coalesce(fa, 1e9) < coalesce(fb, 1e9) OR (fa = fb AND NOT ra))"
    passed = "pa AND pb" if rule.combine == "all" else "pa OR pb"
    failing = "'signs_merge'" if rule.merge_signs_only else "'signs_only'"
    return f"""SELECT *, CASE WHEN outcome IN ('would_merge', 'held_back', 'signs_merge') THEN CASE WHEN CASE WHEN {first} THEN ra ELSE rb END THEN 'right' ELSE 'left' END END AS side,
 CASE WHEN outcome IN ('would_merge', 'held_back') THEN {"greatest(fa, fb)" if rule.combine == "all" else "least(fa, fb)"} WHEN outcome = 'signs_merge' THEN least(fa, fb) END AS score,
 CASE WHEN outcome IN ('would_merge', 'signs_merge') AND CASE WHEN CASE WHEN {first} THEN ra ELSE rb END THEN gap_right ELSE gap_left END THEN 'gap' END AS blocked FROM (SELECT *, CASE WHEN e - s > {rule.max_bins} THEN 'none' WHEN {passed} THEN CASE WHEN mismatch THEN 'held_back' ELSE 'would_merge' END WHEN mismatch THEN {failing} ELSE 'none' END AS outcome
 FROM (SELECT *, coalesce(fa < 1, false) AS pa, coalesce(fb < 1, false) AS pb FROM (SELECT *, {f[a]} AS fa, {f[b]} AS fb, {right[a]} AS ra, {right[b]} AS rb, coalesce(srd_phi_left * srd_phi_right < 0, false) AS mismatch FROM hs)))"""


query("m14_rule0", "source chrom:i seg:i outcome side score:r blocked", _rule_sql(_RULE0))(lambda g: scores(g).transform(flank_rule, _RULE0))
query("m14_any_rule", "source chrom:i seg:i outcome side score:r blocked", _rule_sql(_ANY))(lambda g: scores(g).transform(flank_rule, _ANY))
query("m18_outcome_counts", "source outcome n:i", f"SELECT source, outcome, count(*) AS n FROM ({_rule_sql(_RULE0)}) GROUP BY ALL")(lambda g: scores(g).transform(flank_rule, _RULE0).groupBy("source", "outcome").agg(F.count("*").alias("n")))
_USER = ConditionRule("weak", (Condition("weak_flank", "delta_median", 0.02), Condition("max_size", max_bins=25)), "delta_median")
RULES = RuleSet(_RULE0, (_USER,))
_RULES = f"""SELECT source, chrom, seg, CASE WHEN outcome = 'would_merge' THEN 'rule0' WHEN w THEN 'weak' END AS claimed_by, CASE WHEN outcome = 'would_merge' OR w THEN 1 ELSE 0 END AS phase,
 CASE WHEN outcome = 'would_merge' THEN side WHEN w THEN us END AS side, CASE WHEN outcome = 'would_merge' THEN score WHEN w THEN least(abs(delta_median_left), abs(delta_median_right)) END AS score,
 CASE WHEN outcome = 'would_merge' THEN blocked WHEN w AND CASE WHEN us = 'left' THEN gap_left ELSE gap_right END THEN 'gap' END AS blocked FROM (SELECT *, coalesce(least(abs(delta_median_left), abs(delta_median_right)) < 0.02 AND delta_median_left IS NOT NULL AND delta_median_right IS NOT NULL, false) AND e - s <= 25 AS w, CASE WHEN abs(delta_median_left) <= abs(delta_median_right) THEN 'left' ELSE 'right' END AS us FROM ({_rule_sql(_RULE0)}))"""
query("m15_rules", "source chrom:i seg:i claimed_by phase:i side score:r blocked", _RULES)(
    lambda g: evaluate(scores(g), RULES).withColumn("phase", F.coalesce("phase", F.lit(0)))
)


query("m15_rules_across_gaps", "source chrom:i seg:i claimed_by phase:i side score:r blocked", f"SELECT * REPLACE (nullif(blocked, 'gap') AS blocked) FROM ({_RULES})")(
    lambda g: evaluate(scores(g), replace(RULES, cross_gaps=True)).withColumn("phase", F.coalesce("phase", F.lit(0)))
)
_ACROSS = f"SELECT * REPLACE (nullif(blocked, 'gap') AS blocked) FROM ({_RULES})"


@query("m16_first_merge", "source chrom:i removed:i score:r side", f"""SELECT source, chrom, CASE WHEN side = 'left' THEN s ELSE e END AS removed, score, side FROM (SELECT *, row_number() OVER (PARTITION BY source, chrom ORDER BY round(score, 9), s) AS k FROM ({_rule_sql(_RULE0)}) WHERE outcome = 'would_merge' AND blocked IS NULL) WHERE k = 1""")
def m16_first(g: Genome) -> DataFrame:
    return kernels.merge_step(g.profile, g.boundaries, RuleSet(_RULE0))


_FIRST_RULE = f"SELECT *, 'rule0' AS claimed_by, 1 AS phase FROM ({_rule_sql(_RULE0)}) WHERE outcome = 'would_merge'"
#: The tables that hang on the boundaries, in SQL, from the labels to the scores.
_SCORED = GENOME[GENOME.index("lab AS (") : GENOME.index("base AS (")].rstrip().rstrip(",")
_TABLES = "lab|st|it|summ|phi|fl|dv|sd|hs|boundaries"


def merged_sql(rounds_: list[tuple[str, int]]) -> str:
    """Tables merged (round, step and what goes) and left_ (the boundaries left at last) in SQL: each round is the SQL of its rules' claims on hs and a number of steps that is enough.

    In a step each chromosome's first claim that nothing blocks goes, then all scores are computed anew.
    """
    out, said, t = "left_0 AS (SELECT source, chrom, bin FROM boundaries)", [], 0

    def at(sql: str) -> str:
        own = lambda m: f"{m[1]} left_{t} AS boundaries" if m[2] == "boundaries" and not m[3] else f"{m[1]} left_{t}{m[3]}" if m[2] == "boundaries" else f"{m[1]} {m[2]}_{t}{m[3] or f' AS {m[2]}'}"
        sql = re.sub(rf"\b(FROM|JOIN) ({_TABLES})\b( AS \w+)?", own, sql)
        return re.sub(rf"^({_TABLES}) AS \(", lambda m: f"{m[1]}_{t} AS MATERIALIZED (", sql, flags=re.M)

    for number, (claims, steps) in enumerate(rounds_, 1):
        for step in range(1, steps + 1):
            out += f""", {at(_SCORED)}, gone_{t} AS MATERIALIZED (SELECT source, chrom, {number} AS round, {step} AS step, CASE WHEN side = 'left' THEN s ELSE e END AS removed, claimed_by, phase, side, score
 FROM (SELECT c.*, h.s, h.e FROM ({at(claims)}) AS c JOIN hs_{t} AS h ON h.source = c.source AND h.chrom = c.chrom AND h.seg = c.seg) WHERE claimed_by IS NOT NULL AND blocked IS NULL QUALIFY row_number() OVER (PARTITION BY source, chrom ORDER BY phase, CASE claimed_by WHEN 'rule0' THEN 0 ELSE 1 END, round(score, 9), s) = 1),
 left_{t + 1} AS MATERIALIZED (SELECT b.* FROM left_{t} AS b ANTI JOIN gone_{t} AS g ON g.source = b.source AND g.chrom = b.chrom AND g.removed = b.bin)"""
            said.append(f"SELECT * FROM gone_{t}")
            t += 1
    return f"{out}, merged AS ({' UNION ALL '.join(said)}), left_ AS (SELECT * FROM left_{t})"


_SMALL_RULE = f"SELECT source, chrom, seg, claimed_by, phase, side, score, blocked FROM ({_FIRST_RULE})"


@query("m19_merged_genome", "source chrom:i bin:i", f"WITH {merged_sql([(_RULES, 10)])} SELECT * FROM left_")
def m19(g: Genome) -> DataFrame:
    return kernels.merged_boundaries(g.profile, g.boundaries, RULES)


@query("m19_merged_across_gaps", "source chrom:i bin:i", f"WITH {merged_sql([(_ACROSS, 14)])} SELECT * FROM left_")
def m19_across(g: Genome) -> DataFrame:
    return kernels.merged_boundaries(g.profile, g.boundaries, replace(RULES, cross_gaps=True))


query("m20_rounds", "source chrom:i round:i step:i removed:i claimed_by phase:i side score:r", f"WITH {merged_sql([(_SMALL_RULE, 10), (_RULES, 8)])} SELECT * FROM merged")(lambda g: rounds.fold(g.profile, g.boundaries, [RuleSet(_RULE0), RULES]))
query("m23_boundary_candidates", "source chrom:i s:i candidate", "SELECT source, chrom, s, least(n, p) <= 31 AS candidate FROM (SELECT *, lag(n) OVER (PARTITION BY source, chrom ORDER BY seg) AS p FROM st) WHERE p IS NOT NULL")(
    lambda g: segments.with_flanks(segments.segment_summaries(labelled(g)), ["n"]).where("n_left IS NOT NULL").withColumn("candidate", F.least("n", "n_left") <= MAX_BINS)
)
query("m27_proposals", "source chrom:i seg:i proposal", f"""SELECT source, chrom, seg, CASE WHEN l AND r THEN CASE WHEN sign(srd_phi_left) = sign(srd_phi_right) AND sign(srd_phi_left) <> 0 THEN 'keep_focal' ELSE 'ambiguous_keep' END WHEN r THEN 'merge_left' WHEN l THEN 'merge_right' WHEN abs(delta_median_left) <= abs(delta_median_right) THEN 'merge_left' ELSE 'merge_right' END AS proposal
 FROM (SELECT *, abs(srd_phi_left) >= {SRD_REF} AND abs(delta_median_left) >= {TAU} AS l, abs(srd_phi_right) >= {SRD_REF} AND abs(delta_median_right) >= {TAU} AS r FROM hs)""")(
    lambda g: scores(g).withColumn("proposal", segments.assign_proposal(*[(F.col(f"{m}_left"), F.col(f"{m}_right")) for m in ("srd_phi", "delta_median")], SRD_REF, TAU))
)

# states, changes and noise

_CUTS = ", ".join(map(str, STATE_CUTS))
query("c8_states", "source chrom:i seg:i code:i", "SELECT source, chrom, seg, coalesce(round_even(state * 2, 0), 255) AS code FROM states")(lambda g: states(g).withColumn("code", calls.encode_states(F.col("state"))))


def _before_after(g: Genome) -> DataFrame:
    """Codes of each bin by its own segment, and by its month-long neighbours' mean: a coarser call to compare with."""
    fine = labelled(g).join(states(g).select(*PLACE, "seg", "state", "med"), [*PLACE, "seg"])
    coarse = F.avg("x").over(W.partitionBy(*PLACE, F.floor(F.col("i") / 30)))
    return fine.withColumns({"before": calls.encode_states(F.col("state")), "after": calls.encode_states(F.when(F.col("med") > 0, calls.state_by_ratio(F.round(coarse / F.col("med"), 9), STATE_CUTS)))})


_BA = "SELECT *, coalesce(round_even(state * 2, 0), 255)::INT AS before, coalesce((" + " + ".join(f"(CASE WHEN r >= {c}::DOUBLE THEN 1 WHEN r IS NOT NULL THEN 0 END)" for c in STATE_CUTS) + ")::INT, 255) AS after FROM (SELECT lab.*, st2.state, CASE WHEN med > 0 THEN round(avg(lab.x) OVER (PARTITION BY lab.source, lab.chrom, lab.i // 30) / med, 9) END AS r FROM lab JOIN (SELECT source, chrom, seg, state FROM states) AS st2 USING (source, chrom, seg) JOIN base USING (source))"
query("c9_transitions", "source before:i after:i n:i", f"SELECT source, before, after, count(*) AS n FROM ({_BA}) WHERE before <> after GROUP BY ALL")(lambda g: calls.transitions(F.col("before"), F.col("after"), _before_after(g), ["source"]))
query("c10_changes", "source n_called:i n_changed:i pct_changed:r", f"SELECT source, count(*) FILTER (before <> 255 AND after <> 255) AS n_called, count(*) FILTER (before <> 255 AND after <> 255 AND before <> after) AS n_changed, round_even(100.0::DOUBLE * count(*) FILTER (before <> 255 AND after <> 255 AND before <> after) / count(*) FILTER (before <> 255 AND after <> 255), 3) AS pct_changed FROM ({_BA}) GROUP BY source")(
    lambda g: calls.changed_share(_before_after(g), ["source"])
)
_NOISE = """SELECT {0}, count(*) AS n_called, count(*) FILTER (p = q AND state <> p) AS n_zigzag, median(e - s) FILTER (p = q AND state <> p) AS zigzag_length, count(*) FILTER ((state > 1 AND q < 1) OR (state < 1 AND q > 1)) AS n_opposed FROM (SELECT *, lag(state) OVER w AS p, lead(state) OVER w AS q FROM states WHERE state IS NOT NULL WINDOW w AS (PARTITION BY source, chrom ORDER BY seg)) GROUP BY ALL"""
query("n1_sequence_noise", "source chrom:i n_called:i n_zigzag:i zigzag_length:r n_opposed:i", _NOISE.format("source, chrom"))(lambda g: calls.sequence_noise(states(g), PLACE))
query("n2_genome_noise", "source level n_called:i n_zigzag:i", f"SELECT source, chrom::VARCHAR AS level, n_called, n_zigzag FROM ({_NOISE.format('source, chrom')}) UNION ALL SELECT source, 'genome', sum(n_called), sum(n_zigzag) FROM ({_NOISE.format('source, chrom')}) GROUP BY source")(
    lambda g: calls.sequence_noise(states(g), PLACE).rollup("source", "chrom").agg(F.sum("n_called").alias("n_called"), F.sum("n_zigzag").alias("n_zigzag")).where("source IS NOT NULL").withColumn("level", F.coalesce(F.col("chrom").cast("string"), F.lit("genome")))
)
query("c2_estimators", "source chrom:i seg:i estimate:r retained:i", "SELECT source, chrom, seg, avg(x) AS estimate, count(*) AS retained FROM lab JOIN (SELECT source, chrom, seg, q1, q3 FROM st) USING (source, chrom, seg) WHERE x >= 0 AND round(x - q3 - 1.5::DOUBLE * (q3 - q1), 9) <= 0 GROUP BY ALL")(
    lambda g: calls.segment_estimates(labelled(g), [*PLACE, "seg"], "iqr_upper")
)

# resampling and edits

_LEVELS = "SELECT source, cell, sum(CASE WHEN i BETWEEN 60 AND 119 THEN x ELSE 0 END) / 60 AS a, sum(CASE WHEN i BETWEEN 10 AND 49 THEN x ELSE 0 END) / 40 AS b FROM signal JOIN membership USING (cell) GROUP BY ALL"


def _draws(replicates: int) -> str:
    """Bootstrap weights in SQL: cells are numbered by a hashed part and their id, and drawn by number."""
    return f"""WITH ord AS (SELECT source, cell, row_number() OVER (PARTITION BY source ORDER BY part, cell) - 1 AS o, count(*) OVER (PARTITION BY source) AS n FROM (SELECT source, cell, ('0x' || substr(md5(cell::VARCHAR), 1, 8))::BIGINT % 64 AS part FROM membership)),
 drawn AS (SELECT source, rep, ('0x' || substr(md5('42:' || source || ':' || rep || ':' || o), 1, 8))::BIGINT % n AS o FROM (SELECT source, o, n, unnest(range(1, {replicates + 1})) AS rep FROM ord)),
 weights AS (SELECT d.source, d.rep, ord.cell, count(*) AS w FROM drawn AS d JOIN ord ON ord.source = d.source AND ord.o = d.o GROUP BY ALL)"""


REPLICATES = 200


def _levels(g: Genome) -> DataFrame:
    rows = g.with_sources(g.signal)
    return rows.groupBy("source", "cell").agg(*[(F.sum(F.when(F.col("i").between(*r), F.col("x")).otherwise(0.0)) / (r[1] - r[0] + 1)).alias(n) for n, r in (("a", (60, 119)), ("b", (10, 49)))])


_RATIO = f""", levels AS ({_LEVELS}),
 obs AS (SELECT source, CASE WHEN avg(a) > 0 AND avg(b) > 0 THEN log2(avg(a) / avg(b)) END AS observed FROM levels GROUP BY source),
 reps AS (SELECT source, rep, CASE WHEN sum(a * w) > 0 AND sum(b * w) > 0 THEN log2(sum(a * w) / sum(b * w)) END AS v FROM levels JOIN weights USING (source, cell) GROUP BY ALL)
 SELECT source, any_value(observed) AS observed, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high, stddev_samp(v) AS se, avg(CASE WHEN sign(v) = sign(observed) THEN 1::DOUBLE ELSE 0::DOUBLE END) AS sign_agreement, count(*) FILTER (v IS NULL) AS invalid FROM reps JOIN obs USING (source) GROUP BY source"""
_RATIO_COLUMNS = "source observed:r ci_low:r ci_high:r se:r sign_agreement:r invalid:i"
query("b1_bootstrap", _RATIO_COLUMNS, _draws(REPLICATES) + _RATIO)(lambda g: resample.bootstrap_ratio(_levels(g), resample.bootstrap_weights(g.membership, REPLICATES), "a", "b"))


@query("b3_hash_draws", "source rep:i ordinal:i draw:i", "SELECT source, rep, o AS ordinal, ('0x' || substr(md5('42:' || source || ':' || rep || ':' || o), 1, 8))::BIGINT AS draw FROM (SELECT source, unnest(range(0, n_cells)) AS o FROM n_cells) CROSS JOIN (SELECT unnest(range(1, 4)) AS rep)")
def b3(g: Genome) -> DataFrame:
    n = g.membership.groupBy("source").agg(F.count("*").alias("n"))
    rows = n.select("source", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ordinal")).withColumn("rep", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return rows.withColumn("draw", resample.hashed_number(F.lit("42"), F.col("source"), F.col("rep").cast("string"), F.col("ordinal").cast("string")))


query("b10_fano", "source chrom:i seg:i n:i mean:r fano:r status", "SELECT *, CASE WHEN n < 2 THEN 'too_short' WHEN mean <= 0 THEN 'zero_mean' ELSE 'ok' END AS status, CASE WHEN n >= 2 AND mean > 0 THEN v / mean END AS fano FROM st")(lambda g: resample.fano_factors(labelled(g), [*PLACE, "seg"]))
query("e1_edit", "source chrom:i i:i edited:r", "SELECT source, chrom, i, CASE WHEN t > 0 THEN v * o / t ELSE v END AS edited FROM (SELECT *, sum(v) OVER (PARTITION BY source, chrom) AS t, sum(x) OVER (PARTITION BY source, chrom) AS o FROM (SELECT *, CASE WHEN i BETWEEN 50 AND 79 THEN greatest(x * 1.5::DOUBLE, 0) ELSE x END AS v FROM profile))")(
    lambda g: resample.apply_edit(g.profile, 50, 80, "multiply", 1.5, keep_total=True)
)
query("e2_duplicate", "source chrom:i i:i edited:r", "SELECT p.source, p.chrom, p.i, coalesce(d.x, p.x) AS edited FROM profile AS p LEFT JOIN profile AS d ON d.source = p.source AND d.chrom = p.chrom AND p.i BETWEEN 100 AND 149 AND d.i = 20 + (p.i - 100) % 15")(
    lambda g: resample.duplicate_region(g.profile, 20, 35, 100, 50)
)

# allelic signals

query("l1_signals", "source chrom:i i:i ha:i hb:i dbaf:r shrunk_abs_dbaf:r kept", "SELECT * FROM sig")(lambda g: allelic.signals(allele_counts(g), 5))


@query("l8_segment_view", "source chrom:i seg:i kept:i mean:r sd:r n_inner:i", """SELECT st.source, st.chrom, st.seg, count(sig.i) FILTER (sig.kept) AS kept, avg(sig.dbaf) FILTER (sig.kept) AS mean, stddev_pop(sig.dbaf) FILTER (sig.kept) AS sd, any_value(coalesce(k, 0)) AS n_inner FROM st
 LEFT JOIN sig ON sig.source = st.source AND sig.chrom = st.chrom AND sig.i >= st.s AND sig.i < st.e LEFT JOIN (SELECT a.source, a.chrom, a.seg, count(*) AS k FROM st AS a JOIN boundaries AS b ON b.source = 'all' AND b.chrom = a.chrom AND b.bin - a.s > 3 AND a.e - b.bin > 3 GROUP BY ALL) AS c ON c.source = st.source AND c.chrom = st.chrom AND c.seg = st.seg GROUP BY ALL""")
def l8(g: Genome) -> DataFrame:
    bins = labelled(g).select(*PLACE, "i", "seg")
    rows = allelic.signals(allele_counts(g), 5).join(bins, [*PLACE, "i"])
    marks = g.boundaries.where("source = 'all'").select("chrom", F.col("bin").alias("i")).join(bins, ["chrom", "i"]).withColumnRenamed("i", "bin")
    return allelic.segment_view(_partition(g), rows, marks, 3)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


from . import catalog_compare, catalog_experiments, catalog_prune, catalog_recall, catalog_review, catalog_scan, catalog_tables  # noqa: E402,F401  their queries are added to these
