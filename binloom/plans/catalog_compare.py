"""More of the engine's operators as queries: lookups, comparisons, reviews, resampled flanks and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from binloom.functions import stats
from binloom.operators import allelic, calls, cohort, kernels, resample, segments, tracks
from binloom.operators.segments import PLACE
from binloom.sources.genome import Genome

from .catalog import _BA, _NOISE, _draws, REPLICATES, MAX_BINS, SRD_REF, STATE_CUTS, TAU, _before_after, _partition, allele_counts, cells, labelled, query, scores, states, greedy_sql

# lookups and set comparisons

query("j2_left_lookup", "cell:i best_s:r", "SELECT c.cell, CASE WHEN c.cell % 3 = 0 THEN s_acctbal END AS best_s FROM cells AS c LEFT JOIN supplier ON s_suppkey = c.cell")(
    lambda g: cells(g).join(g.read("supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("cell"), F.col("s_acctbal").alias("best_s")), "cell", "left")
)
query("j3_membership_flag", "cell:i in_cohort", "SELECT cell, cell IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10) AS in_cohort FROM cells")(
    lambda g: cells(g).join(g.read("supplier").where("s_nationkey < 10").select(F.col("s_suppkey").alias("cell"), F.lit(True).alias("hit")), "cell", "left").withColumn("in_cohort", F.col("hit").isNotNull())
)
query("j4_flank_screen", "source chrom:i s:i srd_phi_left:r eligible", f"SELECT h.source, h.chrom, h.s, h.srd_phi_left, c.eligible FROM hs AS h LEFT JOIN (SELECT source, chrom, s, n <= {MAX_BINS} AS eligible FROM st WHERE source <> 'all') AS c USING (source, chrom, s)")(
    lambda g: scores(g).join(_partition(g).where("source <> 'all'").select(*PLACE, "s", (F.col("e") - F.col("s") <= MAX_BINS).alias("eligible")), [*PLACE, "s"], "left")
)


@query("j10_window_overlaps", "chrom:i a:i b:i shared:i", """SELECT x.chrom, x.id AS a, y.id AS b, least(x.e, y.e) - greatest(x.s, y.s) AS shared FROM (SELECT chrom, i AS id, i AS s, i + 25 AS e FROM bins WHERE i % 10 = 0) AS x
 JOIN (SELECT chrom, i AS id, i AS s, i + 25 AS e FROM bins WHERE i % 10 = 0) AS y ON x.chrom = y.chrom AND x.id < y.id AND x.s < y.e AND y.s < x.e""")
def j10(g: Genome) -> DataFrame:
    windows = g.bins.where("i % 10 = 0").select("chrom", F.col("i").alias("s"), (F.col("i") + 25).alias("e"))
    a, b = (windows.select("chrom", F.col("s").alias(x), F.col("s").alias(f"{x}_s"), F.col("e").alias(f"{x}_e")) for x in "ab")
    return cohort.overlap_join(a, b, ["chrom"]).where("a < b")


_NEAR = "SELECT chrom, cell, x, row_number() OVER (PARTITION BY chrom ORDER BY x DESC, cell) AS rank FROM (SELECT chrom, cell, sum(x) AS x FROM signal GROUP BY ALL)"


def _neighbours(g: Genome, k: int) -> DataFrame:
    return cohort.top_k(g.signal.groupBy("chrom", "cell").agg(F.sum("x").alias("x")), ["chrom"], "x", "cell", k)


query("j11_labelled_neighbours", "chrom:i cell:i rank:i source", f"SELECT chrom, cell, rank, 'cluster' || (cell % 5) AS source FROM ({_NEAR}) WHERE rank <= 5")(
    lambda g: _neighbours(g, 5).join(g.membership.where("source <> 'all'"), "cell")
)
query("a25_neighbour_overlap", "a:i b:i shared:i", f"SELECT x.chrom AS a, y.chrom AS b, count(*) AS shared FROM ({_NEAR}) AS x JOIN ({_NEAR}) AS y ON x.cell = y.cell AND x.chrom < y.chrom WHERE x.rank <= 15 AND y.rank <= 15 GROUP BY ALL")(
    lambda g: _neighbours(g, 15).select("cell", F.col("chrom").alias("a")).join(_neighbours(g, 15).select("cell", F.col("chrom").alias("b")), "cell").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
)
query("u3_missing_extra", "cell:i side", "(SELECT cell, 'missing' AS side FROM cells WHERE cell NOT IN (SELECT cell FROM signal WHERE chrom = 1995 AND i < 20)) UNION ALL (SELECT s_suppkey, 'extra' FROM supplier WHERE s_suppkey NOT IN (SELECT cell FROM cells))")(
    lambda g: cells(g).select("cell").subtract(g.signal.where("chrom = 1995 AND i < 20").select("cell")).withColumn("side", F.lit("missing")).union(g.read("supplier").select("s_suppkey").subtract(cells(g).select("cell")).withColumn("side", F.lit("extra")))
)
query("u6_boundary_sets", "chrom:i bins", "SELECT chrom, string_agg(bin::VARCHAR, ',' ORDER BY bin) AS bins FROM (SELECT DISTINCT chrom, bin FROM boundaries) GROUP BY chrom")(
    lambda g: g.boundaries.groupBy("chrom").agg(F.array_join(F.sort_array(F.collect_set("bin")), ",").alias("bins"))
)

# profiles and tracks

query("a2_allelic_pseudobulk", "source g:i ha:r nonzero:r", "SELECT source, g, sum(k) / any_value(n_cells) AS ha, count(*) FILTER (k > 0)::DOUBLE / any_value(n_cells) AS nonzero FROM (SELECT cell, g, count(*) FILTER (status = 'F') AS k FROM lines JOIN bins USING (dt) GROUP BY ALL) JOIN membership USING (cell) JOIN n_cells USING (source) GROUP BY source, g")(
    lambda g: g.with_sources(g.lines.groupBy("cell", "day").agg(F.count_if(F.col("status") == "F").alias("k")).join(g.bins, "day"))
    .groupBy("source", "g").agg(F.sum("k").alias("t"), F.count_if(F.col("k") > 0).alias("z"))
    .join(g.membership.groupBy("source").agg(F.count("*").alias("n")), "source").select("source", "g", (F.col("t") / F.col("n")).alias("ha"), (F.col("z") / F.col("n")).alias("nonzero"))
)
query("a10_segment_trend", "source chrom:i seg:i r:r", "SELECT source, chrom, seg, CASE WHEN count(*) >= 3 AND var_pop(x) > 0 AND var_pop(i) > 0 THEN corr(x, i) END AS r FROM lab GROUP BY ALL")(
    lambda g: labelled(g).withColumn("i", F.col("i").cast("double")).groupBy(*PLACE, "seg").agg(stats.guarded_corr("x", "i").alias("r"))
)
query("a13_skewness", "source chrom:i skew:r", "SELECT source, chrom, avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5) AS skew FROM (SELECT *, avg(x) OVER (PARTITION BY source, chrom) AS m FROM profile) GROUP BY ALL")(
    lambda g: g.profile.groupBy(*PLACE).agg(stats.population_skewness("x").alias("skew"))
)
query("w4_level_track", "source chrom:i i:i v:r", "SELECT source, chrom, i, CASE WHEN med > 0 THEN greatest(-5, least(5, CASE WHEN x <= 0 THEN -5::DOUBLE ELSE log2(x / med) END)) END AS v FROM profile JOIN (SELECT source, chrom, median(x) AS med FROM profile GROUP BY ALL) USING (source, chrom)")(
    lambda g: g.profile.join(g.profile.groupBy(*PLACE).agg(F.percentile("x", F.lit(0.5)).alias("med")), PLACE).withColumn("v", tracks.log2_track(F.col("x"), F.col("med"), 5.0)[0])
)
query("w7_segment_ids", "source g:i id:i", "SELECT source, g, sum(CASE WHEN b.bin IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.source, p.chrom ORDER BY p.i) AS id FROM profile AS p LEFT JOIN boundaries AS b ON b.source = p.source AND b.chrom = p.chrom AND b.bin = p.i".replace("SELECT source, g", "SELECT p.source, g"))(
    lambda g: labelled(g).withColumn("id", F.col("seg"))
)


@query("w13_residual_lags", "source lag:i r:r", "SELECT source, k AS lag, corr(a, b) AS r FROM (SELECT x.source, k, x.r AS a, y.r AS b FROM (SELECT source, chrom, seg, \"start\", x - avg(x) OVER (PARTITION BY source, chrom, seg) AS r FROM lab) AS x CROSS JOIN (SELECT unnest(range(1, 11)) AS k) JOIN (SELECT source, chrom, seg, \"start\", x - avg(x) OVER (PARTITION BY source, chrom, seg) AS r FROM lab) AS y ON y.source = x.source AND y.chrom = x.chrom AND y.seg = x.seg AND y.\"start\" = x.\"start\" + k * 100000) GROUP BY ALL")
def w13(g: Genome) -> DataFrame:
    keys = [*PLACE, "seg"]
    rows = labelled(g).withColumn("r", F.col("x") - F.avg("x").over(W.partitionBy(*keys))).select(*keys, "start", "r")
    ahead = rows.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(10)))).select(*keys, (F.col("start") + F.col("lag") * 100_000).alias("start"), "lag", F.col("r").alias("before"))
    return rows.join(ahead, [*keys, "start"]).groupBy("source", "lag").agg(stats.guarded_corr("before", "r").alias("r"))


# partitions

query("g4_spliced_labels", "source g:i label:i", """SELECT source, g, dense_rank() OVER (PARTITION BY source ORDER BY chrom, seg) AS label FROM (SELECT p.source, p.chrom, p.g, sum(CASE WHEN b.bin IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.source, p.chrom ORDER BY p.i) AS seg FROM profile AS p
 LEFT JOIN (SELECT * FROM boundaries WHERE chrom <> 1997 UNION ALL SELECT source, 1997, unnest([40, 41, 200]) FROM n_cells) AS b ON b.source = p.source AND b.chrom = p.chrom AND b.bin = p.i)""")(
    lambda g: segments.labelled(g.profile, g.boundaries.where("chrom <> 1997").union(g.membership.select("source").distinct().select("source", F.lit(1997).alias("chrom"), F.explode(F.array(*[F.lit(x).cast("long") for x in (40, 41, 200)])).alias("bin"))))
    .withColumn("label", F.dense_rank().over(W.partitionBy("source").orderBy("chrom", "seg")))
)
query("g9_split_tests", "source chrom:i cut:i ad:r p_local:r p_global:r")(
    lambda g: kernels.split_tests(g.profile, g.boundaries.withColumnRenamed("bin", "cut"), 1000)
)
query("m20_live_scores", "source chrom:i seg:i srd_left:r delta_mean_right:r", "SELECT * FROM hs")(lambda g: segments.flank_scores(labelled(g)))


@query("m24_constituent_range", "source chrom:i first:i range:r below", f"SELECT source, chrom, first, CASE WHEN count(*) = count(l) THEN max(l) - min(l) END AS range, coalesce(CASE WHEN count(*) = count(l) THEN max(l) - min(l) END < {TAU}, false) AS below FROM (SELECT source, chrom, seg - k AS first, CASE WHEN median > 0 THEN log2(median) END AS l FROM st CROSS JOIN (SELECT unnest(range(0, 3)) AS k) WHERE seg >= k) GROUP BY ALL")
def m24_whole(g: Genome) -> DataFrame:
    """The runs of three segments (fewer at a chromosome's end) from each segment on."""
    rows = segments.segment_summaries(labelled(g)).withColumn("l", F.when(F.col("median") > 0, F.log2("median")))
    rows = rows.select(*PLACE, "l", F.explode(F.sequence(F.greatest(F.col("seg") - 2, F.lit(0)), F.col("seg"))).alias("first"))
    found = rows.groupBy(*PLACE, "first").agg(F.when(F.count("*") == F.count("l"), F.max("l") - F.min("l")).alias("range"))
    return found.withColumn("below", F.coalesce(F.col("range") < TAU, F.lit(False)))


@query("m28_conflicts", "source chrom:i seg:i removed:i conflict", f"SELECT source, chrom, seg, removed, count(*) OVER (PARTITION BY source, chrom, removed) > 1 AS conflict FROM (SELECT *, CASE WHEN abs(delta_median_left) <= abs(delta_median_right) THEN s ELSE e END AS removed FROM hs WHERE e - s <= {MAX_BINS})")
def m28(g: Genome) -> DataFrame:
    rows = scores(g).where(F.col("e") - F.col("s") <= MAX_BINS).withColumn("removed", F.when(F.abs("delta_median_left") <= F.abs("delta_median_right"), F.col("s")).otherwise(F.col("e")))
    return rows.withColumn("conflict", F.count("*").over(W.partitionBy(*PLACE, "removed")) > 1)


query("m33_colour_bins", "source chrom:i seg:i metric:r colour:i", "SELECT source, chrom, seg, metric, (abs(metric) >= 0.02)::INT + (abs(metric) >= 0.05)::INT + (abs(metric) >= 0.1)::INT AS colour FROM (SELECT *, round(CASE WHEN abs(delta_mean_left) <= abs(delta_mean_right) THEN delta_mean_left ELSE delta_mean_right END, 9) AS metric FROM hs)")(
    lambda g: scores(g).withColumn("metric", F.round(F.when(F.abs("delta_mean_left") <= F.abs("delta_mean_right"), F.col("delta_mean_left")).otherwise(F.col("delta_mean_right")), 9)).withColumn("colour", sum(((F.abs("metric") >= c).cast("int") for c in (0.05, 0.1)), (F.abs("metric") >= 0.02).cast("int")))
)
query("m34_alternative_flanks", "source chrom:i seg:i n:i delta_mean_left:r delta_median_left:r delta_iqr_mean_left:r delta_mean_right:r delta_median_right:r delta_iqr_mean_right:r", f"SELECT * FROM hs WHERE n <= {MAX_BINS}")(
    lambda g: scores(g).where(F.col("n") <= MAX_BINS)
)

# states by cell and noise

_CELL_STATES = "SELECT m.source, s.cell, l.chrom, l.seg, min(l.i) AS s, max(l.i) + 1 AS e, sum(coalesce(x.x, 0)) / count(*) AS mean FROM membership AS m JOIN (SELECT DISTINCT cell FROM signal) AS s USING (cell) JOIN lab AS l ON l.source = m.source LEFT JOIN signal AS x ON x.cell = s.cell AND x.g = l.g WHERE m.source <> 'all' GROUP BY ALL"
_CELL_CALLS = f"SELECT *, CASE WHEN med > 0 THEN CASE WHEN mean / med >= 1.25::DOUBLE THEN 2::DOUBLE WHEN mean / med >= 0.75::DOUBLE THEN 1::DOUBLE ELSE 0::DOUBLE END END AS state FROM (SELECT *, avg(mean) OVER (PARTITION BY cell) AS med FROM ({_CELL_STATES}))"


def _cell_calls(g: Genome) -> DataFrame:
    """Each cell's state on its own cluster's segments: sums per (cell, segment) from one equi-join of signal and labels, over segment sizes."""
    keys = ["source", "chrom", "seg"]
    labels = labelled(g).where("source <> 'all'")
    sizes = labels.groupBy(*keys).agg(F.count("*").alias("n"), F.min("i").alias("s"), (F.max("i") + 1).alias("e"))
    own = g.membership.where("source <> 'all'")
    sums = g.signal.join(own, "cell").join(labels.select("source", "g", "seg"), ["source", "g"]).groupBy(*keys, "cell").agg(F.sum("x").alias("x"))
    rows = own.join(sizes, "source").join(sums, [*keys, "cell"], "left").withColumn("mean", F.coalesce("x", F.lit(0.0)) / F.col("n"))
    level = F.avg("mean").over(W.partitionBy("cell"))
    return rows.withColumn("med", level).withColumn("state", F.when(F.col("med") > 0, F.when(F.col("mean") / F.col("med") >= 1.25, 2.0).when(F.col("mean") / F.col("med") >= 0.75, 1.0).otherwise(0.0)))


query("c7_cell_calls", "source cell:i chrom:i seg:i mean:r state:r", _CELL_CALLS)(_cell_calls)
_CELL_NOISE = f"SELECT source, cell, count(*) AS n_called, count(*) FILTER (p = q AND state <> p) AS n_zigzag FROM (SELECT *, lag(state) OVER w AS p, lead(state) OVER w AS q FROM ({_CELL_CALLS}) WHERE state IS NOT NULL WINDOW w AS (PARTITION BY source, cell, chrom ORDER BY seg)) GROUP BY ALL"


def _cell_noise(g: Genome) -> DataFrame:
    return calls.sequence_noise(_cell_calls(g), ["source", "cell", "chrom"]).groupBy("source", "cell").agg(F.sum("n_called").alias("n_called"), F.sum("n_zigzag").alias("n_zigzag"))


query("n3_cells_noise", "source n_cells:i mean_zigzag:r", f"SELECT source, count(*) AS n_cells, avg(n_zigzag) AS mean_zigzag FROM (SELECT source, n_zigzag FROM ({_CELL_NOISE}) UNION ALL SELECT 'all', n_zigzag FROM ({_CELL_NOISE})) GROUP BY source")(
    lambda g: _cell_noise(g).withColumn("source", F.explode(F.array("source", F.lit("all")))).groupBy("source").agg(F.count("*").alias("n_cells"), F.avg("n_zigzag").alias("mean_zigzag"))
)


@query("n4_combined_noise", "source cluster_zigzag:i cell_zigzag:r", f"SELECT coalesce(a.source, b.source) AS source, a.z AS cluster_zigzag, b.z AS cell_zigzag FROM (SELECT source, sum(n_zigzag) AS z FROM ({_NOISE.format('source, chrom')}) GROUP BY source) AS a FULL JOIN (SELECT source, avg(n_zigzag) AS z FROM ({_CELL_NOISE}) GROUP BY source) AS b ON a.source = b.source")
def n4(g: Genome) -> DataFrame:
    a = calls.sequence_noise(states(g), PLACE).groupBy("source").agg(F.sum("n_zigzag").alias("cluster_zigzag"))
    return a.join(_cell_noise(g).groupBy("source").agg(F.avg("n_zigzag").alias("cell_zigzag")), "source", "full")


query("c11_change_by_chromosome", "source chrom:i n_called:i n_changed:i median_step:r", f"SELECT source, chrom, count(*) FILTER (before <> 255 AND after <> 255) AS n_called, count(*) FILTER (before <> 255 AND after <> 255 AND before <> after) AS n_changed, median(after - before) FILTER (before <> 255 AND after <> 255) AS median_step FROM ({_BA}) GROUP BY ALL")(
    lambda g: calls.changed_share(_before_after(g), PLACE).join(_before_after(g).where("before <> 255 AND after <> 255").groupBy(*PLACE).agg(F.percentile(F.col("after") - F.col("before"), F.lit(0.5)).alias("median_step")), PLACE, "left")
)
query("k4_ordered_transitions", "source place:i before:i after:i", f"SELECT source, row_number() OVER (PARTITION BY source ORDER BY n DESC, before, after) AS place, before, after FROM (SELECT source, before, after, count(*) AS n FROM ({_BA}) WHERE before <> after GROUP BY ALL)")(
    lambda g: calls.transitions(F.col("before"), F.col("after"), _before_after(g), ["source"]).withColumn("place", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "before", "after")))
)
query("c6_cluster_rows", "source chrom:i bin_start:i bin_end:i n_bins:i state:r", "SELECT states.source, states.chrom, o.g0 + states.s AS bin_start, o.g0 + states.e - 1 AS bin_end, states.n AS n_bins, state FROM states JOIN (SELECT chrom, min(g) AS g0 FROM bins GROUP BY chrom) AS o ON o.chrom = states.chrom")(
    lambda g: states(g).join(g.chroms.select("chrom", "offset"), "chrom").select(*PLACE, (F.col("offset") + F.col("s")).alias("bin_start"), (F.col("offset") + F.col("e") - 1).alias("bin_end"), F.col("n").alias("n_bins"), "state")
)

# resampled flanks and edits

#: Numbers of the signal in one task.
ENTRIES = 1 << 20


def _cell_sums(g: Genome) -> DataFrame:
    """source, chrom, seg, cell, x: cells are dealt to tasks of ENTRIES numbers, which add up theirs and keep them."""
    tasks = max(1, -(-g.signal.count() // ENTRIES))
    dealt = g.with_sources(g.signal.select("cell", "g", "x").repartition(tasks, "cell"))
    return dealt.join(labelled(g).select("source", "g", "chrom", "seg"), ["source", "g"]).groupBy(*PLACE, "seg", "cell").agg(F.sum("x").alias("x"))


def _sizes(g: Genome) -> DataFrame:
    return labelled(g).groupBy(*PLACE, "seg").agg(F.count("*").alias("n"))


def _replicates(g: Genome, replicates: int = 20) -> DataFrame:
    means = _cell_sums(g).join(_sizes(g), [*PLACE, "seg"]).select(*PLACE, "seg", "cell", (F.col("x") / F.col("n")).alias("mean"))
    return resample.flank_replicates(means, resample.bootstrap_weights(g.membership, replicates), replicates)


_DELTAS = """, means AS (SELECT m.source, s.cell, l.chrom, l.seg, sum(s.x) / any_value(st.n) AS mean FROM signal AS s JOIN membership AS m USING (cell) JOIN lab AS l ON l.source = m.source AND l.g = s.g JOIN st ON st.source = l.source AND st.chrom = l.chrom AND st.seg = l.seg GROUP BY ALL),
 levels AS (SELECT source, rep, chrom, seg, sum(mean * w) AS m FROM means JOIN weights USING (source, cell) GROUP BY ALL),
 deltas AS (SELECT source, rep, chrom, seg, CASE WHEN m > 0 AND p > 0 THEN log2(m / p) END AS delta_left, CASE WHEN m > 0 AND q > 0 THEN log2(m / q) END AS delta_right FROM (SELECT *, lag(m) OVER w AS p, lead(m) OVER w AS q FROM levels WINDOW w AS (PARTITION BY source, rep, chrom ORDER BY seg)))"""
_FLANKS = _draws(REPLICATES) + _DELTAS
query("b6_flank_replicates", "source rep:i chrom:i seg:i delta_left:r delta_right:r", f"{_FLANKS} SELECT * FROM deltas")(lambda g: _replicates(g, REPLICATES))
_UNCERTAIN = "source chrom:i seg:i n_valid:i se_left:r se_right:r covariance:r withheld"
_UNCERTAINTY = " SELECT source, chrom, seg, count(*) FILTER (delta_left IS NOT NULL AND delta_right IS NOT NULL) AS n_valid, stddev_samp(delta_left) AS se_left, stddev_samp(delta_right) AS se_right, covar_samp(delta_left, delta_right) AS covariance, CASE WHEN count(delta_left) = 0 OR count(delta_right) = 0 THEN 'terminal' WHEN count(*) FILTER (delta_left IS NOT NULL AND delta_right IS NOT NULL) < 10 THEN 'too_few' ELSE '' END AS withheld FROM deltas GROUP BY ALL"
query("b8_flank_uncertainty", _UNCERTAIN, _FLANKS + _UNCERTAINTY)(lambda g: resample.flank_uncertainty(_replicates(g, REPLICATES)))


def _side_summary(g: Genome) -> DataFrame:
    return resample.side_summary(resample.side_replicates(_cell_sums(g), _sizes(g), g.membership, resample.bootstrap_weights(g.membership, REPLICATES), REPLICATES))


_ROOT = "sqrt(greatest(2 * ((CASE WHEN y > 0 THEN y * ln(y / (n * (y + ry) / (n + rn))) ELSE 0 END) + (CASE WHEN ry > 0 THEN ry * ln(ry / (rn * (y + ry) / (n + rn))) ELSE 0 END)), 0::DOUBLE))"
_SIDES = f"""{_draws(REPLICATES)}, every AS (SELECT source, rep, cell, w FROM weights UNION ALL SELECT source, 0, cell, 1 FROM membership),
 sums AS (SELECT m.source, e.rep, l.chrom, l.seg, sum(s.x * e.w) AS y FROM signal AS s JOIN membership AS m USING (cell) JOIN lab AS l ON l.source = m.source AND l.g = s.g JOIN every AS e ON e.source = m.source AND e.cell = m.cell GROUP BY ALL),
 grid AS (SELECT st.source, st.chrom, st.seg, st.n::DOUBLE AS n, rep, n_cells, coalesce(y, 0) / n_cells AS y FROM st JOIN n_cells USING (source) CROSS JOIN (SELECT unnest(range(0, {REPLICATES + 1})) AS rep) LEFT JOIN sums USING (source, chrom, seg, rep)),
 pairs AS (SELECT *, 'left' AS side, lag(y) OVER w AS ry, lag(n) OVER w AS rn FROM grid WINDOW w AS (PARTITION BY source, rep, chrom ORDER BY seg) UNION ALL SELECT *, 'right', lead(y) OVER w, lead(n) OVER w FROM grid WINDOW w AS (PARTITION BY source, rep, chrom ORDER BY seg)),
 scored AS (SELECT *, rn IS NULL AS terminal, CASE WHEN y > 0 AND ry > 0 THEN log2((y / n) / (ry / rn)) END AS delta, CASE WHEN rn IS NULL THEN NULL WHEN y + ry = 0 THEN 0 ELSE sign(y / n - ry / rn) * {_ROOT} END AS srd, coalesce(y = 0 AND ry = 0, false) AS zero FROM pairs),
 summed AS (SELECT source, chrom, seg, side, any_value(n_cells) AS n_cells, bool_or(terminal) AS terminal, bool_or(zero) FILTER (rep = 0) AS zero_pair, count(*) FILTER (rep > 0 AND delta IS NULL) AS n_missing,
  {", ".join(f"max({v}) FILTER (rep = 0) AS {v}, count({v}) FILTER (rep > 0) AS n_{v}, stddev_samp({v}) FILTER (rep > 0) AS sd_{v}, quantile_cont({v}, 0.025) FILTER (rep > 0) AS lo_{v}, quantile_cont({v}, 0.975) FILTER (rep > 0) AS hi_{v}, count(*) FILTER (rep > 0 AND {v} > 0) AS up_{v}, count(*) FILTER (rep > 0 AND {v} < 0) AS down_{v}" for v in ("delta", "srd"))} FROM scored GROUP BY ALL),
 told AS (SELECT *, CASE WHEN terminal THEN 'terminal_flank_missing' WHEN n_cells < 2 THEN 'too_few_cells' WHEN n_missing > 0 THEN 'nonfinite_replicates' WHEN sd_delta = 0 THEN 'zero_bootstrap_variance' ELSE '' END AS withheld,
  {", ".join(f"CASE WHEN n_{v} > 1 THEN sd_{v} END AS se_{v}, CASE WHEN n_{v} > 1 THEN lo_{v} END AS low_{v}, CASE WHEN n_{v} > 1 THEN hi_{v} END AS high_{v}, CASE WHEN n_{v} > 1 THEN (CASE WHEN {v} > 0 THEN up_{v} WHEN {v} < 0 THEN down_{v} WHEN {v} = 0 THEN n_{v} - up_{v} - down_{v} END) / n_{v}::DOUBLE END AS agree_{v}" for v in ("delta", "srd"))} FROM summed)"""
query("b7_flank_z", "source chrom:i seg:i side delta:r se:r z_boot:r n_missing:i zero_pair withheld", f"{_SIDES} SELECT *, CASE WHEN withheld IN ('', 'zero_bootstrap_variance') THEN se_delta END AS se, CASE WHEN withheld = '' THEN delta / se_delta END AS z_boot FROM told")(_side_summary)
query("b9_screen_bootstrap", "source chrom:i seg:i side delta:r se_delta:r low_delta:r high_delta:r agree_delta:r srd:r se_srd:r low_srd:r high_srd:r agree_srd:r", f"{_SIDES} SELECT * FROM told WHERE NOT terminal")(lambda g: _side_summary(g).where("NOT terminal"))
query("b4_bootstrap_weights", "source rep:i cell:i w:i", f"{_draws(REPLICATES)} SELECT * FROM weights")(lambda g: resample.bootstrap_weights(g.membership, REPLICATES))
_DRAWN = "('0x' || substr(md5('42:' || p.source || ':' || p.chrom || ':' || p.i), 1, 8))::BIGINT"
query("e2_extend", "source chrom:i i:i edited:r", f"SELECT p.source, p.chrom, p.i, coalesce(d.x, p.x) AS edited FROM profile AS p LEFT JOIN profile AS d ON d.source = p.source AND d.chrom = p.chrom AND p.i BETWEEN 100 AND 149 AND d.i = 20 + {_DRAWN} % 15")(
    lambda g: resample.region_draws(g.profile, g.profile.where("i BETWEEN 20 AND 34").select(*PLACE, (F.col("i") - 20).alias("k"), "x"), 100, 150)
)
query("e5_width_series", "source chrom:i width:i mean:r edited:r", "SELECT source, chrom, width, avg(x) AS mean, avg(CASE WHEN i >= 120 - width // 2 AND i < 120 - width // 2 + width THEN x * 2 ELSE x END) AS edited FROM profile CROSS JOIN (SELECT unnest([10, 25, 50, 100, 150]) AS width) GROUP BY ALL")(
    lambda g: g.profile.withColumn("width", F.explode(F.array(*map(F.lit, (10, 25, 50, 100, 150))))).withColumn("lo", 120 - F.floor(F.col("width") / 2)).groupBy(*PLACE, "width").agg(F.avg("x").alias("mean"), F.avg(F.when((F.col("i") >= F.col("lo")) & (F.col("i") < F.col("lo") + F.col("width")), F.col("x") * 2).otherwise(F.col("x"))).alias("edited"))
)
query("e3_edited_scores", "source chrom:i seg:i before:r after:r", "SELECT source, chrom, seg, avg(x) AS before, avg(CASE WHEN i BETWEEN 50 AND 79 THEN x + 3 ELSE x END) AS after FROM lab GROUP BY ALL")(
    lambda g: resample.apply_edit(labelled(g), 50, 80, "add", 3.0).groupBy(*PLACE, "seg").agg(F.avg("x").alias("before"), F.avg("edited").alias("after"))
)

# allelic against depth

query("l3_track", "i:i dbaf:r", "SELECT i, dbaf FROM sig WHERE source = 'all' AND chrom = 1998 AND kept")(lambda g: allelic.signals(allele_counts(g), 5).where("source = 'all' AND chrom = 1998 AND kept"))
_AGREED = greedy_sql("SELECT a.source, a.chrom, a.bin AS a_bin, b.bin AS b_bin, abs(a.bin - b.bin) AS distance FROM boundaries AS a JOIN boundaries AS b ON a.source <> 'all' AND b.source = 'all' AND a.chrom = b.chrom AND abs(a.bin - b.bin) <= 3")
query("l7_agreement", "source n_a:i n_b:i n_matched:i a_only:i b_only:i median_offset:r", f"""SELECT source, n_a, n_b, coalesce(n, 0) AS n_matched, n_a - coalesce(n, 0) AS a_only, n_b - coalesce(n, 0) AS b_only, median_offset FROM (SELECT source, count(*) AS n_a FROM boundaries WHERE source <> 'all' GROUP BY source) CROSS JOIN (SELECT count(*) AS n_b FROM boundaries WHERE source = 'all')
 LEFT JOIN (SELECT source, count(*) AS n, median(b_bin - a_bin) AS median_offset FROM ({_AGREED}) GROUP BY source) USING (source)""")(
    lambda g: allelic.agreement(g.boundaries.where("source <> 'all'"), _all_for_each(g), kernels.match_one_to_one(g.boundaries.where("source <> 'all'"), _all_for_each(g), 3))
)


def _all_for_each(g: Genome) -> DataFrame:
    return g.boundaries.where("source = 'all'").drop("source").withColumn("source", F.explode(F.array(*[F.lit(s) for s in g.sources if s != "all"])))


@query("l9_call_shares", "source chrom:i a_s:i code:i bins:i share:r rank:i", """SELECT source, chrom, a_s, code, bins, bins::DOUBLE / sum(bins) OVER (PARTITION BY source, chrom, a_s) AS share, row_number() OVER (PARTITION BY source, chrom, a_s ORDER BY bins DESC, code) AS rank FROM (SELECT b.source, a.chrom, a.s AS a_s, coalesce(round_even(b.state * 2, 0), 255)::INT AS code, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS bins
 FROM st AS a JOIN states AS b ON a.source = 'all' AND b.source <> 'all' AND a.chrom = b.chrom AND a.s < b.e AND b.s < a.e GROUP BY ALL)""")
def l9(g: Genome) -> DataFrame:
    clusters = F.explode(F.array(*map(F.lit, g.sources[:-1]))).alias("source")
    a = _partition(g, "all").select(clusters, "chrom", F.col("s").alias("a_s"), F.col("e").alias("a_e"))
    b = states(g).where("source <> 'all'").select("source", "chrom", F.col("s").alias("b_s"), F.col("e").alias("b_e"), calls.encode_states(F.col("state")).alias("code"))
    return allelic.call_shares(cohort.overlap_join(a, b, ["source", "chrom"]), ["source", "chrom", "a_s"], "code")


@query("z21_table_mismatches", "source chrom:i seg:i", "SELECT source, chrom, seg FROM st WHERE abs(mean - median) > 0.5::DOUBLE")
def z21(g: Genome) -> DataFrame:
    """Rows of two tables whose values differ by more than a tolerance, or that only one has."""
    a = segments.segment_summaries(labelled(g)).select(*PLACE, "seg", "mean")
    b = segments.segment_summaries(labelled(g)).select(*PLACE, "seg", "median")
    both = a.join(b, [*PLACE, "seg"], "full")
    return both.where(F.col("mean").isNull() | F.col("median").isNull() | (F.abs(F.col("mean") - F.col("median")) > 0.5))
