"""Reviews and small helpers of the engine as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from binloom.functions import stats
from binloom.operators import cohort, ordering, segments, tracks
from binloom.operators.segments import PLACE
from binloom.sources.genome import Genome

from .catalog import MAX_BINS, TAU, _partition, cells, labelled, query, scores

query("k1_cell_orders", "cell:i ascending:i descending:i", "SELECT cell, row_number() OVER (ORDER BY coverage, cell) AS ascending, row_number() OVER (ORDER BY coverage DESC, cell) AS descending FROM cells")(
    lambda g: ordering.running_total(ordering.running_total(cells(g), [], ["coverage", "cell"], name="a"), [], [F.desc("coverage"), "cell"], name="d").select("cell", (F.col("a") + 1).alias("ascending"), (F.col("d") + 1).alias("descending"))
)
query("p7_candidates", "chrom:i bin:i", "SELECT chrom, bin FROM boundaries WHERE source = 'cluster3' AND chrom = 1998")(lambda g: g.boundaries.where("source = 'cluster3' AND chrom = 1998"))


@query("p11_window_samples", "source chrom:i j:i x:r", "SELECT source, chrom, i AS j, x FROM profile JOIN (SELECT chrom, count(*) AS n FROM bins GROUP BY chrom) USING (chrom) WHERE i >= greatest(-5, 1) AND i < least(40, n)")
def p11(g: Genome) -> DataFrame:
    rows = g.profile.join(g.chroms.select("chrom", "n"), "chrom")
    return rows.where((F.col("i") >= F.greatest(F.lit(-5), F.lit(1))) & (F.col("i") < F.least(F.lit(40), F.col("n")))).withColumn("j", F.col("i"))


@query("p13_clipped_windows", "source chrom:i seg:i lo:i hi:i", "SELECT source, chrom, seg, greatest(s, 100) AS lo, least(e, 220) AS hi FROM st WHERE greatest(s, 100) < least(e, 220)")
def p13(g: Genome) -> DataFrame:
    return _partition(g).withColumns({"lo": F.greatest(F.col("s"), F.lit(100)), "hi": F.least(F.col("e"), F.lit(220))}).where("lo < hi")


query("u4_first_of_each", "source chrom:i bin:i", "SELECT source, chrom, min(bin) AS bin FROM boundaries GROUP BY ALL")(
    lambda g: cohort.top_k(g.boundaries.withColumn("weight", -F.col("bin")), PLACE, "weight", "bin", 1)
)
query("e6_latest_boundaries", "source chrom:i bin:i rank:i", "SELECT source, chrom, bin, rank FROM (SELECT *, row_number() OVER (PARTITION BY source, chrom ORDER BY bin DESC) AS rank FROM boundaries) WHERE rank <= 12")(
    lambda g: cohort.top_k(g.boundaries, PLACE, "bin", "bin", 12)
)


@query("m25_boundary_reasons", "source chrom:i s:i delta:r reason", f"SELECT source, chrom, s, CASE WHEN median > 0 AND p > 0 THEN log2(median / p) END AS delta, CASE WHEN least(n, m) > {MAX_BINS} THEN 'long_long_not_candidate' WHEN NOT (median > 0 AND p > 0) THEN 'observed_median_zero' WHEN abs(log2(median / p)) >= {TAU} THEN 'effect_ge_tau' ELSE 'eligible' END AS reason FROM (SELECT *, lag(median) OVER w AS p, lag(n) OVER w AS m FROM st WINDOW w AS (PARTITION BY source, chrom ORDER BY seg)) WHERE m IS NOT NULL")
def m25(g: Genome) -> DataFrame:
    rows = segments.with_flanks(segments.segment_summaries(labelled(g)), ["n", "median"]).where("n_left IS NOT NULL")
    rows = rows.withColumn("delta", stats.log2_ratio(F.col("median"), F.col("median_left")))
    reason = F.when(F.least("n", "n_left") > MAX_BINS, "long_long_not_candidate").when(F.col("delta").isNull(), "observed_median_zero").when(F.abs("delta") >= TAU, "effect_ge_tau").otherwise("eligible")
    return rows.withColumn("reason", reason)


query("m32_flank_picks", "source chrom:i seg:i pick:r side", "SELECT source, chrom, seg, CASE WHEN abs(srd_phi_left) <= abs(srd_phi_right) THEN srd_phi_left ELSE srd_phi_right END AS pick, CASE WHEN abs(srd_phi_left) <= abs(srd_phi_right) THEN 'left' ELSE 'right' END AS side FROM hs")(
    lambda g: scores(g).withColumn("side", segments.smaller_side(F.col("srd_phi_left"), F.col("srd_phi_right"))).withColumn("pick", F.when(F.col("side") == "left", F.col("srd_phi_left")).otherwise(F.col("srd_phi_right")))
)
query("z12_flank_asymmetry", "source chrom:i seg:i asymmetry:r", "SELECT source, chrom, seg, CASE WHEN l > 0 AND r > 0 THEN log2(l / r) END AS asymmetry FROM (SELECT *, lag(mean) OVER w AS l, lead(mean) OVER w AS r FROM st WINDOW w AS (PARTITION BY source, chrom ORDER BY seg)) WHERE l IS NOT NULL AND r IS NOT NULL")(
    lambda g: segments.with_flanks(segments.segment_summaries(labelled(g)), ["mean"]).where("mean_left IS NOT NULL AND mean_right IS NOT NULL").withColumn("asymmetry", stats.log2_ratio(F.col("mean_left"), F.col("mean_right")))
)
query("z14_bin_width", "chrom:i width:r", 'SELECT chrom, median(d) AS width FROM (SELECT chrom, "start" - lag("start") OVER (PARTITION BY chrom ORDER BY i) AS d FROM bins) WHERE d > 0 GROUP BY chrom')(
    lambda g: g.bins.withColumn("d", F.col("start") - F.lag("start").over(W.partitionBy("chrom").orderBy("i"))).where("d > 0").groupBy("chrom").agg(F.percentile("d", F.lit(0.5)).alias("width"))
)
query("z15_valid_sums", "source chrom:i seg:i total:r n_valid:i", "SELECT source, chrom, seg, sum(x) FILTER (x >= 0 AND isfinite(x)) AS total, count(*) FILTER (x >= 0 AND isfinite(x)) AS n_valid FROM lab GROUP BY ALL")(
    lambda g: labelled(g).withColumn("v", F.when((F.col("x") >= 0) & ~F.isnan("x") & (F.col("x") < float("inf")), F.col("x"))).groupBy(*PLACE, "seg").agg(F.sum("v").alias("total"), F.count("v").alias("n_valid"))
)
query("z22_chromosome_offset", "source chrom:i shift:r", "SELECT source, chrom, CASE WHEN m > 0 AND g > 0 THEN log2(m / g) END AS shift FROM (SELECT source, chrom, avg(x) AS m FROM profile GROUP BY ALL) JOIN (SELECT source, avg(x) AS g FROM profile GROUP BY source) USING (source)")(
    lambda g: g.profile.groupBy(*PLACE).agg(F.avg("x").alias("m")).join(g.profile.groupBy("source").agg(F.avg("x").alias("whole")), "source").withColumn("shift", stats.log2_ratio(F.col("m"), F.col("whole")))
)
query("z23_segment_overlay", "source chrom:i i:i mean:r median:r overlap", "SELECT lab.source, lab.chrom, lab.i, st.mean, st.median, round(abs(st.mean - st.median), 9) < 0.04::DOUBLE AS overlap FROM lab JOIN st USING (source, chrom, seg)")(
    lambda g: labelled(g).join(segments.segment_summaries(labelled(g)).select(*PLACE, "seg", "mean", "median"), [*PLACE, "seg"]).withColumn("overlap", F.round(F.abs(F.col("mean") - F.col("median")), 9) < 0.04)
)
query("w6_gap_at_boundary", "source chrom:i bin:i gap", 'SELECT b.source, b.chrom, b.bin, "start" > pe + 1 AS gap FROM boundaries AS b JOIN (SELECT source, chrom, i, "start", lag("end") OVER (PARTITION BY source, chrom ORDER BY i) AS pe FROM profile) AS p ON p.source = b.source AND p.chrom = b.chrom AND p.i = b.bin')(
    lambda g: tracks.gap_flags(g.profile).withColumnRenamed("i", "bin").join(g.boundaries, [*PLACE, "bin"])
)
