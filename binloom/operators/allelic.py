"""Allelic signals from two counts a bin, and how their breakpoints and segments agree with the depth's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .segments import PLACE


def signals(counts: DataFrame, least: int = 10) -> DataFrame:
    """counts (source, chrom, i, ha, hb) with at, dbaf, abs_dbaf, shrunk_abs_dbaf, oriented, kept; undefined shares are NULL."""
    at = F.col("ha") + F.col("hb")
    diff = F.col("ha") - F.col("hb")
    share = F.when(at > 0, diff / at)
    return counts.withColumns({
        "at": at, "dbaf": share, "abs_dbaf": F.abs(share), "shrunk_abs_dbaf": F.abs(diff) / (at + 2), "oriented": F.when(diff != 0, F.signum(diff) * F.abs(share)), "kept": at >= least,
    })


def segment_view(segments: DataFrame, rows: DataFrame, breakpoints: DataFrame, margin: int, x: str = "dbaf") -> DataFrame:
    """Per segment (source, chrom, seg, s, e): kept bins, their mean and population deviation, and breakpoints more than `margin` bins from both edges.

    rows and breakpoints carry the segment they lie in, so nothing is joined by range.
    """
    stats = rows.where("kept").groupBy(*PLACE, "seg").agg(F.count("*").alias("kept"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))
    inner = breakpoints.join(segments.select(*PLACE, "seg", "s", "e"), [*PLACE, "seg"]).where((F.col("bin") - F.col("s") > margin) & (F.col("e") - F.col("bin") > margin))
    inner = inner.groupBy(*PLACE, "seg").agg(F.count("*").alias("n_inner"))
    return segments.join(stats, [*PLACE, "seg"], "left").join(inner, [*PLACE, "seg"], "left").select(*PLACE, "seg", F.coalesce("kept", F.lit(0)).alias("kept"), "mean", "sd", F.coalesce("n_inner", F.lit(0)).alias("n_inner"))


def matched_distance(pairs: DataFrame, gaps: DataFrame, tolerance: int) -> DataFrame:
    """pairs (source, chrom, a_bin, b_bin) with gap-aware distance: 0 where a lies inside b's gap [gap_start, gap_end], else to its nearer end."""
    rows = pairs.join(gaps.select(*PLACE, F.col("bin").alias("b_bin"), "gap_start", "gap_end"), [*PLACE, "b_bin"], "left")
    lo, hi = F.coalesce("gap_start", "b_bin"), F.coalesce("gap_end", "b_bin")
    distance = F.greatest(lo - F.col("a_bin"), F.col("a_bin") - hi, F.lit(0))
    return rows.withColumn("distance", distance).where(F.col("distance") <= tolerance).drop("gap_start", "gap_end")


def agreement(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per source: breakpoints of both sets, matched ones, those of one set alone, and the median signed offset."""
    n = a.groupBy("source").agg(F.count("*").alias("n_a")).join(b.groupBy("source").agg(F.count("*").alias("n_b")), "source", "full")
    m = pairs.groupBy("source").agg(F.count("*").alias("n_matched"), F.percentile(F.col("b_bin") - F.col("a_bin"), F.lit(0.5)).alias("median_offset"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return n.join(m, "source", "left").select("source", zero("n_a").alias("n_a"), zero("n_b").alias("n_b"), zero("n_matched").alias("n_matched"), (zero("n_a") - zero("n_matched")).alias("a_only"), (zero("n_b") - zero("n_matched")).alias("b_only"), "median_offset")


def call_shares(overlaps: DataFrame, keys: list[str], call: str) -> DataFrame:
    """Per key the share of each call by overlapped length, ranked by (-share, call)."""
    length = overlaps.groupBy(*keys, call).agg(F.sum("shared").alias("bins"))
    share = F.col("bins") / F.sum("bins").over(W.partitionBy(*keys))
    return length.withColumn("share", share).withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("bins"), call)))
