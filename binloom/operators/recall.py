"""Calls of every cell under its cluster's segments, and what changes when the segments do.

Signal is joined to segment labels by bin, never by interval; two segmentations are compared on the pieces
of their overlay, so bins aren't unfolded for each cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.functions.stats import ratio

from .calls import NOT_CALLED, copy_numbers, encode_states, weighted_medians
from .segments import PLACE

UNIT = ["source", "chrom", "seg"]


def segments_of(labels: DataFrame) -> DataFrame:
    """source, chrom, seg, n of labels (source, chrom, i, seg)."""
    return labels.groupBy(*UNIT).agg(F.count("*").alias("n"))


def cell_segments(signal: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """cell, source, chrom, seg, n, mean of each cell under its own source's segments; bins without signal count as 0.

    members: source, cell with one source a cell; cells of a source without segments are left out.
    """
    sums = signal.join(members, "cell").join(labels.select(*PLACE, "i", "seg"), [*PLACE, "i"]).groupBy("cell", "chrom", "seg").agg(F.sum("x").alias("total"))
    every = members.join(segments_of(labels), "source").join(sums, ["cell", "chrom", "seg"], "left")
    return every.select("cell", *UNIT, "n", (F.coalesce("total", F.lit(0.0)) / F.col("n")).alias("mean"))


def call_cells(signal: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """cell_segments with each cell's fit: status, best_s, continuous, whole, state and its code."""
    return copy_numbers(cell_segments(signal, members, labels), ["cell"]).withColumn("code", encode_states(F.col("state")))


def overlay(before: DataFrame, after: DataFrame) -> DataFrame:
    """source, chrom, before_seg, after_seg, n_bins: the pieces of two labellings (source, chrom, i, seg) of the same bins."""
    both = before.select(*PLACE, "i", F.col("seg").alias("before_seg")).join(after.select(*PLACE, "i", F.col("seg").alias("after_seg")), [*PLACE, "i"])
    return both.groupBy(*PLACE, "before_seg", "after_seg").agg(F.count("*").alias("n_bins"))


def piece_calls(before: DataFrame, after: DataFrame, pieces: DataFrame, unit: list[str]) -> DataFrame:
    """unit, chrom, n_bins, before, after, before_s, after_s for each piece: the codes and scales of two calls (unit, source, chrom, seg, code, best_s)."""
    keys = [*dict.fromkeys([*unit, *PLACE])]
    a = before.select(*keys, F.col("seg").alias("before_seg"), F.col("code").alias("before"), F.col("best_s").alias("before_s"))
    b = after.select(*keys, F.col("seg").alias("after_seg"), F.col("code").alias("after"), F.col("best_s").alias("after_s"))
    return a.join(pieces, [*PLACE, "before_seg"]).join(b, [*keys, "after_seg"])


def changes(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: bins called before, bins whose code changed, their share in percent (0 where none was called), both scales and their difference."""
    called, changed = (F.sum(F.when(c, F.col("n_bins")).otherwise(0)) for c in (F.col("before") != NOT_CALLED, F.col("before") != F.col("after")))
    scale = {c: F.first(c).alias(c) for c in ("before_s", "after_s")}  # one a key
    rows = pieces.groupBy(*keys).agg(called.alias("bins_called"), changed.alias("bins_changed"), *scale.values())
    share = F.coalesce(ratio(100 * F.col("bins_changed"), F.col("bins_called")), F.lit(0.0))
    return rows.withColumns({"pct_changed": share, "s_change": F.col("after_s") - F.col("before_s")})


def cell_changes_summary(per_cell: DataFrame) -> DataFrame:
    """One row of `changes` by cell: cells, cells with a change, the median share, and the median, least and largest change of scale."""
    return per_cell.agg(
        F.count("*").alias("n_cells"), F.count_if(F.col("bins_changed") > 0).alias("n_changed_cells"), F.bround(F.percentile("pct_changed", F.lit(0.5)), 3).alias("median_pct"),
        F.percentile("s_change", F.lit(0.5)).alias("median_s_change"), F.min("s_change").alias("least_s_change"), F.max("s_change").alias("largest_s_change"),
    )


def transitions(pieces: DataFrame) -> DataFrame:
    """before, after, bins: how many bins went from one code to another."""
    return pieces.where("before <> after").groupBy("before", "after").agg(F.sum("n_bins").alias("bins"))


def source_changes(per_source: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """`changes` by source with its segments before and after, and how many merges lie between."""
    count = lambda labels, name: labels.select(*UNIT).distinct().groupBy("source").agg(F.count("*").alias(name))
    rows = per_source.join(count(before, "segments_before"), "source").join(count(after, "segments_after"), "source")
    return rows.withColumns({"merges": F.col("segments_before") - F.col("segments_after"), "pct_changed": F.bround("pct_changed", 3)})


def fit_status(values: DataFrame, segments: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, baseline, median, best_s, status: whether a scale can be fitted, and if not, for want of what.

    values: keys, x, times (a value that occurs so often is one row); segments: keys, chrom, seg, n, mean; fits:
    keys, best_s.  The baseline is the mean of the values from 0 to the upper fence, the median that of the
    segments' means by their bins.  undefined_baseline, undefined_median and undefined_scale are told apart.
    """
    fences = values.groupBy(*keys).agg(F.percentile("x", F.lit(0.25), F.col("times")).alias("q1"), F.percentile("x", F.lit(0.75), F.col("times")).alias("q3"))
    inside = values.join(fences, keys).where((F.col("x") >= 0) & (F.round(F.col("x") - F.col("q3") - 1.5 * (F.col("q3") - F.col("q1")), 9) <= 0))
    baseline = inside.groupBy(*keys).agg((F.sum(F.col("x") * F.col("times")) / F.sum("times")).alias("baseline"))
    rows = fences.select(*keys).join(baseline, keys, "left").join(weighted_medians(segments, keys), keys, "left").join(fits, keys, "left")
    wanting = lambda c: ~F.coalesce(F.col(c) > 0, F.lit(False))
    status = F.when(wanting("baseline"), "undefined_baseline").when(wanting("median"), "undefined_median").when(wanting("best_s"), "undefined_scale").otherwise("ok")
    return rows.select(*keys, "baseline", "median", "best_s", status.alias("status"))
