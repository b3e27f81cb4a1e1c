"""Ordered-sequence operators along a chromosome: rolling means, tracks, gaps, lags, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from binloom.functions.stats import guarded_corr, log2_ratio

from .ordering import running_total
from .segments import PLACE


def along() -> W:
    """Each chromosome's bins in order."""
    return W.partitionBy(*PLACE).orderBy("i")


def rolling_mean(x: str = "x", window: int = 25, least: int = 8) -> Column:
    """Centred mean, NULL where fewer than `least` values are in the window."""
    half = window // 2
    frame = along().rowsBetween(-half, half)
    return F.when(F.count(x).over(frame) >= least, F.avg(x).over(frame))


def smoothed(x: str = "x", window: int = 25) -> Column:
    """Centred mean with at least a third of the window; the value itself for windows of one."""
    return F.col(x) if window <= 1 else rolling_mean(x, window, max(1, window // 3))


def log2_track(x: Column, baseline: Column, clip: float = 4.0) -> tuple[Column, Column]:
    """log2 of x over the baseline, clipped, and its status: ok, zero, nan or undefined."""
    status = F.when(x.isNull(), "nan").when(~F.coalesce(baseline > 0, F.lit(False)), "undefined").when(x <= 0, "zero").otherwise("ok")
    value = F.greatest(F.lit(-clip), F.least(F.lit(clip), log2_ratio(x, baseline)))
    return F.when(status == "ok", value).when(status == "zero", -clip), status


def gap_flags(rows: DataFrame) -> DataFrame:
    """gap: the bin doesn't follow the one before; wide_gap: the step is over three times the chromosome's upper median step."""
    steps = rows.withColumn("step", F.col("start") - F.lag("start").over(along())).withColumn("gap", F.coalesce(F.col("start") > F.lag("end").over(along()) + 1, F.lit(False)))
    median = steps.where("step IS NOT NULL").groupBy(*PLACE).agg(upper_median("step").alias("median_step"))
    return steps.join(median, PLACE).withColumn("wide_gap", F.coalesce(F.col("step") > 3 * F.col("median_step"), F.lit(False)))


def upper_median(x: str) -> Column:
    """The value at position n // 2 of the sorted values, as an aggregate for groups of bins; ordering.upper_medians is for groups of cells."""
    n = F.count(x)
    return F.element_at(F.sort_array(F.collect_list(x)), (F.floor(n / 2) + 1).cast("int"))


def autocorrelation(rows: DataFrame, lags: int = 10, x: str = "x") -> DataFrame:
    """source, chrom, lag, r: the correlation of x with itself k bins before, for k = 1 .. lags; one pass, no self join."""
    order = W.partitionBy(*PLACE).orderBy("i")
    shifted = rows.select(*PLACE, "i", x, *[F.lag(x, k).over(order).alias(f"l{k}") for k in range(1, lags + 1)])
    wide = shifted.groupBy(*PLACE).agg(*[guarded_corr(x, f"l{k}").alias(f"r{k}") for k in range(1, lags + 1)])
    return wide.unpivot(PLACE, [f"r{k}" for k in range(1, lags + 1)], "lag", "r").withColumn("lag", F.substring("lag", 2, 3).cast("int"))


def local_maxima(rows: DataFrame, x: str = "x") -> DataFrame:
    """Bins whose x is at least the one before and above the next; an absent neighbour counts as lower."""
    before, after = F.lag(x).over(along()), F.lead(x).over(along())
    peak = F.coalesce(F.col(x) >= before, F.lit(True)) & F.coalesce(F.col(x) > after, F.lit(True))
    return rows.withColumn("peak", peak).where("peak").drop("peak")


def ranked(rows: DataFrame, by: str, tie: str, keys: list[str] | None = None, name: str = "rank") -> DataFrame:
    """1 for the largest; equal values in ascending order of `tie`."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*(keys or PLACE)).orderBy(F.desc(by), tie)))


def empirical_distribution(rows: DataFrame, keys: list[str], x: str, tie: str) -> DataFrame:
    """ecdf = (position + 1) / n of each row; equal values keep steps of their own."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    return running_total(rows, keys, [x, tie], name="_place").join(n, keys).withColumn("ecdf", (F.col("_place") + 1) / F.col("_n")).drop("_place", "_n")


def coalesced_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Unions of overlapping or touching half-open intervals (s, e)."""
    order = W.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("opens", F.when(F.col("s") <= reach, 0).otherwise(1)).withColumn("island", F.sum("opens").over(order))
    return rows.groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")
