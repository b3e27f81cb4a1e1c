"""Discrete states: encoding, changes between two calls, and how noisy a call is."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from binloom.functions.stats import inside_fences

NOT_CALLED = 255


def state_by_ratio(ratio: Column, cuts: tuple[float, ...] = (0.6, 0.85, 1.15, 1.4)) -> Column:
    """States 0, 0.5, 1, 1.5, 2 by where the ratio to the baseline falls among the cuts; NULL stays NULL."""
    out = F.lit(0.0)
    for c in cuts:
        out = out + F.when(ratio >= c, 0.5).otherwise(0.0)
    return F.when(ratio.isNotNull(), out)


def encode_states(state: Column) -> Column:
    """Twice the state as a small integer; NOT_CALLED for undefined ones."""
    return F.coalesce(F.rint(state * 2).cast("int"), F.lit(NOT_CALLED))


#: Drawn where a call is as before.
UNCHANGED = 254


def pixel_code(after: Column, before: Column) -> Column:
    """after's code, or UNCHANGED for a call that is as before."""
    return F.when((after == before) & (after != NOT_CALLED), UNCHANGED).otherwise(after)


def state_label(code: Column) -> Column:
    """A code in words."""
    name = F.when(code < 2, "loss").when(code == 2, "base").otherwise("gain")
    return F.when(code == NOT_CALLED, "not called").otherwise(F.concat(F.format_number(code / 2, 1), F.lit(" ("), name, F.lit(")")))


def noise_by_round(rounds: list[DataFrame], measures: list[str]) -> DataFrame:
    """source, measure and a column for each round's value; tables by source."""
    out = None
    for k, df in enumerate(rounds):
        long = df.select("source", *[F.col(m).cast("double") for m in measures]).unpivot("source", measures, "measure", f"round{k}")
        out = long if out is None else out.join(long, ["source", "measure"], "full")
    return out


def five_states(whole: Column, continuous: Column) -> Column:
    """The five-state call from a rounded and a continuous copy number; -1 where the two contradict each other, NULL without them."""
    rounded = F.greatest(F.lit(1), F.least(F.lit(3), whole)) - 1
    banded = F.when(continuous <= 1, 0).when(continuous >= 3, 2).otherwise(1)
    state = F.when(rounded == banded, rounded.cast("double")).when((rounded == 0) & (banded == 1), 0.5).when((rounded == 2) & (banded == 1), 1.5).otherwise(-1.0)
    return F.when(whole.isNotNull() & continuous.isNotNull(), state)


def transitions(before: Column, after: Column, rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many bins went from one code to another, most frequent first by the sort key (-n, before, after)."""
    pairs = rows.select(*keys, before.alias("before"), after.alias("after")).where("before <> after")
    return pairs.groupBy(*keys, "before", "after").agg(F.count("*").alias("n"))


def changed_share(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n_called, n_changed and pct_changed of rows with codes `before` and `after`; bins not called in either aren't counted."""
    called = (F.col("before") != NOT_CALLED) & (F.col("after") != NOT_CALLED)
    changed = F.count_if(called & (F.col("before") != F.col("after")))
    return rows.groupBy(*keys).agg(F.count_if(called).alias("n_called"), changed.alias("n_changed"), F.when(F.count_if(called) > 0, F.bround(100.0 * changed / F.count_if(called), 3)).alias("pct_changed"))


def sequence_noise(segments: DataFrame, keys: list[str], order: str = "seg", state: str = "state") -> DataFrame:
    """Per key: called segments, zig-zags (a state unlike both neighbours, which agree), their median length, and boundaries between gain and loss."""
    w = W.partitionBy(*keys).orderBy(order)
    rows = segments.where(F.col(state).isNotNull()).withColumns({"p": F.lag(state).over(w), "q": F.lead(state).over(w)})
    zigzag = (F.col("p") == F.col("q")) & (F.col(state) != F.col("p"))
    opposed = ((F.col(state) > 1) & (F.col("q") < 1)) | ((F.col(state) < 1) & (F.col("q") > 1))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_called"), F.count_if(zigzag).alias("n_zigzag"), F.percentile(F.when(zigzag, F.col("e") - F.col("s")), F.lit(0.5)).alias("zigzag_length"), F.count_if(opposed).alias("n_opposed"))


def segment_estimates(rows: DataFrame, keys: list[str], method: str = "arithmetic") -> DataFrame:
    """Per key: estimate and retained count of x; method arithmetic, iqr_upper or iqr_two_sided."""
    if method == "arithmetic":
        return rows.groupBy(*keys).agg(F.avg("x").alias("estimate"), F.count("*").alias("retained"))
    q = rows.groupBy(*keys).agg(F.percentile("x", F.lit(0.25)).alias("q1"), F.percentile("x", F.lit(0.75)).alias("q3"))
    return rows.join(q, keys).where(inside_fences("x", lower=method == "iqr_two_sided")).groupBy(*keys).agg(F.avg("x").alias("estimate"), F.count("*").alias("retained"))


#: The scales that are looked at, as parts of the bin-weighted median, and digits of the misfit that count.
SCALES, DIGITS = (0.35, 0.75), 7


def best_scale(means: np.ndarray, lengths: np.ndarray, median: float) -> float:
    """The scale near half the bin-weighted median that leaves the weighted copy numbers nearest to whole numbers; the smallest of equal ones.

    Exact: as the scale falls, a rounded copy number rises by one at known points; between them the misfit
    is a parabola in the scale's inverse u, A u^2 - 2 B u + C, whose sums are carried from point to point.
    """
    lo, hi = 1 / (SCALES[1] * median), 1 / (SCALES[0] * median)
    first, end = np.floor(means * lo - 0.5).astype(int) + 1, np.ceil(means * hi - 0.5).astype(int)
    jumps = np.maximum(end - first, 0)
    at = np.repeat(np.arange(len(means)), jumps)
    h = np.concatenate([np.arange(x, x + k) for x, k in zip(first, jumps)]) if len(at) else np.zeros(0)
    u = (h + 0.5) / means[at] if len(at) else np.zeros(0)
    order = np.argsort(u, kind="stable")
    c = np.rint(means * lo)
    a = (lengths * means**2).sum()
    b = (lengths * means * c).sum() + np.append(0, np.cumsum((lengths[at] * means[at])[order]))
    d = (lengths * c**2).sum() + np.append(0, np.cumsum((lengths[at] * (2 * h + 1))[order]))
    u = np.concatenate([[lo], u[order], [hi]])
    best = np.clip(b / a, u[:-1], u[1:])
    misfit = np.round(a * best**2 - 2 * b * best + d, DIGITS)
    return float(1 / best[np.flatnonzero(misfit == misfit.min())].max())


def weighted_medians(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, median: the segments' means' median by their bins, the least mean that half of the bins don't exceed."""
    unit = W.partitionBy(*keys)
    ranked = segments.withColumns({"c": F.sum("n").over(unit.orderBy("mean", "chrom", "seg")), "t": F.sum("n").over(unit)})
    return ranked.where("c >= t / 2").groupBy(*keys).agg(F.min("mean").alias("median"))


def scales(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, best_s of segments (keys, chrom, seg, n, mean): best_scale's sweep as windows over the points at which a copy number rises, some a segment.

    All of it goes by the keys, so the segments are dealt out once.
    """
    unit, n, mean = W.partitionBy(*keys), F.col("n").cast("double"), F.col("mean")
    rows = segments.withColumns({"c": F.sum("n").over(unit.orderBy("mean", "chrom", "seg")), "t": F.sum("n").over(unit)})
    rows = rows.withColumns({"median": F.min(F.when(F.col("c") >= F.col("t") / 2, mean)).over(unit), "a": F.sum(n * mean * mean).over(unit)}).where("median > 0")
    rows = rows.withColumns({"lo": 1 / (SCALES[1] * F.col("median")), "hi": 1 / (SCALES[0] * F.col("median"))})
    c, first, last = F.rint(mean * F.col("lo")), F.floor(mean * F.col("lo") - 0.5) + 1, F.ceil(mean * F.col("hi") - 0.5) - 1

    def point(u: Column, b: Column, d: Column) -> Column:
        return F.struct(u.alias("u"), b.alias("b"), d.alias("d"))

    risen = F.when(last >= first, F.transform(F.sequence(first, last), lambda h: point((h + 0.5) / mean, n * mean, n * (2 * h + 1))))
    points = F.concat(F.array(point(F.col("lo"), n * mean * c, n * c * c)), F.coalesce(risen, F.array().cast("array<struct<u:double,b:double,d:double>>")))
    rows = rows.select(*keys, "a", "hi", F.explode(points).alias("p")).select(*keys, "a", "hi", "p.*")
    # points at one place count together, as all segments start at one
    order = unit.orderBy("u")
    so_far = order.rangeBetween(W.unboundedPreceding, W.currentRow)
    sums = rows.select(*keys, "a", "hi", "u", F.lead("u").over(order).alias("next"), F.sum("b").over(so_far).alias("b"), F.sum("d").over(so_far).alias("d"))
    best = F.least(F.greatest(F.col("b") / F.col("a"), F.col("u")), F.coalesce("next", "hi"))
    found = sums.withColumn("best", best).withColumn("misfit", F.round(F.col("a") * F.col("best") * F.col("best") - 2 * F.col("b") * F.col("best") + F.col("d"), DIGITS))
    return found.groupBy(*keys).agg((-1 / F.min(F.struct("misfit", (-F.col("best")).alias("less")))["less"]).alias("best_s"))


def copy_numbers(segments: DataFrame, keys: list[str]) -> DataFrame:
    """segments (keys, seg, n, mean) with status, best_s, continuous, whole and the five-state call, one scale per key.

    The keys' baseline is its bin-weighted median of means; without a positive one nothing is called.
    """
    found = segments.join(scales(segments, keys), keys, "left").withColumn("continuous", F.col("mean") / F.col("best_s"))
    found = found.withColumns({"status": F.when(F.col("best_s").isNull(), "undefined").otherwise("ok"), "whole": F.rint("continuous").cast("long")})
    return found.withColumn("state", five_states(F.col("whole"), F.col("continuous")))
