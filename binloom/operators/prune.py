"""Pruning of boundaries by the stability of their effect under the bootstrap, and by repeated proposals.

A chromosome of one source is a row: its profile, the replicates' profiles and its boundaries as arrays,
whose size is set by the bins and the replicates, not by the cells.  What a run decides is a row per
boundary; segments, summaries and sensitivity tables follow from it by joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from binloom.functions.stats import signed_srd

from .kernels import spread
from .segments import PLACE, assign_proposal, flat_partition, with_flanks

DECISIONS = (
    "source string, chrom int, tau double, stab double, id int, bin long, left_bins long, right_bins long, candidate boolean, delta double, under double, n_valid int, "
    "guard double, eligible boolean, first_reason string, removed boolean, pass int, reason string"
)
#: Numbers of a tile of bins by replicates.
TILE = 1 << 20
PASSES = "source string, chrom int, pass int, bin long"


def replicate_profiles(signal: DataFrame, weights: DataFrame, replicates: int) -> DataFrame:
    """source, g, boot: each replicate's mean at every bin where the source has signal; boot[k] is replicate k + 1.

    signal: source, cell, g, x; weights: source, rep, cell, w, which add up to the source's cells in each replicate.
    A batch of cells is a sparse matrix whose product with their counts is taken a tile of bins at a time;
    tasks hand on one array for each bin of a tile, which Spark adds up, first within tasks.
    """
    vectors = signal.groupBy("source", "cell").agg(F.collect_list("g").alias("g"), F.collect_list("x").alias("x"))
    drawn = weights.groupBy("source", "cell").agg(F.collect_list("rep").alias("rep"), F.collect_list("w").alias("w"))
    n = weights.where("rep = 1").groupBy("source").agg(F.sum("w").alias("n_cells"))
    width = max(1, TILE // max(1, replicates))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = np.array(b.column("source").to_pylist())
            for source in np.unique(names):
                rows = b.filter(pa.array(names == source))
                counts = np.zeros((rows.num_rows, replicates))
                lengths = [rows.column(c).value_lengths().to_numpy() for c in ("rep", "g")]
                cells = [np.repeat(np.arange(rows.num_rows), k) for k in lengths]
                counts[cells[0], rows.column("rep").flatten().to_numpy() - 1] = rows.column("w").flatten().to_numpy()
                g, x = (rows.column(c).flatten().to_numpy() for c in ("g", "x"))
                order = np.argsort(g, kind="stable")
                g, x, cell = g[order], x[order], cells[1][order]
                bins, at = np.unique(g, return_inverse=True)
                for lo in range(0, len(bins), width):
                    part = slice(*np.searchsorted(at, [lo, lo + width]))
                    tile = np.zeros((min(width, len(bins) - lo), replicates))
                    for step in range(part.start, part.stop, width):
                        some = slice(step, min(step + width, part.stop))
                        first = np.flatnonzero(np.diff(at[some], prepend=-1))
                        tile[at[some][first] - lo] += np.add.reduceat(x[some, None] * counts[cell[some]], first, axis=0)
                    boot = pa.ListArray.from_arrays(np.arange(len(tile) + 1, dtype=np.int32) * replicates, tile.ravel())
                    yield pa.RecordBatch.from_arrays([pa.array([source] * len(tile)), pa.array(bins[lo : lo + width]), boot], ["source", "g", "boot"])

    sums = vectors.join(drawn, ["source", "cell"]).mapInArrow(added, "source string, g long, boot array<double>")
    total = sums.groupBy("source", "g").agg(*(F.sum(F.get("boot", F.lit(k))).alias(f"b{k}") for k in range(replicates)))
    return total.join(n, "source").select("source", "g", F.array(*(F.col(f"b{k}") / F.col("n_cells") for k in range(replicates))).alias("boot"))


class Boundaries:
    """One chromosome's live segments with their medians, observed and of each replicate."""

    def __init__(self, x: np.ndarray, boot: np.ndarray, cuts: list[int]):
        self.x, self.boot, self.known = x, boot, {}
        edges = [0, *sorted({b for b in cuts if 0 < b < len(x)}), len(x)]
        self.segments = [(a, b, k, k + 1) for k, (a, b) in enumerate(zip(edges, edges[1:]))]  # bins, then original segments, half-open
        with np.errstate(divide="ignore"):
            levels = np.log2([self.medians(a, b)[0] for a, b, *_ in self.segments])
        self.levels = np.where(np.isfinite(levels), levels, np.nan)

    def medians(self, a: int, b: int) -> tuple[float, np.ndarray]:
        if (a, b) not in self.known:
            self.known[a, b] = float(np.median(self.x[a:b])), np.median(self.boot[:, a:b], axis=1)
        return self.known[a, b]

    def terminal(self, i: int) -> bool:
        """Whether the boundary after segment i touches a chromosome's first or last segment."""
        return i == 0 or i + 2 >= len(self.segments)

    def lengths(self, i: int) -> tuple[int, int]:
        return tuple(b - a for a, b, *_ in self.segments[i : i + 2])

    def guard(self, i: int) -> float:
        """Range of the original segments' log2 medians that a merge would join; NaN if one is undefined."""
        levels = self.levels[self.segments[i][2] : self.segments[i + 1][3]]
        return float(levels.max() - levels.min())

    def effect(self, i: int, tau: float, stab: float) -> tuple[float, float, int, str]:
        """Observed log2 ratio of both medians, share of replicates below tau, valid replicates, and the reason against a merge, empty for none."""
        (left, lefts), (right, rights) = (self.medians(a, b) for a, b, *_ in self.segments[i : i + 2])
        if not (left > 0 and right > 0):
            return np.nan, np.nan, len(self.boot), "observed_median_zero"
        delta = float(np.log2(left / right))
        if not len(self.boot):
            return delta, np.nan, 0, "no_bootstrap_available"
        with np.errstate(divide="ignore", invalid="ignore"):
            again = np.log2(lefts / rights)
        valid = int(np.isfinite(again).sum())
        if valid < len(again):
            return delta, np.nan, valid, "invalid_replicates"
        under = float((np.abs(again) < tau).mean())
        return delta, under, valid, "effect_ge_tau" if abs(delta) >= tau else "stability_below_cutoff" if under < stab else ""

    def merge(self, i: int) -> None:
        (a, _, first, _), (_, b, _, last) = self.segments[i : i + 2]
        self.segments[i : i + 2] = [(a, b, first, last)]


def pruned(x: np.ndarray, boot: np.ndarray, cuts: list[int], tau: float, stab: float, small: int) -> list[tuple]:
    """DECISIONS from id on: each original boundary as it is scored at first, and what became of it.

    One boundary goes at a time: of those between inner segments of which one is small, whose effect is below tau,
    stable, and whose merge spans less than tau, the one of the smallest effect, the lower bin on ties.
    """
    live = Boundaries(x, boot, cuts)
    n = len(live.segments)
    first = []
    for i in range(n - 1):
        left, right = live.lengths(i)
        delta, under, valid, reason = live.effect(i, tau, stab)
        candidate = not live.terminal(i) and min(left, right) <= small
        if not candidate:
            reason = "terminal_unchanged" if live.terminal(i) else "long_long_not_candidate"
        first.append((i, live.segments[i][1], left, right, candidate, delta, under, valid, live.guard(i), candidate and not reason, reason or "eligible"))
    removed, failed, step = {}, {}, 0
    while len(live.segments) > 2:
        open_ = []
        for i in range(len(live.segments) - 1):
            if live.terminal(i) or min(live.lengths(i)) > small:
                continue
            delta, _, _, reason = live.effect(i, tau, stab)
            if not reason and not live.guard(i) < tau:
                reason = "chain_guard"
            if reason:
                failed[live.segments[i][3] - 1] = reason
            else:
                open_.append((round(abs(delta), 10), live.segments[i][1], i))
        if not open_:
            break
        step, i = step + 1, min(open_)[2]
        removed[live.segments[i][3] - 1] = step
        live.merge(i)
    last = {}
    for i in range(len(live.segments) - 1):
        id_ = live.segments[i][3] - 1
        last[id_] = "terminal_unchanged" if live.terminal(i) else failed.get(id_) or ("long_long_not_candidate" if min(live.lengths(i)) > small else "never_candidate")
    return [(*row, row[0] in removed, removed.get(row[0]), f"removed_iter{removed[row[0]]:02d}" if row[0] in removed else last[row[0]]) for row in first]


def prune(profile: DataFrame, boots: DataFrame, boundaries: DataFrame, taus: tuple[float, ...] = (0.2,), stabs: tuple[float, ...] = (0.95,), small: int = 100) -> DataFrame:
    """DECISIONS for each original boundary and pair of tau and stab, all on the same replicates.

    profile: source, chrom, g, i, x; boots: source, g, boot, absent bins are 0 in each replicate.
    """
    size = boots.select(F.max(F.size("boot"))).first()[0] or 0
    bins = profile.join(boots, ["source", "g"], "left").select(*PLACE, F.struct("i", "x", F.coalesce("boot", F.array_repeat(F.lit(0.0), size)).alias("boot")).alias("bin"))
    rows = bins.groupBy(*PLACE).agg(F.sort_array(F.collect_list("bin")).alias("bins"))
    rows = rows.select(*PLACE, F.col("bins.x").alias("x"), F.flatten("bins.boot").alias("boot"))
    rows = rows.join(boundaries.groupBy(*PLACE).agg(F.collect_list("bin").alias("cuts")), PLACE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in DECISIONS.split(", ")]
        for rows in batches:
            out = []
            for source, chrom, x, boot, cuts in zip(*(rows[c] for c in (*PLACE, "x", "boot", "cuts"))):
                boot = np.asarray(boot).reshape(len(x), -1).T
                out += [(source, chrom, tau, stab, *r) for tau in taus for stab in stabs for r in pruned(np.asarray(x), boot, [int(b) for b in cuts], tau, stab, small)]
            yield pd.DataFrame(out, columns=names).astype({"pass": "Int64"})

    return spread(rows, PLACE).mapInPandas(run, DECISIONS)


def sensitivity(decisions: DataFrame) -> DataFrame:
    """Per source, chromosome, tau and stab: boundaries, those merged and retained, and the segments left."""
    return decisions.groupBy(*PLACE, "tau", "stab").agg(
        F.count("*").alias("n_boundaries"), F.count_if("removed").alias("n_merged"), F.count_if(~F.col("removed")).alias("n_retained"), (F.count_if(~F.col("removed")) + 1).alias("n_segments"),
    )


def merged_by_cutoffs(decisions: DataFrame, stabs: tuple[float, ...]) -> DataFrame:
    """tau by stab: how many boundaries of all went."""
    return sensitivity(decisions).groupBy("tau").pivot("stab", [*stabs]).agg(F.sum("n_merged"))


def review_summary(decisions: DataFrame) -> DataFrame:
    """Per source and chromosome, for one tau and stab: segments, boundaries, those nominated, eligible and merged, and the nominated ones' effects."""
    effect = F.when(F.col("candidate"), F.abs("delta"))
    return decisions.groupBy(*PLACE).agg(
        (F.count("*") + 1).alias("n_segments"), F.count("*").alias("n_boundaries"), F.count_if("candidate").alias("n_nominated"), F.count_if("eligible").alias("n_eligible"), F.count_if("removed").alias("n_merged"),
        F.min(effect).alias("least_delta"), F.percentile(effect, F.lit(0.5)).alias("median_delta"), F.max(F.when(F.col("candidate"), F.col("under"))).alias("largest_under"),
    )


def simplified_segments(decisions: DataFrame, sizes: DataFrame, summaries: DataFrame) -> DataFrame:
    """The segments that the retained boundaries of one tau and stab leave: bounds, original segments, whether merged, and the range of their log2 medians (NULL if one is undefined)."""
    kept = flat_partition(decisions.where("NOT removed").select(*PLACE, "bin"), sizes)
    level = F.when(F.col("median") > 0, F.log2("median"))
    parts = summaries.select(*PLACE, "s", F.col("seg").alias("original"), level.alias("level"))
    marks = kept.select(*PLACE, "s", "seg", F.col("e").alias("bin_end"), F.col("s").alias("bin_start"))
    seen = W.partitionBy(*PLACE).orderBy("s").rowsBetween(W.unboundedPreceding, 0)
    rows = parts.join(marks, [*PLACE, "s"], "left").withColumns({c: F.last(c, ignorenulls=True).over(seen) for c in ("seg", "bin_start", "bin_end")})
    span = F.when(F.count("*") == F.count("level"), F.max("level") - F.min("level"))
    return rows.groupBy(*PLACE, "seg", "bin_start", "bin_end").agg(F.count("*").alias("n_original"), F.min("original").alias("first_original"), (F.count("*") > 1).alias("merged"), span.alias("range"))


def unresolved_segments(decisions: DataFrame, summaries: DataFrame, small: int = 100) -> DataFrame:
    """The small inner original segments with what became of both their boundaries, for one tau and stab."""
    ends = decisions.select(*PLACE, "bin", "removed", "reason")
    left = ends.select(*PLACE, F.col("bin").alias("s"), F.col("removed").alias("merged_left"), F.col("reason").alias("reason_left"))
    right = ends.select(*PLACE, F.col("bin").alias("e"), F.col("removed").alias("merged_right"), F.col("reason").alias("reason_right"))
    rows = summaries.where(F.col("e") - F.col("s") <= small).select(*PLACE, "seg", "s", "e", "median").join(left, [*PLACE, "s"]).join(right, [*PLACE, "e"])
    return rows.withColumn("standalone", ~F.col("merged_left") & ~F.col("merged_right"))


def small_candidates(summaries: DataFrame, small: int = 100, srd_least: float = 3.3, effect_least: float = 0.2) -> DataFrame:
    """Small inner segments with rounded srd and log2 ratio of rates to both sides, strong sides, proposal, the boundary it would remove, and whether another proposes the same.

    Rates get 1e-12 added here, and only here, so that ratios to zero are finite.
    """
    rows = with_flanks(summaries.select(*PLACE, "seg", "s", "e", "sum", "n"), ["sum", "n"]).where(F.col("sum_left").isNotNull() & F.col("sum_right").isNotNull() & (F.col("n") <= small))
    out: dict[str, Column] = {}
    for side in ("left", "right"):
        out[f"srd_{side}"] = F.round(signed_srd(F.col("sum"), F.col("n"), F.col(f"sum_{side}"), F.col(f"n_{side}")), 4)
        out[f"log2fc_{side}"] = F.round(F.log2((F.col("sum") / F.col("n") + 1e-12) / (F.col(f"sum_{side}") / F.col(f"n_{side}") + 1e-12)), 4)
    rows = rows.withColumns(out)
    strong = {f"strong_{side}": (F.abs(f"srd_{side}") >= srd_least) & (F.abs(f"log2fc_{side}") >= effect_least) for side in ("left", "right")}
    proposal = assign_proposal(*[(F.col(f"{m}_left"), F.col(f"{m}_right")) for m in ("srd", "log2fc")], srd_least, effect_least)
    rows = rows.withColumns(strong).withColumn("proposal", proposal)
    rows = rows.withColumn("proposed", F.when(F.col("proposal") == "merge_left", F.col("s")).when(F.col("proposal") == "merge_right", F.col("e")))
    twice = F.count("proposed").over(W.partitionBy(*PLACE, "proposed")) > 1
    return rows.withColumn("conflict", F.col("proposed").isNotNull() & twice)


def srd(y: float, n: int, other: float, m: int) -> float:
    """The signed root deviance of two totals over n and m bins; 0 if both are 0."""
    if y + other == 0:
        return 0.0
    rate = (y + other) / (n + m)
    deviance = 2 * sum(t * np.log(t / (k * rate)) for t, k in ((y, n), (other, m)) if t > 0)
    return float(np.sign(y / n - other / m) * np.sqrt(max(deviance, 0.0)))


def converge(profile: DataFrame, boundaries: DataFrame, small: int = 100, srd_least: float = 3.3, effect_least: float = 0.2, most: int = 100) -> DataFrame:
    """PASSES: the boundaries that go in each pass.  All that a pass proposes go at once, then scores are computed anew, until nothing is proposed.

    A segment that stands out on both sides stays; one between unlike sides goes to that of the smaller srd.
    """
    cuts = boundaries.groupBy(*PLACE).agg(F.collect_list("bin").alias("cuts"))
    rows = profile.groupBy(*PLACE).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("bins")).join(cuts, PLACE).select(*PLACE, F.col("bins.x").alias("x"), "cuts")

    def passes(x: np.ndarray, cuts: list[int]) -> Iterator[tuple[int, int]]:
        total = np.concatenate([[0.0], np.cumsum(x)])
        edges = [0, *sorted({b for b in cuts if 0 < b < len(x)}), len(x)]
        for number in range(most):
            gone = set()
            for (a, b), (s, e), (c, d) in zip(zip(edges, edges[1:]), zip(edges[1:], edges[2:]), zip(edges[2:], edges[3:])):
                if e - s > small:
                    continue
                own, n = total[e] - total[s], e - s
                sides = [(total[q] - total[p], q - p) for p, q in ((a, b), (c, d))]
                r = [round(srd(own, n, y, m), 4) for y, m in sides]
                fold = [round(float(np.log2((own / n + 1e-12) / (y / m + 1e-12))), 4) for y, m in sides]
                strong = [abs(p) >= srd_least and abs(q) >= effect_least for p, q in zip(r, fold)]
                if all(strong):
                    if np.sign(r[0]) != np.sign(r[1]) or not r[0]:
                        gone.add(s if abs(r[0]) <= abs(r[1]) else e)
                elif any(strong):
                    gone.add(e if strong[0] else s)
                else:
                    gone.add(s if abs(fold[0]) <= abs(fold[1]) else e)
            if not gone:
                return
            yield from ((number, b) for b in sorted(gone))
            edges = [b for b in edges if b not in gone]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(source, chrom, *r) for source, chrom, x, cuts in zip(*(rows[c] for c in (*PLACE, "x", "cuts"))) for r in passes(np.asarray(x), [int(b) for b in cuts])]
            yield pd.DataFrame(out, columns=["source", "chrom", "pass", "bin"])

    return spread(rows, PLACE).mapInPandas(run, PASSES)
