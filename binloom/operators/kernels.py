"""Anderson-Darling splits and greedy merging, each a grouped Arrow function per (source, chromosome); greedy peaks and matching, in rounds of windows.

A chromosome has some hundreds to thousands of bins, so a group is small whatever the number of cells.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from binloom.functions.shared import written
from binloom.plans.rules import RuleSet, evaluate

from .segments import PLACE, flank_scores, labelled


#: Numbers in a block of ad_statistics.
CELLS = 1 << 18


def ad_statistics(x: np.ndarray) -> np.ndarray:
    """The two-sample Anderson-Darling statistic, midrank form for ties, of each split of x; entry b - 1 is the cut before b."""
    n = len(x)
    if n < 2:
        return np.zeros(0)
    values, where = np.unique(x, return_inverse=True)
    l = np.bincount(where).astype(float)
    if len(values) < 2:
        return np.zeros(n - 1)
    below = np.cumsum(l) - l / 2
    weight = l / n / (below * (n - below) - n * l / 4)
    out, counts = np.zeros(n - 1), np.zeros(len(values))
    step = max(1, CELLS // len(values))
    for lo in range(0, n - 1, step):  # cuts by the block: a row of counts for each
        cuts = np.arange(lo + 1, min(lo + step, n - 1) + 1)
        left = np.zeros((len(cuts), len(values)))
        left[np.arange(len(cuts)), where[lo : lo + len(cuts)]] = 1
        left = np.cumsum(left, 0) + counts
        counts = left[-1].copy()
        mid = np.cumsum(left, 1) - left / 2
        out[lo : lo + len(cuts)] = ((n * mid - cuts[:, None] * below) ** 2 @ weight) * (1 / cuts + 1 / (n - cuts)) * (n - 1) / n
    return out


def ad_curves(profile: DataFrame) -> DataFrame:
    """source, chrom, cut, ad for each split of each chromosome."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        ad = ad_statistics(rows["x"].to_numpy())
        return pd.DataFrame({"source": rows["source"].iloc[0], "chrom": rows["chrom"].iloc[0], "cut": np.arange(1, len(rows)), "ad": ad})

    return profile.select(*PLACE, "i", "x").groupBy(*PLACE).applyInPandas(run, "source string, chrom int, cut long, ad double")


def draws(seed: int, name: str, n: int) -> np.random.Generator:
    """A generator that depends on the seed and a name alone, so a retried task draws alike."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{name}:{n}".encode()).digest()[:8]))


def permutation_p(left: np.ndarray, right: np.ndarray, observed: float, n: int, rng: np.random.Generator, pool: np.ndarray | None = None) -> float:
    """(1 + permutations that reach the observed statistic) / (n + 1); with a pool, samples of both sizes drawn from it instead."""
    both = np.unique(np.concatenate([left, right]) if pool is None else pool, return_inverse=True)[1]  # ranks do as well as values
    size, cut, reached = len(left) + len(right), len(left), 0
    for _ in range(n):
        x = rng.permutation(both) if pool is None else both[rng.choice(len(both), size, replace=False)]
        l = np.bincount(x)
        values = np.flatnonzero(l)
        if len(values) < 2:
            reached += observed <= 0
            continue
        l = l[values].astype(float)
        below = np.cumsum(l) - l / 2
        f = np.bincount(x[:cut], minlength=values[-1] + 1)[values]
        mid = np.cumsum(f) - f / 2
        ad = (l / size * (size * mid - cut * below) ** 2 / (below * (size - below) - size * l / 4)).sum() * (1 / cut + 1 / (size - cut)) * (size - 1) / size
        reached += ad >= observed
    return (1 + reached) / (n + 1)


def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows dealt by keys to a fixed number of tasks: groups of few bytes but much work would else be put in one."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def split_tests(profile: DataFrame, cuts: DataFrame, permutations: int = 1000, seed: int = 42) -> DataFrame:
    """Both permutation tests of given cuts (source, chrom, cut) of whole chromosomes: source, chrom, cut, ad, p_local, p_global.

    The global test samples from the profile of all of the source's chromosomes.
    """
    from .scan import chromosomes, node_name, pools, tested

    track = profile.withColumn("kept", F.lit(True))
    chroms, values = written(chromosomes(track)), written(pools(track, "genome")[0])
    nodes = cuts.join(chroms.select(*PLACE, F.size("x").cast("long").alias("end")), PLACE).join(ad_curves(profile), [*PLACE, "cut"])
    named = nodes.withColumns({"start": F.lit(0).cast("long"), "name": F.concat(node_name(seed, "cut", "end"), F.lit(":given"))})
    found = tested(written(named), chroms, values, ["source"], permutations, 2.0, "start", "end")
    return found.select(*PLACE, "cut", "ad", "p_local", "p_global")


def geometry_reasons(start: int, end: int, cut: int, n: int, min_child: int, min_terminal: int) -> list[str]:
    """Why a cut of [start, end) isn't allowed: children must be long enough, those at a chromosome's end longer."""
    out = []
    for name, size, terminal in (("left", cut - start, start == 0), ("right", end - cut, end == n)):
        if size < min_child:
            out.append(f"{name}_child_too_short")
        if terminal and size < min_terminal:
            out.append(f"{name}_terminal_too_short")
    return out


def recursive_breakpoints(profile: DataFrame, k: int = 6, permutations: int = 1000, alpha: float = 0.001, min_child: int = 20, min_terminal: int = 50, seed: int = 42, pool: str = "chromosome") -> DataFrame:
    """Recursive segmentation: source, chrom, depth, start, end, bin, ad, p_local, p_global, accepted, reason; one row per candidate tested, or node without a valid one.

    In each node the split with the largest statistic and valid geometry is tested, by permutation in
    the node first, then against samples of the pool (chromosome or genome); a failed test ends the node.
    """
    from .scan import Settings, candidates

    found = candidates(profile.withColumn("kept", F.lit(True)), pool, Settings(k, permutations, alpha, min_child, min_terminal, seed))
    reason = F.when(~F.col("tested"), F.col("reasons")).when(F.col("accepted"), "").when(F.col("p_global").isNull(), "p_local").otherwise("p_global")
    rows = found.where("tested OR rank IS NULL")
    return rows.select(*PLACE, "depth", F.col("node_start").alias("start"), F.col("node_end").alias("end"), "bin", "ad", "p_local", "p_global", "accepted", reason.alias("reason"))


def merge_step(profile: DataFrame, boundaries: DataFrame, rules: RuleSet) -> DataFrame:
    """The next merge of each (source, chromosome): the claim of the lowest phase, rule, score (to nine digits) and start that nothing blocks.

    Scores and dispersion are computed anew from the boundaries given.
    """
    claims = evaluate(flank_scores(labelled(profile, boundaries)), rules)
    # chosen inside the aggregate: a filter would be pushed through every rule's columns and repeat them all
    free = F.col("claimed_by").isNotNull() & F.col("blocked").isNull()
    first = F.min(F.when(free, F.struct("phase", "rule_order", F.round("score", 9).alias("order"), "s", "e", "side", "claimed_by", "score"))).alias("c")
    removed = F.when(F.col("c.side") == "left", F.col("c.s")).otherwise(F.col("c.e")).alias("removed")
    return claims.groupBy(*PLACE).agg(first).where("c IS NOT NULL").select(*PLACE, "c.*", removed).drop("order")


class Segments:
    """A chromosome's live partition: a merge computes one segment and the pairs on both its sides anew, nothing else."""

    def __init__(self, x: np.ndarray, start: np.ndarray, end: np.ndarray, boundaries: list[int]):
        self.x, self.start, self.end = x, start, end
        cuts = [0, *sorted({b for b in boundaries if 0 < b < len(x)}), len(x)]
        self.segments = list(zip(cuts, cuts[1:]))
        self.summaries = [self.summary(a, b) for a, b in self.segments]
        self.pairs = [self.pair(k) for k in range(len(self.segments) - 1)]

    def summary(self, a: int, b: int) -> dict[str, float]:
        v = self.x[a:b]
        q1, median, q3 = np.percentile(v, [25, 50, 75]).tolist()
        reach = 1.5 * (q3 - q1)
        kept = v[(np.round(v - q1 + reach, 9) >= 0) & (np.round(v - q3 - reach, 9) <= 0)]
        mean = float(v.mean())
        return {"n": len(v), "sum": float(v.sum()), "mean": mean, "median": median, "iqr_mean": float(kept.mean()), "pearson": float(((v - mean) ** 2).sum()) / mean if mean > 0 and len(v) > 1 else None}

    def pair(self, k: int) -> dict[str, float]:
        """The scores of segment k + 1 against segment k, and whether a gap lies between; the other way round they change their sign."""
        o, s = self.summaries[k : k + 2]
        rate = (s["sum"] + o["sum"]) / (s["n"] + o["n"])
        part = sum(y * math.log(y / (n * rate)) for y, n in ((s["sum"], s["n"]), (o["sum"], o["n"])) if y > 0)
        srd = math.copysign(math.sqrt(max(2 * part, 0.0)), s["mean"] - o["mean"]) if s["mean"] != o["mean"] else 0.0
        deltas = {f"delta_{level}": math.log2(s[level] / o[level]) if s[level] > 0 and o[level] > 0 else math.nan for level in ("mean", "median", "iqr_mean")}
        return {"srd": srd, **deltas, "gap": bool(self.start[self.segments[k + 1][0]] > self.end[self.segments[k][1] - 1] + 1)}

    def scores(self) -> list[dict]:
        """The flank scores of internal segments, as flank_scores gives them."""
        used = [s for s in self.summaries if s["pearson"] is not None]
        freedom = sum(s["n"] - 1 for s in used)
        phi = sum(s["pearson"] for s in used) / freedom if freedom else 0.0
        root, out = math.sqrt(phi) if phi > 0 else math.nan, []
        for (s, e), left, right in zip(self.segments[1:], self.pairs, self.pairs[1:]):
            row = {"s": s, "e": e, "gap_left": left["gap"], "gap_right": right["gap"], "srd_phi_left": left["srd"] / root, "srd_phi_right": -right["srd"] / root}
            for name in ("srd", "delta_mean", "delta_median", "delta_iqr_mean"):
                row[f"{name}_left"], row[f"{name}_right"] = left[name], -right[name]
            out.append(row)
        return out

    def merge(self, s: int, e: int, side: str) -> int:
        k = self.segments.index((s, e)) - (side == "left")
        (a, removed), (_, b) = self.segments[k : k + 2]
        self.segments[k : k + 2] = [(a, b)]
        self.summaries[k : k + 2] = [self.summary(a, b)]
        del self.pairs[k]
        for near in (k - 1, k):
            if 0 <= near < len(self.pairs):
                self.pairs[near] = self.pair(near)
        return removed


STEPS = "source string, chrom int, step int, removed long, s long, e long, claimed_by string, phase int, side string, score double"


def greedy_merge(profile: DataFrame, boundaries: DataFrame, rules: RuleSet, max_steps: int = 10_000) -> DataFrame:
    """The merges of each (source, chromosome) in order: one a step, after which all scores and the dispersion are computed anew.

    A step takes the claim of the lowest phase, rule, score and start; blocked ones are passed over, never redirected.
    """
    cuts = boundaries.groupBy(*PLACE).agg(F.collect_list("bin").alias("cuts"))
    rows = profile.select(*PLACE, "i", "start", "end", "x").join(cuts, PLACE)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        live = Segments(*(rows[c].to_numpy() for c in ("x", "start", "end")), [int(b) for b in rows["cuts"].iloc[0]])
        out = []
        while len(live.segments) > 2:
            claims = [c for c in map(rules.claim, live.scores()) if c and c["blocked"] is None]
            if not claims:
                break
            c = min(claims, key=lambda c: (c["phase"], c["rule_order"], round(c["score"], 9), c["s"]))
            if len(out) == max_steps:
                raise RuntimeError("merging did not end within max_steps")
            out.append((rows["source"].iloc[0], rows["chrom"].iloc[0], len(out) + 1, live.merge(c["s"], c["e"], c["side"]), c["s"], c["e"], c["claimed_by"], c["phase"], c["side"], c["score"]))
        return pd.DataFrame(out, columns=[f.split()[0] for f in STEPS.split(", ")])

    return rows.groupBy(*PLACE).applyInPandas(run, STEPS)


def merged_boundaries(profile: DataFrame, boundaries: DataFrame, rules: RuleSet) -> DataFrame:
    """The boundaries that greedy merging leaves."""
    gone = greedy_merge(profile, boundaries, rules).select(*PLACE, F.col("removed").alias("bin"))
    return boundaries.join(gone, [*PLACE, "bin"], "left_anti")


def greedy_peaks(curves: DataFrame, value: str = "ad", at: str = "cut", apart: int = 60, most: int = 5) -> DataFrame:
    """The highest local maxima of each curve that lie at least `apart` bins from higher ones: source, chrom, rank, position, value.

    In each round all peaks that are the highest within reach are taken and their rivals go, which comes to
    the same as taking one after the other from the highest down; of equal ones the lower place is first.
    Values count to nine digits.
    """
    place, height = W.partitionBy(*PLACE).orderBy("position"), F.struct("value", (-F.col("position")).alias("p"))
    before, after = (f(F.col("value")).over(place) for f in (F.lag, F.lead))
    rows = curves.select(*PLACE, F.col(at).cast("long").alias("position"), F.round(value, 9).alias("value"))
    tops = rows.withColumns({"before": before, "after": after}).where("(before IS NULL OR value >= before) AND (after IS NULL OR value > after)")
    left, taken = written(tops.select(*PLACE, "position", "value")), None
    reach = place.rangeBetween(-(apart - 1), apart - 1)
    while not left.isEmpty():
        marked = written(left.withColumn("first", F.max(height).over(reach) == height))
        won = marked.where("first").select(*PLACE, "position", "value")
        taken = won if taken is None else taken.union(won)
        left = written(marked.withColumn("lost", F.max("first").over(reach)).where("NOT lost").select(*PLACE, "position", "value"))
    taken = left if taken is None else taken
    rank = F.row_number().over(W.partitionBy(*PLACE).orderBy(F.desc("value"), "position"))
    return taken.withColumn("rank", rank).where(F.col("rank") <= most).select(*PLACE, "rank", "position", "value")


def match_one_to_one(a: DataFrame, b: DataFrame, tolerance: int) -> DataFrame:
    """Pairs of breakpoints (source, chrom, bin) of two sets within the tolerance, nearest first, each breakpoint once: source, chrom, a_bin, b_bin, distance.

    Candidates come from joining tiles of the tolerance's width on keys, not from comparing all pairs.  A
    pair that is first among all pairs of both its ends is taken, all such pairs in one round; their ends'
    other pairs go.  That comes to the same as taking the nearest pair again and again.
    """
    width = tolerance + 1
    tile = F.floor(F.col("bin") / width)
    left = a.select(*PLACE, F.col("bin").alias("a_bin"), tile.alias("tile"))
    right = b.select(*PLACE, F.col("bin").alias("b_bin"), F.explode(F.array(tile - 1, tile, tile + 1)).alias("tile"))
    near = left.join(right, [*PLACE, "tile"]).withColumn("distance", F.abs(F.col("a_bin") - F.col("b_bin"))).where(F.col("distance") <= tolerance)
    rows, taken = written(near.select(*PLACE, "a_bin", "b_bin", "distance").distinct()), None
    pair = F.struct("distance", "a_bin", "b_bin")
    ends = [W.partitionBy(*PLACE, "a_bin"), W.partitionBy(*PLACE, "b_bin")]
    while not rows.isEmpty():
        first = [F.min(pair).over(w) == pair for w in ends]
        marked = written(rows.withColumn("won", first[0] & first[1]))
        won = marked.where("won").drop("won")
        taken = won if taken is None else taken.union(won)
        lost = {f"lost{k}": F.max("won").over(w) for k, w in enumerate(ends)}
        rows = written(marked.withColumns(lost).where("NOT lost0 AND NOT lost1").drop("won", *lost))
    return rows if taken is None else taken
