"""Pruning against plain restatements on small made profiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from binloom.operators import prune, segments

CUTS = [10, 14, 20, 23, 30, 50]


def made(seed):
    rng = np.random.default_rng(seed)
    level = np.repeat([4.0, 4.1, 4.05, 6.0, 4.0, 4.02, 4.3], [10, 4, 6, 3, 7, 20, 14])
    x = level + rng.normal(0, 0.05, 64)
    boot = x + rng.normal(0, 0.15, (40, 64))
    if seed == 2:
        x[10:14] = 0
        boot[:, 10:14] = 0
    if seed == 3:
        boot[5, 20:23] = 0
    return x, boot


def restated(x, boot, tau, stab, small):
    """The boundaries that go, in order, all computed anew at every step."""
    segs = [(a, b, (k,)) for k, (a, b) in enumerate(zip([0, *CUTS], [*CUTS, len(x)]))]
    levels = [np.log2(np.median(x[a:b])) if np.median(x[a:b]) > 0 else None for a, b, _ in segs]
    gone = []
    while len(segs) > 2:
        best = None
        for i in range(1, len(segs) - 2):
            (a, b, p), (_, c, q) = segs[i], segs[i + 1]
            if min(b - a, c - b) > small:
                continue
            m, n = np.median(x[a:b]), np.median(x[b:c])
            if m <= 0 or n <= 0 or abs(np.log2(m / n)) >= tau:
                continue
            pairs = [(np.median(r[a:b]), np.median(r[b:c])) for r in boot]
            if any(u <= 0 or v <= 0 for u, v in pairs) or np.mean([abs(np.log2(u / v)) < tau for u, v in pairs]) < stab:
                continue
            part = [levels[k] for k in p + q]
            if None in part or max(part) - min(part) >= tau:
                continue
            key = (round(abs(np.log2(m / n)), 10), b, i)
            best = key if best is None or key < best else best
        if best is None:
            break
        i = best[2]
        gone.append(best[1])
        segs[i : i + 2] = [(segs[i][0], segs[i + 1][1], segs[i][2] + segs[i + 1][2])]
    return gone


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("tau,stab,small", [(0.2, 0.5, 100), (0.08, 0.9, 100), (0.2, 0.5, 4), (0.001, 0.1, 100)])
def test_pruned(seed, tau, stab, small):
    x, boot = made(seed)
    rows = prune.pruned(x, boot, CUTS, tau, stab, small)
    assert [r[1] for r in sorted((r for r in rows if r[11]), key=lambda r: r[12])] == restated(x, boot, tau, stab, small)
    assert [r[1] for r in rows] == CUTS and rows[0][10] == rows[-1][10] == "terminal_unchanged"
    reasons = {r[1]: r[13] for r in rows}
    if seed == 2:
        assert rows[1][10] == "observed_median_zero" or rows[1][2] > small < rows[1][3]
    if seed == 3 and small == 100:
        assert rows[2][10] == "invalid_replicates" and not rows[2][11]
    assert all(reasons.values())


def test_prune_runs_every_cutoff_and_its_summaries_agree(spark):
    x, boot = made(1)
    profile = spark.createDataFrame([("s", 1, i, i, 1 + 10 * i, 10 + 10 * i, float(v)) for i, v in enumerate(x)], "source string, chrom int, g long, i long, start long, end long, x double")
    boots = spark.createDataFrame([("s", i, [float(v) for v in boot[:, i]]) for i in range(64)], "source string, g long, boot array<double>")
    cuts = spark.createDataFrame([("s", 1, b) for b in CUTS], "source string, chrom int, bin long")
    found = prune.prune(profile, boots, cuts, (0.1, 0.2), (0.5, 0.9)).cache()
    assert found.count() == 4 * len(CUTS)
    for tau, stab in ((0.1, 0.5), (0.2, 0.9)):
        mine = found.where((F.col("tau") == tau) & (F.col("stab") == stab))
        assert sorted(r.bin for r in mine.where("removed").collect()) == sorted(restated(x, boot, tau, stab, 100))
    one = found.where("tau = 0.2 AND stab = 0.5")
    gone = len(restated(x, boot, 0.2, 0.5, 100))
    assert gone > 1 and prune.review_summary(one).first().n_merged == gone
    assert [tuple(r)[4:] for r in prune.sensitivity(one).collect()] == [(6, gone, 6 - gone, 7 - gone)]
    sums = segments.segment_summaries(segments.labelled(profile, cuts))
    sizes = spark.createDataFrame([("s", 1, 64)], "source string, chrom int, n long")
    left = prune.simplified_segments(one, sizes, sums).orderBy("seg").collect()
    assert sum(r.n_original for r in left) == 7 and [r.bin_start for r in left][1:] == sorted(set(CUTS) - set(restated(x, boot, 0.2, 0.5, 100)))
    assert all((r.n_original > 1) == r.merged for r in left)
    assert prune.unresolved_segments(one, sums).count() == 5


def test_replicate_profiles(spark):
    signal = spark.createDataFrame([("a", c, g, float(c + g)) for c in range(4) for g in range(5) if (c + g) % 3], "source string, cell long, g long, x double").repartition(3)
    drawn = {1: [0, 0, 1, 3], 2: [2, 2, 2, 2]}
    weights = spark.createDataFrame([("a", rep, c, cells.count(c)) for rep, cells in drawn.items() for c in set(cells)], "source string, rep int, cell long, w long")
    got = {r.g: r.boot for r in prune.replicate_profiles(signal, weights, 2).collect()}
    for g, boot in got.items():
        assert boot == [sum(c + g for c in drawn[rep] if (c + g) % 3) / 4 for rep in (1, 2)]


def test_converge(spark):
    """Every pass takes all that is proposed; scores are then computed anew."""
    rng = np.random.default_rng(6)
    x = np.repeat([10.0, 10.4, 10.1, 30.0, 10.0, 3.0, 9.0], [20, 5, 6, 8, 7, 9, 20]) + rng.normal(0, 0.2, 75)
    cuts = [20, 25, 31, 39, 46, 55]
    profile = spark.createDataFrame([("s", 1, i, float(v)) for i, v in enumerate(x)], "source string, chrom int, i long, x double")
    rows = prune.converge(profile, spark.createDataFrame([("s", 1, b) for b in cuts], "source string, chrom int, bin long"), 10, 2.0, 0.3).collect()
    gone = {r.bin: r["pass"] for r in rows}
    # 25..31 and 20..25 are weak on both sides' account, 39..46 lies between unlike sides and goes to the lower one
    assert gone == {20: 0, 25: 0, 46: 0}
    assert prune.srd(0.0, 3, 0.0, 5) == 0.0 and prune.srd(9.0, 3, 3.0, 3) > 0 > prune.srd(3.0, 3, 9.0, 3)
