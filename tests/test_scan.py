"""Scans, trees and the event index on made signals and against plain loops; calls of cells against a loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from binloom.operators import kernels, recall, scan
from binloom.operators.calls import best_scale

QUICK = scan.Settings(depths=1, permutations=200, alpha=0.01, min_child=20, min_terminal=20)


def track(spark, x, kept=None, source="s", chrom=1, **more):
    kept = [True] * len(x) if kept is None else kept
    rows = [(source, chrom, i, float(v), bool(k), *(float(c[i]) for c in more.values())) for i, (v, k) in enumerate(zip(x, kept))]
    return spark.createDataFrame(rows, "source string, chrom int, i long, x double, kept boolean" + "".join(f", {c} double" for c in more))


@pytest.fixture(scope="module")
def step():
    rng = np.random.default_rng(1)
    return np.concatenate([rng.normal(0.05, 0.01, 80), rng.normal(0.30, 0.01, 80)])


def found(df, settings=QUICK, pool="genome"):
    cuts = scan.breakpoints(scan.candidates(df, pool, settings), df)
    segs = scan.scanned_segments(df, cuts).orderBy("bin_start").collect()
    return [(r.bin, r.gap_start, r.gap_end) for r in cuts.collect()], [(r.bin_start, r.bin_end, r.n_bins, r.kept_bins) for r in segs]


def test_step_and_skipped_bins(spark, step):
    assert found(track(spark, step)) == ([(80, None, None)], [(0, 79, 80, 80), (80, 159, 80, 80)])
    kept = [not 75 <= i < 85 for i in range(160)]
    assert found(track(spark, step, kept)) == ([(85, 75, 85)], [(0, 84, 85, 75), (85, 159, 75, 75)])
    assert found(track(spark, step, [False] * 160)) == ([], [(0, 159, 160, 0)])
    assert found(track(spark, step, [i == 5 for i in range(160)])) == ([], [(0, 159, 160, 1)])


def test_geometry_and_sums(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0.05, 0.01, 10), rng.normal(0.3, 0.01, 150)])
    rows = scan.candidates(track(spark, x), settings=scan.Settings(1, 50, 0.01, 5, 20)).orderBy("rank").collect()
    assert (rows[0].bin, rows[0].valid, rows[0].reasons) == (10, False, "left_terminal_too_short")
    assert sum(r.tested for r in rows) == 1 and rows[-1].tested and [r.rank for r in rows] == [*range(1, len(rows) + 1)]
    df = track(spark, x, [i >= 5 for i in range(160)], ha=np.ones(160), hb=np.full(160, 2.0))
    none = spark.createDataFrame([], "source string, chrom int, bin long")
    r = scan.scanned_segments(df, none, ("ha", "hb")).first()
    assert (r.ha_sum, r.hb_sum, r.kept_bins) == (155.0, 310.0, 155)
    short = scan.candidates(track(spark, x[:30]), settings=QUICK).collect()
    assert short[-1].reasons == "no_valid_candidate" and short[-1].rank is None and not any(r.tested for r in short)


def test_the_pool_is_the_genome_or_the_chromosome(spark, step):
    kept = [i >= 4 for i in range(160)]
    df = track(spark, step, kept).union(track(spark, np.arange(500.0), chrom=2))
    assert {r.chrom: len(r.x) for r in scan.chromosomes(df).collect()} == {1: 156, 2: 500}
    assert [len(r.pool) for r in scan.pools(df, "genome")[0].collect()] == [656]
    assert {r.chrom: len(r.pool) for r in scan.pools(df, "chromosome")[0].collect()} == {1: 156, 2: 500}
    with pytest.raises(ValueError):
        scan.candidates(df, "nothing", QUICK)


def test_reasons_and_repeats(spark):
    df = track(spark, np.random.default_rng(3).normal(0.1, 0.01, 160))
    rows = scan.candidates(df, settings=QUICK).withColumn("reason", scan.rejection_reason(0.01))
    tested = rows.where("tested").collect()
    assert len(tested) == 1 and not tested[0].accepted and tested[0].reason.startswith("local permutation p = ")
    assert sorted(map(str, rows.collect())) == sorted(map(str, rows.collect()))


def test_trees(spark, step):
    df = track(spark, step)
    nodes = {r.side: r for r in scan.split_trees(df, 2, 200, 0.01).collect()}
    assert set(nodes) == {"root", "left", "right"} and nodes["root"].cut == 80 and nodes["root"].accepted
    assert not nodes["left"].hypothetical and (nodes["right"].start, nodes["right"].end) == (80, 160)
    flat = {r.side: r for r in scan.split_trees(df.withColumn("x", F.col("i") % 2 * 1.0), 4, 50, 0.001).collect()}
    assert set(flat) == {"root", "left", "right"} and flat["left"].hypothetical and not flat["left"].accepted
    with pytest.raises(ValueError):
        scan.inspected(step, step, "a", 11, 10, 0.01, 1)


def test_curves_in_blocks(monkeypatch):
    x = np.random.default_rng(4).integers(0, 9, 200).astype(float)
    whole = kernels.ad_statistics(x)
    monkeypatch.setattr(kernels, "CELLS", 50)
    assert np.allclose(whole, kernels.ad_statistics(x)) and not kernels.ad_statistics(np.ones(5)).any()


def test_event_index(spark):
    rng = np.random.default_rng(7)
    x = rng.poisson(1.0, (6, 70)).astype(float)
    x[:3, 15:40] += 4
    x[5] = 0
    sizes = {1: 40, 2: 30}
    bins = spark.createDataFrame([(g, 1 if g < 40 else 2, g if g < 40 else g - 40, 1 + g * 10) for g in range(70)], "g long, chrom int, i long, start long")
    signal = spark.createDataFrame([(c, g, float(x[c, g])) for c in range(6) for g in range(70) if x[c, g] or c == 5 and g == 0], "cell long, g long, x double")
    cuts = {(c, 1, 15) for c in range(4)} | {(0, 1, 39), (1, 1, 16)}
    got = {(r.cell, r.chrom, r.node): (r.bin, r.accepted, r.parent_accepted, r.n_left, r.n_right) for r in scan.event_index(signal, bins, spark.createDataFrame([*cuts], "cell long, chrom int, bin long")).collect()}
    want = {}
    for c in range(6):
        for chrom, n in sizes.items():
            v = x[c, :40] if chrom == 1 else x[c, 40:]
            best = lambda a: 1 + max(range(len(a)), key=lambda k: (round(a[k], 9), -k))
            root = best(kernels.ad_statistics(v))
            ok = (c, chrom, root) in cuts
            want[c, chrom, "root"] = (root, ok, True, root, n - root)
            for node, lo, hi in (("left", 0, root), ("right", root, n)):
                if hi - lo > 1:
                    k = best(kernels.ad_statistics(v[lo:hi]))
                    want[c, chrom, node] = (lo + k, ok and (c, chrom, lo + k) in cuts, ok, k, hi - lo - k)
    assert got == want and any(v[1] for k, v in got.items() if k[2] == "root")


def test_cells_are_called_under_their_clusters_segments(spark):
    rng = np.random.default_rng(8)
    x = rng.poisson(10, (6, 70)).astype(float)
    x[3:, 10:20] += 6
    cuts = {"a": [(1, 10), (1, 20), (2, 15)], "b": [(1, 10), (1, 20)]}
    place = [(1, i) for i in range(40)] + [(2, i) for i in range(30)]
    labels = {s: [sum(c == chrom and b <= i for c, b in cuts[s]) for chrom, i in place] for s in cuts}
    frame = spark.createDataFrame([(s, *p, k) for s in cuts for p, k in zip(place, labels[s])], "source string, chrom int, i long, seg int")
    signal = spark.createDataFrame([(c, *place[g], float(x[c, g])) for c in range(6) for g in range(70) if x[c, g]], "cell long, chrom int, i long, x double")
    members = spark.createDataFrame([(c, "a" if c < 3 else "b") for c in range(6)], "cell long, source string")
    rows = recall.call_cells(signal, members, frame).collect()
    for c in range(6):
        own = sorted((r for r in rows if r.cell == c), key=lambda r: (r.chrom, r.seg))
        key = [(p[0], k) for p, k in zip(place, labels["a" if c < 3 else "b"])]
        groups = sorted(set(key))
        means = np.array([x[c][[k == g for k in key]].mean() for g in groups])
        n = np.array([key.count(g) for g in groups])
        order = np.argsort(means, kind="stable")
        s = best_scale(means, n, means[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])
        assert [(r.chrom, r.seg) for r in own] == groups and np.allclose([r.mean for r in own], means) and np.allclose([r.best_s for r in own], s)
    one = frame.withColumn("seg", F.lit(0))
    pieces = recall.piece_calls(recall.call_cells(signal, members, frame), recall.call_cells(signal, members, one), recall.overlay(frame, one), ["cell"])
    total = recall.changes(pieces, ["cell"]).collect()
    assert len(total) == 6 and all(r.bins_called == 70 for r in total)
