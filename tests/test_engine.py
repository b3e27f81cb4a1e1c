"""Every query against its SQL, and the sequential kernels against plain restatements."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from binloom.operators import kernels, resample, segments, tracks
from binloom.operators.calls import best_scale, copy_numbers, five_states
from binloom.plans import catalog
from binloom.plans.rounds import fold, rounds_digest
from binloom.plans.rules import Condition, ConditionRule, FlankRule, RuleSet, evaluate
from binloom.sources.genome import Genome

SF = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in os.listdir(SF) if f.endswith(".parquet")]


def canonical(df):
    rows = df[sorted(df.columns)].astype(object).itertuples(index=False)
    return sorted(tuple("NULL" if v is None or v is pd.NA or v != v else f"{float(v) + 0.0:.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name in catalog.oracle_sql():
        want = db.sql(catalog.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
    else:
        assert len(got)


def plain_ad(x, cut):
    """The midrank two-sample statistic by its definition, one value at a time."""
    n, z = len(x), np.unique(x)
    total = 0.0
    for v in z:
        l = (x == v).sum()
        below = (x < v).sum() + l / 2
        left = (x[:cut] < v).sum() + (x[:cut] == v).sum() / 2
        d = below * (n - below) - n * l / 4
        if d > 0:
            total += l / n * ((n * left - cut * below) ** 2 / cut + (n * (below - left) - (n - cut) * below) ** 2 / (n - cut)) / d
    return (n - 1) / n * total


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=2, max_size=30))
def test_ad_statistics(values):
    x = np.array(values, float)
    assert np.allclose(kernels.ad_statistics(x), [plain_ad(x, c) for c in range(1, len(x))])


def test_recursion_finds_a_step(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0.05, 0.01, 80), rng.normal(0.30, 0.01, 80)])
    profile = spark.createDataFrame([("s", 1, i, float(v)) for i, v in enumerate(x)], "source string, chrom int, i long, x double")
    rows = kernels.recursive_breakpoints(profile, k=1, permutations=200, alpha=0.01, min_child=20, min_terminal=20).collect()
    assert [(r.bin, r.accepted) for r in rows] == [(80, True)]
    flat = profile.withColumn("x", profile.i * 0 + 1.0)
    assert not any(r.accepted for r in kernels.recursive_breakpoints(flat, permutations=50).collect())


def test_geometry():
    assert kernels.geometry_reasons(0, 200, 60, 200, 20, 50) == []
    assert kernels.geometry_reasons(0, 200, 30, 200, 20, 50) == ["left_terminal_too_short"]
    assert kernels.geometry_reasons(10, 100, 15, 200, 20, 50) == ["left_child_too_short"]


RULES = RuleSet(FlankRule(tau=0.06, srd_ref=0.4, max_bins=31, merge_signs_only=True), (ConditionRule("weak", (Condition("weak_flank", "delta_median", 0.05), Condition("sign_mismatch", "delta_mean"), Condition("max_size", max_bins=25)), "delta_iqr_mean"), FlankRule(("delta_median",), "any", 0.01, id="copy"), ConditionRule("odd", (Condition("ambiguous", "delta_mean"),)), ConditionRule("off", (), enabled=False)))


def test_merging_takes_the_columns_claims(spark):
    """The rules as Columns and as the kernel sees them agree, step after step."""
    g = Genome(spark, SF)
    profile, boundaries = g.profile.where("source = 'cluster1'").cache(), g.boundaries.where("source = 'cluster1'").cache()
    steps = {}
    for r in kernels.greedy_merge(profile, boundaries, RULES).collect():
        steps.setdefault(r.chrom, []).append(r)
    assert sum(map(len, steps.values())) > 3
    cuts = boundaries
    for k in range(2):
        first = {r.chrom: r for r in kernels.merge_step(profile, cuts, RULES).collect()}
        for chrom, done in steps.items():
            if len(done) > k:
                r = first[chrom]
                assert (r.removed, r.claimed_by, r.phase, r.side) == tuple(done[k][c] for c in ("removed", "claimed_by", "phase", "side"))
                assert abs(r.score - done[k].score) < 1e-9
        gone = spark.createDataFrame([("cluster1", c, d[k].removed) for c, d in steps.items() if len(d) > k], "source string, chrom int, bin long")
        cuts = cuts.join(gone, ["source", "chrom", "bin"], "left_anti")


def test_rules_that_never_hold_merge_nothing(spark):
    g = Genome(spark, SF)
    none = RuleSet(FlankRule(tau=1e-9, srd_ref=1e-9))
    assert kernels.merged_boundaries(g.profile, g.boundaries, none).count() == g.boundaries.count()
    assert fold(g.profile, g.boundaries, [none, none]).count() == 0
    assert rounds_digest([none, RULES]) != rounds_digest([RULES, none])
    with pytest.raises(ValueError):
        FlankRule(("nothing",))
    with pytest.raises(ValueError):
        RuleSet(FlankRule(), (FlankRule(),))


ROW = "source string, chrom int, seg int, s int, e int, srd_phi_left double, srd_phi_right double, delta_mean_left double, delta_mean_right double, gap_left boolean, gap_right boolean"


@pytest.mark.parametrize("row,want", [
    ((1.0, 2.0, 0.1, 0.15, False, False), ("would_merge", "left", None)),
    ((1.0, 2.0, 0.1, 0.05, True, False), ("would_merge", "right", None)),  # the smallest fraction decides: 0.05 / 0.2 on the right
    ((1.0, 2.0, 0.1, 0.15, True, False), ("would_merge", "left", "gap")),
    ((1.0, -2.0, 0.1, -0.15, False, False), ("held_back", "left", None)),
    ((5.0, -9.0, 0.1, -0.15, False, False), ("signs_only", None, None)),
    ((5.0, 9.0, 0.1, 0.15, False, False), ("none", None, None)),
    ((None, 2.0, None, 0.1, False, False), ("would_merge", "right", None)),
    ((None, None, 0.1, 0.1, False, False), ("none", None, None)),
])
def test_flank_rule_outcomes(spark, row, want):
    from binloom.plans.rules import flank_rule

    r = flank_rule(spark.createDataFrame([("a", 1, 1, 0, 10, *row)], ROW), FlankRule()).first()
    assert (r.outcome, r.side, r.blocked) == want


def test_empty_segments_are_harmless(spark):
    sizes = spark.createDataFrame([("a", 1, 10)], "source string, chrom int, n long")
    cuts = spark.createDataFrame([("a", 1, b) for b in (0, 3, 3, 10, 12, -1, 7)], "source string, chrom int, bin long")
    assert sorted((r.s, r.e) for r in segments.flat_partition(cuts, sizes).collect()) == [(0, 3), (3, 7), (7, 10)]


def test_states_and_scale(spark):
    means, n = np.array([2.0, 3.0, 1.0, 2.0]) * 4.1, np.array([50, 20, 10, 40])
    s = best_scale(means, n, 2 * 4.1)
    assert np.array_equal(np.rint(means / s), [2, 3, 1, 2])
    rows = spark.createDataFrame([("a", 1, k, int(c), float(m)) for k, (m, c) in enumerate(zip(means, n))] + [("z", 1, 0, 5, 0.0)], "source string, chrom int, seg long, n long, mean double")
    got = {(r.source, r.seg): (r.status, r.state) for r in copy_numbers(rows, ["source"]).collect()}
    assert got[("a", 1)][1] in (2.0, 1.5) and got[("a", 0)][1] == 1.0 and got[("z", 0)] == ("undefined", None)
    rng = np.random.default_rng(2)
    many = [(str(k), 1, j, int(rng.integers(1, 60)), float(m)) for k in range(40) for j, m in enumerate(rng.gamma(3, 1, rng.integers(1, 12)).round(3) * (rng.random() < 0.9))]
    scaled = {r.source: r.best_s for r in copy_numbers(spark.createDataFrame(many, "source string, chrom int, seg long, n long, mean double"), ["source"]).select("source", "best_s").distinct().collect()}
    for k in scaled:
        m, c = (np.array([r[j] for r in many if r[0] == k], float) for j in (4, 3))
        order = np.argsort(m, kind="stable")
        median = m[order][np.searchsorted(np.cumsum(c[order]), c.sum() / 2)]
        if not median > 0:
            assert scaled[k] is None
            continue
        misfit = lambda s: ((m / s - np.rint(m / s)) ** 2 * c).sum()  # noqa: B023, E731
        grid = np.linspace(0.35, 0.75, 2001) * median
        assert abs(scaled[k] - best_scale(m, c, median)) < 1e-9 and misfit(scaled[k]) <= min(map(misfit, grid)) + 1e-6
        assert 0.35 * median - 1e-9 <= scaled[k] <= 0.75 * median + 1e-9
    from pyspark.sql import functions as F

    pairs = spark.createDataFrame([(1, 0.9), (1, 1.4), (2, 2.0), (3, 2.6), (3, 3.1), (2, 0.9)], "w long, c double")
    assert [r[0] for r in pairs.select(five_states(F.col("w"), F.col("c"))).collect()] == [0.0, 0.5, 1.0, 1.5, 2.0, -1.0]


def test_bootstrap_weights_draw_as_many_as_there_are(spark):
    members = spark.createDataFrame([(s, c) for c in range(40) for s in ("a", "all")], "source string, cell long")
    w = resample.bootstrap_weights(members, 7).groupBy("source", "rep").sum("w").collect()
    assert len(w) == 14 and all(r[2] == 40 for r in w)


def test_matching_is_one_to_one_and_nearest_first(spark):
    f = lambda bins: spark.createDataFrame([("a", 1, b) for b in bins], "source string, chrom int, bin long")
    got = sorted((r.a_bin, r.b_bin) for r in kernels.match_one_to_one(f([10, 12, 40]), f([11, 13, 44, 99]), 3).collect())
    assert got == [(10, 11), (12, 13)]


def test_upper_median_and_islands(spark):
    df = spark.createDataFrame([("a", 1, float(v)) for v in (4, 1, 3, 2)], "source string, chrom int, x double")
    assert df.groupBy("source").agg(tracks.upper_median("x")).first()[1] == 3.0
    spans = spark.createDataFrame([("a", 0, 3), ("a", 3, 5), ("a", 9, 11), ("a", 10, 10)], "k string, s int, e int")
    assert sorted((r.s, r.e) for r in tracks.coalesced_intervals(spans, ["k"]).collect()) == [(0, 5), (9, 11)]


def test_evaluate_keeps_one_row_a_segment(spark):
    g = Genome(spark, SF)
    rows = segments.flank_scores(segments.labelled(g.profile, g.boundaries))
    assert evaluate(rows, RULES).count() == rows.count()
