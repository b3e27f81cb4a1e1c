"""Queries that have to give a result for every source, chromosome and boundary."""

import numpy as np
import pytest

from binloom.operators import kernels
from binloom.plans import catalog
from binloom.sources.genome import Genome

from .test_engine import SF, plain_ad


@pytest.fixture(scope="module")
def genome(spark):
    g = Genome(spark, SF)
    return {tuple(r) for r in g.profile.select("source", "chrom").distinct().collect()}, {tuple(r) for r in g.boundaries.select("source", "chrom", "bin").collect()}


@pytest.mark.parametrize("name", ["g8_ad_curve", "m20_live_scores", "m24_constituent_range", "b6_flank_replicates"])
def test_every_place(spark, genome, name):
    rows = catalog.queries()[name](spark, SF).select("source", "chrom").distinct().collect()
    assert {tuple(r) for r in rows} == genome[0]


def test_every_boundary(spark, genome):
    rows = catalog.queries()["g9_split_tests"](spark, SF).select("source", "chrom", "cut").collect()
    assert len(rows) == len(genome[1]) and {tuple(r) for r in rows} == genome[1]


def test_curves_of_several_places(spark):
    rng = np.random.default_rng(3)
    x = {(s, c): rng.integers(0, 6, 25).astype(float) for s in ("all", "cluster0") for c in (1996, 1997)}
    profile = spark.createDataFrame([(*p, i, float(v)) for p, values in x.items() for i, v in enumerate(values)], "source string, chrom int, i long, x double")
    got = {(r.source, r.chrom, r.cut): r.ad for r in kernels.ad_curves(profile).collect()}
    want = {(*p, cut): plain_ad(values, cut) for p, values in x.items() for cut in range(1, 25)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_production_parameters(spark, genome):
    """1000 permutations: p-values are parts of 1001; 200 replicates of every source."""
    p = [r.p_local for r in catalog.queries()["g11_recursive_breakpoints"](spark, SF).collect() if r.p_local is not None]
    assert p and all(abs(v * 1001 - round(v * 1001)) < 1e-2 for v in p) and any(abs(v * 101 - round(v * 101)) > 1e-2 for v in p)
    for name in ("b4_bootstrap_weights", "b6_flank_replicates"):
        reps = {tuple(r) for r in catalog.queries()[name](spark, SF).select("source", "rep").distinct().collect()}
        assert reps == {(s, k) for s, _ in genome[0] for k in range(1, 201)}
