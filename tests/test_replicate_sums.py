"""Sums of replicates against a plain restatement; a cell's replicates never become rows."""

import math

import numpy as np
import pytest

from binloom.operators import resample
from binloom.plans import catalog_compare
from binloom.sources.genome import Genome

from .test_engine import SF


def _frames(spark, x, drawn):
    values = [("s", c, 1990 + s % 2, s, float(x[c, s])) for c in range(len(x)) for s in range(x.shape[1]) if not x[c, s] == 0]
    weights = [("s", k + 1, c, int((d == c).sum())) for k, d in enumerate(drawn) for c in range(len(x)) if (d == c).any()]
    return spark.createDataFrame(values, "source string, cell long, chrom int, seg long, x double"), spark.createDataFrame(weights, "source string, rep int, cell long, w long")


@pytest.mark.parametrize("tile", [1, 1 << 20])
def test_sums(spark, monkeypatch, tile):
    monkeypatch.setattr(resample, "TILE", tile)
    rng = np.random.default_rng(5)
    x, drawn = rng.integers(0, 3, (9, 7)).astype(float), rng.integers(0, 9, (20, 9))
    x[1:, 6] = 0  # seldom drawn
    x[2, 5], x[3, 5] = math.inf, math.nan  # only where they are drawn
    got = {(r.rep, r.chrom, r.seg): r.y for r in resample.replicate_sums(*_frames(spark, x, drawn), 20).collect()}
    want = {(k + 1, 1990 + s % 2, s): sum(x[c, s] for c in d if x[c, s] != 0) for k, d in enumerate(drawn) for s in range(7) if any(x[c, s] != 0 for c in d)}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), equal_nan=True)
    assert any(math.isfinite(v) for (_, _, s), v in want.items() if s == 5) and any(not math.isfinite(v) for v in want.values())


def test_null_and_zero_are_rows(spark):
    values = spark.createDataFrame([("s", 0, 1, 0, None), ("s", 0, 1, 1, 0.0), ("s", 1, 1, 2, 4.0)], "source string, cell long, chrom int, seg long, x double")
    weights = spark.createDataFrame([("s", 1, 0, 2), ("s", 2, 1, 2)], "source string, rep int, cell long, w long")
    assert sorted(tuple(r) for r in resample.replicate_sums(values, weights, 2).collect()) == [("s", 1, 1, 0, 0.0), ("s", 1, 1, 1, 0.0), ("s", 2, 1, 2, 8.0)]


def test_no_row_for_each_cell_segment_and_replicate(spark):
    """40 cells, 30 segments, 50 replicates: no step makes 60,000 rows but what tasks hand on, a row a segment and replicate of a batch."""
    rng = np.random.default_rng(6)
    values, weights = _frames(spark, rng.integers(1, 9, (40, 30)).astype(float), rng.integers(0, 40, (50, 40)))
    df = resample.flank_replicates(values.withColumnRenamed("x", "mean"), weights, 50)
    df.collect()
    pairs = values.join(weights, ["source", "cell"]).count()
    plan, found = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        p = plan.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plan.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plan.append(p.plan())
        else:
            plan += [p.children().apply(k) for k in range(p.children().size())]
        if "Join" in kind and p.metrics().contains("numOutputRows"):
            found.append(p.metrics().apply("numOutputRows").value())
    assert found and max(found) <= 40 < pairs


def test_cells_are_dealt(spark, monkeypatch):
    """Tasks hold a bounded part of the signal, whatever Spark's own numbers are, and the sums are the same."""
    g = Genome(spark, SF)
    want = {tuple(r) for r in catalog_compare._cell_sums(g).collect()}
    monkeypatch.setattr(catalog_compare, "ENTRIES", -(-g.signal.count() // 13))
    dealt = catalog_compare._cell_sums(g)
    assert {tuple(r) for r in dealt.collect()} == want
    assert "13), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
