"""Parts of a graph are told before its matrix is made."""

import pytest

from binloom.operators import diffusion


def test_parts_are_told_first(spark, monkeypatch):
    monkeypatch.setattr(diffusion, "normalised", lambda rows: pytest.fail("a matrix was made"))
    edges = [(a + k, b + k, 1.0) for k in (0, 100, 200) for a, b in ((5, 9), (9, 1), (1, 7), (7, 2), (2, 8))]
    found = diffusion.diffusion_component(spark.createDataFrame(edges, "source long, target long, weight double")).collect()
    assert {(r.node, r.value, r.note) for r in found} == {(n, None, diffusion.APART) for e in edges for n in e[:2]}


def test_a_path_is_one_part(spark):
    path = [(k * 37 % 101, (k + 1) * 37 % 101, 1.0) for k in range(100)]
    both = diffusion.averaged(spark.createDataFrame(path, "source long, target long, weight double"))
    assert not diffusion.is_apart(both)
    assert diffusion.is_apart(both.where("source <> 50 AND target <> 50"))
