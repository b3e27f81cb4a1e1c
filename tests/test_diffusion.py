"""Diffusion components against dense eigenvectors; graphs without one."""

import numpy as np
import pytest

from binloom.operators import diffusion
from binloom.operators.diffusion import APART, SLOW, diffusion_component

EDGES = "source long, target long, weight double"


def dense(edges):
    nodes = sorted({n for a, b, _ in edges for n in (a, b)})
    at = {n: k for k, n in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for a, b, x in edges:
        w[at[a], at[b]] += x / 2
        w[at[b], at[a]] += x / 2
    q = w.sum(1)
    w = w / np.outer(q, q)
    z = np.sqrt(w.sum(1))
    values, vectors = np.linalg.eigh(w / np.outer(z, z))
    v = vectors[:, np.argsort(-values)[1]]
    return nodes, v * np.sign(v[np.lexsort((nodes, -np.round(np.abs(v), 9)))[0]])


@pytest.mark.parametrize("kind", ["ring", "random"])
def test_dense_eigenvector(spark, kind):
    rng = np.random.default_rng(4)
    n = 40
    if kind == "ring":
        edges = [(i, (i + k) % n, 1.0 / k + rng.random() * 0.2) for i in range(n) for k in (1, 2, 3)]
    else:
        edges = [(i, j, 1.0 + rng.random()) for i in range(n) for j in range(n) if i != j and rng.random() < 0.3]
    got = {r.node: r.value for r in diffusion_component(spark.createDataFrame(edges, EDGES)).collect()}
    nodes, want = dense(edges)
    assert np.allclose([got[k] for k in nodes], want, atol=1e-5) and len(got) == n


def test_no_component(spark):
    apart = [(0, 1, 1.0), (1, 2, 1.0), (2, 0, 2.0), (10, 11, 1.0), (11, 12, 1.0)]
    assert {(r.node, r.value, r.note) for r in diffusion_component(spark.createDataFrame(apart, EDGES)).collect()} == {(k, None, APART) for k in (0, 1, 2, 10, 11, 12)}
    assert diffusion_component(spark.createDataFrame([(0, 1, -1.0), (0, 2, None), (0, 3, float("nan")), (0, 4, float("inf"))], EDGES)).count() == 0
    ring = [(i, (i + 1) % 30, 1.0 + i % 3) for i in range(30)]
    assert {r.note for r in diffusion_component(spark.createDataFrame(ring, EDGES), rounds=1).collect()} == {SLOW}


def test_many_nodes_in_few_products(spark, monkeypatch):
    """Values that lie close together, in tiles of several parts."""
    monkeypatch.setattr(diffusion, "ENTRIES", 1 << 8)
    rng = np.random.default_rng(6)
    n = 700
    edges = [(i, (i + 1) % n, 1.0) for i in range(n)] + [(int(a), int(b), float(x)) for a, b, x in zip(rng.integers(0, n, 6 * n), rng.integers(0, n, 6 * n), rng.random(6 * n))]
    rows = diffusion_component(spark.createDataFrame(edges, EDGES), rounds=14).collect()
    nodes, want = dense(edges)
    got = {r.node: r.value for r in rows}
    assert {r.note for r in rows} == {None} and len(rows) == n
    assert np.allclose([got[k] for k in nodes], want, atol=1e-5)
