"""Hashed permutations against a loop over hashes, and their SQL on a small table."""

import hashlib

import duckdb
import numpy as np
import pytest

from binloom.operators import kernels, permute, scan

from .test_engine import plain_ad


def plain_hash(name, replicate, position):
    h = int(hashlib.md5(name.encode()).hexdigest()[:8], 16) ^ ((replicate + 1) * 2654435769) % 2**32 ^ ((position + 1) * 2246822519) % 2**32
    for _ in range(2):
        h = ((h >> 16) ^ h) * 73244475 % 2**32
    return (h >> 16) ^ h


def plain_p(x, size, cut, observed, name, n):
    count = 0
    for r in range(n):
        order = sorted(range(len(x)), key=lambda i: (plain_hash(name, r, i), i))[:size]
        count += round(plain_ad(np.array([x[i] for i in order]), cut), 9) >= round(observed, 9)
    return (1 + count) / (n + 1)


@pytest.mark.parametrize(("n", "size", "cut"), [(30, 30, 7), (30, 12, 5), (9, 9, 8), (2, 2, 1)])
def test_loop(n, size, cut):
    x = np.random.default_rng(n + cut).integers(0, 5, n).astype(float)
    observed = plain_ad(x[:size], cut)
    assert (1 + permute.reached(x, size, cut, observed, "a:b", 0, 40)) / 41 == plain_p(x, size, cut, observed, "a:b", 40)
    assert sum(permute.reached(x, size, cut, observed, "a:b", lo, lo + 10) for lo in range(0, 40, 10)) == permute.reached(x, size, cut, observed, "a:b", 0, 40)


def test_orders_are_permutations_of_even_chance():
    keys = permute.order_keys("node", np.arange(4000), 10)
    first = np.bincount(keys.argsort(1)[:, 0], minlength=10)
    assert first.min() > 300 and first.max() < 500 and len(np.unique(keys[0])) == 10


def test_blocks_and_sql(spark, monkeypatch):
    """The same p from one row or many, from any partitioning, and in SQL; a pool's positions beyond the bound don't matter."""
    rng = np.random.default_rng(5)
    nodes = {f"n{k}": np.round(rng.random(60 + k), 2) for k in range(3)}
    tests = [(name, x.tolist(), len(x), 20, float(kernels.ad_statistics(x)[19])) for name, x in nodes.items()]
    pool = np.round(rng.random(400), 2)
    tests += [(f"{name}:pool", sorted(pool.tolist()), len(x), 20, 1.0) for name, x in nodes.items()]
    schema = "name string, x array<double>, size int, cut int, observed double"
    got = {r.name: r.p for r in permute.permutation_ps(spark.createDataFrame(tests, schema), 100).collect()}
    monkeypatch.setattr(permute, "WORK", 500)
    assert got == {r.name: r.p for r in permute.permutation_ps(spark.createDataFrame(tests[::-1], schema).repartition(3), 100).collect()} and len(got) == 6
    con = duckdb.connect()
    con.sql("CREATE TABLE t (name TEXT, src TEXT, size BIGINT, cut BIGINT, observed DOUBLE)")
    con.sql("CREATE TABLE m (name TEXT, i BIGINT, x DOUBLE)")
    con.sql("CREATE TABLE pl (src TEXT, i BIGINT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, 's', ?, ?, ?)", [(t[0], *t[2:]) for t in tests])
    con.executemany("INSERT INTO m VALUES (?, ?, ?)", [(t[0], i, v) for t in tests[:3] for i, v in enumerate(t[1])])
    con.executemany("INSERT INTO pl VALUES ('s', ?, ?)", [(i, v) for i, v in enumerate(tests[3][1])])
    local = permute.permutations_sql("(SELECT * FROM t WHERE name NOT LIKE '%pool')", "m", "name", 100, False)
    whole = permute.permutations_sql("(SELECT * FROM t WHERE name LIKE '%pool')", "pl", "src", 100, True)
    assert got == dict(con.sql(local).fetchall() + con.sql(whole).fetchall())


def test_split_tests_and_trees_against_the_loop(spark):
    rng = np.random.default_rng(6)
    x = {1: np.round(np.concatenate([rng.random(25), rng.random(25) + 0.6]), 2), 2: np.round(rng.random(40), 2)}
    pool = np.sort(np.concatenate(list(x.values())))
    profile = spark.createDataFrame([("s", c, i, float(v)) for c, values in x.items() for i, v in enumerate(values)], "source string, chrom int, i long, x double")
    cuts = [(1, 25), (1, 10), (2, 20)]
    got = {(r.chrom, r.cut): (r.ad, r.p_local, r.p_global) for r in kernels.split_tests(profile, spark.createDataFrame([("s", *c) for c in cuts], "source string, chrom int, cut long"), 60).collect()}
    for c, cut in cuts:
        ad, name = plain_ad(x[c], cut), f"42:s:{c}:{cut}:{len(x[c])}:given"
        assert abs(got[c, cut][0] - ad) < 1e-9 and got[c, cut][1:] == (plain_p(x[c], len(x[c]), cut, ad, name, 60), plain_p(pool, len(x[c]), cut, ad, f"{name}:pool", 60))
    track = profile.selectExpr("*", "true AS kept")
    for r in scan.split_trees(track, 3, 60, 0.05).collect():
        if r.cut is None:
            assert r.end - r.start < 2
            continue
        v, name = x[r.chrom][r.start : r.end], f"42:s:{r.chrom}:{r.start}:{r.end}"
        ads = [round(plain_ad(v, k), 9) for k in range(1, len(v))]
        assert r.cut == r.start + 1 + ads.index(max(ads))
        assert (r.p_local, r.p_global) == tuple(plain_p(y, len(v), r.cut - r.start, r.ad, f"{name}{s}", 60) for y, s in ((v, ""), (pool, ":pool")))
        assert r.accepted == (not r.hypothetical and max(r.p_local, r.p_global) < 0.05)
