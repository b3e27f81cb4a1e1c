"""Permutation tests as rows: the order of a permutation is the rank of a hash that any engine can compute.

The hash of a test's name, a replicate's number and a position orders the positions.  The local test
takes the first `cut` positions of the node as the left side; the global one takes the first `size`
positions of the pool, and of these the first `cut` as the left side.  A test is split into blocks of
replicates, rows of their own that any task can take, so one wide node doesn't wait for one task; what
comes back from a block is two numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the hash: a mask of 32 bits, two odd steps, and an odd factor under 2**31, so products fit 64 bits.
MASK, REPLICATE, POSITION, FACTOR = (1 << 32) - 1, 2654435769, 2246822519, 73244475
#: Numbers in one block of a task's arrays.
CELLS = 1 << 20
#: Hashes that one row's replicates take; a test has as many rows as that needs.
WORK = 1 << 22


def name_number(name: str) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[:8], 16)


def order_keys(name: str, replicates: np.ndarray, n: int) -> np.ndarray:
    """For each replicate a row of n different numbers, whose order is the permutation of n positions."""
    start = np.uint64(name_number(name)) ^ (replicates.astype(np.uint64) + np.uint64(1)) * np.uint64(REPLICATE) & np.uint64(MASK)
    at = np.arange(n, dtype=np.uint64)
    h = start[:, None] ^ ((at + np.uint64(1)) * np.uint64(POSITION) & np.uint64(MASK))[None, :]
    for _ in range(2):
        h = (h >> np.uint64(16) ^ h) * np.uint64(FACTOR) & np.uint64(MASK)
    return (h >> np.uint64(16) ^ h) << np.uint64(32) | at


def statistics_of(whole: np.ndarray, left: np.ndarray, size: int, cut: int) -> np.ndarray:
    """The midrank two-sample Anderson-Darling statistic of each row of counts by value; values that a row lacks count nothing."""
    below, mid = np.cumsum(whole, 1) - whole / 2, np.cumsum(left, 1) - left / 2
    d = below * (size - below) - size * whole / 4
    part = np.where(d > 0, whole / size * (size * mid - cut * below) ** 2, 0) / np.where(d > 0, d, 1)
    return part.sum(1) * (1 / cut + 1 / (size - cut)) * (size - 1) / size


def reached(x: np.ndarray, size: int, cut: int, observed: float, name: str, first: int, end: int) -> int:
    """How many of the replicates [first, end) reach the observed statistic; digits beyond the ninth don't count.

    x: the node's values, of which all are taken (size is their number), or a pool's.
    """
    values, rank = np.unique(x, return_inverse=True)
    n, k, count = len(x), len(values), 0
    step = max(1, CELLS // n)
    for lo in range(first, end, step):
        rows = np.arange(lo, min(lo + step, end))
        keys = order_keys(name, rows, n)
        at = np.argpartition(keys, (cut - 1, size - 1) if size < n else cut - 1, axis=1)
        base = np.arange(len(rows))[:, None] * k
        counts = lambda places: np.bincount((base + rank[places]).ravel(), minlength=len(rows) * k).reshape(len(rows), k).astype(float)
        left = counts(at[:, :cut])
        whole = left + counts(at[:, cut:size])
        count += int((np.round(statistics_of(whole, left, size, cut), 9) >= round(observed, 9)).sum())
    return count


def permutation_ps(tests: DataFrame, permutations: int) -> DataFrame:
    """name, p: (1 + replicates that reach the observed statistic) / (permutations + 1) for each test.

    tests: name (of its own for each test), x (the values of the node or the pool), size, cut, observed.
    """
    blocks = F.greatest(F.lit(1), F.least(F.lit(permutations), F.ceil(F.size("x") * F.lit(float(permutations)) / WORK))).cast("int")
    rows = tests.select("name", "x", "size", "cut", "observed", blocks.alias("blocks"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first, end = ((F.floor((F.col("block") + k) * permutations / F.col("blocks"))).cast("int") for k in (0, 1))
    rows = rows.select("name", "x", "size", "cut", "observed", first.alias("first"), end.alias("end"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [reached(np.asarray(x), *r) for x, r in zip(b["x"], zip(b["size"], b["cut"], b["observed"], b["name"], b["first"], b["end"]))]
            yield pd.DataFrame({"name": b["name"], "reached": found})

    # few rows of much work: dealt to a fixed number of tasks, else they would be put in one
    dealt = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "name", "first")
    return dealt.mapInPandas(run, "name string, reached long").groupBy("name").agg(((1 + F.sum("reached")) / (permutations + 1)).alias("p"))


def permutations_sql(tests: str, members: str, by: str, permutations: int, pool: bool) -> str:
    """The same in SQL: name, p of tests (name, `by`, size, cut, observed) over members (`by`, i, x).

    Of a pool, positions are taken whose hash is under a bound that half as many more than needed lie under.
    """
    bound = f"h <= 64 * {MASK}.0 / whole + 1.5 * size * {MASK}.0 / whole" if pool else "true"
    step = f"(xor(h >> 16, h) * {FACTOR}) & {MASK}"
    return f"""SELECT name, (1 + count(*) FILTER (round(ad, 9) >= round(observed, 9))) / {permutations + 1}::DOUBLE AS p FROM (
 SELECT name, r, observed, sum(CASE WHEN d > 0 THEN l / size * power(size * m - cut * ba, 2) / d ELSE 0 END) * (1 / min(cut) + 1 / (min(size) - min(cut))) * (min(size) - 1) / min(size) AS ad FROM (
 SELECT name, r, observed, cut::DOUBLE AS cut, size::DOUBLE AS size, l, ba, m, ba * (size - ba) - size * l / 4 AS d FROM (
 SELECT name, r, observed, cut, size, l, sum(l) OVER w - l / 2 AS ba, sum(f) OVER w - f / 2 AS m FROM (
 SELECT name, r, observed, cut, size, x, count(*)::DOUBLE AS l, count(*) FILTER (k <= cut)::DOUBLE AS f FROM (
 SELECT name, r, observed, cut, size, x, row_number() OVER (PARTITION BY name, r ORDER BY h, i) AS k FROM (
 SELECT * REPLACE (xor(h >> 16, h) AS h) FROM (SELECT * REPLACE ({step} AS h) FROM (SELECT * REPLACE ({step} AS h) FROM (
 SELECT name, r, observed, cut, size, whole, i, x, xor(xor(nid, ((r + 1) * {REPLICATE}) & {MASK}), ((i + 1) * {POSITION}) & {MASK}) AS h
 FROM (SELECT *, ('0x' || substr(md5(name), 1, 8))::BIGINT AS nid, unnest(range({permutations}))::BIGINT AS r FROM {tests}) AS t_
 JOIN (SELECT *, count(*) OVER (PARTITION BY {by}) AS whole FROM {members}) AS m_ USING ({by}))))) WHERE {bound}) WHERE k <= size
 GROUP BY name, r, observed, cut, size, x) WINDOW w AS (PARTITION BY name, r ORDER BY x))) GROUP BY name, r, observed) GROUP BY name"""
