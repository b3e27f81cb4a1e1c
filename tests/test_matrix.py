"""Matrices in blocks: written and read, single files, pruning of parts by row, odd files; wide tables by column batches."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from binloom.sources import matrix, tables


@pytest.fixture(scope="module")
def dense():
    x = np.random.default_rng(1).integers(0, 4, (300, 17)).astype(float)
    x[5] = 0
    return x


def read(df):
    return {r.row: list(r.values) for r in df.select("row", F.col("values")).collect()}


def values(df):
    return {r["row"]: list(r["values"]) for r in df.collect()}


def test_single_files(spark, dense, tmp_path):
    np.save(tmp_path / "x.npy", dense.astype("float32"))
    assert values(matrix.read_matrix(spark, f"{tmp_path}/x.npy")) == {i: v.tolist() for i, v in enumerate(dense)}
    assert values(matrix.read_matrix(spark, f"file://{tmp_path}/x.npy").where("row >= 290 AND row < 293")) == {i: dense[i].tolist() for i in (290, 291, 292)}
    rows, cols = np.nonzero(dense)
    os.mkdir(tmp_path / "csr")
    for name, a in (("indptr", np.searchsorted(rows, np.arange(301))), ("indices", cols.astype("int32")), ("data", dense[rows, cols])):
        np.save(tmp_path / "csr" / f"{name}.npy", a)
    sparse = matrix.read_matrix(spark, f"{tmp_path}/csr", "sparse")
    got = {(r["row"], r["column"]): r["value"] for r in matrix.entries(sparse).collect()}
    assert got == {(int(i), int(j)): dense[i, j] for i, j in zip(rows, cols)} and sparse.count() == 300
    assert {r.row: r.n for r in matrix.read_matrix(spark, f"{tmp_path}/csr", "pointers").collect()} == {i: int((dense[i] != 0).sum()) for i in range(300)}
    assert [r.x for r in matrix.dense_row(sparse, 7, 17).orderBy("g").collect()] == dense[7].tolist()
    assert [r.x for r in matrix.dense_row(sparse, 5, 17).orderBy("g").collect()] == [0.0] * 17


@pytest.mark.parametrize("kind", ["dense", "sparse"])
def test_round_trip(spark, dense, tmp_path, kind):
    frame = spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(dense) if i != 40 for j, v in enumerate(row) if v or kind == "dense"], "i long, j long, v double")
    rows = matrix.sparse_rows(frame, "i", "j", "v")
    matrix.write_matrix(rows if kind == "sparse" else rows.drop("columns"), f"{tmp_path}/m", kind)
    found = matrix.read_matrix(spark, f"{tmp_path}/m", kind)
    if kind == "dense":
        assert values(found) == {i: v.tolist() for i, v in enumerate(dense) if i != 40}
    else:
        assert {(r["row"], r["column"], r["value"]) for r in matrix.entries(found).collect()} == {tuple(r) for r in frame.collect()}
    assert sorted(r.row for r in found.where("row IN (3, 40, 41, 999)").collect()) == [3, 41]


def test_pruning(spark, dense, tmp_path, monkeypatch):
    """A filter on row leaves parts out; what it can't push stays with Spark."""
    np.save(tmp_path / "x.npy", dense)
    monkeypatch.setattr(matrix, "PART", 170)
    parts = lambda *f: (lambda r: (list(r.pushFilters(list(f))), r.partitions()))(matrix.MatrixReader(f"{tmp_path}/x.npy", False, False))
    assert len(parts()[1]) == 30
    rest, left = parts(matrix.EqualTo(("row",), 25))
    assert not rest and [(p.lo, p.hi) for p in left] == [(25, 26)]
    rest, left = parts(matrix.GreaterThan(("row",), 270), matrix.EqualTo(("other",), 1))
    assert len(rest) == 1 and sum(p.hi - p.lo for p in left) == 29
    assert parts(matrix.In(("row",), (500, 600)))[1] == [] and parts(matrix.LessThan(("row",), 0))[1] == []
    for first in (0, 100, 200):
        os.makedirs(tmp_path / "blocks", exist_ok=True)
        np.save(tmp_path / "blocks" / f"rows-{first:012d}-{first + 100:012d}-a.npy", dense[first : first + 100])
    r = matrix.MatrixReader(f"{tmp_path}/blocks", False, False)
    list(r.pushFilters([matrix.GreaterThanOrEqual(("row",), 150), matrix.LessThanOrEqual(("row",), 160)]))
    assert {p.first for p in r.partitions()} == {100} and sum(p.hi - p.lo for p in r.partitions()) == 11
    df = matrix.read_matrix(spark, f"{tmp_path}/blocks").where("row = 150")
    assert df.rdd.getNumPartitions() == 1 and values(df) == {150: dense[150].tolist()}


def test_odd_files(spark, tmp_path):
    np.save(tmp_path / "none.npy", np.zeros((0, 3)))
    np.save(tmp_path / "thin.npy", np.zeros((3, 0)))
    assert values(matrix.read_matrix(spark, f"{tmp_path}/none.npy")) == {} and values(matrix.read_matrix(spark, f"{tmp_path}/thin.npy")) == {0: [], 1: [], 2: []}
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 2))))
    for bad in ("f.npy", "missing.npy"):
        with pytest.raises(Exception, match="rows must lie together|missing"):
            matrix.read_matrix(spark, f"{tmp_path}/{bad}").collect()
    with pytest.raises(Exception, match="no such kind"):
        matrix.read_matrix(spark, f"{tmp_path}/none.npy", "other").collect()


def test_wide_table(spark, tmp_path):
    """20,000 columns are summed by column batches, in any order of columns; unknown and repeated members count as said."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (40, 20_000)).astype("float32")
    order = rng.permutation(20_000)
    columns = {"chr": ["1"] * 40, "start": list(range(40)), "end": list(range(1, 41))} | {f"c{k}": x[:, k] for k in order}
    pq.write_table(pa.table(columns), tmp_path / "wide.parquet", row_group_size=16)
    members = spark.createDataFrame([(f"s{k % 3}", f"c{k}") for k in range(20_000)] + [("all", f"c{k}") for k in range(19_990)] + [("s0", "absent")], "source string, cell string")
    got = {(r.source, r.start): r.total for r in tables.sum_by_source(spark, f"{tmp_path}/wide.parquet", members).collect()}
    want = {(f"s{s}", i): float(x[i, s::3].sum()) for s in range(3) for i in range(40)} | {("all", i): float(x[i, :19_990].sum()) for i in range(40)}
    assert got == want
