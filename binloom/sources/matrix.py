"""Matrices and graphs on disk as Spark data sources: dense rows (npy) and compressed sparse rows (CSR), in blocks of rows.

A matrix is a folder of blocks.  A dense block is one .npy file; a sparse block is a folder of three,
indptr.npy, indices.npy and data.npy.  A block's name holds its first row and the one after its last,
`rows-<first>-<end>-...`, so a filter on `row` leaves out blocks, and rows of a block, before any file is
opened; a single .npy file and a single folder of the three are a block that starts at row 0.  Parts of
a block are read by their offsets: a task holds PART numbers at most, or one row.

Files are reached by Arrow's file systems (local, HDFS, S3 and the like).
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

#: Numbers of one part.
PART = 1 << 20
BLOCK = re.compile(r"rows-(\d+)-(\d+)-")


def _place(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


class Numbers:
    """An .npy file whose rows are read by their offsets."""

    def __init__(self, files, path: str):
        self.file = files.open_input_file(path)
        version = np.lib.format.read_magic(self.file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, fortran, self.dtype = read(self.file)
        if fortran and len(self.shape) > 1 or self.dtype.hasobject:
            raise ValueError(f"{path}: rows must lie together and be numbers")
        self.start = self.file.tell()

    def rows(self, lo: int, hi: int) -> np.ndarray:
        width = int(np.prod(self.shape[1:], dtype=np.int64))
        size = width * self.dtype.itemsize
        self.file.seek(self.start + lo * size)
        data = self.file.read((hi - lo) * size)
        if len(data) < (hi - lo) * size:
            raise ValueError("the file ends early")
        return np.frombuffer(data, self.dtype).reshape(hi - lo, *self.shape[1:])


@dataclass
class Part(InputPartition):
    """Rows [lo, hi) of the block at a path; its first row has the number `first`."""

    path: str
    first: int
    lo: int
    hi: int

    def __init__(self, path: str, first: int, lo: int, hi: int):
        super().__init__((path, lo))
        self.path, self.first, self.lo, self.hi = path, first, lo, hi


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, sparse: bool, pointers: bool):
        self.path, self.sparse, self.pointers = path, sparse, pointers
        self.least, self.end, self.among = 0, 1 << 62, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps what filters say of `row`; the others are Spark's to apply."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("row",) or isinstance(value, tuple) is not isinstance(f, In) or value is None:
                yield f
            elif isinstance(f, EqualTo):
                self.least, self.end = max(self.least, value), min(self.end, value + 1)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.least = max(self.least, value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                self.end = min(self.end, value + isinstance(f, LessThanOrEqual))
            elif isinstance(f, In):
                wanted = {v for v in value if v is not None}
                self.among = wanted if self.among is None else self.among & wanted
            else:
                yield f

    def _blocks(self) -> list[tuple[str, int, int | None]]:
        """Path, first row and end of each block."""
        from pyarrow import fs

        files, path = _place(self.path)
        whole = files.get_file_info(path)
        if whole.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        inside = [] if whole.is_file else files.get_file_info(fs.FileSelector(path))
        named = [(x.path, m) for x in inside if (m := BLOCK.match(x.base_name))]
        if whole.is_file or any(x.base_name == "indptr.npy" for x in inside):
            return [(path, 0, None)]
        return sorted((p, int(m[1]), int(m[2])) for p, m in named)

    def partitions(self) -> list[InputPartition]:
        """Parts of the blocks that hold wanted rows; of a sparse block's, whose rows have many lengths, the pointers are looked up first."""
        files, out = _place(self.path)[0], []
        for path, first, end in self._blocks():
            lo, hi = max(self.least, first) - first, self.end - first
            if end is not None and (hi <= 0 or lo >= end - first):
                continue
            if self.among is not None:
                mine = [v for v in self.among if v >= first and (end is None or v < end)]
                if not mine:
                    continue
                lo, hi = max(lo, min(mine) - first), min(hi, max(mine) + 1 - first)
            held = Numbers(files, posixpath.join(path, "indptr.npy") if self.sparse else path)
            n = held.shape[0] - self.sparse
            lo, hi = max(0, lo), min(hi, n)
            while lo < hi:
                if self.pointers:
                    to = min(hi, lo + PART)
                elif self.sparse:
                    to = min(hi, lo + PART)
                    at = held.rows(lo, to + 1)
                    to = lo + max(1, int(np.searchsorted(at, at[0] + PART, "right")) - 1)
                else:
                    to = min(hi, lo + max(1, PART // max(1, int(np.prod(held.shape[1:], dtype=np.int64)))))
                out.append(Part(path, first, lo, to))
                lo = to
        return out

    def _kept(self, rows: np.ndarray) -> np.ndarray:
        return np.isin(rows, list(self.among)) if self.among is not None else np.ones(len(rows), bool)

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no rows are wanted
            return
        files, _ = _place(self.path)
        rows = np.arange(part.first + part.lo, part.first + part.hi)
        keep = pa.array(self._kept(rows))
        if not self.sparse:
            x = Numbers(files, part.path).rows(part.lo, part.hi)
            ends = np.arange(len(x) + 1) * int(np.prod(x.shape[1:], dtype=np.int64))
            values = pa.ListArray.from_arrays(ends.astype(np.int32), x.ravel().astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(rows), values], ["row", "values"]).filter(keep)
            return
        held = {c: Numbers(files, posixpath.join(part.path, f"{c}.npy")) for c in ("indptr", *(() if self.pointers else ("indices", "data")))}
        at = held["indptr"].rows(part.lo, part.hi + 1).astype(np.int64)
        if self.pointers:
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.diff(at))], ["row", "n"]).filter(keep)
            return
        ends = (at - at[0]).astype(np.int32)
        columns = pa.ListArray.from_arrays(ends, held["indices"].rows(at[0], at[-1]).astype(np.int64))
        values = pa.ListArray.from_arrays(ends, held["data"].rows(at[0], at[-1]).astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(rows), columns, values], ["row", "columns", "values"]).filter(keep)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class MatrixWriter(DataSourceArrowWriter):
    """Writes each run of consecutive rows of a task as a block; rows come sorted, and no row twice.

    Blocks are written under a hidden name and get theirs on commit, so a task that fails or runs twice leaves none that is read.
    """

    def __init__(self, path: str, sparse: bool):
        self.path, self.sparse = path, sparse

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _place(self.path)
        names = []
        files.create_dir(root)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, values = batch.column("row").to_numpy(), batch.column("values")
            starts = np.flatnonzero(np.append(True, np.diff(rows) != 1)).tolist()
            for lo, hi in zip(starts, [*starts[1:], len(rows)]):
                names.append(f"rows-{rows[lo]:012d}-{rows[hi - 1] + 1:012d}-{uuid.uuid4().hex}" + ".npy" * (not self.sparse))
                name = posixpath.join(root, f".{names[-1]}")
                part = values.slice(lo, hi - lo)
                lengths = part.value_lengths().to_numpy()
                if self.sparse:
                    files.create_dir(name)
                    for c, x in (("indptr", np.append(0, np.cumsum(lengths))), ("indices", batch.column("columns").slice(lo, hi - lo).flatten().to_numpy()), ("data", part.flatten().to_numpy())):
                        self._save(files, posixpath.join(name, f"{c}.npy"), x)
                elif len(set(lengths.tolist())) > 1:
                    raise ValueError("dense rows have one length")
                else:
                    self._save(files, name, part.flatten().to_numpy().reshape(hi - lo, -1))
        return Written(names)

    def commit(self, messages: list) -> None:
        files, root = _place(self.path)
        for name in (n for m in messages if m for n in m.names):
            files.move(posixpath.join(root, f".{name}"), posixpath.join(root, name))

    @staticmethod
    def _save(files, path: str, x: np.ndarray) -> None:
        with files.open_output_stream(path) as out:
            np.lib.format.write_array(out, np.ascontiguousarray(x))

    def abort(self, messages: list) -> None:
        """Hidden blocks are never read; those of tasks that ended are taken away."""
        files, root = _place(self.path)
        for name in (n for m in messages if m for n in m.names):
            hidden = posixpath.join(root, f".{name}")
            (files.delete_dir if self.sparse else files.delete_file)(hidden)


class MatrixSource(DataSource):
    """Format `row_matrix`; options: path, kind (dense: row, values; sparse: row, columns, values; pointers: row, n)."""

    @classmethod
    def name(cls) -> str:
        return "row_matrix"

    @property
    def kind(self) -> str:
        kind = self.options.get("kind", "dense")
        if kind not in ("dense", "sparse", "pointers"):
            raise ValueError(f"no such kind of matrix: {kind}")
        return kind

    def schema(self) -> str:
        return {"dense": "row bigint, values array<double>", "sparse": "row bigint, columns array<bigint>, values array<double>", "pointers": "row bigint, n bigint"}[self.kind]

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options["path"], self.kind != "dense", self.kind == "pointers")

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options["path"], self.kind == "sparse")


def read_matrix(spark: SparkSession, path: str, kind: str = "dense") -> DataFrame:
    spark.dataSource.register(MatrixSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("row_matrix").option("kind", kind).load(path)


def write_matrix(rows: DataFrame, path: str, kind: str = "dense") -> None:
    """Writes rows (of the kind's columns) as blocks; rows are dealt out by ranges, so blocks are few and each has rows of its own."""
    rows.sparkSession.dataSource.register(MatrixSource)
    dealt = rows.repartitionByRange("row").sortWithinPartitions("row")
    dealt.write.format("row_matrix").option("kind", kind).mode("append").save(path)


def sparse_rows(entries: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """row, columns, values of a table of entries."""
    each = F.sort_array(F.collect_list(F.struct(F.col(column).cast("long").alias("c"), F.col(value).cast("double").alias("v"))))
    rows = entries.groupBy(F.col(row).cast("long").alias("row")).agg(each.alias("e"))
    return rows.select("row", F.col("e.c").alias("columns"), F.col("e.v").alias("values"))


def entries(rows: DataFrame) -> DataFrame:
    """row, column, value of sparse rows, which may be a matrix or the edges of a graph."""
    return rows.select("row", F.explode(F.arrays_zip("columns", "values")).alias("e")).select("row", F.col("e.columns").alias("column"), F.col("e.values").alias("value"))


def dense_row(rows: DataFrame, row: int, n: int) -> DataFrame:
    """g, x of one sparse row, zeros included; only the parts that hold the row are read."""
    one = entries(rows.where(F.col("row") == row)).select(F.col("column").alias("g"), F.col("value").alias("x"))
    axis = rows.sparkSession.range(n).withColumnRenamed("id", "g")
    return axis.join(one, "g", "left").select("g", F.coalesce("x", F.lit(0.0)).alias("x"))
