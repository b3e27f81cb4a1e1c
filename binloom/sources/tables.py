"""Reading and checking the engine's input tables, and writing its results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "cellID string, raw_coverage long, tercile string, n_segments int, best_s double, frac_loss double, frac_gain double, frac_base double"
BINS = "seq string, start long, end long, bin_in_chrom int"
BREAKPOINTS = "cell string, seq string, breakpoint int, ad_dist double, p_value_local double, p_value_global double"
EDGES = "graph string, source string, target string, weight double"
COORDINATES = ["chr", "start", "end"]
#: The copy-number levels of a call.
LEVELS = (0.0, 0.5, 1.0, 1.5, 2.0)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A table with a header; a row that doesn't fit the schema fails the read."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep, mode="FAILFAST", enforceSchema=False)


def registry(spark: SparkSession, folder: str, needed: list[str], optional: list[str]) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """The Parquet tables of a folder that are there, and (name, problem or note) for those that aren't: a needed one is a problem."""
    found, said = {}, []
    for name in [*needed, *optional]:
        try:
            found[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            said.append((name, "problem" if name in needed else "note"))
    return found, said


def bad_levels(calls: DataFrame, column: str = "cn") -> DataFrame:
    """The rows whose level is none of LEVELS, NULL and NaN among them."""
    return calls.where(~F.coalesce(F.col(column).isin(*LEVELS), F.lit(False)))


def level_codes(calls: DataFrame, column: str = "cn") -> DataFrame:
    """calls with `code`, twice the level as a small integer."""
    return calls.withColumn("code", F.rint(F.col(column) * 2).cast("smallint"))


def wide_columns(wide: DataFrame) -> list[str]:
    """The barcodes of a matrix with a row a bin and a column a cell."""
    return [c for c in wide.columns if c not in COORDINATES]


def sum_by_source(spark: SparkSession, path: str, members: DataFrame, columns: int = 200, rows: int = 4096) -> DataFrame:
    """source, chr, start, end, total of a wide Parquet table at a path; columns are matched by barcode.

    members: source, cell; a cell may have several sources, and cells that the table lacks count nothing.  A
    task reads some columns of a file, straight from its column groups and some rows at a time, and hands on
    one sum a source and bin: no row and no plan has all columns, and the table is never turned on its side.
    """
    wide = spark.read.parquet(path)
    place = spark.createDataFrame([(c, k // columns) for k, c in enumerate(wide_columns(wide))], "cell string, batch int")
    mine = members.select("source", "cell").distinct().join(place, "cell").groupBy("batch", "source").agg(F.collect_list("cell").alias("cells"))
    batches = mine.groupBy("batch").agg(F.collect_list(F.struct("source", "cells")).alias("sources"))
    work = batches.withColumn("file", F.explode(F.array(*map(F.lit, wide.inputFiles()))))

    def summed(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item in (r for b in items for r in b.to_pylist()):
            sources = {s["source"]: s["cells"] for s in item["sources"]}
            needed = sorted({c for cells in sources.values() for c in cells})
            files, file = fs.FileSystem.from_uri(item["file"])
            with files.open_input_file(file) as f:
                for part in pq.ParquetFile(f).iter_batches(rows, columns=[*COORDINATES, *needed]):
                    x = np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in needed])
                    at = {c: k for k, c in enumerate(needed)}
                    for source, cells in sources.items():
                        total = np.nansum(x[[at[c] for c in cells]], axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array([source] * part.num_rows), *(part.column(c).cast(t) for c, t in zip(COORDINATES, (pa.string(), pa.int64(), pa.int64()))), pa.array(total)], ["source", *COORDINATES, "total"])

    dealt = work.repartition(spark.sparkContext.defaultParallelism * 4, "batch", "file")
    return dealt.mapInArrow(summed, "source string, chr string, start long, end long, total double").groupBy("source", *COORDINATES).agg(F.sum("total").alias("total"))


def input_problems(wide: DataFrame, bins: DataFrame, cells: DataFrame, name: str) -> DataFrame:
    """name, problem, n: bins (chr, start, end) and barcodes (cell) that a wide matrix lacks or has beyond the given ones; no rows, no problem."""
    own = wide.sparkSession.createDataFrame([(c,) for c in wide_columns(wide)], "cell string")
    return axis_problems(wide, own, bins, cells, name)


def axis_problems(rows: DataFrame, own: DataFrame, bins: DataFrame, cells: DataFrame, name: str) -> DataFrame:
    """input_problems of a matrix with any number of cells, given as its bins, a row each, and the table of its barcodes."""
    have, want = rows.select(*COORDINATES), bins.select(*COORDINATES)
    sides = {"bins_missing": want.exceptAll(have), "bins_extra": have.exceptAll(want), "barcodes_missing": cells.select("cell").subtract(own), "barcodes_extra": own.subtract(cells.select("cell"))}
    rows = None
    for problem, side in sides.items():
        row = side.agg(F.lit(name).alias("name"), F.lit(problem).alias("problem"), F.count("*").alias("n"))
        rows = row if rows is None else rows.union(row)
    return rows.where("n > 0")


def sums_agree(total: DataFrame, a: DataFrame, b: DataFrame, cells: list[str]) -> DataFrame:
    """The bins and cells at which the first matrix isn't the sum of the other two, by 1e-8 and a part in 1e5."""
    long = [df.select(*COORDINATES, *[F.col(f"`{c}`").cast("double") for c in cells]).unpivot(COORDINATES, [f"`{c}`" for c in cells], "cell", x) for df, x in ((total, "t"), (a, "a"), (b, "b"))]
    rows = long[0].join(long[1], [*COORDINATES, "cell"]).join(long[2], [*COORDINATES, "cell"])
    sum_ = F.col("a") + F.col("b")
    return rows.where(F.abs(F.col("t") - sum_) > 1e-8 + 1e-5 * F.abs(sum_))


def with_cluster(cells: DataFrame, clusters: DataFrame) -> DataFrame:
    """cells with their cluster; a cell without one fails the job that reads it."""
    rows = cells.join(clusters, "cell", "left")
    missing = F.raise_error(F.concat(F.lit("cell without a cluster: "), F.col("cell").cast("string")))
    return rows.withColumn("cluster", F.when(F.col("cluster").isNotNull(), F.col("cluster")).otherwise(missing.cast("string")))


def packed_codes(calls: DataFrame, key: str = "cell") -> DataFrame:
    """key and one byte a bin, in the order of g, as a binary column: a row as long as the axis."""
    ordered = F.sort_array(F.collect_list(F.struct("g", F.lpad(F.hex("code"), 2, "0").alias("h"))))
    return calls.groupBy(key).agg(F.unhex(F.array_join(F.transform(ordered, lambda v: v["h"]), "")).alias("codes"))


def write_segmentation(breakpoints: DataFrame, audit: DataFrame, folder: str, inputs: str, settings: dict) -> None:
    """Breakpoints and audit as tab-separated tables, and the run's settings and counts as JSON, in folders below `folder`.

    Nothing is written into the folder that the inputs come from.
    """
    if folder.rstrip("/") == inputs.rstrip("/"):
        raise ValueError("the results' folder holds the inputs")
    for name, df in (("accepted_breakpoints", breakpoints), ("candidate_audit", audit)):
        df.write.csv(f"{folder}/{name}", sep="\t", header=True)
    row = {"n_breakpoints": breakpoints.count(), "n_audit_rows": audit.count()} | settings
    breakpoints.sparkSession.createDataFrame([tuple(row.values())], [*row]).write.json(f"{folder}/run")


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """keys, column, a, b (as text) of every cell of two tables that differs, and of rows that one lacks (column NULL).

    Numbers may differ by the tolerance and as large a part of b; NaN equals NaN; all else must be equal.
    """
    columns = [c for c in a.columns if c not in keys]
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the tables have unlike columns")
    numbers = {f.name for f in a.schema.fields if f.dataType.typeName() in ("double", "float")}
    both = a.select(*keys, F.struct(*columns).alias("a")).join(b.select(*keys, F.struct(*columns).alias("b")), keys, "full")

    def differs(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c not in numbers:
            return ~x.eqNullSafe(y)
        near = F.coalesce(F.abs(x - y) <= tolerance + tolerance * F.abs(y), F.lit(False)) | x.eqNullSafe(y)
        return ~near

    shown = [F.when(differs(c), F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").cast("string").alias("a"), F.col(f"b.{c}").cast("string").alias("b"))) for c in columns]
    lone = F.col("a").isNull() | F.col("b").isNull()
    none = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.when(F.col("a").isNotNull(), "row").alias("a"), F.when(F.col("b").isNotNull(), "row").alias("b")))
    found = F.when(lone, none).otherwise(F.filter(F.array(*shown), lambda v: v.isNotNull()))
    return both.select(*keys, F.explode(found).alias("d")).select(*keys, "d.*")


def reproduced(found: DataFrame, stored: DataFrame, keys: list[str], value: str, tolerance: float = 5e-5) -> DataFrame:
    """status, n_rows, n_match, largest: whether both tables have the same keys and, within the tolerance, the same values."""
    both = found.select(*keys, F.col(value).alias("x"), F.lit(True).alias("here")).join(stored.select(*keys, F.col(value).alias("y"), F.lit(True).alias("there")), keys, "full")
    gap = F.abs(F.col("x") - F.col("y"))
    counts = both.agg(F.count_if(F.col("here").isNull() | F.col("there").isNull()).alias("lone"), F.count("*").alias("n_rows"), F.count_if(gap <= tolerance).alias("n_match"), F.max(gap).alias("largest"))
    status = F.when(F.col("lone") > 0, "segments_differ").when((F.col("n_rows") > 0) & (F.col("n_rows") == F.col("n_match")), "ok").otherwise("values_differ")
    return counts.select(status.alias("status"), "n_rows", "n_match", "largest")
