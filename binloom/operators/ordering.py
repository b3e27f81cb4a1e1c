"""Places in sorted order without sorting all rows, or all rows of a key, in one task.

Rows are dealt to tasks by ranges of the order and numbered within each; what lies before a range is added
from a table of one row for each key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from binloom.functions.shared import written


def running_total(df: DataFrame, keys: list[str], order: list[Column | str], weight: Column | None = None, name: str = "before") -> DataFrame:
    """df with the sum of `weight` (one a row) over the rows of its key that come before it in the order; the order has no ties within a key."""
    placed = df.withColumn("_weight", F.lit(1).cast("long") if weight is None else weight).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    placed = written(placed)  # a row's range stays what it is
    before = (W.unboundedPreceding, -1)
    within = F.sum("_weight").over(W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(*before))
    ranges = placed.groupBy("_part", *keys).agg(F.sum("_weight").alias("_total"))
    offset = ranges.select("_part", *keys, F.coalesce(F.sum("_total").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(*before)), F.lit(0)).alias("_offset"))
    rows = placed.join(offset, ["_part", *keys]).withColumn(name, F.col("_offset") + F.coalesce(within, F.lit(0)))
    return rows.drop("_part", "_weight", "_offset")


def value_counts(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, x, count, before (rows with smaller values) and total (rows of the key): a row for each distinct value, NULL ones left out."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("count"))
    rows = running_total(counts, keys, [x], F.col("count"))
    if not keys:
        return rows.withColumn("total", F.lit(rows.agg(F.sum("count")).first()[0] or 0))
    return rows.join(counts.groupBy(*keys).agg(F.sum("count").alias("total")), keys)


def value_at(df: DataFrame, keys: list[str], x: str, places: dict[str, Column]) -> DataFrame:
    """Per key the values at the given places, from 0, of the sorted values; places may use the column `total`."""
    rows = value_counts(df, keys, x)
    inside = lambda p: (F.col("before") <= p) & (p < F.col("before") + F.col("count"))
    return rows.groupBy(*keys).agg(*[F.max(F.when(inside(p), F.col(x))).alias(name) for name, p in places.items()])


def upper_medians(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Per key the value at place n // 2 as v."""
    return value_at(df, keys, x, {"v": F.floor(F.col("total") / 2)})


def with_average_rank(df: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """df with the rank of x within its key; equal values share the mean of their ranks, NULL ones have none."""
    ranks = value_counts(df, keys, x).select(*keys, x, (F.col("before") + (F.col("count") + 1) / 2).alias(name))
    return df.join(ranks, [*keys, x], "left")
