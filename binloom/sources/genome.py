"""The engine's tables as a view of a star schema: cells, ordered bins, a sparse signal, groups of cells and boundaries.

A cell is a supplier, a bin a shipping day, a chromosome a year.  Days on which nothing was shipped are no
bins, so the bins have gaps where the data have some.

The lines are read once for an input: the signal, the profile and what hangs on the lines alone are
written to the shared folder on first use and read from there by every later query of the application.
Spark knows the size of what it reads there, so small tables are broadcast and the rest is not.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from binloom.functions.shared import written

#: Each bin's width in base pairs.
WIDTH = 100_000
#: The tables written for each application and input, by name.
_layout: dict[tuple, DataFrame] = {}


def materialised(make: Callable[[Genome], DataFrame]) -> cached_property:
    """A table of a Genome that is written on first use; another state of the input's files is another table."""

    def get(self: Genome) -> DataFrame:
        key = (*self.input, make.__name__)
        if key not in _layout:
            _layout[key] = written(make(self))
        return _layout[key]

    get.__doc__ = make.__doc__
    return cached_property(get)


class Genome:
    def __init__(self, spark: SparkSession, sf_dir: str, clusters: int = 5):
        self.spark, self.dir, self.clusters = spark, sf_dir, clusters

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def input(self) -> tuple:
        """The application, the folder and its lines' files as they are now."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/lineitem.parquet")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        size = files.getContentSummary(path)
        return self.spark.sparkContext.applicationId, self.dir, self.clusters, size.getLength(), size.getFileCount(), files.getFileStatus(path).getModificationTime()

    @property
    def sources(self) -> list[str]:
        return [*(f"cluster{k}" for k in range(self.clusters)), "all"]

    @cached_property
    def lines(self) -> DataFrame:
        """cell, day, x, status of every line."""
        return self.read("lineitem").select(F.col("l_suppkey").alias("cell"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("x"), F.col("l_linestatus").alias("status"))

    @materialised
    def daily(self) -> DataFrame:
        """cell, day, x, ha, hb: what the lines of a cell and day add up to, their quantity and their numbers by status; all other tables hang on it."""
        said = [F.count_if(F.col("status") == s).alias(to) for s, to in (("F", "ha"), ("O", "hb"))]
        return self.lines.groupBy("cell", "day").agg(F.sum("x").alias("x"), *said)

    @materialised
    def bins(self) -> DataFrame:
        """g, chrom, i, start, end, day; one row per bin, some thousands."""
        start = (F.unix_date("day").cast("long") * WIDTH + 1).alias("start")
        days = self.daily.select("day").distinct().select("day", F.year("day").alias("chrom"), start)
        local = days.withColumn("i", (F.row_number().over(W.partitionBy("chrom").orderBy("day")) - 1).cast("long"))
        size = local.groupBy("chrom").agg(F.count("*").alias("n"))
        before = W.orderBy("chrom").rowsBetween(W.unboundedPreceding, -1)  # over one row per chromosome
        offset = size.select("chrom", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        return local.join(F.broadcast(offset), "chrom").select((F.col("offset") + F.col("i")).alias("g"), "chrom", "i", "start", (F.col("start") + WIDTH - 1).alias("end"), "day")

    @cached_property
    def chroms(self) -> DataFrame:
        return self.bins.groupBy("chrom").agg(F.min("g").alias("offset"), F.count("*").alias("n"), F.min("start").alias("start_bp"), F.max("end").alias("end_bp"))

    @materialised
    def signal(self) -> DataFrame:
        """cell, g, x without zeros; bins are a small table, whose size Spark checks before it broadcasts it."""
        return self.daily.join(self.bins.select("g", "chrom", "i", "day"), "day").select("cell", "g", "chrom", "i", "x")

    def with_sources(self, df: DataFrame) -> DataFrame:
        """df's rows once for each source of their cell; "all" overlaps the clusters."""
        own = F.concat(F.lit("cluster"), (F.col("cell") % self.clusters).cast("string"))
        return df.withColumn("source", F.explode(F.array(own, F.lit("all"))))

    @materialised
    def membership(self) -> DataFrame:
        return self.with_sources(self.signal.select("cell").distinct()).select("source", "cell")

    @materialised
    def profile(self) -> DataFrame:
        """source, chrom, g, i, start, end, x: means over members, absent values counted as 0."""
        members = self.membership.groupBy("source").agg(F.count("*").alias("n_cells"))
        total = self.with_sources(self.signal).groupBy("source", "g").agg(F.sum("x").alias("total"))
        every = self.bins.withColumn("source", F.explode(F.array(*map(F.lit, self.sources))))
        x = F.coalesce("total", F.lit(0.0)) / F.col("n_cells")
        return every.join(total, ["source", "g"], "left").join(members, "source").select("source", "chrom", "g", "i", "start", "end", x.alias("x"))

    def cut_here(self) -> Column:
        """Whether a boundary lies before a bin of `profile` joined with its day."""
        opens = F.coalesce(F.month("day") != F.lag(F.month("day")).over(W.partitionBy("source", "chrom").orderBy("i")), F.lit(False))
        cluster = F.when(F.col("source") != "all", F.substring("source", 8, 3).cast("int"))
        chosen = (F.col("source") == "all") | ((F.month("day") + cluster) % 3 != 0)
        return (F.col("i") > 0) & ((opens & chosen) | ((F.dayofmonth("day") == 10) & (F.month("day") % 3 == 0)))

    @materialised
    def boundaries(self) -> DataFrame:
        """source, chrom, bin: the first bin of each segment but a chromosome's first."""
        every = self.bins.withColumn("source", F.explode(F.array(*map(F.lit, self.sources))))
        return every.withColumn("cut", self.cut_here()).where("cut").select("source", "chrom", F.col("i").alias("bin"))
