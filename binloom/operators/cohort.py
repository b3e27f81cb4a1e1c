"""Choosing, ordering and comparing cells; joins of intervals and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import value_at


def cohort_filter(cells: DataFrame, contains: str = "", terciles: list[str] | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Cells whose id has the text (any case), of the terciles, with coverage within the bounds."""
    keep = F.upper(F.col("cell").cast("string")).contains(contains.upper())
    if terciles:
        keep &= F.col("tercile").isin(terciles)
    if low is not None:
        keep &= F.col("coverage") >= low
    if high is not None:
        keep &= F.col("coverage") <= high
    return cells.where(keep)


def terciles(cells: DataFrame, x: str) -> DataFrame:
    """low, mid, high by the values at sorted positions n // 3 and 2n // 3."""
    cuts = value_at(cells, [], x, {"t1": F.floor(F.col("total") / 3), "t2": F.floor(2 * F.col("total") / 3)}).first()  # two values
    t1, t2 = F.lit(cuts.t1), F.lit(cuts.t2)
    return cells.withColumn("tercile", F.when(F.col(x) < t1, "low").when(F.col(x) < t2, "mid").otherwise("high"))


def region_event(states: DataFrame, lo: int, hi: int, wanted: list[float], least: float) -> DataFrame:
    """cell, n_bins, n_match, matches: whether enough of a region's bins have a wanted state; no bins, no verdict (NULL)."""
    found = states.groupBy("cell").agg(F.count_if(F.col("start").between(lo, hi)).alias("n_bins"), F.count_if(F.col("start").between(lo, hi) & F.col("state").isin(wanted)).alias("n_match"))
    return found.withColumn("matches", F.when(F.col("n_bins") > 0, (F.col("n_match") > 0) & (F.col("n_match") / F.col("n_bins") >= least)))


def combine_events(events: list[DataFrame], mode: str) -> DataFrame:
    """cell, n_ready, n_match, selected: any or all of the rules that have a verdict; a pending rule never counts as false."""
    rows = events[0]
    for more in events[1:]:
        rows = rows.union(more)
    out = rows.groupBy("cell").agg(F.count("matches").alias("n_ready"), F.count_if("matches").alias("n_match"))
    enough = F.col("n_match") > 0 if mode == "any" else F.col("n_match") == F.col("n_ready")
    return out.withColumn("selected", (F.col("n_ready") > 0) & enough)


def top_k(rows: DataFrame, keys: list[str], weight: str, tie: str, k: int) -> DataFrame:
    """The k heaviest rows of each key, ties by `tie`, with their rank."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(weight), tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of both labels together, each side's total, and whether b is a's largest overlap (the smaller label on ties)."""
    n = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    best = F.row_number().over(W.partitionBy(a).orderBy(F.desc("n"), b)) == 1
    return n.withColumns({"n_a": F.sum("n").over(W.partitionBy(a)), "n_b": F.sum("n").over(W.partitionBy(b)), "largest": best})


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared length of two half-open intervals, 0 if they are apart."""
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """Pairs of intervals (a_s, a_e) and (b_s, b_e) of equal keys that overlap, with the shared length.

    Both sides are put on tiles and joined by tile; a pair is kept on the tile where its overlap starts.
    """
    def tiled(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.where(F.col(s) < F.col(e)).withColumn("tile", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))

    both = tiled(a, "a_s", "a_e").join(tiled(b, "b_s", "b_e"), [*keys, "tile"])
    shared = overlap(F.col("a_s"), F.col("a_e"), F.col("b_s"), F.col("b_e"))
    return both.withColumn("shared", shared).where((F.col("shared") > 0) & (F.floor(F.greatest("a_s", "b_s") / width) == F.col("tile"))).drop("tile")


def nearest_boundary(positions: DataFrame, bins: DataFrame, width: int = 6_400_000) -> DataFrame:
    """The boundary (bin number) nearest to each bp: its own bin's start, or the next one's past the bin's middle; 0 before the first bin.

    A bin reaches to the next one's start.  Bins are put on tiles of `width` bp and joined to positions by
    tile, so positions, of any number, are neither sorted nor gathered; the few after the last tile are joined by chromosome.
    """
    order = W.partitionBy("chrom").orderBy("start")
    reach = bins.select("chrom", "i", "start", "end", F.lead("start").over(order).alias("to"))
    tiled = reach.where("to IS NOT NULL").withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("to") - 1) / width))))
    last = reach.where("to IS NULL").select("chrom", F.col("i").alias("last_i"), F.col("start").alias("last_start"), F.col("end").alias("last_end"))
    asked = positions.withColumn("tile", F.floor(F.col("bp") / width))
    inside = (asked["chrom"] == tiled["chrom"]) & (asked["tile"] == tiled["tile"]) & (asked["bp"] >= tiled["start"]) & (asked["bp"] < tiled["to"])
    rows = asked.join(tiled, inside, "left").select("id", asked["chrom"], "bp", "i", "start", "end").join(last, "chrom", "left")
    beyond = F.col("bp") >= F.col("last_start")
    i, middle = F.when(beyond, F.col("last_i")).otherwise(F.col("i")), F.when(beyond, F.col("last_start") + F.col("last_end")).otherwise(F.col("start") + F.col("end")) / 2
    return rows.select("id", "chrom", "bp", F.when(i.isNull(), 0).otherwise(i + F.when(F.col("bp") > middle, 1).otherwise(0)).alias("boundary"))
