"""Deterministic bootstrap of cells, dispersion, and edits of a profile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from binloom.functions.stats import log2_ratio, signed_srd

from .segments import PLACE


#: Draws of one task.
DRAWS = 1 << 19
#: Numbers of a tile of cells by segments or replicates.
TILE = 1 << 20


def hashed_number(*parts: Column) -> Column:
    """A reproducible number from 0 to 2**32 - 1 of text parts, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def bootstrap_weights(membership: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """source, rep, cell, w: how often each cell is drawn when a source's cells are drawn with replacement.

    Each (source, rep) has one draw per member; a draw is an ordinal, joined to the member that has it.
    Ordinals are counted within hashed parts of a source, then offset, so no source is sorted as a whole.
    Members are few and their draws many, which Spark can't tell from the members' size: they are dealt to
    tasks of DRAWS draws before they are drawn, and the join says which side is built, never broadcast.
    """
    part = hashed_number(F.col("cell").cast("string")) % 64
    counted = membership.withColumn("part", part)
    sizes = counted.groupBy("source", "part").agg(F.count("*").alias("k"))
    ends = W.partitionBy("source").orderBy("part")  # over at most 64 rows a source
    sizes = sizes.select("source", "part", (F.sum("k").over(ends) - F.col("k")).alias("offset"), F.sum("k").over(W.partitionBy("source")).alias("n"))
    members = counted.join(sizes, ["source", "part"]).withColumn("ordinal", F.col("offset") + F.row_number().over(W.partitionBy("source", "part").orderBy("cell")) - 1)
    rep = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")
    tasks = max(1, -(-membership.count() * replicates // DRAWS))
    drawn = members.select("source", "n", "ordinal").repartition(tasks, "source", "ordinal").select("source", "n", "ordinal", rep)
    number = F.pmod(hashed_number(F.lit(str(seed)), F.col("source"), F.col("rep").cast("string"), F.col("ordinal").cast("string")), F.col("n"))
    weights = drawn.select("source", "rep", number.alias("ordinal")).repartition(tasks, "source", "ordinal").groupBy("source", "rep", "ordinal").agg(F.count("*").alias("w"))
    return weights.join(members.select("source", "ordinal", "cell").hint("shuffle_hash"), ["source", "ordinal"]).select("source", "rep", "cell", "w")


def bootstrap_ratio(levels: DataFrame, weights: DataFrame, a: str, b: str) -> DataFrame:
    """Per source: observed log2(mean a / mean b) of levels (source, cell, a, b), and the replicates' interval, standard error and sign agreement."""
    observed = levels.groupBy("source").agg(log2_ratio(F.avg(a), F.avg(b)).alias("observed"))
    reps = levels.join(weights, ["source", "cell"]).groupBy("source", "rep").agg(log2_ratio(F.sum(F.col(a) * F.col("w")) / F.sum("w"), F.sum(F.col(b) * F.col("w")) / F.sum("w")).alias("v"))
    reps = reps.join(observed, "source")
    return reps.groupBy("source").agg(
        F.first("observed").alias("observed"), F.percentile("v", F.lit(0.025)).alias("ci_low"), F.percentile("v", F.lit(0.975)).alias("ci_high"), F.stddev_samp("v").alias("se"),
        F.avg(F.when(F.signum("v") == F.signum("observed"), 1.0).otherwise(0.0)).alias("sign_agreement"), F.count_if(F.col("v").isNull()).alias("invalid"),
    )


def fano_factors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Population variance over mean, with a status."""
    s = rows.groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))
    status = F.when(F.col("n") < 2, "too_short").when(F.col("mean") <= 0, "zero_mean").otherwise("ok")
    return s.withColumn("status", status).withColumn("fano", F.when(status == "ok", F.col("variance") / F.col("mean"))).drop("variance")


def apply_edit(rows: DataFrame, lo: int, hi: int, kind: str, amount: float, keep_total: bool = False) -> DataFrame:
    """rows with `edited`: x of bins [lo, hi) multiplied, added to or set, not below 0; with keep_total scaled so each chromosome's sum stays."""
    x = F.col("x")
    changed = {"multiply": x * amount, "add": x + amount, "set": F.lit(float(amount))}[kind]
    rows = rows.withColumn("edited", F.when((F.col("i") >= lo) & (F.col("i") < hi), F.greatest(changed, F.lit(0.0))).otherwise(x))
    if keep_total:
        whole = W.partitionBy(*PLACE)
        after = F.sum("edited").over(whole)
        rows = rows.withColumn("edited", F.when(after > 0, F.col("edited") * F.sum("x").over(whole) / after).otherwise(F.col("edited")))
    return rows


def duplicate_region(rows: DataFrame, lo: int, hi: int, to: int, length: int) -> DataFrame:
    """rows with `edited`: bins [to, to + length) repeat the values of [lo, hi) in order, again and again."""
    donors = rows.where((F.col("i") >= lo) & (F.col("i") < hi)).select(*PLACE, (F.col("i") - lo).alias("k"), F.col("x").alias("donor"))
    inside = (F.col("i") >= to) & (F.col("i") < to + length)
    k = F.when(inside, F.pmod(F.col("i") - to, F.lit(hi - lo)))
    return rows.withColumn("k", k).join(donors, [*PLACE, "k"], "left").withColumn("edited", F.coalesce("donor", "x")).drop("k", "donor")


def region_draws(rows: DataFrame, donors: DataFrame, lo: int, hi: int, seed: int = 42) -> DataFrame:
    """rows with `edited`: bins [lo, hi) take the values of donor bins (source, chrom, k, x), k from 0, drawn by a hash of seed, place and bin."""
    n = donors.groupBy(*PLACE).agg(F.count("*").alias("n"))
    picked = donors.select(*PLACE, F.col("k").alias("drawn"), F.col("x").alias("donor"))
    number = hashed_number(F.lit(str(seed)), F.col("source"), F.col("chrom").cast("string"), F.col("i").cast("string"))
    drawn = F.when((F.col("i") >= lo) & (F.col("i") < hi), F.pmod(number, F.col("n")))
    return rows.join(n, PLACE, "left").withColumn("drawn", drawn).join(picked, [*PLACE, "drawn"], "left").withColumn("edited", F.coalesce("donor", "x")).drop("n", "drawn", "donor")


def replicate_sums(cell_segments: DataFrame, weights: DataFrame, replicates: int, first: int = 1) -> DataFrame:
    """source, rep, chrom, seg, y: the sum of x times w over the cells that a replicate drew and that have the segment; no row without such a cell.

    cell_segments: source, cell, chrom, seg, x, where NULL adds nothing; weights: source, rep, cell, w with rep from first to replicates.
    A cell is a row of its segments and one of its draws, never a row for each replicate and segment: tasks multiply
    cells by segments with cells by replicates, a tile of cells at a time, and hand on one array for each segment.
    """
    at = F.shiftleft(F.col("chrom").cast("long"), 32) + F.col("seg")  # both in one number
    vectors = cell_segments.withColumn("at", at).groupBy("source", "cell").agg(F.collect_list("at").alias("at"), F.collect_list(F.coalesce(F.col("x").cast("double"), F.lit(0.0))).alias("x"))
    drawn = weights.groupBy("source", "cell").agg(F.collect_list("rep").alias("rep"), F.collect_list("w").alias("w"))
    width = replicates + 1 - first

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = np.array(b.column("source").to_pylist())
            for source in np.unique(names):
                rows = b.filter(pa.array(names == source))
                columns, where = np.unique(rows.column("at").flatten().to_numpy(), return_inverse=True)
                x, rep, w = (rows.column(c).flatten().to_numpy() for c in ("x", "rep", "w"))
                ends = {c: np.append(0, np.cumsum(rows.column(c).value_lengths().to_numpy())) for c in ("at", "rep")}
                y, n = np.zeros((len(columns), width)), np.zeros((len(columns), width))
                step = max(1, TILE // max(width, len(columns)))
                for lo in range(0, rows.num_rows, step):
                    hi = min(lo + step, rows.num_rows)
                    own, draws = (slice(ends[c][lo], ends[c][hi]) for c in ("at", "rep"))
                    cell = {c: np.repeat(np.arange(hi - lo), np.diff(ends[c][lo : hi + 1])) for c in ("at", "rep")}
                    values, has, counts = np.zeros((hi - lo, len(columns))), np.zeros((hi - lo, len(columns))), np.zeros((hi - lo, width))
                    np.add.at(values, (cell["at"], where[own]), x[own])
                    has[cell["at"], where[own]] = 1
                    counts[cell["rep"], rep[draws] - first] = w[draws]
                    odd = ~np.isfinite(values)
                    for k in np.flatnonzero(odd.any(axis=1)):  # 0 times such a number isn't 0
                        y[odd[k]] += np.where(counts[k] > 0, values[k, odd[k], None] * counts[k], 0)
                    y += np.where(odd, 0, values).T @ counts
                    n += has.T @ (counts > 0).astype(float)
                lists = [pa.ListArray.from_arrays(np.arange(len(columns) + 1, dtype=np.int32) * width, v.ravel()) for v in (y, n)]
                yield pa.RecordBatch.from_arrays([pa.array([source] * len(columns)), pa.array(columns), *lists], ["source", "at", "y", "n"])

    sums = vectors.join(drawn, ["source", "cell"]).mapInArrow(multiplied, "source string, at long, y array<double>, n array<double>")
    each = sums.select("source", "at", F.posexplode(F.arrays_zip("y", "n")).alias("k", "e")).groupBy("source", "at", "k").agg(F.sum("e.y").alias("y"), F.sum("e.n").alias("n"))
    place = [F.shiftright("at", 32).cast("int").alias("chrom"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("seg")]
    return each.where("n > 0").select("source", (F.col("k") + first).alias("rep"), *place, "y")


def flank_replicates(cell_segments: DataFrame, weights: DataFrame, replicates: int) -> DataFrame:
    """source, rep, chrom, seg, delta_left, delta_right of resampled segment means.

    cell_segments: source, cell, chrom, seg, mean.  The weighted sums of a replicate replace copies of its cells.
    """
    rows = replicate_sums(cell_segments.withColumnRenamed("mean", "x"), weights, replicates).withColumnRenamed("y", "m")
    order = W.partitionBy("source", "rep", "chrom").orderBy("seg")
    deltas = {f"delta_{side}": log2_ratio(F.col("m"), f("m").over(order)) for side, f in (("left", F.lag), ("right", F.lead))}
    return rows.withColumns(deltas).drop("m")


def flank_uncertainty(replicates: DataFrame, least: int = 10) -> DataFrame:
    """Per source, chrom and segment: valid replicates, standard errors, covariance of both sides, and why a summary is withheld."""
    both = F.col("delta_left").isNotNull() & F.col("delta_right").isNotNull()
    found = replicates.groupBy(*PLACE, "seg").agg(
        F.count_if(both).alias("n_valid"), F.stddev_samp("delta_left").alias("se_left"), F.stddev_samp("delta_right").alias("se_right"), F.covar_samp("delta_left", "delta_right").alias("covariance"),
        F.count("delta_left").alias("n_left"), F.count("delta_right").alias("n_right"),
    )
    withheld = F.when((F.col("n_left") == 0) | (F.col("n_right") == 0), "terminal").when(F.col("n_valid") < least, "too_few").otherwise("")
    return found.withColumn("withheld", withheld).drop("n_left", "n_right")


def side_replicates(cell_sums: DataFrame, segments: DataFrame, membership: DataFrame, weights: DataFrame, replicates: int) -> DataFrame:
    """source, chrom, seg, side, rep, n_cells, terminal, delta, srd, zero_pair for both sides of every segment; rep 0 is what is observed.

    cell_sums: source, cell, chrom, seg, x without zeros; segments: source, chrom, seg, n.  Every replicate has
    every segment, so one without signal stays the neighbour that it is.  All is drawn as a source of its own.
    """
    draws = weights.select("source", "cell", "rep", "w").union(membership.select("source", "cell", F.lit(0).alias("rep"), F.lit(1).cast("long").alias("w")))
    sums = replicate_sums(cell_sums, draws, replicates, first=0)
    grid = segments.join(membership.groupBy("source").agg(F.count("*").alias("n_cells")), "source").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    rows = grid.join(sums, ["source", "rep", "chrom", "seg"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)) / F.col("n_cells"))
    order = W.partitionBy("source", "rep", "chrom").orderBy("seg")
    sides = [F.struct(F.lit(side).alias("side"), f("y").over(order).alias("y"), f("n").over(order).alias("n")) for side, f in (("left", F.lag), ("right", F.lead))]
    rows = rows.withColumn("flanks", F.array(*sides)).withColumn("r", F.explode("flanks"))
    delta, srd = log2_ratio(F.col("y") / F.col("n"), F.col("r.y") / F.col("r.n")), signed_srd(F.col("y"), F.col("n"), F.col("r.y"), F.col("r.n"))
    terminal = F.col("r.n").isNull()
    return rows.select(*PLACE, "seg", "r.side", "rep", "n_cells", terminal.alias("terminal"), delta.alias("delta"), F.when(~terminal, srd).alias("srd"), F.coalesce((F.col("y") == 0) & (F.col("r.y") == 0), F.lit(False)).alias("zero_pair"))


def side_summary(rows: DataFrame) -> DataFrame:
    """Per segment and side of side_replicates: z_boot = observed delta / its standard error and why it is withheld, whether both totals are zero, and delta's and srd's standard errors, intervals and sign agreement.

    se and z_boot need a delta in every replicate; the se_, low_, high_ and agree_ columns use those that have one, two at least.
    """
    again = F.col("rep") > 0
    found = {"n_missing": F.count_if(again & F.col("delta").isNull()), "n_cells": F.first("n_cells"), "terminal": F.first("terminal"), "zero_pair": F.max(F.when(~again, F.col("zero_pair")))}
    for name in ("delta", "srd"):
        v, sign = F.when(again, F.col(name)), F.signum(F.when(again, F.col(name)))
        found |= {name: F.max(F.when(~again, F.col(name))), f"se_{name}": F.stddev_samp(v), f"low_{name}": F.percentile(v, F.lit(0.025)), f"high_{name}": F.percentile(v, F.lit(0.975)), f"n_{name}": F.count(v), f"up_{name}": F.count_if(sign > 0), f"down_{name}": F.count_if(sign < 0)}
    out = rows.groupBy(*PLACE, "seg", "side").agg(*[c.alias(k) for k, c in found.items()])
    for name in ("delta", "srd"):
        n, up, down = (F.col(f"{k}_{name}") for k in ("n", "up", "down"))
        alike = F.when(F.col(name) > 0, up).when(F.col(name) < 0, down).when(F.col(name) == 0, n - up - down)
        out = out.withColumns({f"agree_{name}": F.when(n > 1, alike / n), **{f"{k}_{name}": F.when(n > 1, F.col(f"{k}_{name}")) for k in ("se", "low", "high")}})
    withheld = F.when(F.col("terminal"), "terminal_flank_missing").when(F.col("n_cells") < 2, "too_few_cells").when(F.col("n_missing") > 0, "nonfinite_replicates").when(F.col("se_delta") == 0, "zero_bootstrap_variance").otherwise("")
    out = out.withColumn("withheld", withheld).withColumn("z_boot", F.when(F.col("withheld") == "", F.col("delta") / F.col("se_delta")))
    return out.withColumn("se", F.when(F.col("withheld").isin("", "zero_bootstrap_variance"), F.col("se_delta")))
