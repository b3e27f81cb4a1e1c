"""Partitions, segment summaries and flank scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from binloom.functions.stats import log2_ratio, signed_srd

PLACE = ["source", "chrom"]
LEVELS = ("mean", "median", "iqr_mean")


def flat_partition(boundaries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Half-open segments (source, chrom, seg, s, e) between boundaries (source, chrom, bin) of chromosomes (source, chrom, n).

    Boundaries outside (0, n) and repeated ones are harmless: empty segments are dropped.
    """
    inner = boundaries.join(sizes, PLACE).where("bin > 0 AND bin < n").select(*PLACE, F.col("bin").alias("s"), "n")
    starts = inner.union(sizes.select(*PLACE, F.lit(0).cast("long"), "n")).distinct()
    order = W.partitionBy(*PLACE).orderBy("s")
    return starts.select(*PLACE, (F.row_number().over(order) - 1).cast("long").alias("seg"), "s", F.coalesce(F.lead("s").over(order), "n").alias("e"))


def labelled(profile: DataFrame, boundaries: DataFrame) -> DataFrame:
    """profile with `seg`, numbered from 0 along each chromosome: a running count of boundaries, no interval join."""
    flags = boundaries.select(*PLACE, F.col("bin").alias("i")).distinct().withColumn("cut", F.lit(1))
    order = W.partitionBy(*PLACE).orderBy("i")
    marked = profile.join(flags, [*PLACE, "i"], "left")
    cut = F.when(F.col("i") > 0, F.coalesce("cut", F.lit(0))).otherwise(0)
    return marked.withColumn("seg", F.sum(cut).over(order).cast("long")).drop("cut")


def _summary(x: str) -> list[Column]:
    """The aggregates of level_summary; a group is at most a chromosome's bins, so its values fit in a row."""
    return [
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.avg(F.when(F.col(x) == 0, 1.0).otherwise(0.0)).alias("zero_fraction"),
        F.percentile(x, F.lit(0.25)).alias("q1"), F.percentile(x, F.lit(0.5)).alias("median"), F.percentile(x, F.lit(0.75)).alias("q3"), F.collect_list(x).alias("values"),
    ]


def _retained(df: DataFrame) -> DataFrame:
    """Adds iqr_mean and retained, of the values within the fences, and cv."""
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    kept = F.filter("values", lambda v: (F.round(v - F.col("q1") + reach, 9) >= 0) & (F.round(v - F.col("q3") - reach, 9) <= 0))
    df = df.withColumn("values", kept).withColumn("retained", F.size("values").cast("long"))
    mean = F.aggregate("values", F.lit(0.0), lambda acc, v: acc + v) / F.col("retained")
    return df.withColumns({"iqr_mean": F.when(F.col("retained") > 0, mean), "cv": F.when(F.col("mean") > 0, F.col("std") / F.col("mean"))}).drop("values", "q1", "q3")


def level_summary(rows: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Per group: n, mean, median, iqr_mean of the retained values, retained, std (n - 1), cv (mean > 0), zero_fraction."""
    return _retained(rows.groupBy(*keys).agg(*_summary(x))).select(*keys, "n", "mean", "median", "iqr_mean", "retained", "std", "cv", "zero_fraction")


def segment_summaries(labelled_rows: DataFrame) -> DataFrame:
    """level_summary of each segment with s, e, start, end, sum and variance (population).

    Labels come from a window over (source, chrom); that partitioning serves this aggregate and the
    flanks' windows too, so the profile is shuffled once.
    """
    bounds = [F.min("i").alias("s"), (F.max("i") + 1).alias("e"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("x").alias("sum"), F.var_pop("x").alias("variance")]
    return _retained(labelled_rows.groupBy(*PLACE, "seg").agg(*bounds, *_summary("x")))


def _dispersion() -> tuple[Column, Column]:
    """A segment's Pearson sum and degrees of freedom, if it has two bins or more and a positive mean."""
    used = (F.col("n") >= 2) & (F.col("mean") > 0)
    return F.when(used, F.col("variance") * F.col("n") / F.col("mean")), F.when(used, F.col("n") - 1)


def pooled_phi(labelled_rows: DataFrame) -> DataFrame:
    """Per (source, chrom) the Pearson dispersion of the whole partition: segments of two bins or more with a positive mean; NULL without any."""
    pearson, freedom = _dispersion()
    per = labelled_rows.groupBy(*PLACE, "seg").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))
    return per.groupBy(*PLACE).agg((F.sum(pearson) / F.sum(freedom)).alias("phi"))


def with_flanks(summaries: DataFrame, columns: list[str]) -> DataFrame:
    """summaries with each column of both neighbours as column_left and column_right."""
    order = W.partitionBy(*PLACE).orderBy("seg")
    return summaries.withColumns({f"{c}_{side}": f(c).over(order) for side, f in (("left", F.lag), ("right", F.lead)) for c in columns})


def flank_scores(labelled_rows: DataFrame) -> DataFrame:
    """Per internal segment: srd, srd_phi and log2 fold changes of three levels against both neighbours, and whether a gap lies between."""
    whole = W.partitionBy(*PLACE)
    pearson, freedom = _dispersion()
    rows = segment_summaries(labelled_rows).withColumn("phi", F.sum(pearson).over(whole) / F.sum(freedom).over(whole))
    rows = with_flanks(rows, ["sum", "n", "start", "end", *LEVELS]).where("n_left IS NOT NULL AND n_right IS NOT NULL")
    out: dict[str, Column] = {}
    for side in ("left", "right"):
        srd = signed_srd(F.col("sum"), F.col("n"), F.col(f"sum_{side}"), F.col(f"n_{side}"))
        out[f"srd_{side}"] = srd
        out[f"srd_phi_{side}"] = F.when(F.col("phi") > 0, srd / F.sqrt("phi"))
        for level in LEVELS:
            out[f"delta_{level}_{side}"] = log2_ratio(F.col(level), F.col(f"{level}_{side}"))
    out["gap_left"] = F.col("start") > F.col("end_left") + 1
    out["gap_right"] = F.col("start_right") > F.col("end") + 1
    rows = rows.withColumns(out)
    return rows.select(*PLACE, "seg", "s", "e", "n", "mean", "median", "iqr_mean", "phi", *out)


def weaker_side(left: Column, right: Column) -> Column:
    """left, right or tie by the smaller absolute value; NULL unless both sides are there."""
    a, b = F.abs(left), F.abs(right)
    return F.when(a < b, "left").when(b < a, "right").when(a == b, "tie")


def smaller_side(left: Column, right: Column) -> Column:
    """As weaker_side, but a missing side loses and a tie goes left."""
    a, b = F.abs(left), F.abs(right)
    return F.when(b.isNull() & a.isNotNull(), "left").when(a.isNull() & b.isNotNull(), "right").when(a <= b, "left").when(b < a, "right")


def sign_mismatch(left: Column, right: Column) -> Column:
    """Strictly opposite signs; zero and NULL never count."""
    return F.coalesce(left * right < 0, F.lit(False))


def merge_proposal(left: Column, right: Column, threshold: float) -> tuple[Column, Column, Column]:
    """Which sides' absolute scores lie below the threshold, and of two such sides the weaker, both on a tie."""
    ok = [F.coalesce(F.abs(c) < threshold, F.lit(False)) for c in (left, right)]
    side = weaker_side(left, right)
    return ok[0], ok[1], F.when(ok[0] & ok[1], F.when(side == "tie", "both").otherwise(side)).when(ok[0], "left").when(ok[1], "right")


def ambiguity(srd: tuple[Column, Column], delta: tuple[Column, Column]) -> Column:
    """Whether the weaker sides by two scores agree."""
    a, b = weaker_side(*srd), weaker_side(*delta)
    return F.when(a.isNull() | b.isNull(), "undefined").when((a == "tie") | (b == "tie"), "no_unique_preference").when(a == b, "consistent").otherwise("ambiguous")


def assign_proposal(srd: tuple[Column, Column], delta: tuple[Column, Column], srd_ref: float = 3.3, tau: float = 0.20) -> Column:
    """What to do with a small segment by its strong sides, those that reach both thresholds.

    Both strong: it stays, for certain only if it stands above or below both.  One strong: it goes to
    the weak side.  None: to the side of the smaller fold change, left on a tie.
    """
    left, right = [(F.abs(s) >= srd_ref) & (F.abs(d) >= tau) for s, d in zip(srd, delta)]
    alike = (F.signum(srd[0]) == F.signum(srd[1])) & (F.signum(srd[0]) != 0)
    return (
        F.when(left & right, F.when(alike, "keep_focal").otherwise("ambiguous_keep")).when(right, "merge_left").when(left, "merge_right")
        .when(F.abs(delta[0]) <= F.abs(delta[1]), "merge_left").otherwise("merge_right")
    )


def spliced_ids(rows: DataFrame, chrom: int, cuts: list[int]) -> DataFrame:
    """rows (source, chrom, i, id) with the chromosome's segments cut anew: they get numbers above the source's largest, others keep theirs."""
    top = F.max("id").over(W.partitionBy("source"))
    new = top + 1 + sum(((F.col("i") >= b).cast("int") for b in sorted({b for b in cuts if b > 0})), F.lit(0))
    return rows.withColumn("id", F.when(F.col("chrom") == chrom, new).otherwise(F.col("id")))


def exposures(labelled_rows: DataFrame) -> DataFrame:
    """source, chrom, seg, exposure: the bins of each segment that are usable."""
    return labelled_rows.groupBy(*PLACE, "seg").agg(F.count_if("usable").alias("exposure"))


def trimmed_means(rows: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Per key the mean of the finite values within the fences, the plain mean if none is; NULL without finite values."""
    finite = rows.where(F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = level_summary(finite, keys, x).select(*keys, F.coalesce("iqr_mean", "mean").alias("level"))
    return rows.select(*keys).distinct().join(found, keys, "left")
