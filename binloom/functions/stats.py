"""Scalar statistics as Columns.  An undefined ratio is NULL; nothing is added to make it defined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r6(c: Column | str, name: str) -> Column:
    """The column rounded to six decimals, for tables that are compared."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def log2_ratio(a: Column, b: Column) -> Column:
    """log2(a / b), NULL unless both are positive."""
    return F.when((a > 0) & (b > 0), F.log2(a / b))


def xlogy(x: Column, y: Column) -> Column:
    """x * ln(y), 0 where x is 0."""
    return F.when(x == 0, 0.0).otherwise(x * F.ln(y))


def signed_srd(y_t: Column, e_t: Column, y_r: Column, e_r: Column) -> Column:
    """Signed root of the Poisson deviance of two totals with exposures against their common rate; 0 if both totals are 0, NULL for unusable input."""
    rate = (y_t + y_r) / (e_t + e_r)
    deviance = 2 * (xlogy(y_t, y_t / (e_t * rate)) + xlogy(y_r, y_r / (e_r * rate)))
    root = F.signum(y_t / e_t - y_r / e_r) * F.sqrt(F.greatest(deviance, F.lit(0.0)))
    usable = (e_t > 0) & (e_r > 0) & (y_t >= 0) & (y_r >= 0)
    return F.when(usable, F.when(y_t + y_r == 0, 0.0).otherwise(root))


def zero_pair(y_t: Column, y_r: Column) -> Column:
    """Both totals are zero: an srd of 0 that says nothing."""
    return F.coalesce((y_t == 0) & (y_r == 0), F.lit(False))


def quartiles(x: str) -> list[Column]:
    """Exact quartiles with linear interpolation, as aggregates."""
    return [F.percentile(x, F.lit(p)).alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))]


def with_quartiles(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """df with q1, q2 and q3 of x within the keys' groups."""
    return df.join(df.groupBy(*keys).agg(*quartiles(x)), keys)


def inside_fences(x: str, lower: bool = True) -> Column:
    """x within 1.5 interquartile ranges of the quartiles (columns q1, q3); without `lower`, from 0 to the upper fence."""
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    # values on a fence are inside, whatever the last digit of the quartile
    low = F.round(F.col(x) - F.col("q1") + reach, 9) >= 0 if lower else F.col(x) >= 0
    return low & (F.round(F.col(x) - F.col("q3") - reach, 9) <= 0)


def mean_where(x: str, condition: Column) -> Column:
    return F.avg(F.when(condition, F.col(x)))


def population_skewness(x: str) -> Column:
    return F.skewness(x)


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation; NULL for fewer than three pairs or a constant side, for which corr() raises under ANSI rules."""
    paired = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(paired, F.col(x)), F.when(paired, F.col(y))
    return F.when((F.count(a) >= 3) & (F.var_pop(a) > 0) & (F.var_pop(b) > 0), ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))

