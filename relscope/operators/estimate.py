"""Confidence intervals of means and proportions."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import roles
from ..functions.special import normal_quantile, t_quantile
from . import ranks

#: Samples below this size take Student's quantiles.
SMALL = 30
#: No interval is given for a higher confidence.
HIGHEST = 0.999999


def z_score(confidence: float = 0.95, tails: int = 2) -> float:
    return normal_quantile(1 - (1 - confidence) / tails)


def t_score(dof: float, confidence: float = 0.95, tails: int = 2) -> float:
    return t_quantile(1 - (1 - confidence) / tails, dof)


def critical(n: Column, confidence: float) -> Column:
    """Student's quantile for n - 1 degrees of freedom below 30 rows, else the normal one; null for a single row."""
    table = F.create_map(*(F.lit(x) for k in range(2, SMALL) for x in (k, t_score(k - 1, confidence))))
    return F.when(n < SMALL, F.try_element_at(table, n.cast("int"))).otherwise(z_score(confidence))


def se_mean(std: Column, n: Column) -> Column:
    return std / F.sqrt(F.nullif(n, F.lit(0)))


def se_proportion(p: Column, n: Column) -> Column:
    return F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)))


def margin_of_error(statistic: Column, error: Column) -> Column:
    return F.abs(statistic * error)


def proportion_one_hot(df: DataFrame, column: str) -> DataFrame:
    """(successes, n, proportion) of a 0/1 column; no rows give 0 of 0 and a null proportion."""
    v = F.col(column).cast("int")
    return df.agg(F.coalesce(F.sum(v), F.lit(0)).alias("successes"), F.count(v).alias("n"), F.avg(v).alias("proportion"))


def proportion(successes: float, n: float) -> float | None:
    """Successes over a denominator; None with a warning for none."""
    if n < 0 or successes < 0:
        raise ValueError("counts can't be negative")
    if successes > n:
        raise ValueError("there can't be more successes than observations")
    if not n:
        warnings.warn("a proportion of no observations is undefined", stacklevel=2)
        return None
    return successes / n


def mean_interval(mean: Column, std: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column, Column]:
    """Margin, lower and upper bound."""
    moe = margin_of_error(critical(n, confidence), se_mean(std, n))
    return moe, mean - moe, mean + moe


def proportion_interval(p: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column, Column]:
    """Margin, lower and upper bound, which are not clipped to 0 and 1."""
    moe = margin_of_error(critical(n, confidence), se_proportion(p, n))
    return moe, p - moe, p + moe


def _check(confidence: float) -> None:
    if confidence > HIGHEST:
        raise ValueError(f"confidence must be {HIGHEST} at most")


def proportions(df: DataFrame, category: str, partition: str | None = None, within_partition: bool = True) -> DataFrame:
    """(partition, category, count, size, proportion): shares of all rows, of the partition, or of the category over partitions."""
    by = [c for c in (partition, category) if c]
    n = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in by)).groupBy(*by).agg(F.count("*").alias("count"))
    part = Window.partitionBy(F.lit(1)) if not partition else Window.partitionBy(partition if within_partition else category)
    n = n.withColumn("size", F.sum("count").over(part))
    return n.withColumn("proportion", F.col("count") / F.col("size"))


def proportion_estimates(df: DataFrame, category: str, confidence: float = 0.95, partition: str | None = None, within_partition: bool = True) -> DataFrame:
    """Proportions with their intervals, the most frequent first."""
    _check(confidence)
    n = proportions(df, category, partition, within_partition)
    moe, low, high = proportion_interval(F.col("proportion"), F.col("size"), confidence)
    return n.withColumns({"moe": moe, "lower": low, "upper": high}).orderBy(*([partition] if partition else []), F.desc("proportion"), category)


def mean_estimates(df: DataFrame, y: str, confidence: float = 0.95, by: roles.Names = None) -> DataFrame:
    """(by, size, min, mean, median, max, std, moe, lower, upper), the smallest groups first.

    Without groups ``size`` counts values, with groups it counts rows.
    """
    _check(confidence)
    names, v = roles.names(by), roles.number(df, y)
    size = F.count("*") if names else F.count(v)
    s = df.groupBy(*names).agg(size.alias("size"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.stddev_samp(v).alias("std"))
    s = ranks.with_median(df, s, y, names).select(*names, "size", "min", "mean", "median", "max", "std")
    moe, low, high = mean_interval(F.col("mean"), F.col("std"), F.col("size"), confidence)
    return s.withColumns({"moe": moe, "lower": low, "upper": high}).orderBy("size", "mean", *(F.desc(c) for c in names))


def in_season(df: DataFrame, column: str, season: str) -> DataFrame:
    """Rows of one season."""
    return df.where(F.col(f"`{column}`") == season)


def interval_bars(estimates: DataFrame, value: str, labels: list[str]) -> DataFrame:
    """(label, left, width, middle): floating bars for a plot."""
    label = F.concat_ws(" | ", *(F.col(c).cast("string") for c in labels)) if labels else F.lit("all")
    return estimates.select(label.alias("label"), F.col("lower").alias("left"), (F.col("upper") - F.col("lower")).alias("width"), F.col(value).alias("middle"))
