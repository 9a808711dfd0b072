"""Mergeable statistics under Structured Streaming; rank-based tests can't run incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(stream: DataFrame, group: str, y: str) -> DataFrame:
    """(level, n, mean, var_pop) per group, for output mode complete: what ANOVA and t-tests need."""
    v = F.col(y).cast("double")
    return stream.where(F.col(group).isNotNull() & v.isNotNull()).groupBy(F.col(group).alias("level")).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var_pop"))


def contingency(stream: DataFrame, a: str, b: str) -> DataFrame:
    """(la, lb, n), for output mode complete: what chi-squared tests need."""
    return stream.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("la"), F.col(b).alias("lb")).agg(F.count("*").alias("n"))


def windowed_moments(stream: DataFrame, time: str, group: str, y: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Moments per window and group; rows later than the watermark don't count."""
    v = F.col(y).cast("double")
    return stream.withWatermark(time, late).groupBy(F.window(time, window), F.col(group).alias("level")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var_pop"))
