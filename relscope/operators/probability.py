"""Probability models as expressions on columns, and counting."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import roles
from ..functions import draws, special

CLIP = 1e-15


def sampled(df: DataFrame, name: str, values: list, weights: list[float], seed: int = 0, key: roles.Names = None) -> DataFrame:
    """Adds a column drawn from ``values`` by inverting the cumulated weights; with ``key``, columns that tell rows apart, a row's draw follows these."""
    total, upto, draw = sum(weights), 0.0, F.col("_draw")
    out = F.lit(values[-1])
    steps = []
    for v, w in zip(values, weights, strict=True):
        upto += w / total
        steps.append((v, upto))
    for v, u in reversed(steps[:-1]):
        out = F.when(draw < u, F.lit(v)).otherwise(out)
    names = roles.names(key)
    drawn = draws.uniform(seed, *(F.col(f"`{c}`") for c in names)) if names else F.rand(seed)
    return df.withColumn("_draw", drawn).withColumn(name, out).drop("_draw")


def fit_normal(df: DataFrame, column: str) -> DataFrame:
    """(mean, std), the population's."""
    v = roles.number(df, column)
    return df.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def normal_pdf(x: Column, mean: Column, std: Column) -> Column:
    z = (x - mean) / std
    return F.exp(-z * z / 2) / (std * math.sqrt(2 * math.pi))


def normal_cdf(x: Column, mean: Column, std: Column) -> Column:
    return special.normal_cdf((x - mean) / std)


def fit_uniform(df: DataFrame, column: str) -> DataFrame:
    v = roles.number(df, column)
    return df.agg(F.min(v).alias("low"), F.max(v).alias("high"))


def _wide(low: float, high: float) -> None:
    if low == high:
        raise ValueError("the bounds of a uniform distribution must differ")


def uniform_pdf(x: Column, low: float, high: float) -> Column:
    _wide(low, high)
    return F.when((x >= low) & (x <= high), 1 / (high - low)).when(x.isNotNull(), 0.0)


def uniform_cdf(x: Column, low: float, high: float) -> Column:
    _wide(low, high)
    return F.when(x < low, 0.0).when(x > high, 1.0).otherwise((x - low) / (high - low))


def fit_bernoulli(df: DataFrame, column: str) -> DataFrame:
    """(p, std) of a 0/1 column; other values raise."""
    v = F.col(column).cast("double")
    p = df.agg(F.avg(v).alias("p"), F.coalesce(F.bool_or(~v.isin(0.0, 1.0)), F.lit(False)).alias("bad"))
    checked = F.when(~F.col("bad"), F.col("p")).otherwise(F.raise_error("values must be 0 or 1").cast("double"))
    return p.select(checked.alias("p")).select("p", F.sqrt(F.col("p") * (1 - F.col("p"))).alias("std"))


def bernoulli_pmf(x: Column, p: Column) -> Column:
    return F.when(x == 1, p).when(x == 0, 1 - p).when(x.isNotNull(), F.raise_error("values must be 0 or 1").cast("double"))


def binomial_pmf(k: Column, n: Column, p: Column) -> Column:
    """In logarithms, with p kept off 0 and 1; more successes than trials raise."""
    p = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))
    choose = special.lgamma(n + 1.0) - special.lgamma(k + 1.0) - special.lgamma(n - k + 1.0)
    return F.when(k > n, F.raise_error("there can't be more successes than trials").cast("double")).when(k < 0, 0.0).otherwise(F.exp(choose + k * F.log(p) + (n - k) * F.log1p(-p)))


def binomial_steps(k: Column, n: Column, p: Column) -> Column:
    """The probabilities of 0 to k successes."""
    return F.transform(F.sequence(F.lit(0), k.cast("int")), lambda i: binomial_pmf(i, n, p))


def _sum(steps: Column) -> Column:
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    return F.least(F.lit(1.0), _sum(binomial_steps(k, n, p)))


def poisson_pmf(k: Column, rate: Column) -> Column:
    return F.when(k < 0, 0.0).when(rate == 0, F.when(k == 0, 1.0).otherwise(0.0)).otherwise(F.exp(k * F.log(F.nullif(rate, F.lit(0.0))) - rate - special.lgamma(k + 1.0)))


def poisson_steps(upper: Column, rate: Column, lower: Column | None = None) -> Column:
    """The probabilities of ``lower`` (0) to ``upper`` events."""
    return F.transform(F.sequence(F.lit(0) if lower is None else lower.cast("int"), upper.cast("int")), lambda i: poisson_pmf(i, rate))


def poisson_cdf(upper: Column, rate: Column, lower: Column | None = None) -> Column:
    """At most ``upper`` events, and at least ``lower``."""
    return F.when(upper < (F.lit(0) if lower is None else lower), 0.0).otherwise(F.least(F.lit(1.0), _sum(poisson_steps(upper, rate, lower))))


def _whole(value, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{name} must be an integer")
    if value < 0:
        raise ValueError(f"{name} can't be negative")
    return value


def factorial(n: int) -> int:
    return math.factorial(_whole(n, "n"))


def permutations(n: int, k: int) -> int:
    if _whole(k, "k") > _whole(n, "n"):
        raise ValueError("k can't exceed n")
    return math.perm(n, k)


def combinations(n: int, k: int) -> int:
    if _whole(k, "k") > _whole(n, "n"):
        raise ValueError("k can't exceed n")
    return math.comb(n, k)
