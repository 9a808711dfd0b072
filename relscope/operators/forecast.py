"""Seasonal sales from purchase frequencies: Poisson counts times mean prices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import roles
from ..functions import draws
from . import probability

#: Days between purchases of a frequency label.
DAYS = {"Weekly": 7.0, "Fortnightly": 14.0, "Bi-Weekly": 3.5, "Monthly": 365 / 12, "Quarterly": 365 / 4, "Every 3 Months": 365 / 4, "Annually": 365.0}
SEASONS = ("Winter", "Spring", "Summer", "Fall")
#: Periods of a season.
PERIODS = {"Weeks": (365 / 4) / (365 / 52), "Months": 3.0, "Quarters": 1.0, "Seasons": 1.0}


@dataclass(frozen=True)
class Columns:
    frequency: str = "Frequency of Purchases"
    previous: str = "Previous Purchases"
    season: str = "Season"
    amount: str = "Purchase Amount (USD)"


def days_of(label: Column) -> Column:
    """Days between purchases; null for an unknown label."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in DAYS.items() for x in pair)), label)


def with_days(df: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Adds days_between_purchases and days_of_patronage."""
    days = days_of(F.col(f"`{columns.frequency}`"))
    return df.withColumn("days_between_purchases", days).withColumn("days_of_patronage", days * F.col(f"`{columns.previous}`"))


def _rates(df: DataFrame, period_days: float, columns: Columns, *also: Column) -> DataFrame:
    """Rows with their expected purchases in a period and their season's mean amount."""
    days = days_of(F.col(f"`{columns.frequency}`"))
    amount, season = F.col(f"`{columns.amount}`").cast("double"), F.col(f"`{columns.season}`")
    means = df.groupBy(season.alias("season")).agg(F.avg(amount).alias("mean_amount"))
    return df.select(*also, season.alias("season"), (F.lit(period_days) / F.nullif(days, F.lit(0.0))).alias("rate")).join(F.broadcast(means), "season")


def expected_sales(df: DataFrame, multiplier: float = 1.0, period_days: float = 365 / 4, columns: Columns = Columns()) -> DataFrame:
    """(season, customers, purchases, sales): expectations, without sampling."""
    r = _rates(df, period_days, columns).where("rate IS NOT NULL")
    purchases = F.sum(F.col("rate")) * multiplier
    return r.groupBy("season").agg(F.count("*").alias("customers"), purchases.alias("purchases"), (purchases * F.max("mean_amount")).alias("sales"))


def simulated_sales(df: DataFrame, multiplier: float = 2.0, period_days: float = 365 / 4, seed: int = 0, columns: Columns = Columns(), key: roles.Names = None) -> DataFrame:
    """(season, customers, purchases, sales): each row draws from Poisson weights cut off at rate * multiplier, by a seeded inverse.

    With ``key``, columns that tell rows apart, a row's draw follows these and nothing else.
    """
    names = roles.names(key)
    draw = draws.uniform(seed, *(F.col(f"`{c}`") for c in names)) if names else F.rand(seed)
    r = _rates(df, period_days, columns, draw.alias("_u")).where("rate IS NOT NULL")
    r = r.withColumn("_w", probability.poisson_steps(F.floor(F.col("rate") * multiplier), F.col("rate")))
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(0).alias("k"))
    goal = F.col("_u") * F.aggregate("_w", F.lit(0.0), lambda s, x: s + x)
    drawn = F.aggregate("_w", start, lambda s, x: F.struct((s.upto + x).alias("upto"), (s.k + F.when(s.upto + x < goal, 1).otherwise(0)).alias("k")), lambda s: s.k)
    r = r.withColumn("k", F.least(drawn, F.size("_w") - 1))
    return r.groupBy("season").agg(F.count("*").alias("customers"), F.sum("k").alias("purchases"), F.sum(F.col("k") * F.col("mean_amount")).alias("sales"))


def in_order(sales: DataFrame) -> DataFrame:
    """All four seasons from Winter on; those without customers have no sales."""
    seasons = sales.sparkSession.createDataFrame(list(enumerate(SEASONS)), "at int, season string")
    return F.broadcast(seasons).join(sales, "season", "left").na.fill(0).orderBy("at")


def by_period(sales: DataFrame, period: str = "Months") -> DataFrame:
    """(season, period, sales): a season's sales spread evenly over its periods."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {sorted(PERIODS)}")
    n = PERIODS[period]
    whole = max(1, round(n))
    return in_order(sales).select("at", "season", F.explode(F.sequence(F.lit(1), F.lit(whole))).alias("part"), (F.col("sales") / n).alias("sales")).select((F.col("at") * whole + F.col("part")).alias("period"), "season", "sales")


def floating(periods: DataFrame) -> DataFrame:
    """Adds the running start of each period; a year has 52 of them at most."""
    before = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    return periods.withColumn("start", F.coalesce(F.sum("sales").over(before), F.lit(0.0)))
