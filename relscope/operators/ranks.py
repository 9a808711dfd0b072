"""Ranks, running sums and quantiles by sample sort.

A quantile sketch of the values gives splitters, which cut all values into ranges of about equally
many rows.  Each range of a group is put in order apart, and totals of the ranges give what
stands before it: no task holds all values of a group, wherever its values lie.

A range has at most about rows / ``splitters`` rows, unless one value has more; equal values are
in one range and count as one there.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import roles

#: Ranges per shuffle partition, at least, and at most; the share of rows that the sketch sees.
PER_PARTITION, LEAST, MOST, SEEN = 4, 32, 10_000, 1 / 16


def splitters(rows: DataFrame, value: str, ranges: int | None = None) -> list[float]:
    """Rising values that cut ``rows`` into ``ranges`` of about equally many, from a quantile sketch made in one pass without a shuffle of rows.

    Nulls, NaN and infinities don't count.  The sketch sees a random ``SEEN`` of the rows: splitters decide how evenly work is
    dealt and never a result.
    """
    ranges = ranges or min(MOST, max(LEAST, PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    v = F.col(value).cast("double")
    usual = F.when(~F.isnan(v) & (F.abs(v) < math.inf), v)
    found = rows.sample(SEEN, seed=0).agg(F.percentile_approx(usual, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    return sorted({x + 0.0 for x in found})


def with_range(rows: DataFrame, value: str, splits: list[float], name: str = "_range") -> DataFrame:
    """Adds the number of the value's range, which rises with the value; equal values have one."""
    if not splits:
        return rows.withColumn(name, F.lit(0.0))
    number = F.coalesce(F.col(value).cast("double"), F.lit(math.nan))
    # -0.0 is 0.0 here, as it is in groups.
    rows = rows.withColumn("_value", number + F.lit(0.0))
    return Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol="_value", outputCol=name, handleInvalid="keep").transform(rows).drop("_value")


def matched(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Inner join on groups, of which a null may be one."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    right = right.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return left.join(right, same).drop(*(f"_by_{c}" for c in by))


def before(totals: DataFrame, by: list[str], n: str, name: str) -> DataFrame:
    """Adds what the lower ranges of a group have of ``n`` in all; ``totals`` has a row per group and range."""
    return totals.withColumn(name, F.sum(n).over(Window.partitionBy(*by).orderBy("_range")) - F.col(n))


def running(cells: DataFrame, by: list[str], value: str, n: str, name: str, own: bool, splits: list[float] | None = None) -> DataFrame:
    """Adds the running sum of ``n`` in the order of ``value``, each row's own included or not.

    A group has each value once.  ``splits`` may come from other rows of the same values; they are found from ``cells`` otherwise.
    """
    cells = with_range(cells, value, splitters(cells, value) if splits is None else splits)
    totals = before(cells.groupBy(*by, "_range").agg(F.sum(n).alias("_all")), by, "_all", "_before").drop("_all")
    part = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    within = F.sum(n).over(part) - (F.lit(0) if own else F.col(n))
    return matched(cells.withColumn("_within", within), totals, [*by, "_range"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_range", "_before", "_within")


def ranked(counts: DataFrame, by: list[str], value: str = "y", n: str = "n", splits: list[float] | None = None) -> DataFrame:
    """Mid-ranks of distinct values with counts: adds ``rank``."""
    return running(counts, by, value, n, "rank", False, splits).withColumn("rank", F.col("rank") + (F.col(n) + 1) / 2)


def quantiles(rows: DataFrame, by: list[str], shares: tuple[float, ...], y: str = "y", splits: list[float] | None = None) -> DataFrame:
    """(by, q): exact quantiles, linear between neighbours.

    Rows are counted by range; only the ranges in which a quantile falls are put in order.
    """
    rows = rows.where(F.col(y).isNotNull()).select(*by, F.col(y).alias("y"))
    rows = with_range(rows, "y", splitters(rows, "y") if splits is None else splits)
    counts = before(rows.groupBy(*by, "_range").agg(F.count("*").alias("n")), by, "n", "_before")
    counts = counts.withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    places = [(F.floor(F.lit(s) * (F.col("_all") - 1)), F.ceil(F.lit(s) * (F.col("_all") - 1))) for s in shares]
    within = F.lit(False)
    for place in (p for both in places for p in both):
        within = within | ((place >= F.col("_before")) & (place < F.col("_before") + F.col("n")))
    some = matched(rows, counts.where(within).select(*by, "_range", "_before", "_all"), [*by, "_range"])
    cells = some.groupBy(*by, "_range", "y").agg(F.count("*").alias("n"), F.first("_before").alias("_before"), F.first("_all").alias("_all"))
    upto = F.col("_before") + F.sum("n").over(Window.partitionBy(*by, "_range").orderBy("y").rowsBetween(Window.unboundedPreceding, 0))
    # The smallest value of which more than a place's number of rows are no larger.
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("y")))
    found = [e for i, (f, c) in enumerate(places) for e in (at(f).alias(f"f{i}"), at(c).alias(f"c{i}"), F.max(F.lit(shares[i]) * (F.col("_all") - 1) - f).alias(f"w{i}"))]
    s = cells.withColumn("upto", upto).groupBy(*by).agg(*found)
    return s.select(*by, F.array(*(F.col(f"f{i}") + (F.col(f"c{i}") - F.col(f"f{i}")) * F.col(f"w{i}") for i in range(len(shares)))).alias("q"))


def with_median(df: DataFrame, stats: DataFrame, y: str, by: list[str]) -> DataFrame:
    """One row per group with ``median`` added; null for a group without values."""
    rows = df.select(*by, roles.number(df, y).alias("_y"))
    found = quantiles(rows, by, (0.5,), "_y").select(*by, F.col("q")[0].alias("median"))
    if not by:
        return stats.crossJoin(F.broadcast(found.agg(F.max("median").alias("median"))))
    found = found.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return stats.join(found, same, "left").drop(*(f"_by_{c}" for c in by))


def tied_sums(cells: DataFrame, by: list[str], level: str, n: str, splits: list[float]) -> DataFrame:
    """(by, level, gn, r, ties, tied): per level its rows and sum of mid-ranks, the part of the tie correction it sees, and the most equal rows.

    ``cells`` has each (by, level, y) once, with its count.
    """
    part = Window.partitionBy(*by, "_range")
    ranks = with_range(cells, "y", splits)
    ranks = ranks.withColumn("upto", F.sum(n).over(part.orderBy("y").rangeBetween(Window.unboundedPreceding, 0))).withColumn("tied", F.sum(n).over(Window.partitionBy(*by, "_range", "y")))
    within: Column = F.col("upto") - F.col("tied") + (F.col("tied") + 1) / 2
    # A level's rank sum in a range grows by all that stands in lower ranges, once for each of its rows there.
    parts = ranks.groupBy(*by, "_range", level).agg(F.sum(n).alias("gn"), F.sum(F.col(n) * within).alias("r"), F.sum(F.col(n) * (F.col("tied").cast("double") ** 2 - 1)).alias("ties"), F.max("tied").alias("tied"))
    below = F.sum("gn").over(Window.partitionBy(*by).orderBy("_range").rangeBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("r", F.col("r") + F.coalesce(below, F.lit(0)) * F.col("gn"))
    return parts.groupBy(*by, level).agg(F.sum("gn").alias("gn"), F.sum("r").alias("r"), F.sum("ties").alias("ties"), F.max("tied").alias("tied"))
