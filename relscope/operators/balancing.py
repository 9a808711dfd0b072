"""Cells of two categories brought to one size, by draws that follow each row's key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import roles
from ..functions import draws
from . import ranks

#: Ranges of hashes that cells are counted by.
RANGES = 1024


def smallest(rows: DataFrame, by: list[str], k: int, value: str, tie: str, splits: list[float]) -> DataFrame:
    """The ``k`` rows of each group with the smallest ``value``, then ``tie``; all of a smaller group.

    Rows are counted by range of the value.  Ranges within the first k stay whole without a shuffle of their
    rows; only the one that k falls in is put in order.
    """
    ranged = ranks.with_range(rows, value, splits)
    counts = ranks.before(ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n")), by, "_n", "_before").where(F.col("_before") < k)
    cut = F.col("_before") + F.col("_n") > k
    whole = ranks.matched(ranged, counts.where(~cut).select(*by, "_range"), [*by, "_range"]).drop("_range")
    part = ranks.matched(ranged, counts.where(cut).select(*by, "_range", "_before"), [*by, "_range"])
    at = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(value, tie))
    part = part.withColumn("_at", at).where(F.col("_at") <= k - F.col("_before")).drop("_at", "_before", "_range")
    return whole.unionByName(part)


def _drawn(df: DataFrame, key: roles.Names, seed: int) -> DataFrame:
    """Adds ``_hash`` and ``_draw``; equal keys have equal ones."""
    columns = [F.col(f"`{c}`") for c in roles.names(key) or df.columns]
    return df.withColumn("_hash", draws.hashed(seed, *columns)).withColumn("_draw", draws.uniform(seed, *columns))


EVEN = [i / RANGES for i in range(1, RANGES)]


def first_drawn(df: DataFrame, by: list[str], size: int, key: roles.Names = None, seed: int = 0) -> DataFrame:
    """``size`` random rows of each group; all of a smaller one."""
    return smallest(_drawn(df, key, seed), by, size, "_draw", "_hash", EVEN).select(*df.columns)


def balanced(df: DataFrame, a: str, b: str, key: roles.Names = None, size: int | None = None, min_size: int = 5, ntile: float | None = None, override_min: bool = False, strata: str | None = None, seed: int = 0) -> DataFrame:
    """As many random rows of each (a, b) cell that has ``min_size``; all columns stay, rows with a null category go.

    The number is ``size``, the ``ntile`` percentile of these cells' sizes rounded down, or the smallest; a cell with
    fewer keeps what it has.  With ``override_min`` smaller cells come too: as many rows drawn with replacement, so rows
    repeat.  With ``strata`` a row's weight is the number of rows of its cell that share its value there.  Draws follow
    ``key``, by default all columns; rows of one key are drawn together, so it should tell rows apart.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = rows.groupBy(a, b).agg(F.count("*").alias("_size"))
    enough = F.col("_size") >= min_size
    if size is None:
        size = cells.where(enough).agg(F.min("_size") if ntile is None else F.floor(F.percentile("_size", ntile / 100))).first()[0]
    if not size:
        return df.limit(0)
    drawn = _drawn(rows, key, seed).join(cells, [a, b])
    large, splits = drawn.where(enough), EVEN
    if strata is not None:
        shares = rows.groupBy(a, b, F.col(strata).alias("_stratum")).agg(F.count("*").alias("_weight"))
        large = ranks.matched(large.withColumn("_stratum", F.col(strata)), shares, [a, b, "_stratum"])
        # The smallest of exponential waiting times, whose rates are the weights.
        large = large.withColumn("_draw", -F.log("_draw") / F.col("_weight"))
        splits = ranks.splitters(large, "_draw")
    out = smallest(large, [a, b], size, "_draw", "_hash", splits).select(*df.columns)
    if not override_min:
        return out
    own = Window.partitionBy(a, b).orderBy("_hash")
    few = drawn.where(~enough).withColumn("_place", F.row_number().over(own) - 1)
    asked = cells.where(~enough).withColumn("_number", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    asked = asked.select(a, b, F.floor(draws.uniform(seed, F.col(a), F.col(b), F.col("_number")) * F.col("_size")).cast("int").alias("_place"))
    return out.unionByName(asked.join(few, [a, b, "_place"]).select(*df.columns))
