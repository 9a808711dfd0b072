"""Long forms that let one aggregation serve every pair of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import roles


def category_pairs(df: DataFrame, pairs: list[tuple[str, str]], dropna: bool = True) -> DataFrame:
    """(a, b, la, lb, n): counts of level pairs of all column pairs, in one shuffle of counts."""
    used = sorted({c for p in pairs for c in p}, key=df.columns.index)
    # Counting distinct combinations first would explode; levels are counted per pair.
    rows = df.select([roles.level(c, dropna).alias(f"c{i}") for i, c in enumerate(used)])
    at = {c: f"c{i}" for i, c in enumerate(used)}
    each = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(at[a]).alias("la"), F.col(at[b]).alias("lb")) for a, b in pairs))
    long = rows.select(F.explode(each).alias("p")).select("p.*")
    return long.where("la IS NOT NULL AND lb IS NOT NULL").groupBy("a", "b", "la", "lb").agg(F.count("*").alias("n"))


def mixed(df: DataFrame, pairs: list[tuple[str, str]], dropna: bool = True) -> DataFrame:
    """(category, numeric, level, y): the complete rows of (categoric, numeric) column pairs."""
    cats = list(dict.fromkeys(c for c, _ in pairs))
    nums = list(dict.fromkeys(n for _, n in pairs))
    rows = df.select(*(roles.level(c, dropna).alias(f"c{i}") for i, c in enumerate(cats)), *(roles.number(df, n).alias(f"n{i}") for i, n in enumerate(nums)))
    each = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(n).alias("numeric"), F.col(f"c{cats.index(c)}").alias("level"), F.col(f"n{nums.index(n)}").alias("y")) for c, n in pairs))
    return rows.select(F.explode(each).alias("p")).select("p.*").where("level IS NOT NULL AND y IS NOT NULL")


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(numeric, y) of each column."""
    each = F.array(*(F.struct(F.lit(c).alias("numeric"), roles.number(df, c).alias("y")) for c in columns))
    return df.select(F.explode(each).alias("p")).select("p.*").where("y IS NOT NULL")


def levels(df: DataFrame, columns: list[str], dropna: bool = True) -> DataFrame:
    """(category, level, n) of each column."""
    each = F.array(*(F.struct(F.lit(c).alias("category"), roles.level(c, dropna).alias("level")) for c in columns))
    long = df.select(F.explode(each).alias("p")).select("p.*").where("level IS NOT NULL")
    return long.groupBy("category", "level").agg(F.count("*").alias("n"))


def keep(df: DataFrame, column: str, threshold: float, above: bool | None, absolute: bool = False) -> DataFrame:
    """Rows at or above a threshold, below it, or all (``above`` None); undefined values go unless all stay."""
    value = F.abs(column) if absolute else F.col(column)
    return df if above is None else df.where(value >= threshold) if above else df.where(value < threshold)
