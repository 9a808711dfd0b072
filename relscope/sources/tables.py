"""Tables from files, and a loader for purchase habits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binning, forecast
from ..roles import numeric_columns

LEAST_BINS = 5


def csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV file with a header and inferred types; spaces around values are ignored."""
    return spark.read.options(header=True, inferSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, **options).csv(path)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def recoded(df: DataFrame, columns: forecast.Columns = forecast.Columns(), bins: int = LEAST_BINS) -> DataFrame:
    """Purchase habits: yes/no as categories 1 and 0, no identifier, days of patronage, each number binned.

    A number gains <name>_Binned, on its own scale, and <name>_Ordinalized, the bin as a
    category; the bins are the square root of its distinct values, ``bins`` at least.
    """
    out = df.drop("Customer ID")
    if "Gender" in out.columns:
        out = out.withColumn("Male", F.when(F.col("Gender") == "Male", "1").when(F.col("Gender").isNotNull(), "0")).drop("Gender")
    for c in ("Subscription Status", "Discount Applied", "Promo Code Used"):
        if c in out.columns:
            out = out.withColumn(c, F.when(F.col(f"`{c}`") == "Yes", "1").when(F.col(f"`{c}`") == "No", "0"))
    if columns.frequency in out.columns and columns.previous in out.columns:
        out = out.withColumn("Total Days of Patronage", forecast.days_of(F.col(f"`{columns.frequency}`")) * F.col(f"`{columns.previous}`"))
    names = numeric_columns(out)
    if not names:
        return out
    n = out.agg(*(F.count_distinct(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(names))).first()
    for i, c in enumerate(names):
        k = max(bins, round(n[i] ** 0.5))
        out = binning.binned(binning.binned(out, c, k, True, f"{c}_Binned"), c, k, False, f"{c}_Ordinalized")
        out = out.withColumn(f"{c}_Ordinalized", F.col(f"`{c}_Ordinalized`").cast("string"))
    return out


def load_habits(spark: SparkSession, path: str) -> DataFrame:
    return recoded(csv(spark, path))
