"""Random numbers that follow a row's key: the same under retries, in any partitioning, and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 52


def hashed(seed: int, *keys: Column) -> Column:
    """A whole number of 52 bits from MD5 of the seed and the keys as text; a null counts as empty."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def uniform(seed: int, *keys: Column) -> Column:
    """A number between 0 and 1, neither included."""
    return (hashed(seed, *keys) + 0.5) / F.lit(2.0**BITS)
