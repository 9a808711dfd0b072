"""Which columns are numeric and which are categoric, from the schema and the caller's word alone."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Names = str | Iterable[str] | None


def names(value: Names) -> list[str]:
    """A name, several or none as a list."""
    return [] if value is None else [value] if isinstance(value, str) else list(value)


def numeric_columns(df: DataFrame, chosen: Names = None, targets: Names = None, exclude: Names = None) -> list[str]:
    """Numeric columns in schema order: the chosen ones, or all of numeric type; targets are always among them."""
    return _pool(df, [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)], chosen, targets, exclude)


def categoric_columns(df: DataFrame, chosen: Names = None, targets: Names = None, exclude: Names = None) -> list[str]:
    """String columns; integers and booleans only where they are chosen."""
    return _pool(df, [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)], chosen, targets, exclude)


def _pool(df: DataFrame, found: list[str], chosen: Names, targets: Names, exclude: Names) -> list[str]:
    pool = set(names(chosen) or found) | set(names(targets))
    return [c for c in df.columns if c in pool and (c not in names(exclude) or c in names(targets))]


def number(df: DataFrame, c: str) -> Column:
    """The column as double, NaN as null."""
    v = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(v), v)


def level(c: str, dropna: bool = True, label: str = "NaN") -> Column:
    """The column as a string; a null is a level of its own unless nulls are dropped."""
    v = F.col(f"`{c}`").cast("string")
    return v if dropna else F.coalesce(v, F.lit(label))


def mixed_pairs(categoric: list[str], numeric: list[str], categoric_target: Names = None, numeric_target: Names = None, exclude: Names = None) -> list[tuple[str, str]]:
    """(categoric, numeric) pairs; with targets, those that touch any target."""
    cats, nums, out = names(categoric_target), names(numeric_target), []
    for c, n in product(categoric, numeric):
        if c == n or ((cats or nums) and c not in cats and n not in nums):
            continue
        if (c in names(exclude) and n in nums) or (n in names(exclude) and c in cats):
            continue
        out.append((c, n))
    return out


def same_pairs(columns: list[str], target: Names = None, exclude: Names = None) -> list[tuple[str, str]]:
    """Unordered pairs; with targets, (target, other) for each target."""
    targets = names(target)
    if not targets:
        return list(combinations(columns, 2))
    return [(t, c) for t in targets for c in columns if c != t and c not in names(exclude)]


def families(categoric_target: Names, numeric_target: Names) -> dict[str, bool]:
    """Which families of tests the targets leave: a target of one kind rules out pairs of the other."""
    cats, nums = names(categoric_target), names(numeric_target)
    return {"numnum": bool(nums) or not cats, "numcat": True, "catcat": bool(cats) or not nums}
