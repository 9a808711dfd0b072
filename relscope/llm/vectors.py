"""Vectors that take part in searches, and Arrow lists of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable() -> Column:
    """Whether a row takes part: it has a vec_id and a vector that is neither null, empty nor zero, of finite components only."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True)) & some, F.lit(False))


def taking_part(df: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    return df.where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def lists(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    scale = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / scale
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)
