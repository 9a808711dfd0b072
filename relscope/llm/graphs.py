"""Joins on hot keys, and connected components, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime


#: Rows of one key that stay together; keys with more are split.
PART = 1000
#: Hot keys that are broadcast, at most; with more, adaptive execution splits their shuffle.
FEW = 100_000


def parts(left: DataFrame, key: str, by: str, rows: int = PART) -> tuple[DataFrame, DataFrame]:
    """A stored table with ``part``, and (key, parts) of the keys that have several.

    A key of more than ``rows`` rows has them dealt over parts of about that many, by a hash of column ``by``.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > rows)
    hot = runtime.stored(counts.select(key, F.ceil(F.col("n") / rows).alias("parts")))
    found = hot.count()
    if not found:
        return left.withColumn("part", F.lit(0).cast("long")), hot
    known = left.join(F.broadcast(hot) if found <= FEW else hot, key, "left")
    return known.withColumn("part", F.coalesce(F.pmod(F.xxhash64(by), F.col("parts")), F.lit(0).cast("long"))).drop("parts"), hot


def lookup(left: DataFrame, right: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """Inner join of stored tables.  With ``by``, keys that are hot in ``left`` are split by it, and their rows of ``right`` copied to each part."""
    if by is None:
        return left.join(right, key)
    left, hot = parts(left, key, by)
    copies = right.join(hot, key, "left").withColumn("part", F.explode(F.expr("sequence(0L, coalesce(parts, 1L) - 1L)"))).drop("parts")
    return left.join(copies, [key, "part"]).drop("part")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches.

    Nodes take the smallest label among themselves and their neighbours, then their
    label's label, until nothing changes: paths shrink by half or more each round.  Each
    round is a stored table.
    """
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = runtime.stored(pairs.union(pairs.select("other", "node")).distinct())
    labels = runtime.stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    total = None
    while True:
        seen = both.join(labels, "node").select(F.col("other").alias("node"), "component")
        low = runtime.stored(labels.union(seen).groupBy("node").agg(F.min("component").alias("component")))
        jump = low.select(F.col("node").alias("component"), F.col("component").alias("_to"))
        # The smaller label of a large component is a hot key.
        new = runtime.stored(lookup(low, jump, "component", "node").select("node", F.col("_to").alias("component")))
        runtime.released(labels, low)
        labels = new
        # Labels only fall, so an equal sum means that none has changed.
        before, total = total, labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if total == before:
            runtime.released(both)
            return labels
