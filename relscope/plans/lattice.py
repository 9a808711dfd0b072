"""Tests of a target over combinations of categories, from one grouping.

Rows are grouped once, by all categories of the pool together, to what the tests add up: counts, sums, rank sums.  Each
combination's groups are unions of these, so every combination rolls up from that grouping in one plan.
The combinations are one constant array; neither a row nor the plan grows with their number.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import roles
from ..operators import anova, assumptions, chi2, preparation, ranks
from . import compare

BY = ["combo"]


def _values(pool: list[str]):
    """Values of the pool as text, a null reading 'nan'."""
    return F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")) for c in pool))


def rolled_up(groups: DataFrame, pool: list[str], combos: list[tuple[str, ...]], delimiter: str) -> DataFrame:
    """Each row of ``groups``, which has ``values`` of the pool, once per combination: adds ``combo``, its number, and ``level``."""
    members = F.from_json(F.lit(json.dumps([[pool.index(c) for c in combo] for combo in combos])), "array<array<int>>")
    each = groups.select("*", F.posexplode(members).alias("combo", "_members"))
    return each.withColumn("level", F.array_join(F.transform("_members", lambda i: F.get("values", i)), delimiter)).drop("values", "_members")


def _numeric(df: DataFrame, target: str, pool: list[str], combos: list[tuple[str, ...]], methods: list[str], delimiter: str) -> dict[str, DataFrame]:
    """(combo, p_value) by method, of a number over each combination."""
    rows = df.select(_values(pool).alias("values"), roles.number(df, target).alias("y")).where("y IS NOT NULL")
    centre = df.agg(F.avg(roles.number(df, target))).first()[0] or 0.0
    away = F.col("y") - centre
    sums = {"gn": F.count("*"), "s1": F.sum(away), "s2": F.sum(away * away), "least": F.min("y"), "largest": F.max("y")}
    if "kruskal" in methods:
        counts = rows.groupBy("y").agg(F.count("*").alias("n"))
        ranked = ranks.ranked(counts, [], splits=ranks.splitters(rows, "y")).select("y", "rank", F.col("n").cast("double").alias("tied"))
        rows = rows.join(ranked, "y")
        sums |= {"r": F.sum("rank"), "ties": F.sum(F.col("tied") ** 2 - 1), "tied": F.max("tied")}
    groups = rows.groupBy("values").agg(*(e.alias(name) for name, e in sums.items()))
    merge = {"least": F.min, "largest": F.max, "tied": F.max}
    levels = rolled_up(groups, pool, combos, delimiter).groupBy(*BY, "level").agg(*(merge.get(name, F.sum)(name).alias(name) for name in sums))
    out = {}
    if "kruskal" in methods:
        out["kruskal"] = anova.kruskal_of_sums(levels, BY)
    if "anova" in methods:
        mean = F.col("s1") / F.col("gn")
        var = F.when(F.col("least") < F.col("largest"), F.greatest(F.lit(0.0), F.col("s2") / F.col("gn") - mean * mean)).otherwise(0.0)
        out["anova"] = anova.one_way_of_groups(levels.select(*BY, "gn", mean.alias("mean"), var.alias("var")), BY)
    return out


def _rows(df: DataFrame, target: str, pool: list[str], combos: list[tuple[str, ...]], delimiter: str) -> DataFrame:
    """(category, numeric, level, y) of all combinations, the category being the combination's number."""
    rows = df.select(_values(pool).alias("values"), roles.number(df, target).alias("y")).where("y IS NOT NULL")
    return rolled_up(rows, pool, combos, delimiter).select(F.col("combo").cast("string").alias("category"), F.lit(target).alias("numeric"), "level", "y")


def measured(df: DataFrame, target: str, numeric: bool, pool: list[str], combos: list[tuple[str, ...]], tests: list[compare.Instruction], delimiter: str = preparation.DELIMITER, check_assumptions: bool = False, anova_rules=assumptions.AnovaRules(), kruskal_rules=assumptions.KruskalRules()) -> DataFrame:
    """The result relation of the target with each combination, which column_b names by its members' header.

    Gates on assumptions look at the rows themselves, a row per combination.
    """
    spark = df.sparkSession
    names = spark.createDataFrame([(i, preparation.HEADER.join(c)) for i, c in enumerate(combos)], "combo int, name string")
    parts = []
    if not numeric:
        groups = df.select(_values(pool).alias("values"), roles.level(target).alias("la")).where("la IS NOT NULL").groupBy("values", "la").agg(F.count("*").alias("n"))
        counts = rolled_up(groups, pool, combos, delimiter).groupBy("combo", "la", F.col("level").alias("lb")).agg(F.sum("n").alias("n"))
        counts = counts.select(F.lit(target).alias("a"), F.col("combo").cast("string").alias("b"), "la", "lb", "n")
        found = chi2.independence_of(counts, names.select(F.lit(target).alias("a"), F.col("combo").cast("string").alias("b"), F.col("combo").alias("at")))
        found = found.withColumn("combo", F.col("category_b").cast("int"))
        met = F.when(F.col("p_value").isNull(), "False").otherwise(F.col("assumptions_met").cast("string"))
        parts = [(method, found.select("combo", "p_value", (met if check_assumptions else F.lit(None).cast("string")).alias("met"))) for method, _, _ in tests]
    elif not check_assumptions:
        found = _numeric(df, target, pool, combos, [m for m, _, _ in tests], delimiter)
        parts = [(method, found[method].select("combo", "p_value", F.lit(None).cast("string").alias("met"))) for method, _, _ in tests]
    else:
        rows = _rows(df, target, pool, combos, delimiter)
        ties = assumptions.lenient(df, [(str(i), target) for i in range(len(combos))], kruskal_rules.max_tie_ratio)
        splits = ranks.splitters(rows, "y")
        for method, _, _ in tests:
            found = anova.one_way_of(rows, anova.PAIR) if method == "anova" else anova.kruskal_of(rows, anova.PAIR, splits=splits)
            met = assumptions.anova_met_of(rows, anova_rules, splits) if method == "anova" else assumptions.kruskal_met_of(rows, ties, kruskal_rules, splits)
            found = found.join(met.select(*anova.PAIR, F.col("assumptions_met").cast("string").alias("_met")), anova.PAIR, "left")
            met = F.when(F.col("p_value").isNull(), "False").otherwise(F.col("_met"))
            parts.append((method, found.select(F.col("category").cast("int").alias("combo"), "p_value", met.alias("met"))))
    nothing = F.lit(None).cast("double").alias("correlation")
    shaped = [F.broadcast(names).join(found, "combo", "left").select(F.lit(target).alias("column_a"), F.col("name").alias("column_b"), F.lit(method).alias("test"), "p_value", nothing, F.col("met").alias("assumptions_met")) for method, found in parts]
    return reduce(DataFrame.unionByName, shaped) if shaped else spark.createDataFrame([], compare.RESULT)
