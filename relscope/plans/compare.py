"""Comparisons of all columns: which pairs, which tests, one result relation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import roles
from ..operators import anova, assumptions, batch, chi2, numeric, ranks

#: The result relation.
RESULT = "column_a string, column_b string, test string, p_value double, correlation double, assumptions_met string"
FAMILIES = ("numnum", "numcat", "catcat")
#: The tests a family runs by default, as (method, threshold, keep_above).
DEFAULTS = {
    "numnum": [("pearson", 0.6, True), ("spearman", 0.6, True), ("kendall", 0.6, True)],
    "numcat": [("kruskal", 0.05, False), ("anova", 0.05, False)],
    "catcat": [("chi2", 0.05, False)],
    "uniform": [("chi2", 0.05, False)],
    "normal": [("k2", 0.05, False)],
}
METHODS = {"numnum": ("pearson", "spearman", "kendall", "welch", "student"), "numcat": ("kruskal", "anova"), "catcat": ("chi2",), "uniform": ("chi2",), "normal": ("k2",)}
Instruction = tuple[str, float, bool | None]


def instructions(value, family: str) -> list[Instruction]:
    """True as the defaults, False and None as none, one triple or several as a list; anything else raises."""
    if value is True:
        return list(DEFAULTS[family])
    if value is False or value is None:
        return []
    found = [value] if isinstance(value, tuple) else list(value) if isinstance(value, list) else None
    if not found:
        raise ValueError(f"{family}: expected a bool, a triple or a list of triples, not {value!r}")
    for t in found:
        if not isinstance(t, (tuple, list)) or len(t) != 3 or t[0] not in METHODS[family]:
            raise ValueError(f"{family}: {t!r} is not (one of {METHODS[family]}, threshold, keep_above)")
    return [tuple(t) for t in found]


def _blank(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], RESULT)


def _shaped(df: DataFrame, a: str, b: str, test: str, value: str, met: DataFrame | None = None, keys: tuple[str, str] | None = None) -> DataFrame:
    out = df if met is None else df.join(met.select(*keys, F.col("assumptions_met").cast("string").alias("_met")), list(keys), "left")
    is_p = value == "p_value"
    checked = F.lit(None).cast("string") if met is None else F.when(F.col(value).isNull(), "False").otherwise(F.col("_met"))
    nothing = F.lit(None).cast("double")
    return out.select(F.col(a).alias("column_a"), F.col(b).alias("column_b"), F.lit(test).alias("test"), (F.col(value) if is_p else nothing).alias("p_value"), (nothing if is_p else F.col(value)).alias("correlation"), checked.alias("assumptions_met"))


def measured(df: DataFrame, tests: dict[str, list[Instruction]], numeric_columns: roles.Names = None, categoric_columns: roles.Names = None, numeric_target: roles.Names = None, categoric_target: roles.Names = None, exclude: roles.Names = None, check_assumptions: bool = False, anova_rules=assumptions.AnovaRules(), kruskal_rules=assumptions.KruskalRules(), dropna: bool = True, filtered: bool = False) -> DataFrame:
    """Every test of every pair its family has; with ``filtered``, the rows that their instruction keeps.

    Pairs of a number and a category have the number as column_a.  Where assumptions are
    checked, an undefined p-value counts as not met; correlations have no assumptions.
    Gates of tests over groups are evaluated here, one by one, before the tests are.
    """
    on = roles.families(categoric_target, numeric_target)
    nums = roles.numeric_columns(df, numeric_columns, numeric_target)
    cats = roles.categoric_columns(df, categoric_columns, categoric_target)
    parts = [_blank(df)]

    def add(found: DataFrame, value: str, threshold: float, above: bool | None, *shape) -> None:
        found = batch.keep(found, value, threshold, above, absolute=True) if filtered else found
        parts.append(_shaped(found, *shape))

    mixed = roles.mixed_pairs(cats, nums, categoric_target, numeric_target, exclude)
    over_groups = tests.get("numcat", []) if mixed else []
    # One set of splitters for all that looks at the same rows.
    splits = ranks.splitters(batch.mixed(df, mixed, dropna), "y") if over_groups and (check_assumptions or any(method == "kruskal" for method, _, _ in over_groups)) else None
    for method, threshold, above in over_groups:
        met = assumptions.settled(df, method, mixed, anova_rules, kruskal_rules, dropna, splits) if check_assumptions else None
        found = anova.one_way(df, mixed, dropna) if method == "anova" else anova.kruskal(df, mixed, dropna, splits)
        add(found, "p_value", threshold, above, "numeric", "category", method, "p_value", met, ("category", "numeric"))
    for method, threshold, above in tests.get("catcat", []):
        pairs = roles.same_pairs(cats, categoric_target, exclude)
        if on["catcat"] and pairs:
            found = chi2.independence(df, pairs, dropna)
            met = found.select("category_a", "category_b", "assumptions_met") if check_assumptions else None
            add(found.drop("assumptions_met") if check_assumptions else found, "p_value", threshold, above, "category_a", "category_b", method, "p_value", met, ("category_a", "category_b"))
    for method, threshold, above in tests.get("numnum", []):
        if on["numnum"] and len(nums) > 1:
            if method in numeric.METHODS:
                targets = roles.names(numeric_target) or [None]
                found = reduce(DataFrame.unionByName, [numeric.correlations(df, method, nums, t) for t in targets])
                add(found, "correlation", threshold, above, "numeric_a", "numeric_b", method, "correlation")
            else:
                add(numeric.t_tests(df, nums, numeric_target, method), "p_value", threshold, above, "numeric_a", "numeric_b", method, "p_value")
    return reduce(DataFrame.unionByName, parts)


def column_comparison(df: DataFrame, numnum: Instruction | None = ("welch", 0.05, False), numcat: Instruction | None = ("kruskal", 0.05, False), catcat: Instruction | None = ("chi2", 0.05, False), **pool) -> DataFrame:
    """One test per family, filtered, without assumption checks."""
    tests = {f: instructions(t, f) for f, t in zip(FAMILIES, (numnum, numcat, catcat), strict=True)}
    return measured(df, tests, filtered=True, **pool).drop("assumptions_met")


def multi_test_comparison(df: DataFrame, numnum=True, numcat=True, catcat=True, **pool) -> DataFrame:
    """Several tests per family, filtered, with assumptions where they are asked for."""
    tests = {f: instructions(t, f) for f, t in zip(FAMILIES, (numnum, numcat, catcat), strict=True)}
    return measured(df, tests, filtered=True, **pool)


def related_pairs(df: DataFrame, numnum: Instruction, numcat: Instruction, numeric_columns: roles.Names = None, categoric_columns: roles.Names = None, numeric_target: roles.Names = None, categoric_target: roles.Names = None) -> dict[str, list[tuple[str, str]]]:
    """(y, feature) pairs that a first comparison keeps; pairs of numbers in both directions."""
    pool = {"numeric_columns": numeric_columns, "categoric_columns": categoric_columns, "numeric_target": numeric_target, "categoric_target": categoric_target}
    found = column_comparison(df, numnum, numcat, None, **pool).select("column_a", "column_b", "test").distinct().collect()
    numnum_pairs = {p for r in found if r["test"] == numnum[0] for p in ((r["column_a"], r["column_b"]), (r["column_b"], r["column_a"]))}
    return {"numnum": sorted(numnum_pairs), "numcat": sorted((r["column_a"], r["column_b"]) for r in found if r["test"] == numcat[0])}


def classified(results: DataFrame, tests: dict[str, list[Instruction]], compat: bool = False) -> DataFrame:
    """(column_a, column_b, label, outcome) per pair: significant, not_significant or assumptions_not_met.

    A pair is significant when any test passes; its label joins the passing tests in order,
    with ':' and the assumption where one was checked.  A pair none of whose tests passes
    is not significant when one has a defined value and its assumptions weren't refused.
    ``compat`` lets undefined p-values refuse correlations as well.
    """
    rules = F.lit(False)
    for family in FAMILIES:
        for method, threshold, above in tests.get(family, []):
            v = F.abs(F.coalesce("correlation", "p_value"))
            rules = rules | ((F.col("test") == method) & (F.lit(True) if above is None else v >= threshold if above else v < threshold))
    correlation = F.col("test").isin(*numeric.METHODS)
    refused = F.coalesce(F.col("assumptions_met") == "False", F.lit(compat) & correlation & F.col("p_value").isNull())
    undefined = F.coalesce("p_value", "correlation").isNull()
    label = F.when(F.col("assumptions_met").isNull() | correlation, F.col("test")).otherwise(F.concat("test", F.lit(":"), "assumptions_met"))
    r = results.withColumns({"_label": label, "_refused": refused | undefined, "_passes": F.coalesce(rules, F.lit(False)) & ~(refused | undefined)})
    g = r.groupBy("column_a", "column_b").agg(F.bool_or("_passes").alias("passes"), F.bool_and("_refused").alias("refused"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("_passes"), F.col("_label")))), "-").alias("passing"), F.array_join(F.array_sort(F.collect_set("_label")), "-").alias("all"))
    outcome = F.when(F.col("passes"), "significant").when(F.col("refused"), "assumptions_not_met").otherwise("not_significant")
    return g.select("column_a", "column_b", F.when(F.col("passes"), F.col("passing")).otherwise(F.col("all")).alias("label"), outcome.alias("outcome"))
