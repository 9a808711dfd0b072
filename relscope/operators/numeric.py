"""Tests between numbers: t-tests, correlations; normality."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import roles
from ..functions import special
from . import anova, batch, ranks

METHODS = ("pearson", "spearman", "kendall")
#: Rows from which normality is tested by skewness and kurtosis.
LARGE = 300


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(numeric, n, m, v) of each column, in one pass."""
    one = df.agg(*(f(roles.number(df, c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    each = F.array(*(F.struct(F.lit(c).alias("numeric"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v")) for i, c in enumerate(columns)))
    return one.select(F.explode(each).alias("s")).select("s.*")


def t_tests(df: DataFrame, columns: roles.Names = None, target: roles.Names = None, method: str = "welch") -> DataFrame:
    """(numeric_a, numeric_b, t_stat, p_value) of every ordered pair of columns, or each target with every other."""
    if method not in ("welch", "student"):
        raise ValueError(f"method must be 'welch' or 'student', not {method!r}")
    names, targets = roles.numeric_columns(df, columns, target), roles.names(target)
    m = moments(df, names)
    a, b = (m.select(*(F.col(c).alias(f"{c}_{s}") for c in m.columns)) for s in "ab")
    pairs = a.crossJoin(F.broadcast(b)).where("numeric_a <> numeric_b")
    if targets:
        pairs = pairs.where(F.col("numeric_a").isin(targets))
    test = anova.welch if method == "welch" else anova.student
    return test(pairs, "n_a", "m_a", "v_a", "n_b", "m_b", "v_b").select("numeric_a", "numeric_b", "t_stat", "p_value")


def t_test_comparison(df: DataFrame, alpha: float = 0.05, keep_above: bool | None = False, **kind) -> DataFrame:
    return batch.keep(t_tests(df, **kind), "p_value", alpha, keep_above, absolute=True)


def _pairs(df: DataFrame, columns: roles.Names, target: str | None) -> list[tuple[str, str]]:
    names = roles.numeric_columns(df, columns, target)
    return [(c, target) for c in names if c != target] if target else list(combinations(names, 2))


def _complete(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), roles.number(df, a).alias("x"), roles.number(df, b).alias("y")) for a, b in pairs))
    return df.select(F.explode(each).alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL")


def _pearson(rows: DataFrame, x: str = "x", y: str = "y", n: str | None = None) -> DataFrame:
    """Correlation per (a, b), of rows or of weighted points; null for a constant."""
    if n is None:
        s = rows.groupBy("a", "b").agg(F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    else:
        mean = lambda v: F.sum(F.col(n) * F.col(v)) / F.sum(n)
        means = rows.groupBy("a", "b").agg(mean(x).alias("mx"), mean(y).alias("my"))
        w = rows.join(F.broadcast(means), ["a", "b"]).withColumn("dx", F.col(x) - F.col("mx")).withColumn("dy", F.col(y) - F.col("my"))
        s = w.groupBy("a", "b").agg(*(F.sum(F.col(n) * F.col(p) * F.col(q)).alias(k) for k, p, q in (("c", "dx", "dy"), ("vx", "dx", "dx"), ("vy", "dy", "dy"))))
    return s.select("a", "b", F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") / F.nullif(F.sqrt("vx") * F.sqrt("vy"), F.lit(0.0))).alias("correlation"))


def _spearman_of_complete(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson's of mid-ranks for columns without nulls: each column is ranked once, whatever the number of pairs."""
    names = list(dict.fromkeys(c for p in pairs for c in p))
    rows = df.select(*(roles.number(df, c).alias(f"v{i}") for i, c in enumerate(names)))
    every = batch.numbers(rows, rows.columns)
    values = every.groupBy("numeric", "y").agg(F.count("*").alias("n"))
    found = ranks.ranked(values, ["numeric"], splits=ranks.splitters(every, "y")).select("numeric", "y", "rank")
    for i in range(len(names)):
        own = found.where(F.col("numeric") == f"v{i}").select(F.col("y").alias(f"v{i}"), F.col("rank").alias(f"r{i}"))
        rows = rows.join(own, f"v{i}")
    at = {c: f"r{i}" for i, c in enumerate(names)}
    one = rows.agg(*(f(*(at[c] for c in p)).alias(f"{k}{i}") for i, p in enumerate(pairs) for k, f in (("c", F.covar_pop), ("x", lambda a, b: F.var_pop(a)), ("y", lambda a, b: F.var_pop(b)))))
    each = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("c"), F.col(f"x{i}").alias("vx"), F.col(f"y{i}").alias("vy")) for i, (a, b) in enumerate(pairs)))
    s = one.select(F.explode(each).alias("p")).select("p.*")
    return s.select("a", "b", F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") / F.nullif(F.sqrt("vx") * F.sqrt("vy"), F.lit(0.0))).alias("correlation"))


def _spearman(rows: DataFrame, w: str | None = None) -> DataFrame:
    """Pearson's of mid-ranks, which run over distinct values; ``w`` counts a row's copies."""
    points = rows.groupBy("a", "b", "x", "y").agg((F.sum(w) if w else F.count("*")).alias("n"))
    for v in ("x", "y"):
        values = points.groupBy("a", "b", v).agg(F.sum("n").alias("n"))
        found = ranks.ranked(values, ["a", "b"], v, splits=ranks.splitters(rows, v)).select("a", "b", v, F.col("rank").alias(f"r{v}"))
        points = points.join(found, ["a", "b", v])
    return _pearson(points, "rx", "ry", "n")


def _kendall(rows: DataFrame, w: str | None = None) -> DataFrame:
    """Tau-b of distinct points with counts; ``w`` counts a row's copies.

    Two ranks differ first in one bit, which is 0 in the smaller.  So a point goes, once per
    bit of its rank in the column of fewer values, to the group of ranks that agree in all
    higher bits; there each 1 counts the 0s of smaller values in the other column by a
    running sum.  No task holds all points of a pair of columns.
    """
    by, group = ["a", "b"], ["a", "b", "bit", "prefix"]
    points = rows.groupBy(*by, "x", "y").agg((F.sum(w) if w else F.count("*")).cast("double").alias("n"))
    sides = F.explode(F.array(*(F.struct(F.lit(v).alias("side"), F.col(v).alias("v")) for v in "xy")))
    values = points.select(*by, sides.alias("s"), "n").select(*by, "s.*", "n").groupBy(*by, "side", "v").agg(F.sum("n").alias("n"))
    # Reads n, so that all that reads the values shares their shuffle.
    values = values.withColumn("one", F.when(F.col("n") > 0, 1).otherwise(0))
    # One set for both columns: ranges of all values together.
    splits = ranks.splitters(rows.select(F.explode(F.array("x", "y")).alias("v")), "v")
    own = lambda side, v: F.when(F.col("side") == side, v)
    tied = F.col("n") * (F.col("n") - 1) / 2
    totals = values.groupBy(*by).agg(F.sum(own("x", F.col("n"))).alias("all"), *(e for v in "xy" for e in (F.count(own(v, F.lit(1))).alias(f"m{v}"), F.sum(own(v, tied)).alias(f"t{v}"))))
    fewer = F.when(F.col("mx") < F.col("my"), "x").otherwise("y")
    spans = totals.select(*by, fewer.alias("side"), F.length(F.bin(F.least("mx", "my") - 1)).alias("bits"))
    placed = points.join(F.broadcast(spans), by)
    placed = placed.select(*by, "side", "bits", "n", *(F.when(F.col("side") == s, F.col("x")).otherwise(F.col("y")).alias(c) for s, c in (("x", "v"), ("y", "other"))))
    placed = placed.join(ranks.running(values, [*by, "side"], "v", "one", "rank", False, splits).select(*by, "side", "v", "rank"), [*by, "side", "v"])
    each = placed.withColumn("bit", F.explode(F.expr("sequence(0, bits - 1)"))).withColumn("prefix", F.expr("shiftright(rank, bit + 1)"))
    upper = F.expr("shiftright(rank, bit) % 2 = 1")
    cells = each.groupBy(*group, "other").agg(F.sum(F.when(upper, 0.0).otherwise(F.col("n"))).alias("zeros"), F.sum(F.when(upper, F.col("n")).otherwise(0.0)).alias("ones"))
    ranges = Window.partitionBy(*group, "_range").orderBy("other").rowsBetween(Window.unboundedPreceding, 0)
    cells = ranks.with_range(cells, "other", splits)
    cells = cells.withColumn("below", F.sum("zeros").over(ranges) - F.col("zeros"))
    in_order, equal = F.sum(F.col("ones") * F.col("below")), F.sum(F.col("ones") * F.col("zeros"))
    parts = cells.groupBy(*group, "_range").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), (2 * in_order + equal).alias("own"))
    whole = Window.partitionBy(*group)
    upto = F.sum("zeros").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("zeros")
    # Twice the pairs in order, and those of equal values, less all pairs.
    parts = parts.withColumn("score", F.col("own") + F.col("ones") * (2 * upto - F.sum("zeros").over(whole)))
    scores = parts.groupBy(*by).agg(F.sum("score").alias("score"))
    pairs = F.col("all") * (F.col("all") - 1) / 2
    down = F.sqrt(F.greatest(pairs - F.col("tx"), F.lit(0.0))) * F.sqrt(F.greatest(pairs - F.col("ty"), F.lit(0.0)))
    return totals.join(scores, by).select(*by, (F.col("score") / F.nullif(down, F.lit(0.0))).alias("correlation"))


def correlations(df: DataFrame, method: str = "spearman", columns: roles.Names = None, target: str | None = None) -> DataFrame:
    """(numeric_a, numeric_b, correlation) of every pair, or every other column with the target; null for a constant."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    pairs = _pairs(df, columns, target)
    if not pairs:
        return df.sparkSession.createDataFrame([], "numeric_a string, numeric_b string, correlation double")
    used = list(dict.fromkeys(c for p in pairs for c in p))
    if method == "spearman" and not any(df.agg(*(F.count_if(roles.number(df, c).isNull()) for c in used)).first()):
        found = _spearman_of_complete(df, pairs)
    else:
        found = {"pearson": _pearson, "spearman": _spearman, "kendall": _kendall}[method](_complete(df, pairs))
    named = df.sparkSession.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "a string, b string, at int")
    out = F.broadcast(named).join(found, ["a", "b"], "left").orderBy("at")
    return out.select(F.col("a").alias("numeric_a"), F.col("b").alias("numeric_b"), "correlation")


def correlation_comparison(df: DataFrame, threshold: float = 0.6, keep_above: bool | None = True, **kind) -> DataFrame:
    return batch.keep(correlations(df, **kind), "correlation", threshold, keep_above, absolute=True)


# Normality.


#: Royston's polynomials, from the constant up, of the root of 1 / n, of n, and of log n.
LAST = (0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
LAST_BUT_ONE = (0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
FEW_MEAN, FEW_LOG_SD, FEW_LIMIT = (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322), (-2.273, 0.459)
MANY_MEAN, MANY_LOG_SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def shapiro_weights(spark: SparkSession) -> DataFrame:
    """(n, a): what the order statistics of 3 to LARGE - 1 values are weighted with, from normal quantiles."""
    d = spark.range(3, LARGE).select(F.col("id").alias("n"), F.col("id").cast("double").alias("x"))
    d = d.withColumn("m", F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: special.normal_quantile_of((i - 0.375) / (F.col("x") + 0.25))))
    d = d.withColumn("mm", F.aggregate("m", F.lit(0.0), lambda s, v: s + v * v)).withColumn("u", 1 / F.sqrt("x"))
    top, next_ = F.element_at("m", -1), F.element_at("m", -2)
    last = F.when(F.col("n") == 3, math.sqrt(0.5)).otherwise(special.polynomial((0.0, *LAST), F.col("u")) + top / F.sqrt("mm"))
    d = d.withColumn("last", last).withColumn("before", special.polynomial((0.0, *LAST_BUT_ONE), F.col("u")) + next_ / F.sqrt("mm"))
    many = F.col("n") > 5
    left = F.col("mm") - 2 * top * top - F.when(many, 2 * next_ * next_).otherwise(0.0)
    rest = 1 - 2 * F.col("last") ** 2 - F.when(many, 2 * F.col("before") ** 2).otherwise(0.0)
    d = d.withColumn("scale", F.when(F.col("n") == 3, 1.0).otherwise(F.sqrt(left / F.nullif(rest, F.lit(0.0)))))
    at = lambda v, i: F.when(i == 0, -F.col("last")).when(i == F.col("n") - 1, F.col("last")).when(many & (i == 1), -F.col("before")).when(many & (i == F.col("n") - 2), F.col("before")).otherwise(v / F.col("scale"))
    return d.select("n", F.transform("m", at).alias("a"))


def shapiro(groups: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, p_value) of groups (by, n, x) with their values as arrays, by Royston's approximation; null under 3 values, 1 for equal ones."""
    g = groups.join(F.broadcast(shapiro_weights(groups.sparkSession)), "n", "left").withColumn("x", F.array_sort("x"))
    g = g.withColumn("mean", F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.col("n"))
    spread = F.aggregate("x", F.lit(0.0), lambda s, v: s + (v - F.col("mean")) * (v - F.col("mean")))
    weighed = F.aggregate(F.zip_with("a", "x", lambda a, v: a * v), F.lit(0.0), lambda s, v: s + v)
    g = g.withColumn("_w", F.least(F.lit(1.0), weighed * weighed / F.nullif(spread, F.lit(0.0))))
    w, n = F.col("_w"), F.col("n").cast("double")
    three = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    gone, limit, size = F.log(F.when(w < 1, 1 - w)), special.polynomial(FEW_LIMIT, n), F.log(n)
    few = (-F.log(F.when(limit > gone, limit - gone)) - special.polynomial(FEW_MEAN, n)) / F.exp(special.polynomial(FEW_LOG_SD, n))
    many = (gone - special.polynomial(MANY_MEAN, size)) / F.exp(special.polynomial(MANY_LOG_SD, size))
    g = g.withColumn("_z", F.when(F.col("n") <= 11, few).otherwise(many))
    same = F.element_at("x", 1) == F.element_at("x", -1)
    p = F.when(F.col("n") < 3, F.lit(None)).when(same, 1.0).when(F.col("n") == 3, three).when(w >= 1, 1.0).when((F.col("n") <= 11) & (limit <= gone), 0.0)
    return g.select(*by, "n", p.otherwise(special.normal_sf(F.col("_z"))).cast("double").alias("p_value"))


def shapiro_p(x: np.ndarray) -> float | None:
    """The same of one array of 3 to 5000 values, on its own."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return None if n < 3 else 1.0
    from ..functions.special import normal_quantile

    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = m @ m, 1 / math.sqrt(n)
    # Royston's polynomials.
    a = np.empty(n)
    an = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(mm)], u)
    if n == 3:
        a[:] = [-math.sqrt(0.5), 0, math.sqrt(0.5)]
    elif n <= 5:
        a[:] = m / math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * an**2))
        a[0], a[-1] = -an, an
    else:
        an1 = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(mm)], u)
        a[:] = m / math.sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * an1**2))
        a[0], a[1], a[-2], a[-1] = -an, -an1, an1, an
    w = min(1.0, (a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    if n == 3:
        return min(1.0, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w >= 1:
        return 1.0
    if n <= 11:
        g = -2.273 + 0.459 * n
        if g <= math.log(1 - w):
            return 0.0
        y, mu, sd = -math.log(g - math.log(1 - w)), np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        k = math.log(n)
        y, mu, sd = math.log(1 - w), np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    return 0.5 * math.erfc((y - mu) / sd / math.sqrt(2))


def k2(n, skew, kurt):
    """D'Agostino and Pearson's statistic from population moments, as an expression; ``kurt`` is the excess."""
    return special.bound(_k2, n=n, skew=skew, kurt=kurt)


def _k2(n, skew, kurt):
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    zs = special.bound(lambda w2: F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2)), w2=F.sqrt(2 * (beta2 - 1)) - 1)
    e = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurt + 3 - e) / F.sqrt(var)
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = special.bound(lambda b1: 6 + 8 / b1 * (2 / b1 + F.sqrt(1 + 4 / (b1 * b1))), b1=b1)

    def of_kurtosis(a, down):
        cube = F.signum(down) * F.pow((1 - 2 / a) / F.abs(F.nullif(down, F.lit(0.0))), F.lit(1 / 3))
        return (1 - 2 / (9 * a) - cube) / F.sqrt(2 / (9 * a))

    zk = special.bound(lambda a: special.bound(of_kurtosis, a=a, down=1 + x * F.sqrt(2 / (a - 4))), a=a)
    return special.bound(lambda zs, zk: zs * zs + zk * zk, zs=zs, zk=zk)


def normality(df: DataFrame, columns: roles.Names = None, exclude: roles.Names = None) -> DataFrame:
    """(numeric, n, p_value) of each numeric column; null for fewer than 3 values or a large constant."""
    names = roles.numeric_columns(df, columns, None, exclude)
    rows = batch.numbers(df, names)
    return normal_p(rows, ["numeric"])


def normal_p(rows: DataFrame, by: list[str], y: str = "y") -> DataFrame:
    """(by, n, p_value)."""
    m = rows.groupBy(*by).agg(F.count("*").alias("n"), F.skewness(y).alias("skew"), F.kurtosis(y).alias("kurt"), F.var_pop(y).alias("var"))
    large = m.where(F.col("n") >= LARGE).select(*by, "n", F.when(F.col("var") > 0, F.exp(-k2(F.col("n"), F.col("skew"), F.col("kurt")) / 2)).alias("p_value"))
    few = ranks.matched(rows, m.where(F.col("n") < LARGE).select(*by, "n"), by)
    few = few.groupBy(*by, "n").agg(F.collect_list(F.col(y).cast("double")).alias("x"))
    return large.unionByName(shapiro(few, by))


def normality_comparison(df: DataFrame, alpha: float = 0.05, keep_above: bool | None = False, **kind) -> DataFrame:
    return batch.keep(normality(df, **kind), "p_value", alpha, keep_above)
