"""Counts, shares, contingency tables and summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import roles
from . import anova, batch, ranks


def column_makeup(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, count, share): level pairs with their share of all rows that have both."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("count"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("count").alias("_all")))).select(a, b, "count", (F.col("count") / F.col("_all")).alias("share"))


def contingency(df: DataFrame, a: str, b: str, probabilities: bool = False) -> DataFrame:
    """(level_a, level_b, value): cells and margins in one pass; null stands for all levels.

    ``cube`` gives the cells, both margins and the total.
    """
    rows = df.select(roles.level(a).alias("level_a"), roles.level(b).alias("level_b")).where("level_a IS NOT NULL AND level_b IS NOT NULL")
    n = rows.cube("level_a", "level_b").agg(F.count("*").alias("value"))
    if not probabilities:
        return n
    total = n.where("level_a IS NULL AND level_b IS NULL").select(F.col("value").alias("_all"))
    return n.crossJoin(F.broadcast(total)).select("level_a", "level_b", (F.col("value") / F.col("_all")).alias("value"))


def frequencies(df: DataFrame, a: str, b: str, probabilities: bool = False) -> DataFrame:
    """Zero-filled cells of all observed levels."""
    cells = contingency(df, a, b).where("level_a IS NOT NULL AND level_b IS NOT NULL")
    grid = cells.select("level_a").distinct().crossJoin(cells.select("level_b").distinct())
    out = grid.join(cells, ["level_a", "level_b"], "left").select("level_a", "level_b", F.coalesce("value", F.lit(0)).alias("value"))
    if not probabilities:
        return out
    return out.crossJoin(F.broadcast(cells.agg(F.sum("value").alias("_all")))).select("level_a", "level_b", (F.col("value") / F.col("_all")).alias("value"))


def wide(df: DataFrame, a: str, b: str) -> DataFrame:
    """The contingency table with one column per level of ``b``, for display."""
    return df.groupBy(a).pivot(b).count().na.fill(0)


def group_summary(df: DataFrame, group: str, y: str) -> DataFrame:
    """(level, n, median, mean, std, iqr, skew): the skewness is corrected for bias."""
    rows = batch.mixed(df, [(group, y)])
    n = F.count("*")
    skew = F.when((n > 2) & (F.var_pop("y") > 0), F.skewness("y") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))
    s = rows.groupBy("level").agg(n.alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), skew.alias("skew"))
    q = F.col("q")
    return s.join(ranks.quantiles(rows, ["level"], (0.25, 0.5, 0.75)), "level").select("level", "n", q[1].alias("median"), "mean", "std", (q[2] - q[0]).alias("iqr"), "skew")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(category, level, n, share) of each column."""
    return batch.levels(df, columns).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("category")))


def n_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the distinct non-null values of each column."""
    return df.agg(*(F.count_distinct(F.col(c)).alias(c) for c in columns))


def max_tie_ratio(df: DataFrame, columns: list[str]) -> DataFrame:
    """(numeric, ratio): the share of the most frequent value."""
    n = batch.numbers(df, columns).groupBy("numeric", "y").agg(F.count("*").alias("n"))
    return n.groupBy("numeric").agg((F.max("n") / F.sum("n")).alias("ratio"))


def grouped_describe(df: DataFrame, y: str, by: list[str]) -> DataFrame:
    v = roles.number(df, y)
    s = df.groupBy(*by).agg(F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.stddev_samp(v).alias("std"), F.count("*").alias("size"))
    return ranks.with_median(df, s, y, by).select(*by, "min", "mean", "median", "max", "std", "size")


def histogram(df: DataFrame, y: str, bins: int | None = None) -> DataFrame:
    """(bin, low, high, n).  Without a number of bins: the narrower of Sturges' and Freedman and Diaconis' widths.

    Bins are closed below; the last one also above.
    """
    v = roles.number(df, y)
    s = df.agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    if not s["n"]:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    span = s["hi"] - s["lo"]
    if bins is None:
        q = ranks.quantiles(df.select(v.alias("y")), [], (0.25, 0.75)).first()["q"]
        widths = [span / (1 + math.log2(s["n"])), 2 * (q[1] - q[0]) / s["n"] ** (1 / 3)]
        width = min(w for w in widths if w > 0) if span and any(w > 0 for w in widths) else 0
        bins = max(1, -int(-span // width)) if width else 1
    width = span / bins or 1.0
    low = s["lo"] if span else s["lo"] - 0.5
    at = F.least(F.lit(bins - 1), F.floor((v - low) / width).cast("int"))
    n = df.where(v.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    edges = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return edges.join(n, "bin", "left").select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def distribution_per_category(df: DataFrame, group: str, y: str, shares: tuple[float, ...] = (0.0, 0.125, 0.25, 0.5, 0.75, 0.875, 1.0)) -> DataFrame:
    """(level, n, quantiles): what box, letter-value and violin plots draw."""
    rows = batch.mixed(df, [(group, y)])
    return rows.groupBy("level").agg(F.count("*").alias("n")).join(ranks.quantiles(rows, ["level"], shares), "level").select("level", "n", F.col("q").alias("quantiles"))


def letter_values(df: DataFrame, group: str, y: str) -> DataFrame:
    """(level, n, depth, low, high): what a letter-value plot draws of each category; its median has depth 0.

    Depth i has the quantiles 2^-(i+1) and 1 - 2^-(i+1).  A category has log2(n) - 3 depths, rounded down, and at least one.
    """
    rows = batch.mixed(df, [(group, y)])
    sizes = rows.groupBy("level").agg(F.count("*").alias("n"))
    most = max(1, int(sizes.agg(F.max("n")).first()[0] or 0).bit_length() - 4)
    shares = (0.5, *(s for i in range(1, most + 1) for s in (0.5 ** (i + 1), 1 - 0.5 ** (i + 1))))
    found = sizes.join(ranks.quantiles(rows, ["level"], shares), "level")
    at = lambda i: F.col("q")[F.lit(i)]
    each = F.array(F.struct(F.lit(0).alias("depth"), at(0).alias("low"), at(0).alias("high")), *(F.struct(F.lit(i).alias("depth"), at(2 * i - 1).alias("low"), at(2 * i).alias("high")) for i in range(1, most + 1)))
    depths = F.greatest(F.lit(1), F.length(F.bin("n")) - 4)
    return found.select("level", "n", F.explode(each).alias("v"), depths.alias("_depths")).where("v.depth <= _depths").select("level", "n", "v.*")


#: Bins that a density is gathered in, per step of its grid.
FINE = 4


def density(df: DataFrame, y: str, group: str | None = None, grid: int = 100, cut: float = 2.0, adjust: float = 1.0) -> DataFrame:
    """(level, at, density) at ``grid`` points per category: Gaussian kernels of Scott's width times ``adjust``.

    The grid goes ``cut`` widths beyond the values.  Rows are shared linearly between the nearest of ``FINE`` times as many
    points, and these are convolved, so the work after one pass doesn't follow the rows.  Categories whose values
    have no spread have no density.  Without ``group`` all rows are one, its level null.
    """
    if group is None:
        rows = df.select(F.lit(None).cast("string").alias("level"), roles.number(df, y).alias("y")).where("y IS NOT NULL")
    else:
        rows = batch.mixed(df, [(group, y)]).select("level", "y")
    s = rows.groupBy("level").agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.stddev_samp("y").alias("sd")).where("sd > 0")
    width = F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)) * adjust
    s = s.withColumn("width", width).withColumn("start", F.col("lo") - cut * F.col("width"))
    s = s.withColumn("step", (F.col("hi") - F.col("lo") + 2 * cut * F.col("width")) / (grid - 1)).select("level", "n", "width", "start", "step")
    place = (F.col("y") - F.col("start")) / F.col("step") * FINE
    rows = ranks.matched(rows, s, ["level"]).withColumn("place", place).withColumn("left", F.floor("place"))
    sides = F.array(F.struct(F.col("left").alias("bin"), (F.lit(1) - F.col("place") + F.col("left")).alias("mass")), F.struct((F.col("left") + 1).alias("bin"), (F.col("place") - F.col("left")).alias("mass")))
    bins = rows.select("level", F.explode(sides).alias("b")).groupBy("level", F.col("b.bin").alias("bin")).agg(F.sum("b.mass").alias("mass"))
    points = df.sparkSession.range(grid).select(F.col("id").alias("point"))
    near = ranks.matched(bins, s, ["level"]).crossJoin(F.broadcast(points))
    away = (F.col("point") * FINE - F.col("bin")) * F.col("step") / FINE / F.col("width")
    kernel = F.exp(-away * away / 2) / math.sqrt(2 * math.pi)
    out = near.groupBy("level", "point").agg(F.first(F.col("start") + F.col("point") * F.col("step")).alias("at"), (F.sum(F.col("mass") * kernel) / F.first(F.col("n") * F.col("width"))).alias("density"))
    return out.select("level", "at", "density")


def joint(df: DataFrame, x: str, y: str, bins: int = 30) -> dict[str, DataFrame]:
    """What a joint plot draws: ``points`` (bin_x, bin_y, n), the margins ``x`` and ``y`` (bin, low, high, n) and the ``line``.

    Points are counted in a grid of ``bins`` by ``bins`` cells, so their number doesn't follow the rows'.
    """
    a, b = roles.number(df, x), roles.number(df, y)
    both = df.select(a.alias("x"), b.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    limits = both.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cell = lambda v: F.when(F.col(f"{v}1") > F.col(f"{v}0"), F.least(F.lit(bins - 1), F.floor((F.col(v) - F.col(f"{v}0")) * bins / (F.col(f"{v}1") - F.col(f"{v}0"))))).otherwise(0).cast("int")
    points = both.crossJoin(F.broadcast(limits)).groupBy(cell("x").alias("bin_x"), cell("y").alias("bin_y")).agg(F.count("*").alias("n"))
    return {"points": points, "x": histogram(both, "x", bins), "y": histogram(both, "y", bins), "line": regression_line(both, "x", "y")}


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, slope, intercept) of the least-squares line of a joint plot; null for a constant x."""
    a, b = roles.number(df, x), roles.number(df, y)
    both = df.select(a.alias("x"), b.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    m = both.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.covar_pop("x", "y").alias("cxy"))
    slope = F.when(F.col("vx") > 0, F.col("cxy") / F.nullif(F.col("vx"), F.lit(0.0)))
    return m.select("n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def subcategories(df: DataFrame, supercategory: str, subcategory: str) -> DataFrame:
    """(supercategory, n_subcategories)."""
    return df.where(F.col(supercategory).isNotNull()).groupBy(F.col(supercategory).alias("supercategory")).agg(F.count_distinct(subcategory).alias("n_subcategories"))
