"""Tests of a number over the groups of a category: variance, ranks, pairs of groups, two ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import roles
from ..functions import special
from . import balancing, batch
from .ranks import matched, quantiles, ranked, running, splitters, tied_sums, with_median

PAIR = ["category", "numeric"]
#: Within-group mean squares that are as good as zero, as an absolute bound.
ZERO = 1e-8


def _named(df: DataFrame, pairs: list[tuple[str, str]], stats: DataFrame) -> DataFrame:
    names = df.sparkSession.createDataFrame(pairs, "category string, numeric string")
    return F.broadcast(names).join(stats, PAIR, "left")


def _empty(df: DataFrame, ddl: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], ddl)


def one_way_of(rows: DataFrame, by: list[str], level: str = "level", y: str = "y") -> DataFrame:
    """(by, n, k, f_stat, p_value) of rows: groups are aggregated to their moments, then tested."""
    return one_way_of_groups(rows.groupBy(*by, level).agg(F.count("*").alias("gn"), F.avg(y).alias("mean"), F.var_pop(y).alias("var")), by)


def one_way_of_groups(g: DataFrame, by: list[str]) -> DataFrame:
    """The same from groups' sizes ``gn``, means and population variances ``var``."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    g = g.withColumn("grand", F.sum(F.col("gn") * F.col("mean")).over(part) / F.sum("gn").over(part))
    s = g.groupBy(*by).agg(F.sum("gn").alias("n"), F.count("*").alias("k"), F.sum(F.col("gn") * (F.col("mean") - F.col("grand")) ** 2).alias("between"), F.sum(F.col("gn") * F.col("var")).alias("within"))
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    mean_square = F.when(d2 > 0, F.col("within") / F.nullif(d2, F.lit(0.0)))
    f = F.when((d1 > 0) & (mean_square > ZERO), F.col("between") / F.nullif(d1, F.lit(0.0)) / F.nullif(mean_square, F.lit(0.0)))
    s = s.withColumn("f_stat", f)
    return s.select(*by, "n", "k", "f_stat", special.f_sf(F.col("f_stat"), d1, d2).alias("p_value"))


def one_way(df: DataFrame, pairs: list[tuple[str, str]], dropna: bool = True) -> DataFrame:
    """One-way ANOVA of every (categoric, numeric) pair; null without within-group variance."""
    if not pairs:
        return _empty(df, "category string, numeric string, n long, k long, f_stat double, p_value double")
    return _named(df, pairs, one_way_of(batch.mixed(df, pairs, dropna), PAIR))


def kruskal_of(rows: DataFrame, by: list[str], n: str | None = None, splits: list[float] | None = None) -> DataFrame:
    """(by, n, k, h_stat, p_value).  Ranks run over distinct values with counts, range by range; ``n`` counts a row's copies."""
    splits = splitters(rows, "y") if splits is None else splits
    cells = rows.groupBy(*by, "level", "y").agg((F.sum(n) if n else F.count("*")).alias("c"))
    return kruskal_of_sums(tied_sums(cells, by, "level", "c", splits), by)


def kruskal_tail() -> Column:
    """The p-value of h_stat and k."""
    return special.chi2_sf(F.col("h_stat"), (F.col("k") - 1).cast("double"))


def kruskal_of_sums(groups: DataFrame, by: list[str], tail: Column | None = None) -> DataFrame:
    """The same from each level's rows ``gn``, rank sum ``r``, part of the ties and most equal rows; ``tail`` is :func:`kruskal_tail`, if made before."""
    s = groups.groupBy(*by).agg(F.count("*").alias("k"), F.sum(F.col("r") ** 2 / F.col("gn")).alias("rr"), F.sum("gn").alias("n"), F.sum("ties").alias("ties"), F.max("tied").alias("tied"))
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("rr") - 3 * (n + 1)
    fix = 1 - F.col("ties") / F.nullif(n**3 - n, F.lit(0.0))
    s = s.withColumn("h_stat", F.when((F.col("k") > 1) & (F.col("tied") < F.col("n")), raw / F.nullif(fix, F.lit(0.0))))
    return s.select(*by, "n", "k", "h_stat", (kruskal_tail() if tail is None else tail).alias("p_value"))


def kruskal(df: DataFrame, pairs: list[tuple[str, str]], dropna: bool = True, splits: list[float] | None = None) -> DataFrame:
    """Kruskal-Wallis with tie correction, of every (categoric, numeric) pair; null for a constant or one group."""
    if not pairs:
        return _empty(df, "category string, numeric string, n long, k long, h_stat double, p_value double")
    return _named(df, pairs, kruskal_of(batch.mixed(df, pairs, dropna), PAIR, splits=splits))


TESTS = {"anova": one_way, "kruskal": kruskal}


def test_all(df: DataFrame, method: str = "kruskal", numeric: roles.Names = None, categoric: roles.Names = None, numeric_target: roles.Names = None, categoric_target: roles.Names = None, exclude: roles.Names = None, dropna: bool = True) -> DataFrame:
    """Every (categoric, numeric) pair, or those with a target."""
    if method not in TESTS:
        raise ValueError(f"method must be one of {sorted(TESTS)}, not {method!r}")
    pairs = roles.mixed_pairs(roles.categoric_columns(df, categoric, categoric_target), roles.numeric_columns(df, numeric, numeric_target), categoric_target, numeric_target, exclude)
    return TESTS[method](df, pairs, dropna)


def comparison(df: DataFrame, alpha: float = 0.05, keep_above: bool | None = False, **kind) -> DataFrame:
    return batch.keep(test_all(df, **kind), "p_value", alpha, keep_above)


def group_pairs(df: DataFrame, category: str, numeric: str, include_invalid: bool = False) -> DataFrame:
    """(subcat_1, subcat_2, p_value, n_1, n_2): Welch's test of every two groups.

    A group is valid with two rows and a spread; pairs with an invalid one are left out, or
    kept without a p-value.
    """
    g = batch.mixed(df, [(category, numeric)]).groupBy("level").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_samp("y").alias("v"))
    one = g.select(*(F.col(c).alias(f"{c}_1") for c in g.columns))
    two = g.select(*(F.col(c).alias(f"{c}_2") for c in g.columns))
    both = one.join(two, F.col("level_1") < F.col("level_2"))
    ok = F.coalesce((F.col("v_1") > 0) & (F.col("v_2") > 0), F.lit(False))
    both = both.withColumn("valid", ok)
    out = welch(both.where("valid"), "n_1", "m_1", "v_1", "n_2", "m_2", "v_2")
    cols = ["level_1", "level_2", "p_value", "n_1", "n_2"]
    if include_invalid:
        out = out.select(*cols).unionByName(both.where("NOT valid").withColumn("p_value", F.lit(None).cast("double")).select(*cols))
    return out.select(F.col("level_1").alias("subcat_1"), F.col("level_2").alias("subcat_2"), "p_value", F.col("n_1").alias("n_samples_1"), F.col("n_2").alias("n_samples_2"))


def group_similarities(df: DataFrame, category: str, numeric: str, alpha: float = 0.05, return_similar: bool = False, min_observations: int = 0) -> DataFrame:
    """Pairs of groups of more than ``min_observations`` that differ; all of them with ``return_similar``."""
    found = group_pairs(df, category, numeric).where((F.col("n_samples_1") > min_observations) & (F.col("n_samples_2") > min_observations))
    return found if return_similar else found.where(F.col("p_value") < alpha)


def welch(df: DataFrame, n1: str, m1: str, v1: str, n2: str, m2: str, v2: str) -> DataFrame:
    """Adds t_stat and p_value of Welch's test on moments."""
    a, b = F.col(v1) / F.col(n1), F.col(v2) / F.col(n2)
    spread = F.nullif(a + b, F.lit(0.0))
    t = (F.col(m1) - F.col(m2)) / F.sqrt(spread)
    dof = spread**2 / F.nullif(a**2 / F.nullif(F.col(n1) - 1, F.lit(0)) + b**2 / F.nullif(F.col(n2) - 1, F.lit(0)), F.lit(0.0))
    return df.withColumn("t_stat", t).withColumn("_dof", dof).withColumn("p_value", special.t_sf2(F.col("t_stat"), F.col("_dof"))).drop("_dof")


def student(df: DataFrame, n1: str, m1: str, v1: str, n2: str, m2: str, v2: str) -> DataFrame:
    """Adds t_stat and p_value of Student's test on moments, with pooled variance."""
    dof = F.nullif((F.col(n1) + F.col(n2) - 2).cast("double"), F.lit(0.0))
    pooled = ((F.col(n1) - 1) * F.col(v1) + (F.col(n2) - 1) * F.col(v2)) / dof
    t = (F.col(m1) - F.col(m2)) / F.sqrt(F.nullif(pooled * (1 / F.col(n1) + 1 / F.col(n2)), F.lit(0.0)))
    return df.withColumn("t_stat", t).withColumn("p_value", special.t_sf2(F.col("t_stat"), dof))


def two_way(df: DataFrame, a: str, b: str, y: str, balanced: bool = False) -> DataFrame:
    """(effect, ss, dof, f_stat, p_value) of both factors and their interaction.

    Sums of squares are sequential and weighted by cell sizes, or by their mean when
    ``balanced``; the error has N - levels(a) * levels(b) degrees of freedom, empty cells
    counted.
    """
    rows = df.select(roles.level(a).alias("a"), roles.level(b).alias("b"), roles.number(df, y).alias("y")).where("a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL")
    cells = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    grand = F.avg("m") if balanced else F.sum(F.col("n") * F.col("m")) / F.sum("n")
    # Reads v, which no cell lacks, so that both uses of the cells share their shuffle.
    whole = cells.where("v IS NOT NULL").agg(F.avg("n").alias("_mean"), grand.alias("grand"))
    c = cells.crossJoin(F.broadcast(whole)).withColumn("w", F.col("_mean") if balanced else F.col("n").cast("double"))
    mean = lambda part: F.sum(F.col("w") * F.col("m")).over(part) / F.sum("w").over(part)
    c = c.withColumn("ma", mean(Window.partitionBy("a"))).withColumn("mb", mean(Window.partitionBy("b")))
    s = c.agg(
        F.sum(F.col("w") * (F.col("ma") - F.col("grand")) ** 2).alias("sa"),
        F.sum(F.col("w") * (F.col("mb") - F.col("grand")) ** 2).alias("sb"),
        F.sum(F.col("w") * (F.col("m") - F.col("ma") - F.col("mb") + F.col("grand")) ** 2).alias("sab"),
        F.sum(F.col("n") * F.col("v")).alias("se"),
        F.sum("n").alias("n"),
        F.count_distinct("a").alias("ka"),
        F.count_distinct("b").alias("kb"),
    )
    da, db = (F.col("ka") - 1).cast("double"), (F.col("kb") - 1).cast("double")
    effects = F.array(
        F.struct(F.lit(a).alias("effect"), F.col("sa").alias("ss"), da.alias("dof")),
        F.struct(F.lit(b).alias("effect"), F.col("sb").alias("ss"), db.alias("dof")),
        F.struct(F.lit(f"{a}:{b}").alias("effect"), F.col("sab").alias("ss"), (da * db).alias("dof")),
    )
    de = (F.col("n") - F.col("ka") * F.col("kb")).cast("double")
    long = s.select(F.explode(effects).alias("e"), F.col("se"), de.alias("de")).select("e.*", "se", "de")
    f = F.when((F.col("dof") > 0) & (F.col("de") > 0) & (F.col("se") > 0), (F.col("ss") / F.nullif("dof", F.lit(0.0))) / F.nullif(F.col("se") / F.nullif("de", F.lit(0.0)), F.lit(0.0)))
    long = long.withColumn("f_stat", f)
    return long.select("effect", "ss", "dof", "f_stat", special.f_sf(F.col("f_stat"), F.col("dof"), F.col("de")).alias("p_value"))


def balanced_interactions(df: DataFrame, a: str, b: str, size: int | None = None, seed: int = 0) -> DataFrame:
    """As many random rows of each (a, b) cell, the smallest cell's number unless given; all columns stay.

    A cell with fewer rows than ``size`` keeps what it has.  Draws follow the rows' values.  :mod:`balancing` has more ways.
    """
    if size is None:
        size = df.groupBy(a, b).count().agg(F.min("count")).first()[0] or 0
    return balancing.first_drawn(df, [a, b], size, None, seed)
