"""Chi-squared tests on batched level counts, and expected-count rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import roles
from ..functions import special
from . import batch

PAIR = ["a", "b"]


def independence(df: DataFrame, pairs: list[tuple[str, str]], dropna: bool = True) -> DataFrame:
    """(category_a, category_b, n, chi2, dof, p_value, assumptions_met) of each column pair.

    Pearson's statistic without continuity correction, over observed levels; null with
    fewer than two on a side.  Empty cells add their expected count to the statistic, so
    only observed cells are summed.  The assumption is that no expected count is under 1
    and at most a fifth are under 5.
    """
    if not pairs:
        return df.sparkSession.createDataFrame([], "category_a string, category_b string, n long, chi2 double, dof long, p_value double, assumptions_met boolean")
    named = df.sparkSession.createDataFrame([(x, y, i) for i, (x, y) in enumerate(pairs)], "a string, b string, at int")
    return independence_of(batch.category_pairs(df, pairs, dropna), named)


def independence_of(counts: DataFrame, named: DataFrame) -> DataFrame:
    """The same from counts (a, b, la, lb, n) of level pairs, for the pairs (a, b, at) that are ``named``."""
    rows, columns = Window.partitionBy(*PAIR, "la"), Window.partitionBy(*PAIR, "lb")
    cells = counts.withColumn("ra", F.sum("n").over(rows)).withColumn("rb", F.sum("n").over(columns))
    stats = cells.groupBy(*PAIR).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("rb"))).alias("share"))
    rule = expected_counts(*(counts.groupBy(*PAIR, level).agg(F.sum("n").alias(name)) for level, name in (("la", "ra"), ("lb", "rb"))))
    stats = stats.join(rule, PAIR).select(*PAIR, "n", (F.col("n") * (F.col("share") - 1)).alias("chi2"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("dof"), "met")
    defined = F.col("dof") > 0
    out = F.broadcast(named).join(stats, PAIR, "left")
    out = out.select(F.col("a").alias("category_a"), F.col("b").alias("category_b"), F.coalesce("n", F.lit(0)).alias("n"), F.when(defined, F.greatest(F.lit(0.0), F.col("chi2"))).alias("chi2"), "dof", "met")
    return out.select("category_a", "category_b", "n", "chi2", "dof", special.chi2_sf(F.col("chi2"), F.col("dof").cast("double")).alias("p_value"), F.coalesce(F.col("met") & F.col("chi2").isNotNull(), F.lit(False)).alias("assumptions_met"))


def expected_counts(ra: DataFrame, rb: DataFrame) -> DataFrame:
    """(a, b, total, ka, kb, least, low, met) of column pairs from their margins (a, b, la, ra) and (a, b, lb, rb).

    ``least`` is the smallest expected count and ``low`` the number of cells, empty ones included, with one
    under 5.  Levels of one margin are alike, so two histograms of margins are merged: their values number at most the root of
    twice the rows, whatever the number of levels.  An expected count ra * rb / total is under 5 where rb <= (5 * total - 1) div ra.
    """
    side = lambda margins, own, asks: margins.select(*PAIR, F.col(own).alias("margin"), F.lit(asks).alias("asks"))
    alike = side(ra, "ra", 1).unionByName(side(rb, "rb", 0)).groupBy(*PAIR, "asks", "margin").agg(F.count("*").alias("k"))
    pair, rows = Window.partitionBy(*PAIR), F.col("asks") == 1
    known = {"total": F.sum(F.when(rows, F.col("margin") * F.col("k"))), "ka": F.sum(F.when(rows, F.col("k"))), "kb": F.sum(F.when(~rows, F.col("k"))), "least_a": F.min(F.when(rows, F.col("margin"))), "least_b": F.min(F.when(~rows, F.col("margin")))}
    merged = alike.withColumns({name: e.over(pair) for name, e in known.items()})
    merged = merged.withColumn("at", F.when(rows, F.expr("(5 * total - 1) div margin")).otherwise(F.col("margin")))
    upto = F.sum(F.when(rows, 0).otherwise(F.col("k"))).over(pair.orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0))
    s = merged.withColumn("upto", upto).groupBy(*PAIR).agg(*(F.first(name).alias(name) for name in known), F.sum(F.when(rows, F.col("k") * F.col("upto")).otherwise(0)).alias("low"))
    least = F.col("least_a") * F.col("least_b") / F.col("total")
    return s.select(*PAIR, "total", "ka", "kb", least.alias("least"), "low", ((least >= 1) & (F.col("low") * 5 <= F.col("ka") * F.col("kb"))).alias("met"))


def independence_all(df: DataFrame, columns: roles.Names = None, target: roles.Names = None, exclude: roles.Names = None, dropna: bool = True) -> DataFrame:
    """Every pair of categoric columns, or each target with every other."""
    return independence(df, roles.same_pairs(roles.categoric_columns(df, columns, target, None if target else exclude), target, exclude), dropna)


def comparison(df: DataFrame, alpha: float = 0.05, keep_above: bool | None = False, **kind) -> DataFrame:
    return batch.keep(independence_all(df, **kind), "p_value", alpha, keep_above)


def goodness_of_fit(df: DataFrame, columns: roles.Names = None, exclude: roles.Names = None, dropna: bool = True) -> DataFrame:
    """(category, n, k, chi2, p_value, assumptions_met) against equal shares; null for one level."""
    names = roles.categoric_columns(df, columns, None, exclude)
    counts = batch.levels(df, names, dropna)
    s = counts.groupBy("category").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    e = F.col("n") / F.col("k")
    s = s.withColumn("chi2", F.when(F.col("k") > 1, F.col("nn") / e - F.col("n")))
    return s.select("category", "n", "k", "chi2", special.chi2_sf(F.col("chi2"), (F.col("k") - 1).cast("double")).alias("p_value"), (e >= 5).alias("assumptions_met"))


def goodness_of_fit_comparison(df: DataFrame, alpha: float = 0.05, keep_above: bool | None = False, **kind) -> DataFrame:
    return batch.keep(goodness_of_fit(df, **kind), "p_value", alpha, keep_above)


def _two_samples(cells: DataFrame, by: list[str]) -> DataFrame:
    """Homogeneity of n1 and n2 over levels, per group ``by``; null when over a fifth of expected counts are under 5."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    w = cells.withColumn("t1", F.sum("n1").over(part)).withColumn("t2", F.sum("n2").over(part)).withColumn("both", F.col("n1") + F.col("n2"))
    total = F.col("t1") + F.col("t2")
    w = w.withColumn("e1", F.col("both") * F.col("t1") / total).withColumn("e2", F.col("both") * F.col("t2") / total)
    term = lambda n, e: F.when(F.col(e) > 0, (F.col(n) - F.col(e)) ** 2 / F.nullif(F.col(e), F.lit(0.0)))
    low = F.avg((F.when(F.col("e1") < 5, 1.0).otherwise(0.0) + F.when(F.col("e2") < 5, 1.0).otherwise(0.0)) / 2)
    s = w.groupBy(*by).agg(F.sum(term("n1", "e1") + term("n2", "e2")).alias("x"), (F.count("*") - 1).alias("dof"), low.alias("low"), F.min(F.least("t1", "t2")).alias("least"))
    chi2 = F.when((F.col("low") <= 0.2) & (F.col("dof") > 0) & (F.col("least") > 0), F.col("x"))
    return s.select(*by, chi2.alias("chi2"), special.chi2_sf(chi2, F.col("dof").cast("double")).alias("p_value"))


def homogeneity(one: DataFrame, two: DataFrame, column: str) -> DataFrame:
    """(chi2, p_value) of two samples' counts per level."""
    n1, n2 = (df.select(roles.level(column).alias("level")).where("level IS NOT NULL").groupBy("level").agg(F.count("*").alias(n)) for df, n in ((one, "n1"), (two, "n2")))
    return _two_samples(n1.join(n2, "level", "outer").na.fill(0), [])


def subcategories(df: DataFrame, a: str, b: str) -> DataFrame:
    """(subcat_a, subcat_b, source_column, p_value): every two levels of a column compared over the other, both ways."""
    n = batch.category_pairs(df, [(a, b)]).select("la", "lb", "n")
    both = n.select(F.lit(a).alias("source_column"), F.col("la").alias("own"), F.col("lb").alias("over"), "n").unionByName(n.select(F.lit(b).alias("source_column"), F.col("lb").alias("own"), F.col("la").alias("over"), "n"))
    own = both.select("source_column", "own").distinct()
    pairs = own.withColumnRenamed("own", "subcat_a").join(own.withColumnRenamed("own", "subcat_b"), "source_column").where("subcat_a < subcat_b")
    key = ["source_column", "subcat_a", "subcat_b"]
    # Level pairs are few: they are names, not rows.
    sides = pairs.select(*key, F.explode(F.array(F.struct(F.col("subcat_a").alias("own"), F.lit(1).alias("side")), F.struct(F.col("subcat_b").alias("own"), F.lit(2).alias("side")))).alias("s")).select(*key, "s.*")
    cells = sides.join(both, ["source_column", "own"]).groupBy(*key, "over").agg(F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("side") == 2, F.col("n")).otherwise(0)).alias("n2"))
    return _two_samples(cells, key).select("subcat_a", "subcat_b", "source_column", "p_value")


def subcategory_similarities(df: DataFrame, a: str, b: str, alpha: float = 0.05, return_similar: bool = False) -> DataFrame:
    """Pairs that differ; with ``return_similar`` all pairs that have a p-value."""
    found = subcategories(df, a, b).where("p_value IS NOT NULL")
    return found if return_similar else found.where(F.col("p_value") < alpha)


# Super- and subcategories.


def _super_sub(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return batch.category_pairs(df, pairs)


def deterministic_share(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(supercategory, subcategory, share): the share of sub levels that lie in exactly one super level."""
    per = _super_sub(df, pairs).groupBy("a", "b", "lb").agg(F.count("*").alias("k"))
    return per.groupBy(F.col("a").alias("supercategory"), F.col("b").alias("subcategory")).agg(F.avg(F.when(F.col("k") == 1, 1.0).otherwise(0.0)).alias("share"))


def conditional_entropy(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(supercategory, subcategory, bits): the mean over sub levels of the entropy of their super levels."""
    n = _super_sub(df, pairs)
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("a", "b", "lb")))
    per = p.groupBy("a", "b", "lb").agg((-F.sum(F.col("p") * F.log2(F.col("p") + 1e-12))).alias("bits"))
    return per.groupBy(F.col("a").alias("supercategory"), F.col("b").alias("subcategory")).agg(F.avg("bits").alias("bits"))


def sub_to_super(df: DataFrame, supercategory: str, subcategory: str) -> DataFrame:
    """(supercategory, subcategory): each sub level's most frequent super level, the smaller one of equals; null is a level."""
    n = df.groupBy(F.col(supercategory).alias("supercategory"), F.col(subcategory).alias("subcategory")).agg(F.count("*").alias("n"))
    first = Window.partitionBy("subcategory").orderBy(F.desc("n"), F.asc_nulls_last("supercategory"))
    return n.withColumn("at", F.row_number().over(first)).where("at = 1").select("supercategory", "subcategory").orderBy("supercategory", "subcategory")


def ordered_pairs(df: DataFrame, columns: list[str]) -> list[tuple[str, str]]:
    """Pairs with the column of fewer levels first."""
    n = df.agg(*(F.count_distinct(F.col(c)).alias(c) for c in columns)).first().asDict()
    return [(a, b) if n[a] <= n[b] else (b, a) for a, b in roles.same_pairs(columns)]


def deterministic_pairs(df: DataFrame, columns: list[str], min_share: float | None = 1.0) -> DataFrame:
    found = deterministic_share(df, ordered_pairs(df, columns))
    return (found if min_share is None else found.where(F.col("share") >= min_share)).orderBy(F.desc("share"), "supercategory", "subcategory")


def entropy_pairs(df: DataFrame, columns: list[str], max_bits: float | None = 0.2) -> DataFrame:
    found = conditional_entropy(df, ordered_pairs(df, columns))
    return (found if max_bits is None else found.where(F.col("bits") <= max_bits)).orderBy("bits", "supercategory", "subcategory")


