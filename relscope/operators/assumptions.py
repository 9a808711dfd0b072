"""Gates on the assumptions of the tests over groups."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from . import anova, batch, numeric, ranks

PAIR = ["category", "numeric"]
#: What the lenient gate answers; a fixed value.
LENIENT = "Psuedo"
#: The larger sample's size up to which p-values of Kolmogorov and Smirnov are exact.
EXACT = 10_000


@dataclass(frozen=True)
class AnovaRules:
    normality_alpha: float = 0.02
    homogeneity_alpha: float = 0.05
    min_n: int = 5
    iqr_multiplier: float = 2.0


@dataclass(frozen=True)
class KruskalRules:
    levene_alpha: float = 0.05
    ks_alpha: float = 0.05
    return_lenient: bool = False
    max_tie_ratio: float = 0.5
    tolerant: bool = False
    only_lenient: bool = False


def levene(rows: DataFrame, by: list[str] = PAIR, splits: list[float] | None = None) -> DataFrame:
    """(by, p_value) of the median-centred test: ANOVA on distances from the group's median."""
    centre = ranks.quantiles(rows, [*by, "level"], (0.5,), splits=splits).select(*by, "level", F.col("q")[0].alias("med"))
    away = rows.join(centre, [*by, "level"]).withColumn("y", F.abs(F.col("y") - F.col("med")))
    return anova.one_way_of(away, by).select(*by, F.col("f_stat").alias("levene"), "p_value")


def without_outliers(rows: DataFrame, by: list[str] = PAIR, multiplier: float = 1.5, splits: list[float] | None = None) -> DataFrame:
    """Rows within the quartiles of their group, widened by a multiple of the quartile range."""
    q = ranks.quantiles(rows, [*by, "level"], (0.25, 0.75), splits=splits)
    w = F.lit(multiplier) * (F.col("q")[1] - F.col("q")[0])
    return rows.join(q, [*by, "level"]).where((F.col("y") >= F.col("q")[0] - w) & (F.col("y") <= F.col("q")[1] + w)).drop("q")


def group_sizes(rows: DataFrame, by: list[str] = PAIR, min_n: int = 5) -> DataFrame:
    """(by, met): whether every group has ``min_n`` rows."""
    return rows.groupBy(*by, "level").agg(F.count("*").alias("n")).groupBy(*by).agg((F.min("n") >= min_n).alias("met"))


def group_normality(rows: DataFrame, by: list[str] = PAIR, alpha: float = 0.05, min_n: int = 3) -> DataFrame:
    """(by, met): whether no group departs from normal; a group of fewer than ``min_n`` does, 3 at least."""
    p = numeric.normal_p(rows, [*by, "level"])
    return p.groupBy(*by).agg(F.bool_and(F.coalesce((F.col("n") >= max(3, min_n)) & (F.col("p_value") > alpha), F.lit(False))).alias("met"))


def anova_met(df: DataFrame, pairs: list[tuple[str, str]], rules: AnovaRules = AnovaRules(), dropna: bool = True, splits: list[float] | None = None) -> DataFrame:
    """(category, numeric, assumptions_met): after outliers go, sizes, equal spread and normality within groups."""
    return anova_met_of(batch.mixed(df, pairs, dropna), rules, splits)


def _anova_gates(rows: DataFrame, rules: AnovaRules, splits: list[float] | None) -> tuple[DataFrame, DataFrame]:
    """(category, numeric, spread) and (category, numeric, shape); one set of splitters serves rows and what is left of them."""
    splits = ranks.splitters(rows, "y") if splits is None else splits
    rows = without_outliers(rows, PAIR, rules.iqr_multiplier, splits)
    spread = levene(rows, PAIR, splits).select(*PAIR, F.coalesce(F.col("p_value") > rules.homogeneity_alpha, F.lit(False)).alias("spread"))
    # Sizes are looked at along with shapes.
    return spread, group_normality(rows, PAIR, rules.normality_alpha, rules.min_n).withColumnRenamed("met", "shape")


def anova_met_of(rows: DataFrame, rules: AnovaRules = AnovaRules(), splits: list[float] | None = None) -> DataFrame:
    """The same of rows (category, numeric, level, y)."""
    spread, shape = _anova_gates(rows, rules, splits)
    return shape.join(spread, PAIR).select(*PAIR, (F.col("shape") & F.col("spread")).alias("assumptions_met"))


def ks_exact_p(n1: int, n2: int, d: float) -> float:
    """Two-sided tail: the share of lattice paths that reach the distance, counted row by row.

    Only the band of cells within the distance is kept of a row; all paths to a cell beyond it count.
    """
    if d <= 0:
        return 1.0
    n, m = max(n1, n2), min(n1, n2)
    lcm = math.lcm(n, m)
    h, up, across = round(d * lcm), lcm // m, lcm // n
    factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + m + 1)))])
    paths = lambda i, k: factorial[i + k] - factorial[i] - factorial[k]
    # Counts are in units of exp(scale), the largest so far being about 1.
    row, low, high, scale = np.zeros(min(n, (h - 1) // across) + 1), 0, min(n, (h - 1) // across), -math.inf
    for i in range(1, m + 1):
        lo, hi = max(0, (i * up - h) // across + 1), min(n, -((-i * up - h) // across) - 1)
        left = float(paths(i, lo - 1)) if lo else -math.inf
        above = paths(i - 1, np.arange(high + 1, hi + 1))
        largest = max(scale, left, above.max(initial=-math.inf))
        if largest == -math.inf:
            row, low, high = np.zeros(hi - lo + 1), lo, hi
            continue
        from_above = np.concatenate([row[lo - low :] * math.exp(scale - largest), np.exp(above - largest)])
        row = math.exp(left - largest) + np.cumsum(from_above)
        top = row.max()
        row, low, high, scale = row / top if top else row, lo, hi, largest + math.log(top) if top else largest
    return float(min(1.0, math.exp(min(0.0, scale - paths(m, n))) * row[-1])) if scale > -math.inf else 0.0


def _exact(p: pd.DataFrame, most: int) -> pd.DataFrame:
    """P-values of pairs of small groups replaced by exact ones."""
    few = p[["n_1", "n_2"]].max(axis=1) <= most
    return p.assign(p_value=[ks_exact_p(a, b, d) if f else q for f, a, b, d, q in zip(few, p.n_1, p.n_2, p.ks_stat, p.p_value, strict=True)])


#: Shares that a sweep holds at a time.
HELD = 4_000_000


def _largest_gaps(by: list[str]):
    """One range of one test: the largest gap of every two groups' cumulative shares at its values.

    Rows with ``n`` tell each group's size and what it has in lower ranges.  A gap can only peak where one of both
    groups has a row, so a group is held against all others at its own values.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        known, cells = p[p["n"].notna()].sort_values("level"), p[p["n"].isna()]
        levels, sizes, upto = known["level"].to_numpy(), known["n"].to_numpy(float), known["c"].to_numpy(float)
        group = pd.Index(levels).get_indexer(cells["level"])
        values, place = np.unique(cells["y"].to_numpy(), return_inverse=True)
        order = np.argsort(place, kind="stable")
        place, group, count = place[order], group[order], cells["c"].to_numpy(float)[order]
        gap, step = np.zeros((len(levels), len(levels))), max(1, HELD // max(1, len(levels)))
        for at in range(0, len(values), step):
            a, b = np.searchsorted(place, [at, at + step])
            shares = np.zeros((min(step, len(values) - at), len(levels)))
            shares[place[a:b] - at, group[a:b]] = count[a:b]
            shares = np.cumsum(shares, axis=0) + upto
            upto = shares[-1]
            shares = shares / sizes
            own = np.argsort(group[a:b], kind="stable")
            edges = np.searchsorted(group[a:b][own], np.arange(len(levels) + 1))
            for g in np.flatnonzero(np.diff(edges)).tolist():
                at_own = shares[place[a:b][own[edges[g] : edges[g + 1]]] - at]
                gap[g] = np.maximum(gap[g], np.abs(at_own - at_own[:, g : g + 1]).max(axis=0))
        gap = np.maximum(gap, gap.T)
        one, two = np.triu_indices(len(levels), 1)
        out = {"x_1": levels[one], "x_2": levels[two], "n_1": sizes[one].astype(np.int64), "n_2": sizes[two].astype(np.int64), "gap": gap[one, two]}
        return pd.DataFrame({c: p[c].iloc[0] for c in by} | out) if len(one) else pd.DataFrame(columns=[*by, *out])

    return run


def ks_pairs(rows: DataFrame, by: list[str] = PAIR, exact: int = EXACT, splits: list[float] | None = None) -> DataFrame:
    """(by, x_1, x_2, n_1, n_2, ks_stat, p_value) of every two groups.

    All groups are swept at once, range by range of the values, so a row takes part once however many groups
    there are.  P-values are exact while both groups have up to ``exact`` rows, asymptotic beyond.
    """
    splits = ranks.splitters(rows, "y") if splits is None else splits
    cells = rows.groupBy(*by, "level", "y").agg(F.count("*").alias("c"))
    cells = ranks.with_range(cells, "y", splits)
    totals = cells.groupBy(*by, "_range", "level").agg(F.sum("c").alias("c"))
    sizes = totals.groupBy(*by, "level").agg(F.sum("c").alias("n"))
    grid = ranks.matched(totals.select(*by, "_range").distinct(), sizes, by)
    grid = grid.join(totals, [*by, "_range", "level"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    known = ranks.before(grid, [*by, "level"], "c", "_before")
    known = known.select(*by, "_range", "level", F.lit(None).cast("double").alias("y"), F.col("_before").alias("c"), "n")
    both = known.unionByName(cells.select(*by, "_range", "level", F.col("y").cast("double").alias("y"), "c", F.lit(None).cast("long").alias("n")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)
    level = rows.schema["level"].dataType.simpleString()
    own = f"x_1 {level}, x_2 {level}, n_1 long, n_2 long"
    gaps = both.groupBy(*by, "_range").applyInPandas(_largest_gaps(by), f"{kinds + ', ' if by else ''}{own}, gap double")
    d = gaps.groupBy(*by, "x_1", "x_2", "n_1", "n_2").agg(F.max("gap").alias("ks_stat"))
    both = (F.col("n_1") * F.col("n_2") / (F.col("n_1") + F.col("n_2"))).cast("double")
    d = d.withColumn("p_value", special.kolmogorov_sf(F.sqrt(both) * F.col("ks_stat")))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields)
    return d.mapInPandas(lambda it: (_exact(p, exact) for p in it), ddl) if exact else d


def ks_met(pairs: DataFrame, by: list[str] = PAIR, alpha: float = 0.05, tolerant: bool = False) -> DataFrame:
    """(by, met): no two groups differ; or, ``tolerant``, few enough of each group's pairs and of all do."""
    out = F.coalesce(F.col("p_value") < alpha, F.lit(False))
    if not tolerant:
        return pairs.groupBy(*by).agg((~F.bool_or(out)).alias("met"))
    each = pairs.withColumn("out", out.cast("double")).select(*by, "out", F.explode(F.array("x_1", "x_2")).alias("x"))
    per = each.groupBy(*by, "x").agg(F.avg("out").alias("share"))
    part = Window.partitionBy(*by)
    spread = F.stddev_pop("share").over(part)
    z = F.when(spread > 0, (F.col("share") - F.avg("share").over(part)) / F.nullif(spread, F.lit(0.0))).otherwise(0.0)
    per = per.withColumn("bad", (F.col("share") > 0.2) | (z > 3)).groupBy(*by).agg(F.bool_or("bad").alias("bad"), F.avg("share").alias("all"))
    return per.select(*by, (~F.col("bad") & (F.col("all") <= 0.2)).alias("met"))


def lenient(df: DataFrame, pairs: list[tuple[str, str]], max_ratio: float = 0.5) -> DataFrame:
    """(category, numeric, lenient): whether no value of the number is too frequent, over all its rows."""
    n = batch.numbers(df, list(dict.fromkeys(y for _, y in pairs))).groupBy("numeric", "y").agg(F.count("*").alias("n"))
    ok = n.groupBy("numeric").agg((F.max("n") / F.sum("n") < max_ratio).alias("lenient"))
    return df.sparkSession.createDataFrame(pairs, "category string, numeric string").join(ok, "numeric", "left").select(*PAIR, "lenient")


def kruskal_met(df: DataFrame, pairs: list[tuple[str, str]], rules: KruskalRules = KruskalRules(), dropna: bool = True, splits: list[float] | None = None) -> DataFrame:
    """(category, numeric, assumptions_met): 'True', 'False' or what the lenient gate answers."""
    return kruskal_met_of(batch.mixed(df, pairs, dropna), lenient(df, pairs, rules.max_tie_ratio), rules, splits)


def kruskal_met_of(rows: DataFrame, ties: DataFrame, rules: KruskalRules = KruskalRules(), splits: list[float] | None = None) -> DataFrame:
    """The same of rows (category, numeric, level, y), with what :func:`lenient` says of the pairs."""
    ties = ties.withColumn("else_", F.when(F.col("lenient"), LENIENT).otherwise("False"))
    if rules.only_lenient:
        return ties.select(*PAIR, F.col("else_").alias("assumptions_met"))
    splits = ranks.splitters(rows, "y") if splits is None else splits
    sizes = rows.groupBy(*PAIR, "level").agg(F.count("*").alias("n")).groupBy(*PAIR).agg(F.count("*").alias("k"), F.min("n").alias("least"))
    spread = levene(rows, PAIR, splits).select(*PAIR, F.coalesce(F.col("p_value") < rules.levene_alpha, F.lit(False)).alias("uneven"))
    shape = ks_met(ks_pairs(rows, splits=splits), PAIR, rules.ks_alpha, rules.tolerant)
    s = ties.join(sizes, PAIR, "left").join(spread, PAIR, "left").join(shape, PAIR, "left")
    strict = (F.col("least") >= 3) & ~F.coalesce("uneven", F.lit(False)) & F.coalesce("met", F.lit(True))
    other = F.col("else_") if rules.return_lenient else F.lit("False")
    return s.select(*PAIR, F.when(F.coalesce(F.col("k") < 2, F.lit(True)), "False").when(strict, "True").otherwise(other).alias("assumptions_met"))


def _settled(answers: DataFrame) -> DataFrame:
    """A gate's answers, a row per pair of columns, found now: what reads them doesn't hold the gate's plan."""
    return F.broadcast(answers.sparkSession.createDataFrame(answers.collect(), answers.schema))


def settled(df: DataFrame, method: str, pairs: list[tuple[str, str]], anova_rules: AnovaRules = AnovaRules(), kruskal_rules: KruskalRules = KruskalRules(), dropna: bool = True, splits: list[float] | None = None) -> DataFrame:
    """What :func:`anova_met` or :func:`kruskal_met` answers, found now and gate by gate.

    Plans of gates are large, and Spark plans all that is left of a query anew after each of its stages, so the driver's memory
    grows with the gates that one query has.
    """
    rows = batch.mixed(df, pairs, dropna)
    if method == "kruskal":
        return _settled(kruskal_met_of(rows, lenient(df, pairs, kruskal_rules.max_tie_ratio), kruskal_rules, splits))
    spread, shape = map(_settled, _anova_gates(rows, anova_rules, splits))
    return shape.join(spread, PAIR).select(*PAIR, (F.col("shape") & F.col("spread")).alias("assumptions_met"))


def kruskal_report(df: DataFrame, category: str, y: str) -> dict[str, DataFrame]:
    """What the Kruskal gate looks at: summary, levene, ks_pairwise and the test."""
    from . import descriptive

    rows = batch.mixed(df, [(category, y)])
    if not rows.limit(1).count():
        raise ValueError("no row has both columns")
    return {"summary": descriptive.group_summary(df, category, y), "levene": levene(rows), "ks_pairwise": ks_pairs(rows), "kruskal": anova.kruskal(df, [(category, y)])}
