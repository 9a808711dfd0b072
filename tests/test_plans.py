"""What a query's plan takes of the driver's memory."""

import math
import random

import pytest
from pyspark.sql import functions as F

from relscope.functions import special
from relscope.operators import assumptions, numeric
from relscope.plans import compare


def size(df) -> int:
    """Characters of the analyzed plan."""
    return len(df._jdf.queryExecution().analyzed().toString())


def test_gates_leave_no_plan_and_answer_as_before(spark):
    draw = random.Random(4)
    rows = [("abc"[i % 3], draw.gauss(i % 3, 1.0), draw.expovariate(1.0) * (1 + i % 3), None if i % 7 else 1.0) for i in range(1200)]
    rows += [("few", draw.gauss(0, 1.0), draw.expovariate(1.0), 2.0) for _ in range(40)]
    d = spark.createDataFrame(rows, "g string, bell double, skewed double, sparse double")
    every = [("kruskal", 0, None), ("anova", 0, None)]
    found = compare.multi_test_comparison(d, [("pearson", 0, None)], every, False, check_assumptions=True)
    assert size(found) < 120_000
    pairs = [("g", y) for y in ("bell", "skewed", "sparse")]
    met = {("anova", r.numeric): str(r.assumptions_met).lower() for r in assumptions.anova_met(d, pairs).collect()}
    met |= {("kruskal", r.numeric): r.assumptions_met for r in assumptions.kruskal_met(d, pairs).collect()}
    found = [r for r in found.collect() if r.test != "pearson"]
    assert len(found) == 6 and all(r.assumptions_met == ("False" if r.p_value is None else met[r.test, r.column_a]) for r in found)
    assert met["anova", "bell"] == "true" and met["anova", "skewed"] == "false"


def test_a_group_below_the_least_size_refuses_anova(spark):
    draw = random.Random(5)
    rows = [("ab"[i % 2], draw.gauss(0, 1.0)) for i in range(60)]
    d = lambda extra: spark.createDataFrame(rows + [("c", 0.3 * i) for i in range(extra)], "g string, y double")
    met = lambda extra, n: assumptions.anova_met(d(extra), [("g", "y")], assumptions.AnovaRules(min_n=n, homogeneity_alpha=0.0)).first().assumptions_met
    assert met(4, 4) and not met(4, 5)


@pytest.mark.parametrize("tail", ["chi2", "f", "t", "normal", "k2"])
def test_tails_are_short_expressions(spark, tail):
    x, a, b = F.col("id") + 0.5, F.col("id") + 2.0, F.col("id") + 40.0
    e = {"chi2": lambda: special.chi2_sf(x, a), "f": lambda: special.f_sf(x, a, b), "t": lambda: special.t_sf2(x, a), "normal": lambda: special.normal_sf(x), "k2": lambda: numeric.k2(b * 10, x / 100, x / 50)}[tail]()
    d = spark.range(3).select(e.alias("p"))
    assert size(d) < 24_000
    assert all(math.isfinite(r.p) and (tail == "k2" or 0 < r.p < 1) for r in d.collect())
