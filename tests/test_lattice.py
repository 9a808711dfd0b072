"""Combinations rolled up from one grouping, against columns concatenated one by one."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from relscope.operators import assumptions, preparation
from relscope.plans import compare, lattice


def table(spark, seed, n=240):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        a, b, c = (str(v) for v in rng.integers(0, 3, 3))
        y = float(int(a) * int(b) + rng.integers(0, 6))
        rows.append((a, None if rng.random() < 0.1 else b, c, "x", None if rng.random() < 0.05 else y, None if rng.random() < 0.05 else "pq"[int(y > 4)]))
    return spark.createDataFrame(rows, "a string, b string, `c d` string, same string, y double, t string")


def wide(df, pool, combos):
    for c in combos:
        df = preparation.concatenated(df, list(c))
    return df.drop(*pool)


def by_name(results):
    return {(r.column_a, r.column_b, r.test): (r.p_value, r.assumptions_met) for r in results.collect()}


POOL = ["a", "b", "c d", "same"]
COMBOS = [c for size in (2, 3) for c in combinations(POOL, size)]
NAMES = [preparation.HEADER.join(c) for c in COMBOS]


def same(got, want):
    assert set(got) == set(want)
    for k in want:
        p, met = want[k]
        assert got[k] == (None if p is None else pytest.approx(p, rel=1e-9, abs=1e-12), met), k


@pytest.mark.parametrize("checked", [False, True])
def test_numbers(spark, checked):
    d, tests = table(spark, 1), [("kruskal", 0.05, False), ("anova", 0.05, False)]
    rules = assumptions.AnovaRules(0.02, 0.02, 3, 3), assumptions.KruskalRules(0.01, 0.01, True, 0.7, True)
    got = by_name(lattice.measured(d, "y", True, POOL, COMBOS, tests, check_assumptions=checked, anova_rules=rules[0], kruskal_rules=rules[1]))
    w = wide(d, POOL, COMBOS).drop("t")
    same(got, by_name(compare.measured(w, {"numcat": tests}, ["y"], NAMES, "y", None, None, checked, *rules)))
    assert any(p is not None and p < 0.01 for p, _ in got.values())


def test_categories(spark):
    d, tests = table(spark, 2), [("chi2", 0.05, False)]
    got = by_name(lattice.measured(d, "t", False, POOL, COMBOS, tests, check_assumptions=True))
    want = by_name(compare.measured(wide(d, POOL, COMBOS).drop("y"), {"catcat": tests}, [], ["t", *NAMES], None, "t", None, True))
    same({frozenset(k): v for k, v in got.items()}, {frozenset(k): v for k, v in want.items()})


def test_the_plan_does_not_grow(spark):
    d = table(spark, 3)
    pool = [f"p{i}" for i in range(20)]
    many = d.select("y", *(F.concat("a", F.lit(str(i % 7))).alias(p) for i, p in enumerate(pool)))
    combos = list(combinations(pool, 3))[:1000]
    out = lattice.measured(many, "y", True, pool, combos, [("anova", 0.05, False)])
    few = lattice.measured(many, "y", True, pool, combos[:10], [("anova", 0.05, False)])
    lines = lambda df: len(df._jdf.queryExecution().optimizedPlan().treeString().splitlines())
    assert lines(out) == lines(few) and out.count() == 1000


def test_nothing_to_test(spark):
    d = table(spark, 4)
    got = by_name(lattice.measured(d.limit(0), "y", True, POOL, COMBOS[:2], [("anova", 0.05, False), ("kruskal", 0.05, False)]))
    assert len(got) == 4 and set(got.values()) == {(None, None)}
    flat = by_name(lattice.measured(d.withColumn("y", F.lit(1e6)), "y", True, POOL, COMBOS[:2], [("anova", 0.05, False), ("kruskal", 0.05, False)]))
    assert set(flat.values()) == {(None, None)}
