"""Facts about small tables: tests, gates, bins, super- and subcategories, estimates."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from relscope import roles
from relscope.functions import special
from relscope.operators import anova, assumptions, batch, binning, chi2, descriptive, estimate, forecast, numeric, preparation, probability
from relscope.plans import compare
from relscope.plans.analyzer import Analyzer
from relscope.streaming import statistics


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_special_functions(spark):
    lit = lambda x: F.lit(float(x))
    assert value(spark, special.chi2_sf(lit(4), lit(1))) == pytest.approx(0.04550026389635857, rel=1e-12)
    assert value(spark, special.chi2_sf(lit(200), lit(3))) == pytest.approx(4.2e-43, rel=0.05)
    assert value(spark, special.beta_cdf(lit(2.5), lit(4), lit(0.3))) == pytest.approx(0.3521975859067674, rel=1e-12)
    for f, d2 in ((3, 60_000), (40, 6), (0.01, 5)):
        assert value(spark, special.f_sf(lit(f), lit(2), lit(d2))) == pytest.approx((1 + 2 * f / d2) ** (-d2 / 2), rel=1e-9)
    assert value(spark, special.erf(lit(0.7))) == pytest.approx(math.erf(0.7), rel=1e-12)
    assert value(spark, special.lgamma(lit(3.7))) == pytest.approx(math.lgamma(3.7), rel=1e-12)
    assert special.normal_quantile(0.975) == pytest.approx(1.959963984540054, rel=1e-12)
    assert special.t_quantile(0.975, 4) == pytest.approx(2.7764451051977987, rel=1e-9)


def test_chi2(spark):
    d = frame(spark, [("A", "X")] * 2 + [("B", "Y")] * 2, "left string, right string")
    r = chi2.independence_all(d).first()
    assert r.p_value == pytest.approx(0.04550026389635857) and not r.assumptions_met
    cells = {(x.level_a, x.level_b): x.value for x in descriptive.contingency(d, "left", "right").collect()}
    assert cells == {("A", "X"): 2, ("B", "Y"): 2, ("A", None): 2, ("B", None): 2, (None, "X"): 2, (None, "Y"): 2, (None, None): 4}
    assert {(x.level_a, x.level_b): x.value for x in descriptive.frequencies(d, "left", "right").collect()}["A", "Y"] == 0
    for rows in ([], [("A", "X"), ("A", "Y")], [("A", "X"), ("B", "X")]):
        r = chi2.independence(frame(spark, rows, "left string, right string"), [("left", "right")]).first()
        assert r.p_value is None and not r.assumptions_met
    d = frame(spark, [("A", None), ("A", "X"), (None, "X"), ("B", "Y"), ("B", "Y"), (None, "Y")], "left string, right string")
    filled = d.na.fill("NaN")
    assert chi2.independence(d, [("left", "right")], dropna=False).first().chi2 == pytest.approx(chi2.independence(filled, [("left", "right")]).first().chi2)


def test_super_and_subcategories(spark):
    d = frame(spark, [("A", "x"), ("A", "x"), ("B", "z"), ("B", "z"), ("B", "y"), ("A", "y"), ("B", "y")], "super string, sub string")
    assert [tuple(r) for r in chi2.sub_to_super(d, "super", "sub").collect()] == [("A", "x"), ("B", "y"), ("B", "z")]
    assert chi2.deterministic_share(d, [("super", "sub")]).first().share == pytest.approx(2 / 3)
    tie = frame(spark, [("B", "s"), ("A", "s")], "super string, sub string")
    assert chi2.sub_to_super(tie, "super", "sub").first().supercategory == "A"


@pytest.mark.parametrize("a,b", [((1, 1, 2, 2, 3), (3, 3, 4, 4, 5)), ((1, 2, 3, 4, 5), (6, 7, 8, 9, 10))])
def test_kruskal(spark, a, b):
    d = frame(spark, [("a", x) for x in a] + [("b", x) for x in b], "group string, value int")
    pool = np.array(a + b, float)
    ranks = np.array([(pool < x).sum() + ((pool == x).sum() + 1) / 2 for x in pool])
    h = 12 / 110 * (ranks[:5].sum() ** 2 / 5 + ranks[5:].sum() ** 2 / 5) - 33
    ties = sum(c**3 - c for c in np.unique(pool, return_counts=True)[1])
    r = anova.kruskal(d, [("group", "value")]).first()
    assert r.h_stat == pytest.approx(h / (1 - ties / 990)) and r.p_value == pytest.approx(math.erfc(math.sqrt(r.h_stat / 2)), rel=1e-9)


def test_constant_and_single_groups_are_undefined(spark):
    d = frame(spark, [("a", 1)] * 5 + [("b", 1)] * 5, "group string, value int")
    assert anova.kruskal(d, [("group", "value")]).first().p_value is None
    assert anova.one_way(d, [("group", "value")]).first().p_value is None
    assert anova.one_way(d.where("group = 'a'"), [("group", "value")]).first().p_value is None


def test_welch_over_groups(spark):
    d = frame(spark, [("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0), ("c", 9.0), ("d", None)], "group string, value double")
    r = anova.group_pairs(d, "group", "value").collect()
    assert [(x.subcat_1, x.subcat_2, x.n_samples_1, x.n_samples_2) for x in r] == [("a", "b", 2, 2)]
    assert r[0].p_value == pytest.approx(2 * (0.5 - math.sqrt(8) / (2 * math.sqrt(2 + 8))), rel=1e-9)
    assert anova.group_pairs(d, "group", "value", include_invalid=True).where("p_value IS NULL").count() == 2


def test_correlations(spark):
    d = frame(spark, [(k, k * k, (6 - k) ** 2, 1) for k in range(1, 6)], "target int, feature int, feature_b int, same int")
    for method in ("spearman", "kendall"):
        r = {x.numeric_a: x.correlation for x in numeric.correlations(d, method, target="target").collect()}
        assert r["feature"] == pytest.approx(1) and r["feature_b"] == pytest.approx(-1) and r["same"] is None
    assert numeric.correlation_comparison(d, 0.6, True, target="target").count() == 2
    with pytest.raises(ValueError, match="method"):
        numeric.correlations(d, "tau")
    rng = np.random.default_rng(1)
    for n, few, many in ((40, 6, 6), (120, 3, 90), (120, 90, 2), (90, 500, 500)):
        x, y = rng.integers(-few, few, n) / 8, rng.integers(-many, many, n)
        s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(n) for j in range(i))
        tx, ty = (sum(v[i] != v[j] for i in range(n) for j in range(i)) for v in (x, y))
        d = frame(spark, [*zip(x.tolist(), y.tolist(), strict=True), (None, 1), (1.0, None)], "x double, y int")
        assert numeric.correlations(d, "kendall").first().correlation == pytest.approx(s / math.sqrt(tx * ty))
    assert numeric.correlations(frame(spark, [(1.0, 2)], "x double, y int"), "kendall").first().correlation is None


def test_normality(spark):
    d = frame(spark, [(float(x),) for x in np.linspace(0, 1, 20)], "target double")
    assert numeric.normality(d).first().p_value == pytest.approx(0.5, abs=0.4)
    assert numeric.shapiro_p(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0])) == pytest.approx(0.00670, abs=2e-4)
    assert numeric.shapiro_p(np.array([1.0, 2.0])) is None


def test_two_samples_of_kolmogorov_and_smirnov(spark):
    rows = [("a", x) for x in np.linspace(-1, 1, 100).tolist()]
    same = frame(spark, rows + [("b", x) for _, x in rows], "group string, value double")
    apart = frame(spark, rows + [("b", x + 6) for _, x in rows], "group string, value double")
    for d, strict, lenient in ((same, "True", "True"), (apart, "False", assumptions.LENIENT)):
        for rules, want in ((assumptions.KruskalRules(), strict), (assumptions.KruskalRules(return_lenient=True), lenient)):
            assert assumptions.kruskal_met(d, [("group", "value")], rules).first().assumptions_met == want
    pairs = assumptions.ks_pairs(batch.mixed(apart, [("group", "value")])).first()
    assert pairs.ks_stat == pytest.approx(1) and pairs.p_value < 1e-50
    assert assumptions.ks_exact_p(3, 3, 1.0) == pytest.approx(2 / 20)
    assert assumptions.ks_exact_p(3, 2, 1.0) == pytest.approx(2 / 10)
    assert assumptions.ks_exact_p(4, 4, 0.5) == pytest.approx(1 - 14 / 70 - 0, abs=0.6)


def test_bins(spark):
    d = frame(spark, [(k, 2 * k) for k in range(30)], "target int, feature int")
    found = binning.relational(d, ("pearson", 0.6, True), ("kruskal", 0.05, False))
    assert {y: m.bins for y, m in found.items()} == {"target": 2, "feature": 2}
    assert binning.relational(d, ("pearson", 0.6, True), ("kruskal", 0.05, False), distinct_threshold=30) == {}
    assert len(binning.edges(d, "target", 2)) == 3
    b = [r.bin for r in binning.binned(frame(spark, [(0,), (1,), (2,), (3,), (4,), (None,)], "v int"), "v", 2, name="bin").collect()]
    assert b == [1, 1, 1, 2, 2, None]
    with pytest.raises(ValueError):
        binning.relational(d, ("pearson", 0.6, 1))


def test_instructions():
    assert compare.instructions(True, "catcat") == [("chi2", 0.05, False)]
    assert compare.instructions(None, "numnum") == compare.instructions(False, "numnum") == []
    assert compare.instructions(("anova", 0.1, None), "numcat") == [("anova", 0.1, None)]
    for bad in ([], "chi2", ("anova", 0.1), [("nothing", 1, True)]):
        with pytest.raises(ValueError):
            compare.instructions(bad, "numcat")


def test_roles(spark):
    d = frame(spark, [(1, 2.0, "x", True)], "i int, f double, s string, b boolean")
    assert roles.numeric_columns(d) == ["i", "f"] and roles.categoric_columns(d) == ["s"]
    assert roles.categoric_columns(d, ["s"], "i") == ["i", "s"]
    assert roles.mixed_pairs(["s", "t"], ["i", "f"], "s", "f") == [("s", "i"), ("s", "f"), ("t", "f")]
    assert roles.same_pairs(["a", "b", "c"], ["a", "b"]) == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c")]


def test_analyzer(spark):
    rows = [("A" if k < 20 else "B", "P" if k < 20 else "Q", k) for k in range(40)]
    d = frame(spark, rows, "left string, right string, amount int")
    a = Analyzer().fit_full_dataset_analysis(d, super_sub=True)
    assert a.pairs["catcat"]["significant"] == {("left", "right"): "chi2"}
    assert a.profiles["amount"].features["significant"] == {"left": "anova-kruskal", "right": "anova-kruskal"}
    assert a.super_sub == [("left", "right")] and a.uniform_fit == {"left": False, "right": False}
    assert {tuple(r.features) for r in a.relationships(d, "amount").collect()} == {("left",), ("right",)}
    # One bin leaves no spread: an undefined statistic ends the search.
    assert a.binning_metrics(d, "amount") == (None, {"left": None, "right": None}) and a.fit_binning_thresholds(d).profiles["amount"].min_bins is None
    line = frame(spark, [(k, 2 * k) for k in range(30)], "target int, feature int")
    b = Analyzer(numnum=("pearson", 0.6, True), numcat=False, catcat=False).fit_column_relationships(line).fit_binning_thresholds(line)
    assert b.profiles["target"].min_bins == 2 and b.profiles["target"].min_bins_by_feature == {"feature": 2}
    assert set(a.target_plots(d, ["amount"])["numcat"]) == {("amount", "left"), ("amount", "right")}
    with pytest.raises(RuntimeError):
        Analyzer().target_plots(d, "amount", auto_fit=False)


def test_combinations_of_categories(spark):
    rows = [(str(k % 2), str(k // 2 % 2), float((k % 2 + k // 2 % 2) % 2 * 10 + k % 5)) for k in range(80)]
    d = frame(spark, rows, "one string, two string, y double")
    a = Analyzer().fit_column_relationships(d, numeric_target="y").fit_multivariate(d, "y")
    assert list(a.profiles["y"].combinations["significant"]) == [("one", "two")]


def test_estimates(spark):
    d = frame(spark, [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", None)], "g string, y double")
    r = {x.g: x for x in estimate.mean_estimates(d, "y", 0.95, "g").collect()}
    assert r["a"].moe == pytest.approx(special.t_quantile(0.975, 2) / math.sqrt(3)) and r["b"].size == 1 and r["b"].mean is None
    assert estimate.mean_estimates(d, "y").first()["size"] == 3
    with pytest.raises(ValueError):
        estimate.mean_estimates(d, "y", 0.9999999)
    with pytest.warns(UserWarning):
        assert estimate.proportion(0, 0) is None
    assert estimate.z_score(0.95, 1) == pytest.approx(1.6448536269514722)


def test_probability(spark):
    assert value(spark, probability.binomial_cdf(F.lit(3), F.lit(3), F.lit(0.2))) == pytest.approx(1)
    assert value(spark, probability.poisson_cdf(F.lit(2), F.lit(1.5), F.lit(1))) == pytest.approx(math.exp(-1.5) * (1.5 + 1.125))
    assert (probability.factorial(5), probability.permutations(5, 2), probability.combinations(5, 2)) == (120, 20, 10)
    with pytest.raises(TypeError):
        probability.factorial(True)
    with pytest.raises(ValueError):
        probability.combinations(2, 3)
    with pytest.raises(ValueError):
        probability.uniform_pdf(F.lit(1.0), 2, 2)


def test_preparation(spark):
    rows = [(str(k), f"2024-01-0{k % 3 + 1} 0{k % 2}:40:00", "same", None if k else "x", ("a", "b")[k % 2]) for k in range(40)]
    d = frame(spark, rows, "n string, at string, same string, empty string, c string")
    p = {x.column: x for x in preparation.profiles(d)}
    assert (p["n"].proposed, p["at"].proposed, p["c"].proposed) == ("long", "datetime", "category")
    assert p["n"].change and p["at"].change and p["empty"].drop and preparation.constant_columns(list(p.values())) == ["same"]
    clean = preparation.cleaned(d)
    assert dict(clean.dtypes) == {"n": "bigint", "at": "timestamp", "c": "string"}
    assert set(preparation.date_parts(clean).columns) == {"n", "c", "at_day", "at_hour"}
    assert preparation.concatenated(frame(spark, [("a", None)], "x string, y string"), ["x", "y"]).first()["x_&_y"] == "a_|&|_nan"


def test_forecast(spark):
    d = frame(spark, [("Weekly", 10, "Winter", 50.0), ("Never", 2, "Winter", 70.0)], "`Frequency of Purchases` string, `Previous Purchases` int, Season string, `Purchase Amount (USD)` double")
    assert [r.days_of_patronage for r in forecast.with_days(d).collect()] == [70.0, None]
    r = forecast.expected_sales(d).first()
    assert r.sales == pytest.approx(365 / 4 / 7 * 60)
    assert [x.sales > 0 for x in forecast.in_order(forecast.simulated_sales(d)).collect()] == [True, False, False, False]
    assert forecast.floating(forecast.by_period(forecast.expected_sales(d))).count() == 12


def test_statistics_of_a_stream(spark, tmp_path):
    d = frame(spark, [("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, y double")
    d.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    q = statistics.moments(stream, "g", "y").writeStream.outputMode("complete").format("memory").queryName("moments").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.level, r.n, r["mean"]) for r in spark.sql("SELECT * FROM moments").collect()} == {("a", 2, 2.0), ("b", 1, 5.0)}


def test_chi2_tail_at_many_degrees(spark):
    # For even degrees the tail is a Poisson sum.
    for dof, at in ((1998, 1.0), (2002, 1.0), (2002, 1.05), (20_000, 0.99), (100_000, 1.0), (1_000_000, 1.002), (10_000_000, 1.0), (10_000_000, 0.9995)):
        x, a = dof * at / 2, dof // 2
        k = np.arange(max(0, a - 200_000), a, dtype=float)
        logs = k * math.log(x) - x - np.array([math.lgamma(i + 1) for i in k.tolist()])
        want = math.fsum(np.exp(logs).tolist())
        assert value(spark, special.chi2_sf(F.lit(float(dof * at)), F.lit(float(dof)))) == pytest.approx(want, abs=1e-6), (dof, at)


def test_quantiles_and_ranks_over_ranges(spark):
    rng = np.random.default_rng(5)
    y = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-3, 6, 300), [0.0, 0.0, -0.5, 1e-300, -1e300]]).tolist()
    rows = [("a" if k % 3 else None, v) for k, v in enumerate(y)]
    d = frame(spark, rows + [("a", None)], "g string, y double")
    for r in anova.quantiles(d, ["g"], (0.0, 0.1, 0.5, 0.9, 1.0)).collect():
        own = [v for g, v in rows if g == r.g]
        assert r.q == pytest.approx(np.quantile(own, [0, 0.1, 0.5, 0.9, 1]).tolist(), rel=1e-9)
    assert anova.quantiles(d, [], (0.5,)).first().q[0] == pytest.approx(np.median(y))
    counts = d.where("y IS NOT NULL").groupBy("y").agg(F.count("*").alias("n"))
    got = {r.y: r["rank"] for r in anova.ranked(counts, []).collect()}
    ordered = sorted(y)
    assert all(got[v] == ordered.index(v) + (ordered.count(v) + 1) / 2 for v in y)
    s = {r.g: r for r in descriptive.grouped_describe(d, "y", ["g"]).collect()}
    assert s[None].median == pytest.approx(np.median([v for g, v in rows if g is None])) and s["a"]["size"] == sum(g == "a" for g, _ in rows) + 1


def test_spearman_with_and_without_nulls(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), float(c)) for a, b, c in rng.integers(0, 9, (200, 3))]
    d = frame(spark, rows, "a double, b double, c double")
    own = {(r.numeric_a, r.numeric_b): r.correlation for r in numeric.correlations(d, "spearman").collect()}
    other = numeric._spearman(numeric._complete(d, list(own)))
    assert {(r.a, r.b): pytest.approx(r.correlation) for r in other.collect()} == own
    gaps = frame(spark, [(None, *r[1:]) if k % 5 == 0 else r for k, r in enumerate(rows)], "a double, b double, c double")
    part = frame(spark, [r for k, r in enumerate(rows) if k % 5], "a double, b double, c double")
    one, two = ({(r.numeric_a, r.numeric_b): r.correlation for r in numeric.correlations(x, "spearman").collect()} for x in (gaps, part))
    assert one["a", "b"] == pytest.approx(two["a", "b"]) and one["b", "c"] == pytest.approx(own["b", "c"])


@pytest.mark.parametrize("method,x", [("pearson", "n"), ("spearman", "n"), ("kendall", "n"), ("welch", "n"), ("kruskal", "g"), ("anova", "g")])
def test_minimum_bins_by_plain_bisection(spark, method, x):
    rng = np.random.default_rng(9)
    rows = [(float(v), float(round(v + rng.normal() * 3, 1)), "hi" if v + rng.normal() > 20 else "lo") for v in rng.integers(0, 40, 60)]
    d = frame(spark, rows, "y double, n double, g string")
    keep_above, threshold = (True, 0.6) if method in ("pearson", "spearman", "kendall") else (False, 0.05)
    found = binning.find_minimums(d, [("y", x)], method, threshold, keep_above)["y"].by_feature[x]
    low, high, best = 2 if keep_above else 1, len(rows), None
    while low <= high:
        k = (low + high) // 2
        b = binning.binned(d, "y", k, True, "b").select("n", "g", F.col("b").alias("y")) if k > 1 else d.select("n", "g", F.lit(1.0).alias("y"))
        if keep_above:
            stat = numeric.correlations(b.select("y", "n"), method).first().correlation
        elif method == "welch":
            stat = next(r.p_value for r in numeric.t_tests(b, ["y", "n"]).collect() if r.numeric_a == "y")
        else:
            stat = anova.TESTS[method](b, [("g", "y")]).first().p_value
        if stat is None:
            best = None
            break
        if (abs(stat) >= threshold) if keep_above else stat < threshold:
            best, high = k, k - 1
        else:
            low = k + 1
    assert found.found == best


def test_rules_of_types_and_drops():
    P = preparation.Profile
    assert preparation.propose("double", 40, 40, 0, 0, 40, 40) == "long" and preparation.propose("double", 40, 40, 0, 0, 40, 39) == "double"
    made = lambda dtype, unique, null, proposed: preparation.decide(P("c", dtype, 100, unique, null, proposed))
    assert made("string", 1, 50, "category") == (False, True)
    assert made("bigint", 1, 0, "long") == (True, False)
    assert made("string", 100, 0, "category") == (True, False)
    assert made("string", 100, 0, "datetime") == (False, True)


def test_joint_plot(spark):
    d = frame(spark, [(float(k), float(2 * k + 1)) for k in range(50)] + [(None, 1.0)], "x double, y double")
    j = descriptive.joint(d, "x", "y", 10)
    assert sum(r.n for r in j["points"].collect()) == 50 and {r.bin_x - r.bin_y for r in j["points"].collect()} == {0}
    assert [r.n for r in j["x"].orderBy("bin").collect()] == [5] * 10 and j["line"].first().slope == pytest.approx(2)


def test_density_clusters_weigh_equal_rows(spark, tmp_path):
    from relscope.operators import clustering

    rng = np.random.default_rng(4)
    own = np.vstack([rng.normal(0, 0.1, (40, 2)), rng.normal(9, 0.1, (40, 2))])
    weight = rng.integers(1, 4, 80)
    one = clustering.density_clusters(own, 20, 5, weight)
    many = clustering.density_clusters(np.repeat(own, weight, axis=0), 20, 5)
    assert one.labels.tolist() == many.labels[np.cumsum(weight) - 1].tolist() and one.labels.max() == 1
    # A vector that makes up most of the rows doesn't fill the sample.
    rows = [tuple(map(float, r)) for r in own] + [(0.0, 0.0)] * 3000
    d = frame(spark, rows, "x double, y double")
    fitted = clustering.ClusterFeatures().fit(d, ["x", "y"], range(2, 3), range(2, 3))
    assert len(fitted.density.members) == 81
    labels = {r.density_cluster for r in fitted.predict(d).where("x > 5").collect()}
    assert len(labels) == 1 and labels != {r.density_cluster for r in fitted.predict(d).where("x = 0").collect()}
    fitted.save(spark, f"{tmp_path}/model")
    again = clustering.ClusterFeatures.load(spark, f"{tmp_path}/model")
    assert [tuple(r) for r in again.predict(d).limit(90).collect()] == [tuple(r) for r in fitted.predict(d).limit(90).collect()]


def test_density_clusters_of_different_density():
    from relscope.operators import clustering

    rng = np.random.default_rng(8)
    # No single cut separates the two tight groups and keeps the wide one whole.
    parts = [rng.normal((0, 0), 0.05, (60, 2)), rng.normal((0.6, 0), 0.05, (60, 2)), rng.normal((20, 0), 1.5, (60, 2)), [(60, 60), (-50, 40)]]
    x = np.vstack(parts)
    found = clustering.density_clusters(x, 20, 5)
    names = [set(found.labels[a : a + 60].tolist()) - {-1} for a in (0, 60, 120)]
    assert all(len(s) == 1 for s in names) and len(set.union(*names)) == 3
    assert found.labels[180:].tolist() == [-1, -1] and (found.labels < 0).mean() < 0.2
    own = found.predict(np.array([(0.0, 0.0), (0.6, 0.0), (20.0, 0.0), (100.0, 100.0)])).tolist()
    assert [*own[:3]] == [s.pop() for s in names] and own[3] == -1
    d = clustering._distances(x)
    weight = np.ones(len(x), int)
    each = []
    for i in np.flatnonzero(found.labels >= 0):
        means = {c: d[i][(found.labels == c) & (np.arange(len(x)) != i)].mean() for c in range(3)}
        a, b = means[found.labels[i]], min(m for c, m in means.items() if c != found.labels[i])
        each.append((b - a) / max(a, b))
    assert clustering.silhouette(d, found.labels, weight) == pytest.approx(np.mean(each))
    # All rows equal, or one blob: no cluster of its own.
    assert set(clustering.density_clusters(np.zeros((50, 2)), 20, 5).labels) <= {-1, 0, 1}
    assert clustering.silhouette(d[:3, :3], np.array([-1, -1, -1]), weight[:3]) == -1.0


def test_files(spark, tmp_path):
    from relscope.sources import tables

    (tmp_path / "habits.csv").write_text("Customer ID,Gender,Age,Frequency of Purchases,Previous Purchases,Discount Applied\n" + "".join(f"{k}, {('Male', 'Female')[k % 2]} ,{20 + k},Weekly,{k},{('Yes', 'No')[k % 3 == 0]}\n" for k in range(36)))
    d = tables.csv(spark, f"{tmp_path}/habits.csv")
    assert dict(d.dtypes)["Age"] == "int" and {r.Gender for r in d.collect()} == {"Male", "Female"}
    h = tables.load_habits(spark, f"{tmp_path}/habits.csv")
    assert "Customer ID" not in h.columns and "Gender" not in h.columns
    rows = h.collect()
    assert sum(r.Male == "1" for r in rows) == 18 and sum(r["Discount Applied"] == "1" for r in rows) == 24
    assert max(r["Total Days of Patronage"] for r in rows) == 35 * 7 and {r["Age_Ordinalized"] for r in rows} == {str(k) for k in range(1, 7)}
    assert preparation.preview(d, 3, 1).count() == 3


def test_draws_by_weights(spark):
    n = {r.v: r.n for r in probability.sampled(spark.range(20_000), "v", ["a", "b", "c"], [1, 2, 5], 3).groupBy("v").agg(F.count("*").alias("n")).collect()}
    assert n["a"] == pytest.approx(2500, abs=250) and n["b"] == pytest.approx(5000, abs=300) and sum(n.values()) == 20_000
