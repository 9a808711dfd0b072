"""Sample sort, sweeps and tables of ordered values, against plain computations."""

import math
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from relscope.functions import draws, special
from relscope.operators import anova, assumptions, balancing, batch, binning, chi2, descriptive, mixtures, numeric, ranks


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_ranges_are_even_wherever_values_lie(spark):
    rng = np.random.default_rng(0)
    for values in (1.7e9 + rng.integers(0, 31_536_000, 40_000), rng.normal(size=40_000) * 1e-12, np.exp(rng.normal(size=40_000) * 20)):
        d = frame(spark, [(float(v),) for v in values], "y double")
        splits = ranks.splitters(d, "y", 32)
        n = [r["count"] for r in ranks.with_range(d, "y", splits).groupBy("_range").count().collect()]
        assert len(n) == 32 and max(n) <= 2 * len(values) / 32
    few = frame(spark, [(float(1000 + k % 22),) for k in range(22_000)], "y double")
    assert len(ranks.splitters(few, "y", 64)) >= 20


def test_ranges_keep_order_and_equal_values(spark):
    odd = [-math.inf, -1.5, -0.0, 0.0, 2.0, 2.0, 7.0, math.inf, math.nan]
    d = frame(spark, [(v,) for v in odd], "y double")
    got = [r for r in ranks.with_range(d, "y", [-1.5, 0.0, 2.0]).select("y", "_range").collect()]
    number = [r["_range"] for r in got]
    assert number == sorted(number) and number[2] == number[3] and number[4] == number[5] and number[-1] > number[-2]


def test_quantiles_with_given_splitters(spark):
    rng = np.random.default_rng(1)
    rows = [(("a", "b", None)[k % 3], float(v)) for k, v in enumerate(rng.integers(0, 50, 600))]
    d = frame(spark, rows, "g string, y double")
    shares = (0.0, 0.01, 0.3, 0.5, 0.999, 1.0)
    for splits in ([], [10.0], list(map(float, range(1, 50)))):
        for r in ranks.quantiles(d, ["g"], shares, splits=splits).collect():
            assert r.q == pytest.approx(np.quantile([v for g, v in rows if g == r.g], shares).tolist())


def test_expected_counts(spark):
    rng = np.random.default_rng(2)
    for seed in range(4):
        a, b = rng.integers(1, 12, 7 + seed), rng.integers(1, 30, 5)
        a[0] += max(0, b.sum() - a.sum())
        b[0] += max(0, a.sum() - b.sum())
        ra = frame(spark, [("x", "y", str(i), int(v)) for i, v in enumerate(a)], "a string, b string, la string, ra long")
        rb = frame(spark, [("x", "y", str(i), int(v)) for i, v in enumerate(b)], "a string, b string, lb string, rb long")
        r = chi2.expected_counts(ra, rb).first()
        e = [Fraction(int(p) * int(q), int(a.sum())) for p in a for q in b]
        assert (r.total, r.ka, r.kb) == (a.sum(), len(a), len(b))
        assert r.low == sum(x < 5 for x in e) and r.least == pytest.approx(float(min(e)))
        assert r.met == (min(e) >= 1 and Fraction(sum(x < 5 for x in e), len(e)) <= Fraction(1, 5))


def lattice(n1, n2, d):
    """The tail as a share of all paths, counted one by one."""
    whole = math.lcm(n1, n2)
    paths = {}
    for i in range(n1 + 1):
        for k in range(n2 + 1):
            inside = abs(i * (whole // n1) - k * (whole // n2)) < round(d * whole)
            paths[i, k] = 0 if not inside else 1 if i == k == 0 else paths.get((i - 1, k), 0) + paths.get((i, k - 1), 0)
    return float(1 - Fraction(paths[n1, n2], math.comb(n1 + n2, n1)))


def test_exact_kolmogorov_smirnov_tails():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = (int(v) for v in rng.integers(1, 30, 2))
        d = abs(rng.integers(0, a + 1) / a - rng.integers(0, b + 1) / b)
        assert assumptions.ks_exact_p(a, b, d) == pytest.approx(lattice(a, b, d) if d else 1.0, rel=1e-9)
    many = assumptions.ks_exact_p(10_000, 9_999, 0.02)
    assert many == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * 4999.75 * 0.0004) for k in range(1, 50)), rel=0.05)


def test_sweep_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(assumptions, "HELD", 50)
    rng = np.random.default_rng(4)
    rows = [(f"g{k}", float(v)) for k in range(9) for v in rng.integers(k, 20 + 2 * k, 15 + 7 * k)]
    got = {(r.x_1, r.x_2): r for r in assumptions.ks_pairs(batch.mixed(frame(spark, rows, "g string, y double"), [("g", "y")])).collect()}
    own = {g: np.sort([v for h, v in rows if h == g]) for g in {g for g, _ in rows}}
    at = np.unique([v for _, v in rows])
    assert set(got) == set(combinations(sorted(own), 2))
    for (p, q), r in got.items():
        d = np.abs(np.searchsorted(own[p], at, "right") / len(own[p]) - np.searchsorted(own[q], at, "right") / len(own[q])).max()
        assert (r.n_1, r.n_2) == (len(own[p]), len(own[q])) and r.ks_stat == pytest.approx(d)
        assert r.p_value == pytest.approx(lattice(r.n_1, r.n_2, d), rel=1e-9)


@pytest.mark.parametrize("method", ["pearson", "welch", "student", "kruskal", "anova"])
def test_probes_of_the_table(spark, method):
    """What a probe of the table says is what the test says of binned rows."""
    rng = np.random.default_rng(5)
    y = np.round(rng.normal(size=400) * 30, 1)
    rows = [(float(v), float(v + rng.normal() * 40), ("a", "b", "c")[int(abs(v)) % 3]) for v in y] + [(None, 1.0, "a"), (3.0, None, "b"), (3.0, 2.0, None)]
    d = frame(spark, rows, "y double, x double, g string")
    pairs = [("y", "x")] if method in binning.NUMERIC_TESTS else [("y", "g")]
    own = binning._rows(d, pairs, method)
    limits = binning._limits(d, own, pairs, method)
    probes = [1, 2, 3, 7, 50, 399, 5000]
    table = binning.Table.of(own, limits)
    assert table.ranges.count() > 3
    got = {r["bins"]: r["stat"] for r in binning._of_table(table, limits, {0: (limits[0]["lo"], limits[0]["hi"], probes)}, method).collect()}
    for bins in probes:
        b = binning.binned(d, "y", bins, name="b").withColumn("v", binning.rescaled(F.col("b"), F.lit(limits[0]["lo"]), F.lit(limits[0]["hi"]), F.lit(bins)))
        if method == "pearson":
            want = b.where("x IS NOT NULL AND v IS NOT NULL").agg(F.corr("v", "x")).first()[0] if bins > 1 else None
        elif method in ("welch", "student"):
            want = {(r.numeric_a, r.numeric_b): r.p_value for r in numeric.t_tests(b.select("v", "x"), ["v", "x"], None, method).collect()}["v", "x"]
        else:
            want = anova.TESTS[{"kruskal": "kruskal", "anova": "anova"}[method]](b, [("g", "v")]).first().p_value
        assert got[bins] == (None if want is None else pytest.approx(want, rel=1e-6, abs=1e-12)), bins


def test_mixtures_of_every_size(spark):
    rng = np.random.default_rng(6)
    tilted = np.array([[3.0, 2.8], [2.8, 3.0]])
    blobs = [(rng.multivariate_normal(m, tilted, 300), "full") for m in ((0, 0), (30, 0), (0, 30))]
    apart = np.concatenate([b for b, _ in blobs]) + 1e5
    points = mixtures.points_of(frame(spark, [(r.tolist(),) for r in apart] * 2, "v array<double>"))
    found = mixtures.fit(points, 2, range(1, 5), range(1, 5))
    assert max(found.kmeans, key=lambda k: found.kmeans[k].silhouette) == 3
    (k, kind), best = min(found.mixtures.items(), key=lambda m: found.bic(m[1]))
    assert (k, kind) == (3, "full") and found.rows == 1800
    order = np.argsort((best.means + found.origin)[:, 0] + 2 * (best.means + found.origin)[:, 1])
    for i, (x, _) in zip(order, blobs, strict=True):
        assert best.means[i] + found.origin == pytest.approx(x.mean(axis=0) + 1e5, abs=0.2)
        assert best.covariances[i] == pytest.approx(np.cov(x.T, bias=True), abs=0.3)
        assert best.weights[i] == pytest.approx(1 / 3, abs=0.01)
    # One Gaussian is the sample's own, and its likelihood is known.
    one, spread = found.mixtures[1, "full"], np.cov(apart.T, bias=True)
    assert one.covariances[0] == pytest.approx(spread, rel=1e-6)
    assert one.likelihood == pytest.approx(-1800 * (math.log(2 * math.pi) + 1 + np.log(np.linalg.det(spread)) / 2), rel=1e-6)
    diag = found.mixtures[1, "diag"]
    assert diag.covariances[0] == pytest.approx(np.diag(spread), rel=1e-6) and diag.free < one.free
    gap = np.square((apart - found.origin)[:, None] - found.kmeans[3].centres).sum(axis=2)
    own = gap.argmin(axis=1)
    assert found.kmeans[3].cost == pytest.approx(2 * gap.min(axis=1).sum())
    inner = [np.square(apart[own == c] - apart[i]).sum() * 2 / (2 * (own == c).sum() - 1) for i, c in enumerate(own)]
    outer = [min(np.square(apart[own == o] - apart[i]).sum(axis=1).mean() for o in range(3) if o != c) for i, c in enumerate(own)]
    assert found.kmeans[3].silhouette == pytest.approx(np.mean([(b - a) / max(a, b) for a, b in zip(inner, outer, strict=True)]), rel=1e-9)


def test_mixtures_of_nothing_and_of_equal_rows(spark):
    assert mixtures.fit(mixtures.points_of(frame(spark, [], "v array<double>")), 2, [2], [2]) is None
    same = mixtures.fit(mixtures.points_of(frame(spark, [([1.0, 2.0],)] * 20, "v array<double>")), 2, [2, 3], [2])
    assert same.kmeans[2].cost == 0 and np.isfinite(same.mixtures[2, "diag"].likelihood)


def test_draws_follow_the_key(spark):
    d = spark.range(3000).withColumn("u", draws.uniform(3, F.col("id")))
    one = {r.id: r.u for r in d.repartition(7).collect()}
    assert one == {r.id: r.u for r in d.coalesce(1).collect()}
    u = np.sort(list(one.values()))
    assert u[0] > 0 and u[-1] < 1 and np.abs(u - (np.arange(3000) + 0.5) / 3000).max() < 0.03


def cells(spark):
    rows = [(i, "ab"[i % 2], "xyz"[min(2, i % 7)], i % 10 == 0) for i in range(700)] + [(i, "c", "x", False) for i in range(1000, 1003)] + [(2000, None, "x", True)]
    return frame(spark, rows, "id int, a string, b string, s boolean")


def test_balanced_cells(spark):
    d = cells(spark)
    size = {(r.a, r.b): r["count"] for r in d.where("a IS NOT NULL").groupBy("a", "b").count().collect()}
    enough = {c: n for c, n in size.items() if n >= 5}
    for kind, n in (({}, min(enough.values())), ({"ntile": 60}, int(np.percentile(list(enough.values()), 60))), ({"size": 20}, 20)):
        got = balancing.balanced(d, "a", "b", "id", seed=1, **kind).collect()
        by = {c: [r.id for r in got if (r.a, r.b) == c] for c in {(r.a, r.b) for r in got}}
        assert {c: len(v) for c, v in by.items()} == {c: min(n, m) for c, m in enough.items()}
        assert len({r.id for r in got}) == len(got)
        again = balancing.balanced(d.repartition(9), "a", "b", "id", seed=1, **kind).collect()
        assert {r.id for r in again} == {r.id for r in got}
    drawn = balancing.balanced(d, "a", "b", "id", override_min=True, seed=1).where("a = 'c'").collect()
    assert len(drawn) == min(enough.values()) and {r.id for r in drawn} <= {1000, 1001, 1002} and len({r.id for r in drawn}) > 1
    assert balancing.balanced(d, "a", "b", "id", min_size=10_000).collect() == []
    assert balancing.balanced(d.limit(0), "a", "b", "id").collect() == []


def test_strata_weigh_rows(spark):
    # Of each cell a tenth is in a stratum of its own, so its rows have a ninth of the others' weight.
    d = frame(spark, [(i, "a", "b", i % 10 == 0) for i in range(4000)], "id int, a string, b string, s boolean")
    got = balancing.balanced(d, "a", "b", "id", size=400, strata="s", seed=2).collect()
    assert len({r.id for r in got}) == 400 and sum(r.s for r in got) <= 15


def test_density(spark):
    rng = np.random.default_rng(7)
    rows = [("a", float(v)) for v in rng.normal(size=300)] + [("b", float(v)) for v in rng.exponential(size=200)] + [("c", 1.0)] * 5 + [("d", 2.0)]
    d = frame(spark, rows, "g string, y double")
    got = descriptive.density(d, "y", "g").orderBy("level", "at").collect()
    assert {r.level for r in got} == {"a", "b"}
    for g in "ab":
        y = np.array([v for h, v in rows if h == g])
        width = y.std(ddof=1) * len(y) ** -0.2
        at = np.linspace(y.min() - 2 * width, y.max() + 2 * width, 100)
        want = np.exp(-(((at[:, None] - y) / width) ** 2) / 2).sum(axis=1) / (len(y) * width * math.sqrt(2 * math.pi))
        own = [r for r in got if r.level == g]
        assert [r.at for r in own] == pytest.approx(at.tolist())
        assert np.abs(np.array([r.density for r in own]) - want).max() < 2e-3 * want.max()
    assert descriptive.density(d, "y", grid=50).count() == 50 and descriptive.density(d.limit(0), "y").count() == 0


def test_letter_values(spark):
    rows = [("a", float(k)) for k in range(1000)] + [("b", 1.0), ("b", 3.0)]
    got = {(r.level, r.depth): (r.low, r.high) for r in descriptive.letter_values(frame(spark, rows, "g string, y double"), "g", "y").collect()}
    assert {d for g, d in got if g == "a"} == set(range(0, int(math.log2(1000)) - 3 + 1)) and {d for g, d in got if g == "b"} == {0, 1}
    assert got["a", 2] == pytest.approx((np.quantile(range(1000), 0.125), np.quantile(range(1000), 0.875))) and got["b", 0] == (2.0, 2.0)


def test_normal_quantiles(spark):
    from statistics import NormalDist

    p = [1e-10, 1e-4, 0.002, 0.074, 0.075, 0.2, 0.5, 0.7, 0.926, 0.9999]
    got = frame(spark, [(v,) for v in p], "p double").select(special.normal_quantile_of(F.col("p")).alias("z")).collect()
    assert [r.z for r in got] == pytest.approx([NormalDist().inv_cdf(v) for v in p], rel=1e-13)


def test_shapiro_of_many_groups(spark):
    rng = np.random.default_rng(8)
    own = {f"g{n}": (rng.normal(size=n) if n % 2 else rng.exponential(size=n)).round(3) for n in (1, 2, 3, 4, 5, 6, 7, 11, 12, 40, 150, 299)}
    own |= {"same": np.ones(20), "line": np.arange(30.0), "three": np.array([0.0, 0.0, 1.0]), "apart": np.array([0.0] * 9 + [1e6])}
    d = frame(spark, [(g, float(v)) for g, x in own.items() for v in x], "g string, y double")
    got = {r.g: r for r in numeric.normal_p(d, ["g"]).collect()}
    for g, x in own.items():
        want = numeric.shapiro_p(x)
        assert got[g].n == len(x) and got[g].p_value == (None if want is None else pytest.approx(want, rel=1e-7, abs=1e-12)), g
