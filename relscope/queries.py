"""One query per operator over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import special
from .operators import anova, assumptions, balancing, batch, binning, chi2, clustering, descriptive, estimate, forecast, numeric, preparation, probability
from .plans import analyzer, compare
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tables.parquet(spark, f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, with -0 as 0, so that the order of summation doesn't show."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


# Tails in SQL: closed series of logarithms of the gamma function, from the side where they are short.


def sql_chi2_sf(x: str, k: str) -> str:
    a, y = f"(({k}) / 2.0)", f"(({x}) / 2.0)"
    return f"(CASE WHEN ({x}) IS NULL OR ({k}) < 1 THEN NULL WHEN {y} <= 0 THEN 1.0 WHEN {y} > 1000 THEN 0.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 3000), lambda i_: exp(({a} + i_) * ln({y}) - {y} - lgamma({a} + i_ + 1))))) END)"


def sql_beta(a: str, b: str, x: str, y: str) -> str:
    """I_x(a, b) for x + y = 1."""

    def series(a: str, b: str, x: str, y: str) -> str:
        return f"list_sum(list_transform(range(0, 3000), lambda i_: exp(({a} + i_) * ln({x}) + {b} * ln({y}) + lgamma({a} + {b} + i_) - lgamma({b}) - lgamma({a} + i_ + 1))))"

    return f"(CASE WHEN {x} <= 0 THEN 0.0 WHEN {y} <= 0 THEN 1.0 WHEN {x} <= 0.5 THEN {series(a, b, x, y)} WHEN {a} * {y} > 800 THEN 0.0 ELSE greatest(0.0, 1 - {series(b, a, y, x)}) END)"


def sql_f_sf(f: str, d1: str, d2: str) -> str:
    f, d1, d2 = (f"({v})::DOUBLE" for v in (f, d1, d2))
    down = f"({d2} + {d1} * {f})"
    return f"(CASE WHEN {f} IS NULL THEN NULL ELSE {sql_beta(f'({d2} / 2.0)', f'({d1} / 2.0)', f'({d2} / {down})', f'({d1} * {f} / {down})')} END)"


def sql_t_sf(t: str, dof: str) -> str:
    t, dof = (f"({v})::DOUBLE" for v in (t, dof))
    down = f"({dof} + {t} * {t})"
    return f"(CASE WHEN {t} IS NULL THEN NULL ELSE {sql_beta(f'({dof} / 2.0)', '0.5', f'({dof} / {down})', f'({t} * {t} / {down})')} END)"


# Descriptive.


@query("SELECT l_returnflag, l_linestatus, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY ALL")
def column_makeup(spark, sf):
    return rounded(descriptive.column_makeup(read(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"), "share")


@query("SELECT l_returnflag AS level_a, l_linestatus AS level_b, count(*) AS value FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def contingency_table(spark, sf):
    return descriptive.contingency(read(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT o_orderstatus AS level_a, o_orderpriority AS level_b, round(count(*) / (SELECT count(*) FROM orders), 6) AS value FROM orders GROUP BY ALL")
def frequencies_table(spark, sf):
    return rounded(descriptive.frequencies(read(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", True), "value")


@query("SELECT event_type AS level, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(skewness(value), 6) AS skew FROM events GROUP BY event_type")
def group_summary(spark, sf):
    return rounded(descriptive.group_summary(read(spark, sf, "events"), "event_type", "value"), "median", "mean", "std", "iqr", "skew")


@query("SELECT category, level, n, round(n / sum(n) OVER (PARTITION BY category), 6) AS share FROM (SELECT 'p_brand' AS category, p_brand AS level, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2)")
def value_counts(spark, sf):
    return rounded(descriptive.value_counts(read(spark, sf, "part"), ["p_brand", "p_type"]), "share")


@query("SELECT count(DISTINCT p_brand) AS p_brand, count(DISTINCT p_type) AS p_type, count(DISTINCT p_size) AS p_size FROM part")
def n_unique(spark, sf):
    return descriptive.n_unique(read(spark, sf, "part"), ["p_brand", "p_type", "p_size"])


@query("SELECT 'l_quantity' AS numeric, round(max(n) / sum(n), 6) AS ratio FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity) UNION ALL SELECT 'l_tax', round(max(n) / sum(n), 6) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_tax)")
def max_tie_ratio(spark, sf):
    return rounded(descriptive.max_tie_ratio(read(spark, sf, "lineitem"), ["l_quantity", "l_tax"]), "ratio")


@query("SELECT c_mktsegment, min(c_acctbal) AS min, round(avg(c_acctbal), 6) AS mean, round(quantile_cont(c_acctbal, 0.5), 6) AS median, max(c_acctbal) AS max, round(stddev_samp(c_acctbal), 6) AS std, count(*) AS size FROM customer GROUP BY 1")
def grouped_describe(spark, sf):
    return rounded(descriptive.grouped_describe(read(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"]), "mean", "median", "std")


@query(
    """WITH s AS (SELECT event_type AS level, count(*) AS n, unnest(range(0, 1 + greatest(1, length(bin(count(*))) - 4))) AS depth FROM events WHERE value IS NOT NULL GROUP BY 1),
  v AS (SELECT event_type AS level, list(value ORDER BY value) AS x FROM events WHERE value IS NOT NULL GROUP BY 1),
  q AS (SELECT level, n, depth, x, (n - 1) * 0.5 ** (depth + 1) AS a, (n - 1) * (1 - 0.5 ** (depth + 1)) AS b FROM s JOIN v USING (level))
SELECT level, n, depth::INT AS depth, round(x[floor(a)::INT + 1] + (x[ceil(a)::INT + 1] - x[floor(a)::INT + 1]) * (a - floor(a)), 6) AS low, round(x[floor(b)::INT + 1] + (x[ceil(b)::INT + 1] - x[floor(b)::INT + 1]) * (b - floor(b)), 6) AS high FROM q"""
)
def letter_values(spark, sf):
    return rounded(descriptive.letter_values(read(spark, sf, "events"), "event_type", "value"), "low", "high")


def sql_density(rows: str, grid: int, cut: float) -> str:
    """(level, at, density) of rows (level, y)."""
    return f"""WITH r AS ({rows}), s AS (SELECT *, lo - {cut} * width AS start, (hi - lo + {2 * cut} * width) / {grid - 1} AS step FROM (SELECT level, count(*) AS n, min(y) AS lo, max(y) AS hi, stddev_samp(y) * count(*) ** -0.2 AS width FROM r GROUP BY level)),
  p AS (SELECT s.level, (y - start) / step * 4 AS place FROM r JOIN s ON r.level IS NOT DISTINCT FROM s.level),
  m AS (SELECT level, bin, sum(mass) AS mass FROM (SELECT level, floor(place) AS bin, 1 - place + floor(place) AS mass FROM p UNION ALL SELECT level, floor(place) + 1, place - floor(place) FROM p) GROUP BY ALL)
SELECT s.level AS level, round(max(start + i * step), 6) AS at, round(sum(mass * exp(-(((i * 4 - bin) * step / 4 / width) ** 2) / 2) / sqrt(2 * pi())) / max(n * width), 8) AS density FROM m JOIN s ON m.level IS NOT DISTINCT FROM s.level, range({grid}) g(i) GROUP BY s.level, i"""


@query(sql_density("SELECT event_type AS level, value AS y FROM events WHERE value IS NOT NULL", 100, 2.0))
def violin_densities(spark, sf):
    return rounded(rounded(descriptive.density(read(spark, sf, "events"), "value", "event_type"), "at"), "density", digits=8)


@query(sql_density("SELECT NULL::VARCHAR AS level, o_totalprice AS y FROM orders", 200, 0.0).replace(", 8) AS density", ", 12) AS density"))
def histogram_density(spark, sf):
    return rounded(rounded(descriptive.density(read(spark, sf, "orders"), "o_totalprice", grid=200, cut=0.0), "at"), "density", digits=12)


@query("WITH s AS (SELECT min(p_size)::DOUBLE AS lo, (max(p_size) - min(p_size)) / 7.0 AS w FROM part), b AS (SELECT least(6, floor((p_size - lo) / w))::INT AS bin, count(*) AS n FROM part, s GROUP BY 1) SELECT i::INT AS bin, round(lo + i * w, 6) AS low, round(lo + (i + 1) * w, 6) AS high, coalesce(n, 0) AS n FROM range(7) r(i) CROSS JOIN s LEFT JOIN b ON b.bin = i")
def histogram(spark, sf):
    return rounded(descriptive.histogram(read(spark, sf, "part"), "p_size", 7), "low", "high")


@query("SELECT event_type AS level, count(*) AS n, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY 1")
def distribution_per_category(spark, sf):
    q = descriptive.distribution_per_category(read(spark, sf, "events"), "event_type", "value", (0.25, 0.5, 0.75))
    return q.select("level", "n", *(F.round(F.col("quantiles")[k], 6).alias(f"q{k + 1}") for k in range(3)))


@query("SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def regression_line(spark, sf):
    return rounded(rounded(descriptive.regression_line(read(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), "slope"), "intercept", digits=4)


@query("SELECT n_regionkey AS supercategory, count(DISTINCT n_name) AS n_subcategories FROM nation GROUP BY 1")
def subcategories_per_supercategory(spark, sf):
    return descriptive.subcategories(read(spark, sf, "nation"), "n_regionkey", "n_name")


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def contingency_pivot(spark, sf):
    return descriptive.wide(read(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("WITH l AS (SELECT min(l_quantity)::DOUBLE AS x0, max(l_quantity)::DOUBLE AS x1, min(l_extendedprice)::DOUBLE AS y0, max(l_extendedprice)::DOUBLE AS y1 FROM lineitem) SELECT least(6, floor((l_quantity::DOUBLE - x0) * 7 / (x1 - x0)))::INT AS bin_x, least(6, floor((l_extendedprice::DOUBLE - y0) * 7 / (y1 - y0)))::INT AS bin_y, count(*) AS n FROM lineitem, l GROUP BY 1, 2")
def joint_points(spark, sf):
    return descriptive.joint(read(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 7)["points"]


# Chi-squared.


def sql_chi2(table: str, a: str, b: str) -> str:
    return f"""SELECT '{a}' AS category_a, '{b}' AS category_b, total AS n, round(x, 6) AS chi2, dof, round({sql_chi2_sf("x", "dof")}, 6) AS p_value, met AS assumptions_met FROM (
  SELECT max(total) AS total, greatest(0, sum(n * n * total / (ra * rb)) - max(total)) AS x, (count(DISTINCT la) - 1) * (count(DISTINCT lb) - 1) AS dof FROM (
    SELECT *, sum(n) OVER (PARTITION BY la)::DOUBLE AS ra, sum(n) OVER (PARTITION BY lb)::DOUBLE AS rb, sum(n) OVER ()::BIGINT AS total FROM (SELECT {a} AS la, {b} AS lb, count(*) AS n FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2))),
  (SELECT min(e) >= 1 AND avg((e < 5)::INT) <= 0.2 AS met FROM (SELECT x.n * y.n / t.n AS e FROM (SELECT count(*)::DOUBLE AS n FROM {table} WHERE {b} IS NOT NULL AND {a} IS NOT NULL GROUP BY {a}) x, (SELECT count(*)::DOUBLE AS n FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {b}) y, (SELECT count(*)::DOUBLE AS n FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) t))"""


@query(" UNION ALL ".join(sql_chi2("part", a, b) for a, b in (("p_name", "p_brand"), ("p_name", "p_type"), ("p_brand", "p_type"))))
def chi2_independence_all(spark, sf):
    return rounded(chi2.independence_all(read(spark, sf, "part")), "chi2", "p_value")


@query(sql_chi2("lineitem", "l_linestatus", "l_returnflag"))
def chi2_target(spark, sf):
    return rounded(chi2.independence_all(read(spark, sf, "lineitem"), target="l_linestatus"), "chi2", "p_value")


@query(f"WITH l AS (SELECT *, coalesce(nullif(l_returnflag, 'A'), 'NaN') AS f FROM lineitem) {sql_chi2('l', 'f', 'l_linestatus')}")
def chi2_null_as_level(spark, sf):
    d = read(spark, sf, "lineitem").select(F.nullif(F.col("l_returnflag"), F.lit("A")).alias("f"), "l_linestatus")
    return rounded(chi2.independence(d, [("f", "l_linestatus")], dropna=False), "chi2", "p_value")


@query(f"SELECT category, n, k, round(x, 6) AS chi2, round({sql_chi2_sf('x', '(k - 1)')}, 6) AS p_value, n / k >= 5 AS assumptions_met FROM (SELECT category, sum(n)::BIGINT AS n, count(*) AS k, sum(n * n) / (sum(n) / count(*)) - sum(n) AS x FROM (SELECT 'o_orderstatus' AS category, o_orderstatus AS l, count(*)::DOUBLE AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*)::DOUBLE FROM orders GROUP BY 2) GROUP BY category)")
def goodness_of_fit(spark, sf):
    return rounded(chi2.goodness_of_fit(read(spark, sf, "orders")), "chi2", "p_value")


@query(f"SELECT * FROM ({' UNION ALL '.join(sql_chi2('part', a, b) for a, b in (('p_name', 'p_brand'), ('p_name', 'p_type'), ('p_brand', 'p_type')))}) WHERE p_value >= 0.01")
def chi2_comparison(spark, sf):
    return rounded(chi2.comparison(read(spark, sf, "part"), 0.01, True), "chi2", "p_value")


@query(f"SELECT * FROM ({ORACLE_SQL['goodness_of_fit']}) WHERE p_value >= 0.05")
def goodness_of_fit_comparison(spark, sf):
    return rounded(chi2.goodness_of_fit_comparison(read(spark, sf, "orders"), 0.05, True), "chi2", "p_value")


SQL_TWO = "sum((n1 - e1) ** 2 / e1 + (n2 - e2) ** 2 / e2) AS x, count(*) - 1 AS dof, avg(((e1 < 5)::INT + (e2 < 5)::INT) / 2.0) AS low"


@query(f"SELECT CASE WHEN low <= 0.2 THEN round(x, 6) END AS chi2, CASE WHEN low <= 0.2 THEN round({sql_chi2_sf('x', 'dof')}, 6) END AS p_value FROM (SELECT {SQL_TWO} FROM (SELECT n1, n2, (n1 + n2) * t1 / (t1 + t2) AS e1, (n1 + n2) * t2 / (t1 + t2) AS e2 FROM (SELECT *, sum(n1) OVER () AS t1, sum(n2) OVER () AS t2 FROM (SELECT p_brand, count(*) FILTER (p_size <= 25)::DOUBLE AS n1, count(*) FILTER (p_size > 25)::DOUBLE AS n2 FROM part GROUP BY 1))))")
def chi2_homogeneity(spark, sf):
    p = read(spark, sf, "part")
    return rounded(chi2.homogeneity(p.where("p_size <= 25"), p.where("p_size > 25"), "p_brand"), "chi2", "p_value")


def sql_subcats(table: str, a: str, b: str) -> str:
    def one(own: str, over: str) -> str:
        return f"""SELECT x AS subcat_a, y AS subcat_b, '{own}' AS source_column, CASE WHEN low <= 0.2 THEN round({sql_chi2_sf("x2", "dof")}, 6) END AS p_value FROM (
  SELECT x, y, {SQL_TWO.replace("AS x,", "AS x2,")} FROM (SELECT *, (n1 + n2) * t1 / (t1 + t2) AS e1, (n1 + n2) * t2 / (t1 + t2) AS e2 FROM (SELECT *, sum(n1) OVER (PARTITION BY x, y) AS t1, sum(n2) OVER (PARTITION BY x, y) AS t2 FROM (
    SELECT p.x, p.y, t.{over} AS o, count(*) FILTER (t.{own} = p.x)::DOUBLE AS n1, count(*) FILTER (t.{own} = p.y)::DOUBLE AS n2 FROM (SELECT DISTINCT u.{own} AS x, v.{own} AS y FROM {table} u JOIN (SELECT DISTINCT {own} FROM {table}) v ON u.{own} < v.{own}) p JOIN {table} t ON t.{own} IN (p.x, p.y) GROUP BY 1, 2, 3))) GROUP BY x, y)"""

    return f"{one(a, b)} UNION ALL {one(b, a)}"


@query(sql_subcats("orders", "o_orderstatus", "o_orderpriority"))
def chi2_subcategories(spark, sf):
    return rounded(chi2.subcategories(read(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"), "p_value")


@query(f"SELECT * FROM ({sql_subcats('orders', 'o_orderstatus', 'o_orderpriority')}) WHERE p_value < 0.5")
def chi2_subcategory_similarities(spark, sf):
    return rounded(chi2.subcategory_similarities(read(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", 0.5), "p_value")


# Super- and subcategories.


@query("SELECT 'p_type' AS supercategory, 'p_brand' AS subcategory, round(avg((k = 1)::INT), 6) AS share FROM (SELECT count(DISTINCT p_type) AS k FROM part GROUP BY p_brand) UNION ALL SELECT 'p_brand', 'p_name', round(avg((k = 1)::INT), 6) FROM (SELECT count(DISTINCT p_brand) AS k FROM part GROUP BY p_name)")
def deterministic_share(spark, sf):
    return rounded(chi2.deterministic_share(read(spark, sf, "part"), [("p_type", "p_brand"), ("p_brand", "p_name")]), "share")


@query("SELECT 'r' AS supercategory, 'n_name' AS subcategory, 1.0::DOUBLE AS share")
def deterministic_pairs(spark, sf):
    n = read(spark, sf, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("r"))
    return chi2.deterministic_pairs(n, ["n_name", "r"])


def sql_bits(a: str, b: str) -> str:
    return f"SELECT '{a}' AS supercategory, '{b}' AS subcategory, round(avg(h), 6) AS bits FROM (SELECT sum(-p * log2(p + 1e-12)) AS h FROM (SELECT s, n / sum(n) OVER (PARTITION BY s) AS p FROM (SELECT {b} AS s, count(*) AS n FROM part GROUP BY {a}, {b})) GROUP BY s)"


@query(" UNION ALL ".join(sql_bits(a, b) for a, b in (("p_brand", "p_name"), ("p_type", "p_name"), ("p_type", "p_brand"))))
def conditional_entropy(spark, sf):
    return rounded(chi2.entropy_pairs(read(spark, sf, "part"), ["p_name", "p_brand", "p_type"], None), "bits")


@query("SELECT supercategory, subcategory FROM (SELECT p_brand AS supercategory, p_name AS subcategory, row_number() OVER (PARTITION BY p_name ORDER BY count(*) DESC, p_brand) AS pos FROM part GROUP BY 1, 2) WHERE pos = 1")
def sub_to_super(spark, sf):
    return chi2.sub_to_super(read(spark, sf, "part"), "p_brand", "p_name")


# Numbers over groups.


def sql_anova(table: str, c: str, y: str, rows: str | None = None) -> str:
    rows = rows or f"SELECT {c} AS g, {y}::DOUBLE AS y FROM {table} WHERE {c} IS NOT NULL AND {y} IS NOT NULL"
    return f"""SELECT '{c}' AS category, '{y}' AS numeric, n, k, round(f, 6) AS f_stat, round({sql_f_sf("f", "(k - 1.0)", "(n - k)::DOUBLE")}, 6) AS p_value FROM (
  SELECT n, k, (b / (k - 1)) / (w / (n - k)) AS f FROM (SELECT sum(gn)::BIGINT AS n, count(*) AS k, sum(gn * (m - grand) ** 2) AS b, sum(gn * v) AS w FROM (SELECT *, sum(gn * m) OVER () / sum(gn) OVER () AS grand FROM (SELECT g, count(*) AS gn, avg(y) AS m, var_pop(y) AS v FROM ({rows}) GROUP BY g))))"""


@query(" UNION ALL ".join(sql_anova("lineitem", c, y) for c in ("l_returnflag", "l_linestatus") for y in ("l_quantity", "l_discount")))
def anova_all(spark, sf):
    d = read(spark, sf, "lineitem")
    return rounded(anova.test_all(d, "anova", ["l_quantity", "l_discount"]), "f_stat", "p_value")


def sql_kruskal(table: str, c: str, y: str) -> str:
    return f"""SELECT '{c}' AS category, '{y}' AS numeric, n::BIGINT AS n, k, round(h, 6) AS h_stat, round({sql_chi2_sf("h", "(k - 1)")}, 6) AS p_value FROM (
  SELECT n, k, (12 / (n * (n + 1)) * rr - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) AS h FROM (SELECT count(*) AS k, sum(r * r / gn) AS rr FROM (SELECT g, sum(rank) AS r, count(*)::DOUBLE AS gn FROM (SELECT {c} AS g, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS rank FROM {table}) GROUP BY g)),
  (SELECT sum(t)::DOUBLE AS n, sum(t ** 3 - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM {table} GROUP BY {y})))"""


@query(" UNION ALL ".join(sql_kruskal("lineitem", c, "l_quantity") for c in ("l_returnflag", "l_linestatus")))
def kruskal_all(spark, sf):
    return rounded(anova.test_all(read(spark, sf, "lineitem"), "kruskal", ["l_quantity"]), "h_stat", "p_value")


@query(f"SELECT * FROM ({sql_kruskal('events', 'event_type', 'value')}) WHERE p_value >= 0.05 OR p_value < 0.05")
def kruskal_target(spark, sf):
    return rounded(anova.comparison(read(spark, sf, "events"), 0.05, None, categoric="event_type", numeric="value", numeric_target="value"), "h_stat", "p_value")


@query(
    f"""WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS g, sum(n * m) OVER (PARTITION BY a) / sum(n) OVER (PARTITION BY a) AS ma, sum(n * m) OVER (PARTITION BY b) / sum(n) OVER (PARTITION BY b) AS mb FROM c),
s AS (SELECT sum(n * (ma - g) ** 2) AS sa, sum(n * (mb - g) ** 2) AS sb, sum(n * (m - ma - mb + g) ** 2) AS sab, sum(n * v) AS se, sum(n) AS n, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM w),
e AS (SELECT 'l_returnflag' AS effect, sa AS ss, ka - 1.0 AS dof, se, n - ka * kb AS de FROM s UNION ALL SELECT 'l_linestatus', sb, kb - 1.0, se, n - ka * kb FROM s UNION ALL SELECT 'l_returnflag:l_linestatus', sab, (ka - 1.0) * (kb - 1), se, n - ka * kb FROM s),
f AS (SELECT *, (ss / dof) / (se / de) AS f FROM e)
SELECT effect, round(ss, 4) AS ss, dof::DOUBLE AS dof, round(f, 6) AS f_stat, round({sql_f_sf("f", "dof", "de")}, 6) AS p_value FROM f"""
)
def two_way_anova(spark, sf):
    return rounded(rounded(anova.two_way(read(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity"), "f_stat", "p_value"), "ss", digits=4)


@query("SELECT l_returnflag, l_linestatus, min(n) OVER () AS n FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def balanced_interactions(spark, sf):
    return anova.balanced_interactions(read(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


def sql_hash(seed: int, *keys: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'coalesce({k}::VARCHAR, {chr(39) * 2})' for k in keys)})), 1, 13))::BIGINT"


def sql_uniform(seed: int, *keys: str) -> str:
    return f"(({sql_hash(seed, *keys)} + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def sql_balanced(table: str, a: str, b: str, key: tuple[str, ...], size: str, min_size: int, seed: int, weight: str | None = None) -> str:
    """Rows of :func:`balancing.balanced`; ``size`` is an aggregate of the sizes n of cells that have ``min_size``."""
    order = sql_hash(seed, *key) if weight is None else f"-ln({sql_uniform(seed, *key)}) / count(*) OVER (PARTITION BY {a}, {b}, {weight})"
    return f"""SELECT {", ".join(key)}, {a}, {b} FROM (SELECT *, row_number() OVER (PARTITION BY {a}, {b} ORDER BY h) AS pos FROM (SELECT *, {order} AS h, count(*) OVER (PARTITION BY {a}, {b}) AS n FROM {table})),
  (SELECT {size} AS size FROM (SELECT count(*) AS n FROM {table} GROUP BY {a}, {b}) WHERE n >= {min_size}) WHERE n >= {min_size} AND pos <= size"""


KEY = ("l_orderkey", "l_linenumber")


@query(sql_balanced("lineitem", "l_returnflag", "l_linestatus", KEY, "floor(quantile_cont(n, 0.3))", 5, 3))
def balanced_ntile(spark, sf):
    d = read(spark, sf, "lineitem").select(*KEY, "l_returnflag", "l_linestatus")
    return balancing.balanced(d, "l_returnflag", "l_linestatus", KEY, ntile=30, seed=3)


@query(sql_balanced("(SELECT *, p_size > 40 AS large FROM part)", "p_type", "large", ("p_partkey",), "min(n)", 5, 4, "p_brand"))
def balanced_strata(spark, sf):
    d = read(spark, sf, "part").select("p_partkey", "p_type", (F.col("p_size") > 40).alias("large"), "p_brand")
    return balancing.balanced(d, "p_type", "large", "p_partkey", strata="p_brand", seed=4).drop("p_brand")


@query(
    f"""{sql_balanced("part", "p_brand", "p_type", ("p_partkey",), "min(n)", 12, 5)} UNION ALL
SELECT p_partkey, p_brand, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY {sql_hash(5, "p_partkey")}) - 1 AS place FROM part) JOIN
  (SELECT p_brand, p_type, floor({sql_uniform(5, "p_brand", "p_type", "i")} * n) AS place FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) c,
    range((SELECT min(n) FROM (SELECT count(*) AS n FROM part GROUP BY p_brand, p_type) WHERE n >= 12)) r(i) WHERE n < 12) USING (p_brand, p_type, place)"""
)
def balanced_replacement(spark, sf):
    d = read(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return balancing.balanced(d, "p_brand", "p_type", "p_partkey", min_size=12, override_min=True, seed=5)


SQL_WELCH = "(m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) AS dof"


def sql_groups(table: str, c: str, y: str) -> str:
    return f"WITH g AS (SELECT {c} AS l, count({y})::DOUBLE AS n, avg({y}) AS m, var_samp({y}) AS v FROM {table} GROUP BY 1), p AS (SELECT a.l AS l1, b.l AS l2, a.n AS n1, a.m AS m1, a.v AS v1, b.n AS n2, b.m AS m2, b.v AS v2 FROM g a JOIN g b ON a.l < b.l), t AS (SELECT *, {SQL_WELCH} FROM p) SELECT l1 AS subcat_1, l2 AS subcat_2, round({sql_t_sf('t', 'dof')}, 6) AS p_value, n1::BIGINT AS n_samples_1, n2::BIGINT AS n_samples_2 FROM t"


@query(sql_groups("events", "event_type", "value"))
def group_pair_t_tests(spark, sf):
    return rounded(anova.group_pairs(read(spark, sf, "events"), "event_type", "value"), "p_value")


@query(f"SELECT * FROM ({sql_groups('part', 'p_brand', 'p_retailprice')}) WHERE p_value < 0.05 AND n_samples_1 > 20 AND n_samples_2 > 20")
def group_similarities(spark, sf):
    return rounded(anova.group_similarities(read(spark, sf, "part"), "p_brand", "p_retailprice", 0.05, False, 20), "p_value")


# Numbers.


def sql_t_tests(columns: list[str], table: str, stat: str) -> str:
    m = " UNION ALL ".join(f"SELECT '{c}' AS c, count({c})::DOUBLE AS n, avg({c}) AS m, var_samp({c}) AS v FROM {table}" for c in columns)
    return f"WITH m AS ({m}), p AS (SELECT a.c AS numeric_a, b.c AS numeric_b, a.n AS n1, a.m AS m1, a.v AS v1, b.n AS n2, b.m AS m2, b.v AS v2 FROM m a JOIN m b ON a.c <> b.c), t AS (SELECT *, {stat} FROM p) SELECT numeric_a, numeric_b, round(t, 6) AS t_stat, round({sql_t_sf('t', 'dof')}, 6) AS p_value FROM t"


@query(sql_t_tests(["l_discount", "l_tax"], "lineitem", SQL_WELCH))
def welch_all_pairs(spark, sf):
    return rounded(numeric.t_tests(read(spark, sf, "lineitem"), ["l_discount", "l_tax"]), "t_stat", "p_value")


@query(sql_t_tests(["c_acctbal", "c_custkey"], "customer", "(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t, n1 + n2 - 2 AS dof"))
def student_all_pairs(spark, sf):
    return rounded(numeric.t_tests(read(spark, sf, "customer"), ["c_acctbal", "c_custkey"], method="student"), "t_stat", "p_value")


@query(f"SELECT * FROM ({sql_t_tests(['l_discount', 'l_tax'], 'lineitem', SQL_WELCH)}) WHERE p_value < 0.05")
def t_test_comparison(spark, sf):
    return rounded(numeric.t_test_comparison(read(spark, sf, "lineitem"), 0.05, False, columns=["l_discount", "l_tax"]), "t_stat", "p_value")


def sql_pairs(table: str, columns: list[str], value: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS numeric_a, '{b}' AS numeric_b, round({value.format(a=a, b=b)}, 6) AS correlation FROM {table}" for i, a in enumerate(columns) for b in columns[i + 1 :])


@query(sql_pairs("lineitem", ["l_quantity", "l_extendedprice", "l_discount"], "corr({a}, {b})"))
def pearson_all_pairs(spark, sf):
    return rounded(numeric.correlations(read(spark, sf, "lineitem"), "pearson", ["l_quantity", "l_extendedprice", "l_discount"]), "correlation")


@query(" UNION ALL ".join(f"SELECT '{c}' AS numeric_a, 'l_quantity' AS numeric_b, round(corr({c}, l_quantity), 6) AS correlation FROM lineitem" for c in ("l_extendedprice", "l_discount")))
def target_correlations(spark, sf):
    return rounded(numeric.correlations(read(spark, sf, "lineitem"), "pearson", ["l_extendedprice", "l_discount"], "l_quantity"), "correlation")


RANKED = "(SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ("l_quantity", "l_extendedprice", "l_tax")) + " FROM lineitem)"


@query(sql_pairs(RANKED, ["l_quantity", "l_extendedprice", "l_tax"], "corr({a}, {b})"))
def spearman_all_pairs(spark, sf):
    return rounded(numeric.correlations(read(spark, sf, "lineitem"), "spearman", ["l_quantity", "l_extendedprice", "l_tax"]), "correlation")


@query("SELECT 'p_size' AS numeric_a, 'p_retailprice' AS numeric_b, round(sum(sign(a.p_size - b.p_size) * sign(a.p_retailprice - b.p_retailprice)) / (sqrt(sum(abs(sign(a.p_size - b.p_size)))) * sqrt(sum(abs(sign(a.p_retailprice - b.p_retailprice))))), 6) AS correlation FROM part a, part b")
def kendall_all_pairs(spark, sf):
    return rounded(numeric.correlations(read(spark, sf, "part"), "kendall", ["p_size", "p_retailprice"]), "correlation")


@query(f"SELECT * FROM ({sql_pairs('lineitem', ['l_quantity', 'l_extendedprice', 'l_discount'], 'corr({a}, {b})')}) WHERE abs(correlation) >= 0.003")
def correlation_comparison(spark, sf):
    return rounded(numeric.correlation_comparison(read(spark, sf, "lineitem"), 0.003, True, method="pearson", columns=["l_quantity", "l_extendedprice", "l_discount"]), "correlation")


def sql_k2_of(rows: str) -> str:
    """(g, n, p_value) of rows (g, v)."""
    return f"""SELECT g, n::BIGINT AS n, round(exp(-(zs * zs + zk * zk) / 2), 6) AS p_value FROM (SELECT g, n, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs,
  (1 - 2 / (9 * a) - sign(1 + x * sqrt(2 / (a - 4))) * (abs((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))) ** (1 / 3.0))) / sqrt(2 / (9 * a)) AS zk FROM (
  SELECT *, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2, sk * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
    (ku - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6 + 8 / b1 * (2 / b1 + sqrt(1 + 4 / (b1 * b1))) AS a FROM (
    SELECT *, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b1 FROM (
      SELECT g, count(*)::DOUBLE AS n, avg((v - m) ** 3) / avg((v - m) ** 2) ** 1.5 AS sk, avg((v - m) ** 4) / avg((v - m) ** 2) ** 2 AS ku FROM (SELECT g, v, avg(v) OVER (PARTITION BY g) AS m FROM ({rows})) GROUP BY g))))"""


def sql_k2(table: str, y: str) -> str:
    return f"SELECT '{y}' AS numeric, n, p_value FROM ({sql_k2_of(f'SELECT 0 AS g, {y}::DOUBLE AS v FROM {table}')})"


@query(" UNION ALL ".join(sql_k2("customer", y) for y in ("c_acctbal", "c_nationkey")))
def normality(spark, sf):
    return rounded(numeric.normality(read(spark, sf, "customer"), ["c_acctbal", "c_nationkey"]), "p_value")


def sql_polynomial(c: tuple[float, ...], x: str) -> str:
    return "(" + " + ".join(f"({v!r}::DOUBLE) * ({x}) ** {i}" if i else f"({v!r}::DOUBLE)" for i, v in enumerate(c)) + ")"


def sql_normal_quantile(p: str) -> str:
    near, far = f"(0.180625 - ({p} - 0.5) ** 2)", f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6)"
    (a, b), (c, d) = special.MIDDLE, special.OUTER
    return f"(CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {sql_polynomial(a, near)} / {sql_polynomial(b, near)} ELSE sign({p} - 0.5) * {sql_polynomial(c, far)} / {sql_polynomial(d, far)} END)"


def sql_shapiro_of(rows: str) -> str:
    """(g, n, p_value) of rows (g, v), for groups of 6 to 299 rows that are not all equal."""
    sf = f"CASE WHEN z > 0 THEN {sql_chi2_sf('z * z', '1')} / 2 ELSE 1 - {sql_chi2_sf('z * z', '1')} / 2 END"
    few, many = (f"(y - {sql_polynomial(mean, x)}) / exp({sql_polynomial(sd, x)})" for mean, sd, x in ((numeric.FEW_MEAN, numeric.FEW_LOG_SD, "n::DOUBLE"), (numeric.MANY_MEAN, numeric.MANY_LOG_SD, "ln(n)")))
    return f"""SELECT g, n, round({sf}, 6) AS p_value FROM (SELECT g, n, CASE WHEN n <= 11 THEN {few} ELSE {many} END AS z FROM (
  SELECT g, n, CASE WHEN n <= 11 THEN -ln({sql_polynomial(numeric.FEW_LIMIT, "n::DOUBLE")} - ln(1 - w)) ELSE ln(1 - w) END AS y FROM (
  SELECT g, n, (list_sum(list_transform(range(3, n - 1), lambda i: m[i] * x[i])) / sqrt((mm - 2 * m[n] ** 2 - 2 * m[n - 1] ** 2) / (1 - 2 * a ** 2 - 2 * b ** 2)) + a * (x[n] - x[1]) + b * (x[n - 1] - x[2])) ** 2 / list_sum(list_transform(x, lambda v: (v - mean) ** 2)) AS w FROM (
  SELECT *, {sql_polynomial((0.0, *numeric.LAST), "n ** -0.5")} + m[n] / sqrt(mm) AS a, {sql_polynomial((0.0, *numeric.LAST_BUT_ONE), "n ** -0.5")} + m[n - 1] / sqrt(mm) AS b FROM (
  SELECT *, list_sum(list_transform(m, lambda q: q * q)) AS mm FROM (
  SELECT g, count(*) AS n, avg(v) AS mean, list(v ORDER BY v) AS x, list_transform(range(1, count(*) + 1), lambda i: {sql_normal_quantile("((i - 0.375::DOUBLE) / (count(*) + 0.25::DOUBLE))")}) AS m FROM ({rows}) GROUP BY g))))))"""


@query(f"SELECT 's_acctbal' AS numeric, n, p_value FROM ({sql_shapiro_of('SELECT 0 AS g, s_acctbal::DOUBLE AS v FROM supplier WHERE s_suppkey < 80')})")
def normality_of_few(spark, sf):
    return rounded(numeric.normality(read(spark, sf, "supplier").where("s_suppkey < 80"), ["s_acctbal"]), "p_value")


@query(f"SELECT * FROM ({' UNION ALL '.join(sql_k2('lineitem', y) for y in ('l_quantity', 'l_discount'))}) WHERE p_value < 0.05")
def normality_comparison(spark, sf):
    return rounded(numeric.normality_comparison(read(spark, sf, "lineitem"), 0.05, False, columns=["l_quantity", "l_discount"]), "p_value")


# Assumptions.


@query(f"SELECT category, numeric, f_stat AS levene, p_value FROM ({sql_anova('', 'event_type', 'value', 'SELECT e.event_type AS g, abs(value - med) AS y FROM events e JOIN (SELECT event_type, quantile_cont(value, 0.5) AS med FROM events GROUP BY 1) m USING (event_type)')})")
def levene(spark, sf):
    return rounded(assumptions.levene(batch.mixed(read(spark, sf, "events"), [("event_type", "value")])), "levene", "p_value")


@query("SELECT 'event_type' AS category, 'value' AS numeric, e.event_type AS level, count(*) AS n FROM events e JOIN (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1) q USING (event_type) WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) GROUP BY 3")
def iqr_outliers(spark, sf):
    rows = assumptions.without_outliers(batch.mixed(read(spark, sf, "events"), [("event_type", "value")]))
    return rows.groupBy("category", "numeric", "level").agg(F.count("*").alias("n"))


@query("SELECT 'p_brand' AS category, 'p_size' AS numeric, min(n) >= 5 AS met FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)")
def group_sizes(spark, sf):
    return assumptions.group_sizes(batch.mixed(read(spark, sf, "part"), [("p_brand", "p_size")]))


@query(
    """WITH p AS (SELECT DISTINCT a.event_type AS x, b.event_type AS y FROM events a JOIN (SELECT DISTINCT event_type FROM events) b ON a.event_type < b.event_type),
n AS (SELECT event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1),
s AS (SELECT x, y, a.n AS n1, b.n AS n2, e.value AS v, sum(CASE WHEN e.event_type = x THEN 1 / a.n ELSE -1 / b.n END) AS step FROM p JOIN n a ON a.event_type = x JOIN n b ON b.event_type = y JOIN events e ON e.event_type IN (x, y) GROUP BY ALL),
d AS (SELECT x, y, n1, n2, abs(sum(step) OVER (PARTITION BY x, y ORDER BY v)) AS gap FROM s)
SELECT x AS x_1, y AS x_2, n1::BIGINT AS n_1, n2::BIGINT AS n_2, round(max(gap), 6) AS ks_stat FROM d GROUP BY ALL"""
)
def ks_statistics(spark, sf):
    return rounded(assumptions.ks_pairs(batch.mixed(read(spark, sf, "events"), [("event_type", "value")])).select("x_1", "x_2", "n_1", "n_2", "ks_stat"), "ks_stat")


@query()
def ks_p_values(spark, sf):
    d = read(spark, sf, "part")
    return rounded(assumptions.ks_pairs(batch.mixed(d, [("p_type", "p_size")])), "ks_stat", "p_value")


@query("SELECT 'l_returnflag' AS category, numeric, max(n) / sum(n) < 0.05 AS lenient FROM (SELECT 'l_quantity' AS numeric, count(*) AS n FROM lineitem GROUP BY l_quantity UNION ALL SELECT 'l_tax', count(*) FROM lineitem GROUP BY l_tax) GROUP BY numeric")
def lenient_gate(spark, sf):
    return assumptions.lenient(read(spark, sf, "lineitem"), [("l_returnflag", "l_quantity"), ("l_returnflag", "l_tax")], 0.05)


@query()
def kruskal_assumptions(spark, sf):
    return assumptions.kruskal_met(read(spark, sf, "customer"), [("c_mktsegment", "c_acctbal")], assumptions.KruskalRules(return_lenient=True, tolerant=True))


def sql_ks(table: str, c: str, y: str) -> str:
    """(x_1, x_2, n_1, n_2, ks_stat, p_value), by the limit of many rows."""
    return f"""WITH r AS (SELECT {c}::VARCHAR AS g, {y}::DOUBLE AS v FROM {table} WHERE {c} IS NOT NULL AND {y} IS NOT NULL), n AS (SELECT g, count(*)::DOUBLE AS n FROM r GROUP BY 1),
p AS (SELECT a.g AS x, b.g AS y, a.n AS n1, b.n AS n2 FROM n a JOIN n b ON a.g < b.g),
s AS (SELECT x, y, n1, n2, v, sum(CASE WHEN g = x THEN 1 / n1 ELSE -1 / n2 END) AS step FROM p JOIN r ON g IN (x, y) GROUP BY ALL),
d AS (SELECT x, y, n1, n2, max(abs(gap)) AS d FROM (SELECT *, sum(step) OVER (PARTITION BY x, y ORDER BY v) AS gap FROM s) GROUP BY ALL), z AS (SELECT *, n1 * n2 / (n1 + n2) * d * d AS z FROM d)
SELECT x AS x_1, y AS x_2, n1::BIGINT AS n_1, n2::BIGINT AS n_2, round(d, 6) AS ks_stat, round(CASE WHEN sqrt(z) < 0.05 THEN 1 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * z))))) END, 6) AS p_value FROM z"""


def sql_levene(c: str, y: str, rows: str) -> str:
    return sql_anova("", c, y, f"SELECT g, abs(y - med) AS y FROM {rows} JOIN (SELECT g, quantile_cont(y, 0.5) AS med FROM {rows} GROUP BY g) USING (g)")


def sql_normal_of(rows: str) -> str:
    """(g, n, p_value) of rows (g, v), by the test for a group's size."""
    of = lambda few: f"SELECT g, v FROM (SELECT *, count(*) OVER (PARTITION BY g) AS size FROM ({rows})) WHERE size {'<' if few else '>='} {numeric.LARGE}"
    return f"{sql_k2_of(of(False))} UNION ALL {sql_shapiro_of(of(True))}"


def sql_anova_met(table: str, c: str, y: str, rules: assumptions.AnovaRules = assumptions.AnovaRules()) -> str:
    """(category, numeric, assumptions_met), for groups of 6 rows and more."""
    w = f"{rules.iqr_multiplier} * (b - a)"
    return f"""SELECT * FROM (WITH r AS MATERIALIZED (SELECT {c} AS g, {y}::DOUBLE AS y FROM {table} WHERE {c} IS NOT NULL AND {y} IS NOT NULL),
kept AS MATERIALIZED (SELECT g, y FROM r JOIN (SELECT g, quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM r GROUP BY g) USING (g) WHERE y BETWEEN a - {w} AND b + {w})
SELECT '{c}' AS category, '{y}' AS numeric, (SELECT min(n) >= {rules.min_n} FROM (SELECT count(*) AS n FROM kept GROUP BY g)) AND coalesce((SELECT p_value > {rules.homogeneity_alpha} FROM ({sql_levene(c, y, "kept")})), false)
  AND (SELECT bool_and(coalesce(p_value > {rules.normality_alpha}, false)) FROM ({sql_normal_of("SELECT g, y AS v FROM kept")})) AS assumptions_met)"""


def sql_kruskal_met(table: str, c: str, y: str, rules: assumptions.KruskalRules) -> str:
    """(category, numeric, assumptions_met) by the tolerant and lenient rules."""
    return f"""SELECT * FROM (WITH r AS MATERIALIZED (SELECT {c} AS g, {y}::DOUBLE AS y FROM {table} WHERE {c} IS NOT NULL AND {y} IS NOT NULL),
out AS (SELECT x, avg((p_value < {rules.ks_alpha})::INT) AS share FROM (SELECT p_value, unnest([x_1, x_2]) AS x FROM ({sql_ks(table, c, y)})) GROUP BY x),
met AS (SELECT NOT bool_or(share > 0.2 OR (spread > 0 AND (share - centre) / spread > 3)) AND max(centre) <= 0.2 AS met FROM (SELECT share, avg(share) OVER () AS centre, stddev_pop(share) OVER () AS spread FROM out))
SELECT '{c}' AS category, '{y}' AS numeric, CASE WHEN k < 2 THEN 'False' WHEN least_ >= 3 AND NOT coalesce(p < {rules.levene_alpha}, false) AND coalesce(met, true) THEN 'True' WHEN tied < {rules.max_tie_ratio} THEN '{assumptions.LENIENT}' ELSE 'False' END AS assumptions_met
FROM (SELECT count(*) AS k, min(n) AS least_ FROM (SELECT count(*) AS n FROM r GROUP BY g)), (SELECT p_value AS p FROM ({sql_levene(c, y, "r")})), met, (SELECT max(n) / sum(n) AS tied FROM (SELECT count(*) AS n FROM {table} WHERE {y} IS NOT NULL GROUP BY {y})))"""


@query(sql_ks("lineitem", "l_returnflag", "l_quantity"))
def ks_limit_p_values(spark, sf):
    pairs = assumptions.ks_pairs(batch.mixed(read(spark, sf, "lineitem"), [("l_returnflag", "l_quantity")]))
    return rounded(pairs.select("x_1", "x_2", "n_1", "n_2", "ks_stat", "p_value"), "ks_stat", "p_value")


@query(f"SELECT 'l_returnflag' AS category, 'l_quantity' AS numeric, bool_and(p_value > 0.05) AS met FROM ({sql_k2_of('SELECT l_returnflag AS g, l_quantity::DOUBLE AS v FROM lineitem')})")
def group_normality(spark, sf):
    return assumptions.group_normality(batch.mixed(read(spark, sf, "lineitem"), [("l_returnflag", "l_quantity")]))


#: A number that is close to normal within groups: a sum of remainders.
BELL = " + ".join(f"(l_orderkey * {k} + l_linenumber * {k * k}) % 101" for k in (7, 11, 13, 17, 19, 23, 29, 31))


@query(sql_anova_met("customer", "c_mktsegment", "c_acctbal"))
def anova_assumptions(spark, sf):
    return assumptions.anova_met(read(spark, sf, "customer"), [("c_mktsegment", "c_acctbal")])


@query(f"WITH bell AS (SELECT *, {BELL} AS bell FROM lineitem) {sql_anova_met('bell', 'l_returnflag', 'bell')} UNION ALL {sql_anova_met('bell', 'l_returnflag', 'l_quantity')}")
def anova_assumptions_of_many(spark, sf):
    return assumptions.anova_met(read(spark, sf, "lineitem").withColumn("bell", F.expr(BELL)), [("l_returnflag", "bell"), ("l_returnflag", "l_quantity")])


TOLERANT = assumptions.KruskalRules(return_lenient=True, tolerant=True)


@query(f"WITH l AS (SELECT *, l_quantity * (l_returnflag = 'A')::INT AS apart FROM lineitem) {sql_kruskal_met('l', 'l_returnflag', 'l_quantity', TOLERANT)} UNION ALL {sql_kruskal_met('l', 'l_returnflag', 'apart', TOLERANT)}")
def kruskal_assumptions_of_many(spark, sf):
    d = read(spark, sf, "lineitem").withColumn("apart", F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0))
    return assumptions.kruskal_met(d, [("l_returnflag", "l_quantity"), ("l_returnflag", "apart")], TOLERANT)


# Comparisons and the analyzer.


@query(
    f"""SELECT numeric AS column_a, category AS column_b, 'kruskal' AS test, p_value, NULL::DOUBLE AS correlation FROM ({sql_kruskal("part", "p_brand", "p_size")} UNION ALL {sql_kruskal("part", "p_type", "p_size")})
UNION ALL SELECT category_a, category_b, 'chi2', p_value, NULL FROM ({sql_chi2("part", "p_brand", "p_type")})
UNION ALL SELECT numeric_a, numeric_b, 'pearson', NULL, correlation FROM ({sql_pairs("part", ["p_size", "p_retailprice"], "corr({a}, {b})")})
UNION ALL SELECT numeric, category, 'kruskal', p_value, NULL FROM ({sql_kruskal("part", "p_brand", "p_retailprice")} UNION ALL {sql_kruskal("part", "p_type", "p_retailprice")})"""
)
def column_comparison(spark, sf):
    d = read(spark, sf, "part")
    return rounded(compare.column_comparison(d, ("pearson", 0.0, None), ("kruskal", 0.05, None), ("chi2", 0.05, None), numeric_columns=["p_size", "p_retailprice"], categoric_columns=["p_brand", "p_type"]), "p_value", "correlation")


@query()
def multi_test_comparison(spark, sf):
    d = read(spark, sf, "customer").select("c_acctbal", "c_nationkey", "c_mktsegment")
    return rounded(compare.multi_test_comparison(d, [("pearson", 0, None)], [("kruskal", 0, None), ("anova", 0, None)], True, check_assumptions=True), "p_value", "correlation")


@query(
    f"""SELECT numeric AS column_a, category AS column_b, 'kruskal' AS test, p_value, NULL::DOUBLE AS correlation, assumptions_met FROM ({sql_kruskal("lineitem", "l_returnflag", "l_quantity")}) JOIN ({sql_kruskal_met("lineitem", "l_returnflag", "l_quantity", TOLERANT)}) USING (category, numeric)
UNION ALL SELECT numeric, category, 'anova', p_value, NULL, assumptions_met::VARCHAR FROM ({sql_anova("lineitem", "l_returnflag", "l_quantity")}) JOIN ({sql_anova_met("lineitem", "l_returnflag", "l_quantity")}) USING (category, numeric)
UNION ALL SELECT category_a, category_b, 'chi2', p_value, NULL, assumptions_met::VARCHAR FROM ({sql_chi2("lineitem", "l_returnflag", "l_linestatus")}) WHERE category_b = 'l_linestatus'
UNION ALL SELECT numeric, category, 'kruskal', p_value, NULL, assumptions_met FROM ({sql_kruskal("lineitem", "l_linestatus", "l_quantity")}) JOIN ({sql_kruskal_met("lineitem", "l_linestatus", "l_quantity", TOLERANT)}) USING (category, numeric)
UNION ALL SELECT numeric, category, 'anova', p_value, NULL, assumptions_met::VARCHAR FROM ({sql_anova("lineitem", "l_linestatus", "l_quantity")}) JOIN ({sql_anova_met("lineitem", "l_linestatus", "l_quantity")}) USING (category, numeric)"""
)
def multi_test_of_many(spark, sf):
    d = read(spark, sf, "lineitem").select("l_quantity", "l_returnflag", "l_linestatus")
    return rounded(compare.multi_test_comparison(d, False, [("kruskal", 0, None), ("anova", 0, None)], ("chi2", 0, None), check_assumptions=True, kruskal_rules=TOLERANT), "p_value", "correlation")


@query(f"SELECT 'p_size' AS column_a, column_b, test FROM (SELECT CASE WHEN column_a = 'p_size' THEN column_b ELSE column_a END AS column_b, test FROM ({ORACLE_SQL['column_comparison']}) WHERE 'p_size' IN (column_a, column_b))")
def relationships_of_a_column(spark, sf):
    d = read(spark, sf, "part")
    found = compare.column_comparison(d, ("pearson", 0.0, None), ("kruskal", 0.05, None), ("chi2", 0.05, None), numeric_columns=["p_size", "p_retailprice"], categoric_columns=["p_brand", "p_type"])
    return preparation.oriented(found, "p_size").select("column_a", "column_b", "test")


def sql_kendall(table: str, few: str, many: str) -> str:
    """Kendall's tau of a column of few values with another: each row against the counts of each lesser value."""
    return f"""SELECT '{few}' AS numeric_a, '{many}' AS numeric_b, round(score / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 6) AS correlation FROM (
  WITH p AS MATERIALIZED (SELECT {few} AS f, {many} AS m, count(*)::DOUBLE AS n FROM {table} GROUP BY 1, 2), grid AS (SELECT v, o AS m, coalesce(p.n, 0) AS c FROM (SELECT DISTINCT f AS v FROM p) CROSS JOIN (SELECT DISTINCT m AS o FROM p) LEFT JOIN p ON p.f = v AND p.m = o),
  w AS (SELECT *, sum(c) OVER (PARTITION BY v ORDER BY m) AS upto, sum(c) OVER (PARTITION BY v) AS whole FROM grid)
  SELECT (SELECT sum(p.n * (2 * upto - c - whole)) FROM p JOIN w ON w.m = p.m AND w.v < p.f) AS score, (SELECT sum(n) FROM p) AS n, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM p GROUP BY f)) AS tx, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM p GROUP BY m)) AS ty)"""


@query(sql_kendall("lineitem", "l_quantity", "l_tax"))
def kendall_of_few_values(spark, sf):
    return rounded(numeric.correlations(read(spark, sf, "lineitem"), "kendall", ["l_quantity", "l_tax"]), "correlation")


def sql_shape(table: str, numbers: list[str], categories: list[str]) -> str:
    """(target, type, distribution) of columns, by the analyzer's defaults."""
    even = [f"SELECT '{c}' AS target, 'categoric' AS type, CASE WHEN {sql_chi2_sf('x', '(k - 1)')} < 0.05 THEN 'not_uniform' ELSE 'uniform' END AS distribution FROM (SELECT sum(n * n) / (sum(n) / count(*)) - sum(n) AS x, count(*) AS k FROM (SELECT count(*)::DOUBLE AS n FROM {table} GROUP BY {c}))" for c in categories]
    return " UNION ALL ".join([f"SELECT numeric AS target, 'numeric' AS type, CASE WHEN p_value < 0.05 THEN 'not_normal' ELSE 'normal' END AS distribution FROM ({sql_k2(table, y)})" for y in numbers] + even)


def sql_over_groups(table: str, pairs: list[tuple[str, str]]) -> str:
    """(a, b, test, passes) of numbers over categories, by the analyzer's defaults."""
    return " UNION ALL ".join(f"SELECT numeric AS a, category AS b, '{test}' AS test, p_value < 0.05 AS passes FROM ({sql(table, c, y)})" for c, y in pairs for test, sql in (("kruskal", sql_kruskal), ("anova", sql_anova)))


RANKED_TWO = "(SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ("l_quantity", "mixed")) + " FROM l)"


@query(
    f"""WITH l AS (SELECT l_quantity, l_quantity + l_discount * 100 AS mixed, l_returnflag, CASE WHEN l_quantity > 25 THEN 'high' ELSE 'low' END AS band FROM lineitem),
t AS ({sql_over_groups("l", [(c, y) for c in ("l_returnflag", "band") for y in ("l_quantity", "mixed")])} UNION ALL SELECT category_a, category_b, 'chi2', p_value < 0.05 FROM ({sql_chi2("l", "l_returnflag", "band")})
  UNION ALL SELECT numeric_a, numeric_b, 'pearson', abs(correlation) >= 0.6 FROM ({sql_pairs("l", ["l_quantity", "mixed"], "corr({a}, {b})")}) UNION ALL SELECT numeric_a, numeric_b, 'spearman', abs(correlation) >= 0.6 FROM ({sql_pairs(RANKED_TWO, ["l_quantity", "mixed"], "corr({a}, {b})")})
  UNION ALL SELECT numeric_a, numeric_b, 'kendall', abs(correlation) >= 0.6 FROM ({sql_kendall("l", "l_quantity", "mixed")})),
g AS (SELECT a, b, string_agg(test, '-' ORDER BY test) AS tests FROM t WHERE passes GROUP BY a, b)
SELECT target, type, distribution, 1 AS longest_combination, feature AS features, tests FROM (SELECT a AS target, b AS feature, tests FROM g UNION ALL SELECT b, a, tests FROM g) JOIN ({sql_shape("l", ["l_quantity", "mixed"], ["l_returnflag", "band"])}) USING (target)"""
)
def full_dataset_analysis(spark, sf):
    q = F.col("l_quantity").cast("double")
    d = read(spark, sf, "lineitem").select(q.alias("l_quantity"), (q + F.col("l_discount").cast("double") * 100).alias("mixed"), "l_returnflag", F.when(q > 25, "high").otherwise("low").alias("band"))
    return analyzer.Analyzer().fit_full_dataset_analysis(d, super_sub=True).relationships(d).withColumn("features", F.array_join("features", " & "))


SINGLE = ["one", "p_type", "two"]
PAIRED = [(a, b) for i, a in enumerate(SINGLE) for b in SINGLE[i + 1 :]]


@query(
    f"""WITH d AS (SELECT (p_size + 20 * ((p_partkey % 2 + p_partkey // 2 % 2) % 2))::DOUBLE AS shifted, (p_partkey % 2)::VARCHAR AS one, (p_partkey // 2 % 2)::VARCHAR AS two, p_type FROM part),
e AS (SELECT *, {", ".join(f"{a} || '/' || {b} AS {a}_{b}" for a, b in PAIRED)}, one || '/' || p_type || '/' || two AS triple FROM d),
t AS ({sql_over_groups("e", [(c, "shifted") for c in (*SINGLE, *(f"{a}_{b}" for a, b in PAIRED), "triple")])}),
g AS (SELECT b AS name, string_agg(test, '-' ORDER BY test) AS tests FROM t WHERE passes GROUP BY b),
s AS (SELECT name, tests FROM g WHERE name IN ({", ".join(f"'{c}'" for c in SINGLE)})),
p AS (SELECT a || ' & ' || b AS features, tests FROM g JOIN (VALUES {", ".join(f"('{a}_{b}', '{a}', '{b}')" for a, b in PAIRED)}) v(name, a, b) USING (name) WHERE a NOT IN (SELECT name FROM s) AND b NOT IN (SELECT name FROM s)),
c AS (SELECT 3 - (SELECT count(*) FROM s) AS pool, (SELECT count(*) FROM p) AS found)
SELECT target, type, distribution, CASE WHEN pool = 3 AND found = 0 THEN 3 WHEN pool >= 2 THEN 2 ELSE 1 END AS longest_combination, features, tests FROM c, ({sql_shape("d", ["shifted"], [])}), (SELECT name AS features, tests FROM s UNION ALL SELECT * FROM p UNION ALL SELECT 'one & p_type & two', tests FROM g, c WHERE name = 'triple' AND pool = 3 AND found = 0)"""
)
def multivariate_relationships(spark, sf):
    one, two = F.col("p_partkey") % 2, F.floor(F.col("p_partkey") / 2) % 2
    d = read(spark, sf, "part").select((F.col("p_size") + 20 * ((one + two) % 2)).cast("double").alias("shifted"), one.cast("string").alias("one"), two.cast("string").alias("two"), "p_type")
    return analyzer.Analyzer(numnum=False).fit_full_dataset_analysis(d, numeric_target="shifted", multivariates=True).relationships(d).withColumn("features", F.array_join("features", " & "))


@query("SELECT p_brand || '_|&|_' || p_type AS both, count(*) AS n FROM part GROUP BY 1")
def concatenated_categories(spark, sf):
    return preparation.concatenated(read(spark, sf, "part"), ["p_brand", "p_type"], name="both").groupBy("both").agg(F.count("*").alias("n"))


# Bins.


@query("WITH s AS (SELECT min(o_totalprice) - 1e-10 AS lo, max(o_totalprice) + 1e-10 AS hi FROM orders) SELECT greatest(1, least(12, ceil((o_totalprice - lo) * 12 / (hi - lo))))::INT AS bin, count(*) AS n FROM orders, s GROUP BY 1")
def equal_width_bins(spark, sf):
    return binning.bin_counts(read(spark, sf, "orders"), "o_totalprice", 12)


@query("WITH s AS (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part) SELECT p_partkey, round(lo + (greatest(1, least(6, ceil((p_size - lo + 1e-10) * 6 / (hi - lo + 2e-10)))) - 1) * (hi - lo) / 5, 3) AS \"p_size -> Binned\" FROM part, s")
def rescaled_bins(spark, sf):
    return binning.binned(read(spark, sf, "part"), "p_size", 6, True).select("p_partkey", "p_size -> Binned")


def sql_search(y: str, x: str, stat: str, least: int, good: str, rows: str, steps: int = 24) -> str:
    """A bisection for the fewest bins, its answers one after the other: each step tries the middle of what is left.

    ``stat`` selects v from b (bins of y) and x; ``good`` is a condition on v.
    """
    out = [f"WITH d AS MATERIALIZED (SELECT {y}::DOUBLE AS y, {x} AS x FROM {rows}), e AS (SELECT min(y) - 1e-10 AS lo, max(y) + 1e-10 AS hi FROM d), s0 AS (SELECT {least}::BIGINT AS low, greatest(count(*), {least})::BIGINT AS high, NULL::BIGINT AS found, NULL::BIGINT AS beyond, NULL::DOUBLE AS stat FROM d)"]
    for i in range(1, steps + 1):
        out.append(f"p{i} AS MATERIALIZED (SELECT *, (low + high) // 2 AS k FROM s{i - 1})")
        out.append(f"b{i} AS (SELECT greatest(1, least(k, ceil((y - lo) * k / (hi - lo)))) AS b, x FROM d, e, p{i} WHERE low <= high)")
        out.append(f"v{i} AS MATERIALIZED ({stat.format(rows=f'b{i}')})")
        out.append(f"s{i} AS MATERIALIZED (SELECT CASE WHEN v IS NOT NULL AND NOT ({good}) THEN k + 1 ELSE low END AS low, CASE WHEN low <= high AND v IS NULL THEN low - 1 WHEN low <= high AND {good} THEN k - 1 ELSE high END AS high, CASE WHEN low > high THEN found WHEN v IS NULL THEN NULL WHEN {good} THEN k ELSE found END AS found, CASE WHEN low <= high AND v IS NOT NULL AND NOT ({good}) THEN k ELSE beyond END AS beyond, CASE WHEN low <= high AND {good} THEN v ELSE stat END AS stat FROM p{i}, v{i})")
    return f"SELECT '{y}' AS y, '{x}' AS x, found::DOUBLE AS min_bins, beyond::DOUBLE AS beyond, round(stat, 6) AS stat FROM ({', '.join(out)} SELECT * FROM s{steps})"


SQL_CORR = "SELECT abs(corr(b, x)) AS v FROM {rows}"
SQL_RANKS = (
    "SELECT CASE WHEN k > 1 AND tied < n THEN "
    + sql_chi2_sf("h", "(k - 1)").replace("{", "{{").replace("}", "}}")
    + """ END AS v FROM (SELECT *, (12 / (n * (n + 1)) * rr - 3 * (n + 1)) / nullif(1 - ties / (n ** 3 - n), 0) AS h FROM
  (SELECT count(*) AS k, sum(r * r / gn) AS rr FROM (SELECT x, sum(rank) AS r, count(*)::DOUBLE AS gn FROM (SELECT x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rank FROM {rows}) GROUP BY x)),
  (SELECT sum(t)::DOUBLE AS n, sum(t ** 3 - t) AS ties, max(t) AS tied FROM (SELECT count(*)::DOUBLE AS t FROM {rows} GROUP BY b)))"""
)
MIXED = "(SELECT l_quantity, l_quantity + l_extendedprice / 10000 AS mixed, CASE WHEN l_quantity > 25 THEN 'high' ELSE 'low' END AS band FROM lineitem)"


@query(" UNION ALL ".join([sql_search(y, x, SQL_CORR, 2, "v >= 0.6", MIXED) for y, x in (("l_quantity", "mixed"), ("mixed", "l_quantity"))] + [sql_search(y, "band", SQL_RANKS, 1, "v < 0.05", MIXED) for y in ("l_quantity", "mixed")]))
def minimum_bins(spark, sf):
    d = read(spark, sf, "lineitem").select("l_quantity", (F.col("l_quantity") + F.col("l_extendedprice") / 10_000).alias("mixed"), F.when(F.col("l_quantity") > 25, "high").otherwise("low").alias("band"))
    found = binning.relational(d, ("pearson", 0.6, True), ("kruskal", 0.05, False))
    out = spark.createDataFrame([(y, x, s.found, s.beyond, s.stat) for y, m in found.items() for x, s in m.by_feature.items()], "y string, x string, min_bins int, beyond int, stat double")
    return rounded(out.withColumns({c: F.col(c).cast("double") for c in ("min_bins", "beyond")}), "stat")


# Estimates.

Z95 = 1.959963984540054


@query(f"SELECT o_orderpriority, count(*) AS size, min(o_totalprice) AS min, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median, max(o_totalprice) AS max, round(stddev_samp(o_totalprice), 4) AS std, round({Z95} * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS moe, round(avg(o_totalprice) - {Z95} * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS lower, round(avg(o_totalprice) + {Z95} * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS upper FROM orders GROUP BY 1")
def mean_intervals(spark, sf):
    return rounded(estimate.mean_estimates(read(spark, sf, "orders"), "o_totalprice", 0.95, "o_orderpriority"), "mean", "median", "std", "moe", "lower", "upper", digits=4)


@query(f"SELECT o_orderpriority AS label, round(avg(o_totalprice) - {Z95} * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS \"left\", round(2 * {Z95} * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS width, round(avg(o_totalprice), 4) AS middle FROM orders GROUP BY 1")
def interval_bars(spark, sf):
    return rounded(estimate.interval_bars(estimate.mean_estimates(read(spark, sf, "orders"), "o_totalprice", 0.95, "o_orderpriority"), "mean", ["o_orderpriority"]), "left", "width", "middle", digits=4)


@query(f"SELECT *, round({Z95} * sqrt(p * (1 - p) / size), 6) AS moe, round(p - {Z95} * sqrt(p * (1 - p) / size), 6) AS lower, round(p + {Z95} * sqrt(p * (1 - p) / size), 6) AS upper FROM (SELECT *, count / size AS p FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS count, (sum(count(*)) OVER (PARTITION BY o_orderstatus))::BIGINT AS size FROM orders GROUP BY 1, 2))".replace("SELECT *, round", "SELECT o_orderstatus, o_orderpriority, count, size, round(p, 6) AS proportion, round", 1))
def proportion_intervals(spark, sf):
    return rounded(estimate.proportion_estimates(read(spark, sf, "orders"), "o_orderpriority", 0.95, "o_orderstatus"), "proportion", "moe", "lower", "upper")


@query("SELECT o_orderpriority, count(*) AS count, (sum(count(*)) OVER ())::BIGINT AS size, round(count(*) / sum(count(*)) OVER (), 6) AS proportion FROM orders GROUP BY 1")
def single_proportions(spark, sf):
    return rounded(estimate.proportions(read(spark, sf, "orders"), "o_orderpriority"), "proportion")


@query("SELECT sum((l_returnflag = 'R')::INT)::BIGINT AS successes, count(*) AS n, round(avg((l_returnflag = 'R')::INT), 6) AS proportion FROM lineitem")
def one_hot_proportion(spark, sf):
    d = read(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("r"))
    return rounded(estimate.proportion_one_hot(d, "r"), "proportion")


# Probability.


@query(f"WITH m AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s FROM part) SELECT p_partkey, round(exp(-(((p_size - m) / s) ** 2) / 2) / (s * sqrt(2 * pi())), 6) AS pdf, round(0.5 * (1 + sign(p_size - m) * (1 - {sql_chi2_sf('((p_size - m) / s) ** 2', '1')})), 6) AS cdf FROM part, m")
def normal_model(spark, sf):
    d = read(spark, sf, "part")
    d = d.crossJoin(F.broadcast(probability.fit_normal(d, "p_size")))
    x = F.col("p_size").cast("double")
    return rounded(d.select("p_partkey", probability.normal_pdf(x, F.col("mean"), F.col("std")).alias("pdf"), probability.normal_cdf(x, F.col("mean"), F.col("std")).alias("cdf")), "pdf", "cdf")


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 40 THEN round(1 / 30.0, 6) ELSE 0 END::DOUBLE AS pdf, round(least(1, greatest(0, (p_size - 10) / 30.0)), 6)::DOUBLE AS cdf FROM part")
def uniform_model(spark, sf):
    x = F.col("p_size").cast("double")
    return rounded(read(spark, sf, "part").select("p_partkey", probability.uniform_pdf(x, 10, 40).alias("pdf"), probability.uniform_cdf(x, 10, 40).alias("cdf")), "pdf", "cdf")


@query("SELECT round(avg((l_discount > 0.05)::INT), 6) AS p, round(sqrt(avg((l_discount > 0.05)::INT) * (1 - avg((l_discount > 0.05)::INT))), 6) AS std FROM lineitem")
def bernoulli_model(spark, sf):
    d = read(spark, sf, "lineitem").select((F.col("l_discount") > 0.05).cast("int").alias("x"))
    return rounded(probability.fit_bernoulli(d, "x"), "p", "std")


SQL_BINOMIAL = "exp(lgamma(51.0) - lgamma(i + 1.0) - lgamma(51.0 - i) + i * ln(p_size / 51.0) + (50 - i) * ln(1 - p_size / 51.0))"


@query(f"SELECT DISTINCT p_size, round({SQL_BINOMIAL.replace('i ', 'least(p_size, 20) ').replace('- i)', '- least(p_size, 20))')}, 6) AS pmf, round(list_sum(list_transform(range(0, least(p_size, 20) + 1), lambda i: {SQL_BINOMIAL})), 6) AS cdf FROM part")
def binomial_model(spark, sf):
    k, n, p = F.least(F.col("p_size"), F.lit(20)), F.lit(50), F.col("p_size") / 51.0
    d = read(spark, sf, "part").select("p_size").distinct()
    return rounded(d.select("p_size", probability.binomial_pmf(k, n, p).alias("pmf"), probability.binomial_cdf(k, n, p).alias("cdf")), "pmf", "cdf")


@query("SELECT DISTINCT p_size, round(exp(5 * ln(p_size / 7.0) - p_size / 7.0 - lgamma(6.0)), 6) AS pmf, round(list_sum(list_transform(range(0, 6), lambda k: exp(k * ln(p_size / 7.0) - p_size / 7.0 - lgamma(k + 1.0)))), 6) AS cdf FROM part")
def poisson_model(spark, sf):
    rate = F.col("p_size") / 7.0
    d = read(spark, sf, "part").select("p_size").distinct()
    return rounded(d.select("p_size", probability.poisson_pmf(F.lit(5), rate).alias("pmf"), probability.poisson_cdf(F.lit(5), rate).alias("cdf")), "pmf", "cdf")


@query(f"SELECT CASE WHEN u < 0.125 THEN 'a' WHEN u < 0.375 THEN 'b' ELSE 'c' END AS drawn, count(*) AS n FROM (SELECT {sql_uniform(9, 'o_orderkey')} AS u FROM orders) GROUP BY 1")
def drawn_values(spark, sf):
    d = probability.sampled(read(spark, sf, "orders").select("o_orderkey"), "drawn", ["a", "b", "c"], [1, 2, 5], 9, "o_orderkey")
    return d.groupBy("drawn").agg(F.count("*").alias("n"))


# Forecasts, on orders told as purchase habits.


def habits(spark: SparkSession, sf: str) -> DataFrame:
    labels, k = F.array(*map(F.lit, forecast.DAYS)), F.col("o_orderkey")
    season = F.element_at(F.array(*map(F.lit, forecast.SEASONS)), (F.quarter("o_orderdate")))
    return read(spark, sf, "orders").select(F.element_at(labels, (k % 7 + 1).cast("int")).alias("Frequency of Purchases"), (k % 50).cast("int").alias("Previous Purchases"), season.alias("Season"), F.col("o_totalprice").alias("Purchase Amount (USD)"), k.alias("key"))


SQL_HABITS = "(SELECT list_value({labels})[(o_orderkey % 7 + 1)::INT] AS f, list_value({days})[(o_orderkey % 7 + 1)::INT] AS d, o_orderkey % 50 AS p, list_value({seasons})[quarter(o_orderdate)] AS season, o_totalprice AS a, o_orderkey AS key FROM orders)".format(labels=", ".join(f"'{x}'" for x in forecast.DAYS), days=", ".join(f"{x!r}::DOUBLE" for x in forecast.DAYS.values()), seasons=", ".join(f"'{x}'" for x in forecast.SEASONS))


@query(f"SELECT f AS frequency, round(d, 6) AS days, round(sum(d * p), 4) AS patronage FROM {SQL_HABITS} GROUP BY 1, 2")
def patronage(spark, sf):
    d = forecast.with_days(habits(spark, sf))
    return rounded(rounded(d.groupBy(F.col("`Frequency of Purchases`").alias("frequency"), F.col("days_between_purchases").alias("days")).agg(F.sum("days_of_patronage").alias("patronage")), "days"), "patronage", digits=4)


@query(f"SELECT season, count(*) AS customers, round(sum(365 / 4.0 / d), 4) AS purchases, round(sum(365 / 4.0 / d) * avg(a), 2) AS sales FROM {SQL_HABITS} GROUP BY season")
def expected_sales(spark, sf):
    return rounded(rounded(forecast.expected_sales(habits(spark, sf)), "purchases", digits=4), "sales", digits=2)


@query(f"WITH s AS (SELECT season, sum(365 / 4.0 / d) * avg(a) AS sales FROM {SQL_HABITS} GROUP BY season), o AS (SELECT *, list_position(list_value('Winter', 'Spring', 'Summer', 'Fall'), season) - 1 AS pos FROM s), p AS (SELECT (pos * 3 + i)::INT AS period, season, sales / 3 AS sales FROM o, range(1, 4) r(i)) SELECT period, season, round(sales, 2) AS sales, round(coalesce(sum(sales) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS start FROM p")
def monthly_sales(spark, sf):
    return rounded(forecast.floating(forecast.by_period(forecast.expected_sales(habits(spark, sf)), "Months")), "sales", "start", digits=2)


@query(
    f"""WITH h AS (SELECT season, 365 / 4.0 / d AS rate, avg(a) OVER (PARTITION BY season) AS mean, {sql_uniform(7, "key")} AS u FROM {SQL_HABITS}),
  w AS (SELECT *, list_transform(range(0, floor(rate * 2)::INT + 1), lambda k: exp(k * ln(rate) - rate - lgamma(k + 1.0))) AS w FROM h),
  k AS (SELECT *, least(len(w) - 1, len(list_filter(range(1, len(w) + 1), lambda i: list_sum(w[1:i]) < u * list_sum(w)))) AS k FROM w),
  s AS (SELECT season, count(*) AS customers, sum(k)::BIGINT AS purchases, sum(k * mean) AS sales FROM k GROUP BY season)
SELECT (i - 1)::INT AS at, seasons[i] AS season, coalesce(customers, 0) AS customers, coalesce(purchases, 0) AS purchases, round(coalesce(sales, 0), 2) AS sales FROM (SELECT list_value({", ".join(f"'{x}'" for x in forecast.SEASONS)}) AS seasons), range(1, 5) r(i) LEFT JOIN s ON season = seasons[i]"""
)
def simulated_sales(spark, sf):
    return rounded(forecast.in_order(forecast.simulated_sales(habits(spark, sf), seed=7, key="key")), "sales", digits=2)


@query(f"SELECT p % 5 AS former, count(*) AS size, min(a) AS min, round(avg(a), 4) AS mean, round(quantile_cont(a, 0.5), 4) AS median, max(a) AS max, round(stddev_samp(a), 4) AS std, round({Z95} * stddev_samp(a) / sqrt(count(*)), 4) AS moe FROM {SQL_HABITS} WHERE season = 'Winter' GROUP BY 1")
def mean_intervals_of_a_season(spark, sf):
    d = estimate.in_season(habits(spark, sf), "Season", "Winter").withColumn("former", F.col("`Previous Purchases`") % 5)
    found = estimate.mean_estimates(d, "Purchase Amount (USD)", 0.95, "former").drop("lower", "upper")
    return rounded(found, "mean", "median", "std", "moe", digits=4)


# Preparation.


@query("SELECT 'event_type' AS column, count(*) AS rows, count(DISTINCT event_type) AS n_unique, count(*) - count(event_type) AS n_null FROM events UNION ALL SELECT 'value', count(*), count(DISTINCT value), count(*) - count(value) FROM events UNION ALL SELECT 'ts', count(*), count(DISTINCT ts), count(*) - count(ts) FROM events")
def column_profile(spark, sf):
    return preparation.column_counts(read(spark, sf, "events"), ["event_type", "value", "ts"]).select("column", "rows", "n_unique", "n_null")


@query('SELECT "column", proposed FROM (VALUES (\'n\', \'long\'), (\'d\', \'datetime\'), (\'x\', \'double\'), (\'c\', \'category\')) t("column", proposed)')
def type_proposals(spark, sf):
    d = read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("n"), F.col("o_orderdate").cast("string").alias("d"), F.col("o_totalprice").cast("string").alias("x"), F.col("o_orderstatus").alias("c"))
    return spark.createDataFrame([(p.column, p.proposed) for p in preparation.profiles(d)], "column string, proposed string")


@query("SELECT o_orderstatus AS c, o_orderdate AS d, count(*) AS n FROM orders GROUP BY ALL")
def cleaned_table(spark, sf):
    d = read(spark, sf, "orders").select(F.col("o_orderstatus").alias("c"), F.col("o_orderdate").cast("string").alias("d"), F.lit(1).alias("same"))
    return preparation.cleaned(d).groupBy("c", "d").agg(F.count("*").alias("n"))


@query("SELECT hour(ts)::VARCHAR AS ts_hour, (minute(ts) // 30)::VARCHAR AS ts_half_hour, count(*) AS n FROM events GROUP BY ALL")
def date_parts(spark, sf):
    return preparation.date_parts(read(spark, sf, "events")).groupBy("ts_hour", "ts_half_hour").agg(F.count("*").alias("n"))


@query("SELECT coalesce(nullif(event_type, 'error'), 'NAN') AS t, count(*) AS n FROM events GROUP BY 1")
def null_categories(spark, sf):
    d = read(spark, sf, "events").select(F.nullif(F.col("event_type"), F.lit("error")).alias("t"))
    return preparation.named_nulls(d, ["t"]).groupBy("t").agg(F.count("*").alias("n"))


# Clusters.


@query()
def cluster_features(spark, sf):
    d = read(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    fitted = clustering.ClusterFeatures().fit(d, ["p_size", "p_retailprice"])
    return fitted.predict(d).groupBy(*fitted.feature_names()).agg(F.count("*").alias("n"))


#: The queries of the benchmark.
HEADLINE = ("chi2_independence_all", "contingency_table", "anova_all", "kruskal_all", "two_way_anova", "spearman_all_pairs", "pearson_all_pairs", "levene", "ks_statistics", "conditional_entropy", "mean_intervals", "equal_width_bins", "column_profile", "minimum_bins")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether return flag and line status of a line item depend on one another."""
    return chi2.independence(read(spark, sf_dir, "lineitem"), [("l_returnflag", "l_linestatus")])


