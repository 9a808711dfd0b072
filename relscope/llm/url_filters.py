"""URL filters: rules by host and path, and link-graph propagation for the rest.

Pages that an allow rule fits seed trust, those that a block rule fits seed distrust, each
with a total of 1.  Trust follows the links between hosts and distrust runs against them,
both as personalised PageRank; a host without links keeps its mass.  Rounds go on until
what is left to deliver can't change the ranks by more than ``TOLERANCE`` in all.  Where
no rule fits, a page is blocked if distrust makes up more than ``THRESHOLD`` of its host's
trust and distrust, however many pages the host has.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graphs, runtime

#: The rules, as host and path.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-3, 0.5
#: Two vectors of total 1 differ by 2 at most, and each round brings them nearer by the damping.
ROUNDS = math.ceil(math.log(TOLERANCE / 2) / math.log(DAMPING))
#: Rounds between stored tables.
STEP = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of an absolute link in html.
LINK = r"""[hH][rR][eE][fF]\s*=\s*["']?(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"'\s>]+)"""


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        own, _, start = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, share): a host's links to other hosts, in shares of its own."""
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("to"))
    links = links.select(F.col("host").alias("src"), F.translate("to", UPPER, LOWER).alias("dst")).where("src <> dst AND src <> ''")
    counts = runtime.stored(links.groupBy("src", "dst").agg(F.count("*").alias("n")))
    out = counts.groupBy("src").agg(F.sum("n").alias("all"))
    return counts.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"), "n")


def propagated(hosts: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from seeds (host, good, bad), numbers of pages."""
    back = edges.groupBy(F.col("dst").alias("src")).agg(F.sum("n").alias("all"))
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n").join(back, "src").select("src", "dst", F.lit(0.0).alias("forth"), (F.col("n") / F.col("all")).alias("back"))
    moves = edges.select("src", "dst", F.col("share").alias("forth"), F.lit(0.0).alias("back")).unionByName(reverse)
    nodes = runtime.stored(hosts.select("host", "good", "bad").unionByName(edges.select(F.col("dst").alias("host"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("bad"))).groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    # A host without links in a direction keeps what would follow it.
    ends = nodes.join(edges.select(F.col("src").alias("host")).distinct().withColumn("o", F.lit(1)), "host", "left").join(edges.select(F.col("dst").alias("host")).distinct().withColumn("i", F.lit(1)), "host", "left")
    stay = ends.select(F.col("host").alias("src"), F.col("host").alias("dst"), F.when(F.col("o").isNull(), 1.0).otherwise(0.0).alias("forth"), F.when(F.col("i").isNull(), 1.0).otherwise(0.0).alias("back"))
    # A host with very many links is split over parts.
    moves, hot = graphs.parts(runtime.stored(moves.unionByName(stay.where("forth > 0 OR back > 0"))), "src", "dst")
    moves = runtime.stored(moves)
    good, bad = nodes.agg(F.sum("good"), F.sum("bad")).first() or (None, None)
    nodes = runtime.stored(nodes.select("host", (F.col("good") / F.lit(float(good or 1))).alias("good"), (F.col("bad") / F.lit(float(bad or 1))).alias("bad")))
    ranks = nodes.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    split = hot.count() > 0
    held = None
    for number in range(1, rounds + 1):
        own = ranks.withColumnRenamed("host", "src")
        if split:
            own = own.join(hot, "src", "left").withColumn("part", F.explode(F.expr("sequence(0L, coalesce(parts, 1L) - 1L)"))).drop("parts")
        sent = moves.join(own, ["src", "part"] if split else "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("trust") * F.col("forth")).alias("t"), F.sum(F.col("distrust") * F.col("back")).alias("d"))
        new = nodes.join(sent, "host", "left")
        ranks = new.select("host", (F.lit(1 - DAMPING) * F.col("good") + F.lit(DAMPING) * F.coalesce("t", F.lit(0.0))).alias("trust"), (F.lit(1 - DAMPING) * F.col("bad") + F.lit(DAMPING) * F.coalesce("d", F.lit(0.0))).alias("distrust"))
        if number % STEP == 0 or number == rounds:
            ranks = runtime.stored(ranks)
            if held is not None:
                runtime.released(held)
            held = ranks
    return ranks


def judged(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is
    allowed, as no link leads to the empty host.  A null html has no links.
    A null page_id stays null; repeated rows give repeated results and count as often; an
    empty table gives none.  Other columns are not read.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    kind = F.coalesce(*(F.when(F.col("rule") == r, v) for r, v in rules.items()))
    seeds = rows.withColumn("kind", kind).groupBy("host").agg(F.count_if(F.col("kind") == "allow").alias("good"), F.count_if(F.col("kind") == "block").alias("bad"))
    seeds = runtime.stored(seeds)
    edges = runtime.stored(host_edges(pages.select(host_of(url).alias("host"), "html")))
    ranks = propagated(seeds, edges)
    mass = F.col("trust") + F.col("distrust")
    risk = F.when(mass > 0, F.round(F.col("distrust") / mass, 9)).otherwise(0.0)
    hosts = runtime.stored(ranks.select("host", F.when(risk > THRESHOLD, "block").otherwise("allow").alias("_host")))
    # A host with very many pages, such as the empty one of null urls, is split over parts.
    return graphs.lookup(rows, hosts, "host", "page_id").select("page_id", "host", "path", "rule", F.coalesce(kind, "_host").alias("verdict"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(runtime.read(spark, sf_dir, "pages"))


def oracle(rules: dict[str, str] = RULES, rounds: int = ROUNDS) -> str:
    """The same in SQL, its rounds unrolled."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        own, _, start = rule.partition("/")
        fits.append(f"WHEN (host = '{own}' OR host LIKE '%.{own}') AND path LIKE '/{start}%' THEN '{rule}'")
    kind = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in rules.items())
    link = LINK.replace("'", "''")
    text = f"""
WITH a AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS u FROM pages),
b AS (SELECT page_id, html, translate(coalesce(regexp_extract(u, '^([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(u, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
c AS (SELECT page_id, html, host, path, CASE {" ".join(fits)} END AS rule FROM b),
rows_ AS (SELECT page_id, html, host, path, rule, CASE {kind} END AS kind FROM c),
seeds AS (SELECT host, count(*) FILTER (kind = 'allow') AS good, count(*) FILTER (kind = 'block') AS bad FROM rows_ GROUP BY host),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM rows_),
counts AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst AND src <> '' GROUP BY src, dst),
totals AS (SELECT host, sum(good) AS good, sum(bad) AS bad FROM (SELECT host, good, bad FROM seeds UNION ALL SELECT dst, 0, 0 FROM counts) GROUP BY host),
nodes AS MATERIALIZED (SELECT host, good / greatest(1, sum(good) OVER ())::DOUBLE AS good, bad / greatest(1, sum(bad) OVER ())::DOUBLE AS bad FROM totals),
moves AS MATERIALIZED (
  SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS forth, 0.0 AS back FROM counts
  UNION ALL SELECT dst, src, 0.0, n / sum(n) OVER (PARTITION BY dst) FROM counts
  UNION ALL SELECT host, host, CASE WHEN host IN (SELECT src FROM counts) THEN 0.0 ELSE 1.0 END, CASE WHEN host IN (SELECT dst FROM counts) THEN 0.0 ELSE 1.0 END FROM nodes),
r0 AS (SELECT host, good AS trust, bad AS distrust FROM nodes)"""
    for k in range(1, rounds + 1):
        text += f""",
r{k} AS MATERIALIZED (SELECT host, {1 - DAMPING} * any_value(good) + {DAMPING} * coalesce(sum(t), 0) AS trust, {1 - DAMPING} * any_value(bad) + {DAMPING} * coalesce(sum(d), 0) AS distrust
  FROM nodes LEFT JOIN (SELECT dst AS host, trust * forth AS t, distrust * back AS d FROM moves JOIN r{k - 1} ON src = host) USING (host) GROUP BY host)"""
    return (
        text
        + f"""
SELECT page_id, host, path, rule, CASE WHEN kind IS NOT NULL THEN kind WHEN trust + distrust > 0 AND round(distrust / (trust + distrust), 9) > {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict
FROM rows_ JOIN r{rounds} USING (host)"""
    )
