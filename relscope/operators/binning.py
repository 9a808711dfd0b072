"""Equal-width bins, and the fewest bins that keep a relationship.

All searches advance together on a table that is made once: each pair's distinct values of y in order, with counts and
sums per value and level.  A round tries, for every pending pair, the next few numbers of bins that its
bisection may ask for, in one job that reads the table and returns sums; a search over many pairs takes about
log2(rows) / ``AHEAD`` jobs.  Only tests of both columns' ranks go back to the (y, x) points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import roles
from . import anova, numeric, ranks

PAD = 1e-10
#: Answers of a bisection that one job prepares for: it tests 2 ** AHEAD - 1 numbers of bins.
AHEAD, AHEAD_OF_POINTS = 5, 2


def bin_number(v: Column, low: Column, high: Column, bins: Column) -> Column:
    """1 to ``bins``: equal widths on [low - 1e-10, high + 1e-10], closed on the right; null stays null."""
    lo, hi = low - PAD, high + PAD
    at = F.ceil((v - lo) * bins / F.nullif(hi - lo, F.lit(0.0)))
    return F.when(v.isNotNull(), F.greatest(F.lit(1), F.least(bins, F.coalesce(at, F.lit(1)))).cast("int"))


def rescaled(number: Column, low: Column, high: Column, bins: Column) -> Column:
    """Bin numbers on the scale of the values: 1 at the lowest, ``bins`` at the highest."""
    return F.when(bins == 1, number.cast("double")).otherwise(low + (number - 1) * (high - low) / F.nullif(bins - 1, F.lit(0)))


def binned(df: DataFrame, column: str, bins: int, rescale: bool = False, name: str | None = None) -> DataFrame:
    """Adds ``name``, by default '<column> -> Binned' rounded to 3 places when rescaled."""
    v = roles.number(df, column)
    edges = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    out = df.crossJoin(F.broadcast(edges))
    number = bin_number(v, F.col("_lo"), F.col("_hi"), F.lit(bins))
    value = F.round(rescaled(number, F.col("_lo"), F.col("_hi"), F.lit(bins)), 3) if rescale else number
    return out.withColumn(name or f"{column} -> Binned", value).drop("_lo", "_hi")


def edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """The ``bins`` + 1 edges."""
    v = roles.number(df, column)
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    if lo is None:
        return []
    return [lo - PAD + k * (hi - lo + 2 * PAD) / bins for k in range(bins + 1)]


@dataclass
class Search:
    """One (y, x) pair's bisection over the number of bins of y."""

    y: str
    x: str
    low: int
    high: int
    found: int | None = None
    beyond: int | None = None
    stat: float | None = None
    failed: bool = False

    @property
    def open(self) -> bool:
        return not self.failed and self.low <= self.high

    @property
    def probe(self) -> int:
        return (self.low + self.high) // 2

    def probes(self, ahead: int) -> list[int]:
        """Numbers of bins that the next answers may ask for."""
        out, spans = [], [(self.low, self.high)]
        for _ in range(ahead):
            spans = [(a, b) for a, b in spans if a <= b]
            out += [(a + b) // 2 for a, b in spans]
            spans = [x for a, b in spans for x in ((a, (a + b) // 2 - 1), ((a + b) // 2 + 1, b))]
        return out

    def answer(self, stat: float | None, good: bool) -> None:
        if stat is None:
            self.failed, self.found = True, None
        elif good:
            self.found, self.stat, self.high = self.probe, stat, self.probe - 1
        else:
            self.beyond, self.low = self.probe, self.probe + 1


@dataclass
class Minimum:
    """Fewest bins of y: the largest over its features, and per feature."""

    bins: int | None = None
    by_feature: dict[str, Search] = field(default_factory=dict)


NUMERIC_TESTS = ("welch", "student", "pearson", "spearman", "kendall")
#: Tests of both columns' ranks, which need the points themselves.
POINT_TESTS = ("spearman", "kendall")


def _rows(df: DataFrame, pairs: list[tuple[str, str]], method: str) -> DataFrame:
    """(pair, level, x, y) of each pair's complete rows, by its number; the t tests take both columns' rows as they are."""
    each = []
    for i, (y, x) in enumerate(pairs):
        number = roles.number(df, x) if method in NUMERIC_TESTS else F.lit(None).cast("double")
        level = roles.level(x) if method not in NUMERIC_TESTS else F.lit("")
        each.append(F.struct(F.lit(i).alias("pair"), level.alias("level"), number.alias("x"), roles.number(df, y).cast("double").alias("y")))
    rows = df.select(F.explode(F.array(*each)).alias("p")).select("p.*").where("level IS NOT NULL AND y IS NOT NULL")
    return rows.where("x IS NOT NULL") if method in ("pearson", *POINT_TESTS) else rows


def _limits(df: DataFrame, rows: DataFrame, pairs: list[tuple[str, str]], method: str) -> dict[int, dict]:
    """Per pair: the limits of y over all rows; for numbers the count, mean and variances of x."""
    names = list(dict.fromkeys(y for y, _ in pairs))
    one = df.agg(*(f(roles.number(df, y)).alias(f"{k}{i}") for i, y in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max)))).first()
    moments = {"n": F.count, "mean": F.avg, "pop": F.var_pop, "samp": F.var_samp}
    if method in ("welch", "student"):
        own = df.agg(*(f(roles.number(df, x)).alias(f"{k}{i}") for i, (_, x) in enumerate(pairs) for k, f in moments.items())).first()
        about = {i: {k: own[f"{k}{i}"] for k in moments} for i in range(len(pairs))}
    elif method in NUMERIC_TESTS:
        about = {r["pair"]: r.asDict() for r in rows.groupBy("pair").agg(*(f("x").alias(k) for k, f in moments.items())).collect()}
    else:
        about = {i: {} for i in range(len(pairs))}
    limits = {i: (one[f"lo{names.index(y)}"], one[f"hi{names.index(y)}"]) for i, (y, _) in enumerate(pairs)}
    return {i: {"lo": float(lo), "hi": float(hi), **about[i]} for i, (lo, hi) in limits.items() if lo is not None and i in about}


@dataclass
class Table:
    """Each pair's distinct values of y in order, in ranges, with what its test adds up at each.

    A range is one row with arrays: the values, and per value and level a count and the sum of x less its
    mean.  ``before`` has the pair's rows in lower ranges.  A probe reads the arrays alone.
    """

    ranges: DataFrame
    before: dict[tuple[int, float], float]
    #: Made once, as tails are long expressions.
    tail: Column | None = None

    @classmethod
    def of(cls, rows: DataFrame, limits: dict[int, dict]) -> Table:
        splits = ranks.splitters(rows, "y")
        mean = F.element_at(F.create_map(*(F.lit(v) for i, m in limits.items() for v in (i, float(m.get("mean") or 0.0)))), F.col("pair"))
        away = F.coalesce(F.sum(F.col("x") - mean), F.lit(0.0))
        cells = rows.where(F.col("pair").isin(list(limits))).groupBy("pair", "level", "y").agg(F.count("*").cast("double").alias("n"), away.alias("sx"))
        cells = ranks.with_range(cells, "y", splits)
        packed = cells.groupBy("pair", "_range").applyInArrow(_packed, PACKED_DDL)
        packed = packed.persist(StorageLevel.MEMORY_AND_DISK)
        before, now = {}, {}
        for r in packed.select("pair", "_range", "rows").orderBy("pair", "_range").collect():
            before[r["pair"], r["_range"]] = now.get(r["pair"], 0.0)
            now[r["pair"]] = now.get(r["pair"], 0.0) + r["rows"]
        return cls(packed, before)

    def probe(self, asked: dict[int, tuple[float, float, list[int]]], ranked: bool) -> DataFrame:
        """Sums of each pair's numbers of bins: (pair, bins, level) with moments of bin numbers, or with rank sums and ties."""
        before = self.before
        found = self.ranges.mapInArrow(_probing(asked, before, ranked), PROBED_DDL)
        if not ranked:
            sums = (F.min if c == "least" else F.max if c == "largest" else F.sum for c in MOMENTS)
            return found.groupBy("pair", "bins", "level").agg(*(f(c).alias(c) for f, c in zip(sums, MOMENTS, strict=True)))
        # A bin at the edge of a range may go on in the next; those inside a range are done.  One shuffle serves all that follows.
        s = found.repartition("pair", "bins").groupBy("pair", "bins", "bin", "level").agg(F.sum("n").alias("gn"), F.min("start").alias("start"), F.sum("r").alias("r"), F.sum("ties").alias("ties"), F.max("tied").alias("tied"))
        own, edge = Window.partitionBy("pair", "bins", "bin"), F.col("bin").isNotNull()
        s = s.withColumn("whole", F.sum("gn").over(own)).withColumn("start", F.min("start").over(own))
        rank, ties = F.col("start") + (F.col("whole") + 1) / 2, F.col("gn") * (F.col("whole") ** 2 - 1)
        s = s.select("pair", "bins", "level", "gn", *(F.when(edge, e).otherwise(F.col(c)).alias(c) for c, e in (("r", F.col("gn") * rank), ("ties", ties), ("tied", F.col("whole")))))
        return s.groupBy("pair", "bins", "level").agg(F.sum("gn").alias("gn"), F.sum("r").alias("r"), F.sum("ties").alias("ties"), F.max("tied").alias("tied"))


MOMENTS = ("n", "s1", "s2", "sx", "least", "largest")
SUMS = (*MOMENTS, "r", "ties", "tied", "start")
PACKED = pa.schema([("pair", pa.int32()), ("_range", pa.float64()), ("rows", pa.float64()), ("y", pa.list_(pa.float64())), ("place", pa.list_(pa.int32())), ("levels", pa.list_(pa.string())), ("level", pa.list_(pa.int32())), ("n", pa.list_(pa.float64())), ("sx", pa.list_(pa.float64()))])
PACKED_DDL = "pair int, _range double, rows double, y array<double>, place array<int>, levels array<string>, level array<int>, n array<double>, sx array<double>"
PROBED = pa.schema([("pair", pa.int32()), ("bins", pa.int32()), ("level", pa.string()), ("bin", pa.int32()), *((c, pa.float64()) for c in SUMS)])
PROBED_DDL = "pair int, bins int, level string, bin int, " + ", ".join(f"{c} double" for c in SUMS)


def _packed(t: pa.Table) -> pa.Table:
    t = t.sort_by("y").combine_chunks()
    values, place = np.unique(t["y"].to_numpy(), return_inverse=True)
    named = t["level"].combine_chunks().dictionary_encode()
    n = t["n"].to_numpy()
    row = {"pair": [t["pair"][0].as_py()], "_range": [t["_range"][0].as_py()], "rows": [float(n.sum())], "y": [values], "place": [place], "levels": [named.dictionary.to_pylist()], "level": [named.indices.to_numpy()], "n": [n], "sx": [t["sx"].to_numpy()]}
    return pa.table([pa.array(row[f.name], f.type) for f in PACKED], schema=PACKED)


def bin_numbers(y: np.ndarray, low: float, high: float, bins: int) -> np.ndarray:
    """:func:`bin_number` of an array."""
    lo, hi = low - PAD, high + PAD
    at = np.ceil((y - lo) * bins / (hi - lo)) if hi > lo else np.ones(len(y))
    return np.clip(np.nan_to_num(at, nan=1.0), 1, bins).astype(np.int64)


class _Found:
    """Rows of a probe, gathered by column."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def add(self, pair: int, bins: int, levels: np.ndarray, number: int | None, sums: dict) -> None:
        self.rows.append({"pair": pair, "bins": bins, "level": levels, "bin": number, **sums})

    def batch(self) -> pa.RecordBatch:
        columns = []
        for f in PROBED:
            each = [np.full(len(r["level"]), np.nan if r.get(f.name) is None else r[f.name], object if f.name == "level" else float) if np.ndim(r.get(f.name)) == 0 else r[f.name] for r in self.rows]
            whole = np.concatenate(each) if each else np.zeros(0)
            columns.append(pa.array(whole.tolist(), f.type) if f.name == "level" else pa.array(whole, mask=np.isnan(whole)).cast(f.type))
        return pa.RecordBatch.from_arrays(columns, schema=PROBED)


def _probing(asked: dict, before: dict, ranked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                pair, number = batch["pair"][at].as_py(), batch["_range"][at].as_py()
                if pair in asked:
                    arrays = [batch[c][at].values.to_numpy(zero_copy_only=False) for c in ("y", "place", "level", "n", "sx")]
                    found = _Found()
                    _probed(found, pair, before[pair, number], np.array(batch["levels"][at].as_py(), object), *arrays, *asked[pair], ranked)
                    yield found.batch()

    return run


def _probed(found: _Found, pair: int, below: float, levels: np.ndarray, y: np.ndarray, place: np.ndarray, level: np.ndarray, n: np.ndarray, sx: np.ndarray, low: float, high: float, probes: list[int], ranked: bool) -> None:
    k = len(levels)
    count = np.bincount(level, n, k)
    for bins in probes:
        number = bin_numbers(y, low, high, bins)
        if not ranked:
            c = (number - (bins + 1) // 2)[place].astype(float)
            least, largest = np.full(k, np.inf), np.full(k, -np.inf)
            np.minimum.at(least, level, c)
            np.maximum.at(largest, level, c)
            found.add(pair, bins, levels, None, {"n": count, "s1": np.bincount(level, n * c, k), "s2": np.bincount(level, n * c * c, k), "sx": np.bincount(level, sx * c, k), "least": least, "largest": largest})
            continue
        own, at = np.unique(number, return_inverse=True)
        at = at[place]
        tied = np.bincount(at, n, len(own))
        start = below + np.cumsum(tied) - tied
        inner = (at > 0) & (at < len(own) - 1)
        if inner.any():
            each, w, t, s = level[inner], n[inner], tied[at[inner]], start[at[inner]]
            most = np.zeros(k)
            np.maximum.at(most, each, t)
            rows = np.bincount(each, w, k)
            some = np.flatnonzero(rows)
            sums = {"n": rows, "r": np.bincount(each, w * (s + (t + 1) / 2), k), "ties": np.bincount(each, w * (t * t - 1), k), "tied": most}
            found.add(pair, bins, levels[some], None, {c: v[some] for c, v in sums.items()})
        for e in sorted({0, len(own) - 1}):
            w = np.bincount(level[at == e], n[at == e], k)
            some = np.flatnonzero(w)
            found.add(pair, bins, levels[some], int(own[e]), {"n": w[some], "start": start[e]})


def _of_table(table: Table, limits: dict[int, dict], asked: dict, method: str) -> DataFrame:
    """(pair, bins, stat) from a probe of the table.

    Bin values are linear in bin numbers, so moments are those of numbers less the middle one, which are whole.
    """
    by = ["pair", "bins"]
    if method == "kruskal":
        table.tail = anova.kruskal_tail() if table.tail is None else table.tail
        return anova.kruskal_of_sums(table.probe(asked, True), by, table.tail).select(*by, F.col("p_value").alias("stat"))
    known = [(i, *(float(m[k]) if m.get(k) is not None else None for k in ("lo", "hi", "n", "mean", "pop", "samp"))) for i, m in limits.items()]
    known = table.ranges.sparkSession.createDataFrame(known, "pair int, lo double, hi double, nx double, mx double, px double, vx double")
    s = table.probe(asked, False).join(F.broadcast(known), "pair")
    step = F.when(F.col("bins") == 1, F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")) / F.nullif(F.col("bins") - 1, F.lit(0)))
    mean = F.col("s1") / F.col("n")
    spread = F.when(F.col("least") < F.col("largest"), F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean)).otherwise(0.0)
    middle = F.floor((F.col("bins") + 1) / 2)
    value = F.when(F.col("bins") == 1, F.lit(1.0)).otherwise(F.col("lo") + (mean + middle - 1) * step)
    if method == "pearson":
        return s.select(*by, F.when((F.col("px") > 0) & (spread > 0), F.col("sx") / F.col("n") / F.nullif(F.sqrt("px") * F.sqrt(spread), F.lit(0.0))).alias("stat"))
    if method in ("welch", "student"):
        s = s.withColumn("my", value).withColumn("vy", F.when(F.col("n") > 1, spread * step * step * F.col("n") / F.nullif(F.col("n") - 1, F.lit(0.0))))
        test = anova.welch if method == "welch" else anova.student
        return test(s, "n", "my", "vy", "nx", "mx", "vx").select(*by, F.col("p_value").alias("stat"))
    groups = s.select(*by, F.col("n").alias("gn"), value.alias("mean"), (spread * step * step).alias("var"))
    return anova.one_way_of_groups(groups, by).select(*by, F.col("p_value").alias("stat"))


def _of_points(points: DataFrame, limits: dict[int, dict], asked: dict, method: str) -> DataFrame:
    """(pair, bins, stat) of tests of both columns' ranks, from the points."""
    probes = [(i, k, lo, hi) for i, (lo, hi, bins) in asked.items() for k in bins]
    rows = points.join(F.broadcast(points.sparkSession.createDataFrame(probes, "pair int, bins int, lo double, hi double")), "pair")
    number = bin_number(F.col("y"), F.col("lo"), F.col("hi"), F.col("bins"))
    rows = rows.withColumn("y", rescaled(number, F.col("lo"), F.col("hi"), F.col("bins")))
    named = rows.select(F.col("pair").cast("string").alias("a"), F.col("bins").cast("string").alias("b"), "x", "y", "w")
    kind = {"spearman": numeric._spearman, "kendall": numeric._kendall}[method]
    return kind(named, "w").select(F.col("a").cast("int").alias("pair"), F.col("b").cast("int").alias("bins"), F.col("correlation").alias("stat"))


def find_minimums(df: DataFrame, pairs: list[tuple[str, str]], method: str, threshold: float, keep_above: bool) -> dict[str, Minimum]:
    """Fewest bins of each y over 1 to the number of rows, for (y, x) pairs.

    Correlations start at 2 bins.  An undefined statistic ends a pair's search without a
    result.  The number of jobs follows the logarithm of the rows and not the pairs.
    """
    n = df.count()
    least = 2 if method in ("pearson", "spearman", "kendall") else 1
    searches = [Search(y, x, least, max(n, least)) for y, x in pairs]
    rows = _rows(df, pairs, method)
    limits = _limits(df, rows, pairs, method)
    if not limits:
        return {y: Minimum(None, {x: s for s in searches for x in [s.x] if s.y == y}) for y, _ in pairs}
    table = rows.groupBy("pair", "x", "y").agg(F.count("*").alias("w")).persist(StorageLevel.MEMORY_AND_DISK) if method in POINT_TESTS else Table.of(rows, limits)
    sign = abs if method in ("pearson", "spearman", "kendall") else float
    ahead = AHEAD_OF_POINTS if method in POINT_TESTS else AHEAD
    try:
        while pending := [(i, s) for i, s in enumerate(searches) if s.open]:
            asked = {i: (limits[i]["lo"], limits[i]["hi"], s.probes(ahead)) for i, s in pending if i in limits}
            found = (_of_points if method in POINT_TESTS else _of_table)(table, limits, asked, method).collect() if asked else []
            stats = {(r["pair"], r["bins"]): None if r["stat"] is None else sign(r["stat"]) for r in found}
            for i, s in pending:
                for _ in range(ahead):
                    if s.open:
                        stat = stats.get((i, s.probe))
                        s.answer(stat, stat is not None and (stat >= threshold if keep_above else stat < threshold))
    finally:
        (table if method in POINT_TESTS else table.ranges).unpersist()
    out: dict[str, Minimum] = {}
    for s in searches:
        m = out.setdefault(s.y, Minimum())
        m.by_feature[s.x] = s
        if s.found is not None:
            m.bins = max(m.bins or 0, s.found)
    return out


def relational(df: DataFrame, numnum: tuple = ("welch", 0.05, False), numcat: tuple = ("kruskal", 0.05, False), distinct_threshold: int = 5, numeric_columns: roles.Names = None, categoric_columns: roles.Names = None, numeric_target: roles.Names = None, categoric_target: roles.Names = None) -> dict[str, Minimum]:
    """Fewest bins of every number with more than ``distinct_threshold`` values that keep its significant relationships."""
    for t in (numnum, numcat):
        if len(t) != 3 or not isinstance(t[2], bool):
            raise ValueError("an instruction is (method, threshold, keep_above), the last a bool")
    from ..plans import compare

    found = compare.related_pairs(df, numnum, numcat, numeric_columns, categoric_columns, numeric_target, categoric_target)
    n = {}
    names = sorted({y for y, _ in [*found["numnum"], *found["numcat"]]})
    if names:
        n = df.agg(*(F.count_distinct(F.col(c)).alias(c) for c in names)).first().asDict()
    out: dict[str, Minimum] = {}
    for family, (method, threshold, above) in (("numnum", numnum), ("numcat", numcat)):
        pairs = [(y, x) for y, x in found[family] if n[y] > distinct_threshold]
        if pairs:
            for y, m in find_minimums(df, pairs, method, threshold, above).items():
                own = out.setdefault(y, Minimum())
                own.by_feature |= m.by_feature
                own.bins = max((b for b in (own.bins, m.bins) if b is not None), default=None)
    return out


def bin_counts(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n)."""
    return binned(df, column, bins, name="bin").where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))


