"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order, by angle.  The index is a stored
table of inverted files: for each pivot and each shard of vectors, the vectors that have
the pivot among theirs, with its rank.  A query is posted under its own pivots; queries and
inverted files meet by pivot, and each candidate's footrule distance to the query adds up
from the ranks of the pivots they share (one that is missing counts as one rank past the
last).  The candidates nearest by that distance are scored exactly.

Where norms differ, a product is a cosine times a norm.  The footrule distance tells the cosine to expect, by a fit on
a sample; what a candidate's cosine must be to reach the products of true neighbours, a mean over
a few queries compared with all rows, falls with its norm.  Candidates rank by the difference.

The number of pivots grows with the square root of the number of rows, so inverted files
and what a query reads grow with the root too; ranks and exact scores grow with the root of the dimensions.  Half of
the pivots are chosen farthest first, so that a dense group doesn't use them up, and half at random, so that a dense
group has its share and its members have orders of their own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime, vectors

#: Ranks that are posted; pivots, and candidates that are scored exactly, by the root of the number of rows.  Ranks and candidates
#: are for LOW dimensions or fewer, and grow with the root of more.
RANKS, PIVOTS, FIRST, LOW = 48, 18, 30, 64
#: Beyond some 50,000 rows candidates grow with a higher power, as roots of rows lose some neighbours.
LATER, POWER = 1.16, 0.8
#: Queries compared with all rows and rows compared with them, where norms differ by more than EVEN.
KNOWN, FITTED, EVEN = 64, 2048, 1e-3
#: Pivots at most: the driver chooses them among twice as many rows.  With more rows than this allows for, files grow longer.
MOST = 16_384
#: Rows of a shard of vectors, queries of a block at least, and queries that share one copy of a pivot's files.
SHARD, BLOCK, SHARING = 16_384, 1024, 256

FILES = pa.schema([("pivot", pa.int32()), ("shard", pa.int32()), ("counts", pa.binary()), ("rows", pa.binary()), ("sizes", pa.binary())])
FILES_DDL = "pivot int, shard int, counts binary, rows binary, sizes binary"
NEAR = pa.schema([("shard", pa.int32()), ("query_id", pa.int64()), ("rows", pa.binary())])
NEAR_DDL = "shard int, query_id long, rows binary"
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
FOUND_DDL = "query_id long, vec_id long, score double"


def unit(rows: np.ndarray) -> np.ndarray:
    return vectors.unit(rows).astype(np.float32)


@dataclass(frozen=True)
class Norms:
    """Norms between two limits in steps of a byte, and how a candidate ranks by gain and norm; ``fit`` is none where norms are even."""

    low: float
    high: float
    fit: tuple[float, float, float] | None = None
    reach: float = 0.0

    def codes(self, rows: np.ndarray) -> np.ndarray:
        size = np.log(np.maximum(np.linalg.norm(rows.astype(np.float64), axis=1), 1e-300) / self.low)
        return np.clip(np.rint(255 * size / math.log(self.high / self.low)), 0, 255).astype(np.uint8)

    def order(self, gain: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Expected cosine less the one that is needed; ``gain`` is footrule distance from the farthest."""
        a, b, c = self.fit
        return a + b * gain + c * np.sqrt(gain) - self.reach / (self.low * (self.high / self.low) ** (codes / 255))


def gains(one: np.ndarray, many: np.ndarray, pivots: int) -> np.ndarray:
    """How much nearer than with no common pivot an order of pivots is to each of ``many``, in half footrule distances."""
    ranks = many.shape[1]
    place = np.full(pivots, -1)
    place[one] = np.arange(ranks)
    own = place[many]
    return np.where(own >= 0, ranks - np.maximum(own, np.arange(ranks)), 0).sum(axis=1)


def fitted(rows: np.ndarray, pivots: np.ndarray, ranks: int) -> tuple[float, float, float]:
    """Cosine by gain, as a, b, c of a + b * gain + c * root of gain, over pairs of sample rows; never falling."""
    some = unit(rows[:FITTED])
    order = nearest_pivots(some, pivots, ranks)
    few = min(KNOWN, len(some))
    gain = np.concatenate([gains(order[i], np.delete(order, i, axis=0), len(pivots)) for i in range(few)]).astype(float)
    cosine = np.concatenate([np.delete(some @ some[i], i) for i in range(few)]).astype(float)
    for columns in ((gain, np.sqrt(gain)), (gain, 0 * gain)):
        a, b, c = np.linalg.lstsq(np.stack([np.ones_like(gain), *columns], axis=1), cosine, rcond=None)[0] if len(gain) else (0.0, 1.0, 0.0)
        top = ranks * (ranks + 1) / 2
        if b + c / 2 >= 0 and b + c / (2 * math.sqrt(top)) >= 0:
            return float(a), float(b), float(c)
    return 0.0, 1.0, 0.0


def chosen_pivots(rows: np.ndarray, count: int) -> np.ndarray:
    """Half of ``count`` farthest first: again and again the row least near to those chosen; the others as they come."""
    chosen, near = [0], rows @ rows[0]
    while len(chosen) < min(-(-count // 2), len(rows)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    chosen = list(dict.fromkeys(chosen))
    rest = np.setdiff1d(np.arange(len(rows)), chosen)
    return rows[np.concatenate([chosen, rest[: max(0, count - len(chosen))]]).astype(int)]


def nearest_pivots(rows: np.ndarray, pivots: np.ndarray, ranks: int) -> np.ndarray:
    """Numbers of the nearest pivots in order, one row each."""
    out = []
    for at in range(0, len(rows), 512):
        products = rows[at : at + 512] @ pivots.T
        some = np.argpartition(-products, ranks - 1, axis=1)[:, :ranks] if ranks < len(pivots) else np.broadcast_to(np.arange(ranks), (len(products), ranks))
        order = np.argsort(-np.take_along_axis(products, some, axis=1), axis=1, kind="stable")
        out.append(np.take_along_axis(some, order, axis=1))
    return np.concatenate(out) if out else np.zeros((0, ranks), np.int64)


def _inverted(pivots: np.ndarray, ranks: int, norms: Norms, dim: int):
    """A shard's vectors, in order of vec_id, to its inverted files.

    A file has its vectors' places in the shard, by rank, the number of them per rank, and their norms where these differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), own in runtime.groups(batches, "shard"):
            rows = np.concatenate([vectors.matrix(b["embedding"], dim) for b in own])
            order, codes = nearest_pivots(unit(rows), pivots, ranks), norms.codes(rows) if norms.fit else None
            place = np.dtype("<u2" if len(order) < 1 << 16 else "<u4")
            flat = order.T.ravel()
            by = np.argsort(flat, kind="stable")
            edges = np.searchsorted(flat[by], np.arange(len(pivots) + 1))
            found = []
            for pivot in np.flatnonzero(np.diff(edges)).tolist():
                some = by[edges[pivot] : edges[pivot + 1]]
                found.append((pivot, shard, np.bincount(some // len(order), minlength=ranks).astype(place).tobytes(), (some % len(order)).astype(place).tobytes(), codes[some % len(order)].tobytes() if norms.fit else None))
            yield from runtime.emitted(FILES, iter(found))

    return run


def _asked(pivots: np.ndarray, ranks: int, dim: int):
    """Queries to their pivots in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                order = nearest_pivots(unit(vectors.matrix(batch["embedding"], dim)), pivots, ranks)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], vectors.lists(order.astype(np.int32))], names=["query_id", "pivots"])

    return run


def _ranked(ranks: int, most: int, norms: Norms):
    """The ``most`` vectors of a shard that rank first for a query, from the files that they share."""
    step = np.arange(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for (shard, query), own in runtime.groups(batches, "shard", "query_id"):
                rows, gained, sizes = [], [], []
                for batch in own:
                    for rank, counts, data, codes in zip(*(batch[c].to_pylist() for c in ("rank", "counts", "rows", "sizes")), strict=True):
                        place = f"<u{len(counts) // ranks}"
                        rows.append(np.frombuffer(data, place))
                        # The distance starts from no common pivot and falls by twice this with each.
                        gained.append(np.repeat(ranks - np.maximum(rank, step), np.frombuffer(counts, place)))
                        sizes.append(np.frombuffer(codes or b"", np.uint8))
                rows = np.concatenate(rows)
                near = np.bincount(rows, np.concatenate(gained))
                touched = np.flatnonzero(near)
                if len(touched) > most:
                    order = near[touched]
                    if norms.fit:
                        codes = np.zeros(len(near), np.uint8)
                        codes[rows] = np.concatenate(sizes)
                        order = norms.order(order, codes[touched])
                    touched = np.sort(touched[np.argpartition(-order, most - 1)[:most]])
                yield shard, query, touched.astype("<u4").tobytes()

        yield from runtime.emitted(NEAR, found(), 256)

    return run


def _score(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, summed in the order of components: equal rows have equal scores wherever they stand."""
    total = np.zeros(len(rows))
    for k, x in enumerate(query.tolist()):
        total += rows[:, k] * x
    return total


def _nearest(k: int, most: int, dim: int):
    """Exact scores of candidates: a cell has a shard's vectors first, which are held, then queries with places of candidates, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, rows, by_size, size = None, [], None, None, None, 0.0
        for batch in batches:
            cell = np.array([batch[c].to_numpy() for c in ("shard", "block", "role")]).T
            edges = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist(), len(cell)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                *own, role = cell[a].tolist()
                part = batch.slice(a, b - a)
                if not role:
                    if own != now:
                        now, held = own, []
                    held.append(part)
                    continue
                assert own == now
                if held:
                    ids, rows = np.concatenate([h["vec_id"].to_numpy() for h in held]), np.concatenate([vectors.matrix(h["embedding"], dim) for h in held]).astype(np.float64)
                    sizes = np.sqrt((rows * rows).sum(axis=1))
                    by_size, size, held = np.argsort(-sizes, kind="stable"), sizes.max(), []
                yield _scored(part, ids, rows, by_size, size, k, most, dim)

    return run


def _scored(batch: pa.RecordBatch, ids: np.ndarray, rows: np.ndarray, by_size: np.ndarray, size: float, k: int, most: int, dim: int) -> pa.RecordBatch:
    out = []
    for query_id, query, some in zip(batch["vec_id"].to_pylist(), vectors.matrix(batch["embedding"], dim).astype(np.float64), batch["rows"].to_pylist(), strict=True):
        some = np.frombuffer(some, "<u4")
        if len(some) < min(most, len(ids)):  # others share no pivot; the largest of them fill up
            left = np.ones(len(ids), bool)
            left[some] = False
            some = np.concatenate([some, by_size[left[by_size]][: most - len(some)]])
        some = some[ids[some] != query_id]
        if k < len(some):
            rough = rows[some] @ query
            slack = 1e-9 * size * np.linalg.norm(query)
            some = some[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - slack]
        score = _score(rows[some], query)
        best = np.lexsort((ids[some], -score))[:k]
        out.append((np.full(len(best), query_id), ids[some[best]], score[best]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=FOUND)


def _best(queries: np.ndarray, k: int, dim: int):
    """The ``k`` largest products of each query with a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((len(queries), 0))
        for batch in batches:
            if len(batch):
                top = np.hstack([top, queries @ vectors.matrix(batch["embedding"], dim).astype(np.float64).T])
                if top.shape[1] > k:
                    top = -np.partition(-top, k - 1, axis=1)[:, :k]
        yield from runtime.emitted(TOP, ((TaskContext.get().partitionId() % ADDERS, i, v) for i, row in enumerate(top) for v in row.tolist()))

    return run


def _best_of(k: int):
    """The ``k`` largest of other tasks' products."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[int, list[float]] = {}
        for _, query, product in rows:
            own = held.setdefault(query, [])
            (heapq.heappushpop if len(own) >= k else heapq.heappush)(own, product)
        yield from ((0, query, v) for query, own in held.items() for v in own)

    return runtime.by_rows(run, TOP)


#: Tasks that gather the products of others.
ADDERS = 16
TOP = pa.schema([("adder", pa.int32()), ("query", pa.int32()), ("product", pa.float64())])


def reach(stored: DataFrame, queries: np.ndarray, k: int, dim: int) -> float:
    """The mean, over unit ``queries``, of the product with their ``k``-th nearest of all rows."""
    parts = stored.select("embedding").mapInArrow(_best(queries, k, dim), "adder int, query int, product double").repartitionById(ADDERS, F.col("adder"))
    found: dict[int, list[float]] = {}
    for r in parts.mapInArrow(_best_of(k), "adder int, query int, product double").collect():
        found.setdefault(r["query"], []).append(r["product"])
    return float(np.mean([sorted(own, reverse=True)[: k][-1] for own in found.values()]))


def search(vecs: DataFrame, queries: DataFrame, k: int = 20, ranks: int = RANKS, pivots: int = PIVOTS, first: int = FIRST) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vecs`` with the largest inner product found for each query.

    Both frames have (vec_id, embedding).  A query's own vec_id is no candidate; equal
    scores rank by vec_id; fewer rows are returned when there are fewer.  Vectors that are
    null, empty, zero or not finite take no part, nor do those of another length than most;
    equal rows count once, and of several rows of one vec_id the best counts; no vector
    gives no rows.  Other columns are not read.
    """
    spark = runtime.tune(vecs.sparkSession)
    stored = runtime.stored(vectors.taking_part(vecs).distinct())
    lengths = stored.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = lengths[0]["d"], lengths[0]["n"]
    stored = stored.where(F.size("embedding") == dim)
    asked = runtime.stored(vectors.taking_part(queries).distinct().where(F.size("embedding") == dim))
    wide = max(1.0, math.sqrt(dim / LOW))
    ranks = math.ceil(ranks * wide)
    count = min(MOST, max(ranks, math.ceil(pivots * math.sqrt(total))))
    sample = stored.orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * count).select("embedding").collect()
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    low, high = (max(v, 1e-150) for v in stored.select(F.min(norm).alias("low"), F.max(norm).alias("high")).first())
    distinct = np.array(list(dict.fromkeys(tuple(r["embedding"]) for r in sample)))
    pivot_rows = chosen_pivots(unit(distinct), count)
    ranks = min(ranks, len(pivot_rows))
    norms = Norms(low, high)
    if high > low * (1 + EVEN):
        # A query's own row counts in, so one more.
        norms = Norms(low, high, fitted(distinct, pivot_rows, ranks), reach(stored, vectors.unit(distinct[:KNOWN]), k + 1, dim))
    shards = -(-total // SHARD)
    # Shards are random parts of the rows, so each has its share of the first.
    wanted = max(first * math.sqrt(total), first / FIRST * LATER * total**POWER) * wide
    most = math.ceil(wanted / shards * (1 + (shards > 1) * 0.1)) + k

    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    index = stored.select("vec_id", "embedding", shard.alias("shard"))
    placed = index.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "vec_id", "embedding")
    files = runtime.stored(placed.mapInArrow(_inverted(pivot_rows, ranks, norms, dim), FILES_DDL))
    posted = asked.mapInArrow(_asked(pivot_rows, ranks, dim), "query_id long, pivots array<int>")
    posted = runtime.stored(posted.select("query_id", F.posexplode("pivots").alias("rank", "pivot")))
    # At most a row per pivot.
    salts = posted.groupBy("pivot").agg(F.ceil(F.count("*") / SHARING).cast("int").alias("salts"))
    salts = F.broadcast(runtime.stored(salts))
    own = posted.join(salts, "pivot").select("pivot", F.pmod(F.xxhash64("query_id"), "salts").alias("salt"), "query_id", "rank")
    copies = files.join(salts, "pivot").select(*FILES.names, F.explode(F.expr("sequence(0L, salts - 1L)")).alias("salt"))
    met = own.join(copies, ["pivot", "salt"]).select("shard", "query_id", "rank", "counts", "rows", "sizes")
    met = met.repartition(runtime.shards(spark), "shard", "query_id").sortWithinPartitions("shard", "query_id")
    near = runtime.stored(met.mapInArrow(_ranked(ranks, most, norms), NEAR_DDL))

    # Vectors are copied to several blocks of queries only where shards alone leave cores idle.
    blocks = max(1, min(-(-asked.count() // BLOCK), -(-4 * runtime.shards(spark) // shards)))
    ask = near.join(asked.withColumnRenamed("vec_id", "query_id"), "query_id")
    ask = ask.select("shard", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("role"), F.col("query_id").alias("vec_id"), "embedding", "rows")
    every = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("role"), "vec_id", "embedding", F.lit(None).cast("binary").alias("rows"))
    cells = ask.unionByName(every).repartitionById(shards * blocks, F.col("shard") * blocks + F.col("block")).sortWithinPartitions("shard", "block", "role", "vec_id", "embedding")
    found = cells.mapInArrow(_nearest(k, most, dim), FOUND_DDL).repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_permutation_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = runtime.read(spark, sf_dir, "embeddings")
    return search(vecs, vecs.where("vec_id % 20 = 0"), 20)
