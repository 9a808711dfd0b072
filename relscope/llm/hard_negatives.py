"""Hard negatives by a pivot table.

A component sqrt(M - |x|^2) brings all rows to the largest norm, an anchor gets 0 there, so
d(a, x)^2 = |a|^2 + M - 2 a.x: the largest inner product is the smallest Euclidean distance.
The stored pivot table has each row's distances to a few pivots.  By the triangle inequality
|d(a, p) - d(x, p)| <= d(a, x) <= d(a, p) + d(x, p), so the table brackets the score of any row.

Rows are ordered by label, nearest pivot and distance to it, and cut into shards of a range each.  Ranges
of distances bracket a whole shard: an anchor goes only to shards that can hold what it asks for, first to the most
promising one, whose k-th score rules out others.  In a shard the rows' own brackets choose
whom to score exactly.  Shards stay where they are; anchors travel, batch by batch.

What is asked for is the best rows of a band of scores with the anchor's label (its positives) or with another
(negatives between two shares of a positive's score).  All scores are whole numbers and exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime, vectors
from .whitening import finite

#: Pivots, and rows among which they are chosen.
PIVOTS, SAMPLE = 16, 2048
#: Rows of a shard, shards at most (rows of a shard grow beyond it), rows of a packed chunk and anchors of a batch.
SHARD, SHARDS, CHUNK, BATCH = 16_384, 1 << 16, 2048, 128
#: Whole numbers up to this are exact as doubles; a long's range.
EXACT, LOW, HIGH = 1 << 53, -(1 << 63), (1 << 63) - 1

TABLE = pa.schema([("shard", pa.int32()), ("role", pa.int32()), ("data", pa.binary())])
TABLE_DDL = "shard int, role int, data binary"
SUMMARY, ROWS, ASKED = -1, 0, 1
ASKING = ("anchor_id", "band", "label", "low", "high")
FOUND = pa.schema([("anchor_id", pa.int64()), ("band", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "anchor_id long, band long, vec_id long, score long"


class Space(NamedTuple):
    """Pivots with their added component, the largest squared norm, and whether products are exact as doubles."""

    pivots: np.ndarray
    most: float
    exact: bool

    def distances(self, rows: np.ndarray, anchors: bool = False) -> np.ndarray:
        rows = rows.astype(np.float64)
        norms = np.square(rows).sum(axis=1)
        lift = np.zeros(len(rows)) if anchors else np.sqrt(np.maximum(0, self.most - norms))
        products = np.hstack([rows, lift[:, None]]) @ self.pivots.T
        return np.sqrt(np.maximum(0, (norms if anchors else norms + lift * lift)[:, None] + self.most - 2 * products))

    def scores(self, near: np.ndarray, far: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest) score of anchors with squared ``norms`` at distances between ``near`` and ``far``, with room for rounding."""
        slack, base = 1e-6 * math.sqrt(self.most), norms[:, None] + self.most
        room = 1e-6 * self.most + 1e-9
        return (base - np.square(far + slack)) / 2 - room, (base - np.square(np.maximum(0, near - slack))) / 2 + room

    def products(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products; those beyond a long's range are its ends."""
        if self.exact:
            return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
        return np.clip(anchors.astype(object) @ rows.astype(object).T, LOW, HIGH).astype(np.int64)


def farthest_first(rows: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows, each the farthest from those before."""
    chosen, far = [0], np.square(rows - rows[0]).sum(axis=1)
    while len(chosen) < min(count, len(rows)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.square(rows - rows[chosen[-1]]).sum(axis=1))
    return rows[chosen]


def _placed(space: Space, dim: int, kind: str):
    """(vec_id, label, x) to (vec_id, label, x, nearest pivot, distances)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = vectors.matrix(batch["x"], dim)
                d = space.distances(x)
                nearest = d.argmin(axis=1)
                packed = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (x.astype(kind), d.astype("<f4"))]
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], packed[0], pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(d)), nearest]), packed[1]], names=["vec_id", "label", "x", "nearest", "near", "d"])

    return run


def _shards(dim: int, pivots: int, kind: str):
    """A partition as a shard: its rows in packed chunks, then ranges of its labels and distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, n, ranges = TaskContext.get().partitionId(), 0, None
        held: list[pa.RecordBatch] = []

        def chunk() -> tuple:
            nonlocal n, ranges
            ids = np.concatenate([b["vec_id"].to_numpy() for b in held])
            labels = np.concatenate([b["label"].to_numpy() for b in held])
            x = np.frombuffer(b"".join(v.as_py() for b in held for v in b["x"]), kind).reshape(-1, dim)
            d = np.frombuffer(b"".join(v.as_py() for b in held for v in b["d"]), "<f4").reshape(-1, pivots)
            own = [labels.min(), labels.max(), d.min(axis=0), d.max(axis=0)]
            ranges = own if ranges is None else [f(a, b) for f, a, b in zip((min, max, np.minimum, np.maximum), ranges, own, strict=True)]
            n += len(ids)
            return shard, ROWS, runtime.pack((ids, labels, x, d))

        def rows() -> Iterator[tuple]:
            nonlocal held
            for batch in batches:
                if len(batch):
                    held.append(batch)
                if sum(map(len, held)) >= CHUNK:
                    yield chunk()
                    held = []
            if held:
                yield chunk()
            if n:
                yield shard, SUMMARY, runtime.pack((n, *ranges))

        yield from runtime.emitted(TABLE, rows(), 4)

    return run


def _bounds(own: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of anchors (a row each) to rows or shards whose distances to pivots lie in ``low`` to ``high``: at least, at most."""
    near, far = np.zeros((len(own), len(low)), np.float32), np.full((len(own), len(low)), np.inf, np.float32)
    for p in range(own.shape[1]):
        d = own[:, p, None].astype(np.float32)
        np.maximum(near, d - high[None, :, p], out=near)
        np.maximum(near, low[None, :, p] - d, out=near)
        np.minimum(far, d + high[None, :, p], out=far)
    return near, far


def _able(space: Space, dim: int, summaries, same: bool, whole: pa.RecordBatch) -> Iterator[tuple]:
    """A few requests at a time: the batch, its vectors, their distances to pivots, and per shard whether it may answer and its largest score."""
    _, label_low, label_high, d_low, d_high = (np.array(c) for c in zip(*(runtime.unpack(data) for _, data in summaries.value), strict=True))
    for at in range(0, len(whole), BATCH):
        batch = whole.slice(at, BATCH)
        labels, low, high = (batch[c].to_numpy()[:, None] for c in ("label", "low", "high"))
        x = vectors.matrix(batch["x"], dim)
        own = space.distances(x, anchors=True)
        least, largest = space.scores(*_bounds(own, d_low, d_high), np.square(x.astype(np.float64)).sum(axis=1))
        here = (label_low <= labels) & (labels <= label_high)
        able = here if same else ~(here & (label_low == label_high))
        yield batch, x, own, able & (least <= high) & (largest >= low), largest


def _homes(space: Space, dim: int, summaries, same: bool):
    """Requests with the shard that may have the best answer; -1 if none has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = np.array([s for s, _ in summaries.value], np.int32)
        for whole in batches:
            for batch, _, _, able, largest in _able(space, dim, summaries, same, whole):
                home = np.where(able.any(axis=1), shards[np.where(able, largest, -np.inf).argmax(axis=1)], -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32))], names=[*batch.schema.names, "home"])

    return run


def _visits(space: Space, dim: int, summaries, same: bool, first: bool):
    """Requests to their home, or to all other shards that may answer them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = np.array([s for s, _ in summaries.value])

        def rows() -> Iterator[tuple]:
            for whole in batches:
                for batch, x, own, able, largest in _able(space, dim, summaries, same, whole):
                    columns = [batch[c].to_numpy() for c in (*ASKING, "floor")]
                    home = shards == batch["home"].to_numpy()[:, None]
                    asked = home if first else able & ~home & (largest >= columns[-1][:, None])
                    for s in np.flatnonzero(asked.any(axis=0)).tolist():
                        some = np.flatnonzero(asked[:, s])
                        yield int(shards[s]), ASKED, runtime.pack(tuple(a[some] for a in (*columns, x, own)))

        yield from runtime.emitted(TABLE, rows(), 16)

    return run


def _answers(space: Space, same: bool, k: int):
    """The ``k`` best rows of a shard for each request: bracketed by the pivot table, then scored exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            now, held = None, None
            for (shard, role), own in runtime.groups(batches, "shard", "role"):
                packed = (data.as_py() for batch in own for data in batch["data"])
                if role == ROWS:
                    now, held = shard, [np.concatenate(c) for c in zip(*map(runtime.unpack, packed), strict=True)]
                    continue
                if shard != now:
                    continue
                for request in map(runtime.unpack, packed):
                    yield from _best(space, held, request, same, k)

        yield from runtime.emitted(FOUND, found(), 4096)

    return run


def _best(space: Space, held: list[np.ndarray], request: tuple, same: bool, k: int) -> Iterator[tuple]:
    row_ids, row_labels, rows, d = held
    ids, bands, labels, low, high, floor, x, own = request
    # Several bands of one anchor share its brackets and scores.
    _, lead, anchor = np.unique(ids, return_index=True, return_inverse=True)
    least, largest = space.scores(*_bounds(own[lead], d, d), np.square(x[lead].astype(np.float64)).sum(axis=1))
    alike = row_labels == labels[lead, None]
    able = (alike if same else ~alike) & (row_ids != ids[lead, None])
    wanted = np.zeros(able.shape, bool)
    at_least = np.maximum(low, floor)
    for i, a in enumerate(anchor.tolist()):
        wanted[a] |= able[a] & (largest[a] >= at_least[i]) & (least[a] <= high[i])
    some = np.flatnonzero(wanted.any(axis=0))
    if not len(some):
        return
    score, wanted = space.products(x[lead], rows[some]), wanted[:, some]
    for i, a in enumerate(anchor.tolist()):
        fit = np.flatnonzero(wanted[a] & (score[a] >= at_least[i]) & (score[a] <= high[i]))
        if len(fit) > k:
            kth = np.partition(score[a, fit], len(fit) - k)[len(fit) - k]
            fit = fit[score[a, fit] >= kth]
        order = fit[np.lexsort((row_ids[some[fit]], -score[a, fit]))][:k]
        for j in order.tolist():
            yield int(ids[i]), int(bands[i]), int(row_ids[some[j]]), int(score[a, j])


class PivotTable:
    """The stored pivot table of (vec_id, label, x) rows, x an array of whole numbers of one length, vec_id unique."""

    def __init__(self, rows: DataFrame, dim: int, n: int, norm: float, largest: int, pivots: int = PIVOTS, sample: int = SAMPLE) -> None:
        self.spark, self.dim, self.rows = rows.sparkSession, dim, rows
        some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").collect()
        some = np.array([r["x"] for r in some], np.float64).reshape(-1, dim)
        most = norm * (1 + 1e-9)
        lifted = np.hstack([some, np.sqrt(np.maximum(0, most - np.square(some).sum(axis=1, keepdims=True)))])
        self.space = Space(farthest_first(lifted, pivots), most, most < EXACT)
        kind = next(k for k, top in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 64)) if largest < top)
        shards = min(SHARDS, -(-n // SHARD))
        placed = rows.mapInArrow(_placed(self.space, dim, kind), "vec_id long, label long, x binary, nearest int, near double, d binary")
        order = ("label", "nearest", "near", "vec_id")
        ranged = runtime.stored(placed).repartitionByRange(shards, *order).sortWithinPartitions(*order)
        self.table = runtime.stored(ranged.select("vec_id", "label", "x", "d").mapInArrow(_shards(dim, len(self.space.pivots), kind), TABLE_DDL))
        summaries = self.table.where(F.col("role") == SUMMARY).collect()
        self.summaries = self.spark.sparkContext.broadcast(sorted((r["shard"], bytes(r["data"])) for r in summaries))
        self.shards = 1 + max(r["shard"] for r in summaries)

    def _asked(self, requests: DataFrame, same: bool, k: int, first: bool) -> DataFrame:
        visits = requests.mapInArrow(_visits(self.space, self.dim, self.summaries, same, first), TABLE_DDL)
        both = self.table.where(F.col("role") == ROWS).unionByName(visits)
        placed = both.repartitionById(self.shards, F.col("shard")).sortWithinPartitions("shard", "role")
        return placed.mapInArrow(_answers(self.space, same, k), FOUND_DDL)

    def best(self, requests: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor_id, band, vec_id, score, rank): the ``k`` best rows of the label, or of others, with ``low`` <= score <= ``high``.

        ``requests`` has (anchor_id, band, label, x, low, high), of which anchor_id and band are unique together.
        """
        requests = requests.select(*ASKING, "x")
        ddl = "anchor_id long, band long, label long, low long, high long, x array<long>, home int"
        requests = runtime.stored(requests.mapInArrow(_homes(self.space, self.dim, self.summaries, same), ddl))
        home = runtime.stored(self._asked(requests.withColumn("floor", F.lit(LOW)), same, k, True))
        floors = home.groupBy("anchor_id", "band").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        others = requests.join(floors, ["anchor_id", "band"], "left").withColumn("floor", F.coalesce("floor", F.lit(LOW)))
        found = home.unionByName(self._asked(others, same, k, False))
        rank = F.row_number().over(Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "vec_id"))
        return runtime.stored(found.withColumn("rank", rank).where(F.col("rank") <= k))


OUT_DDL = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vecs: DataFrame, anchors: str, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vecs`` has (vec_id, label, x), x an array of whole numbers; ``anchors`` is a condition on vec_id.  A row's score is its inner
    product with the anchor; the larger score comes first, then the smaller vec_id.  An anchor's positives are its first
    ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels with a score of ``low``
    to ``high`` percent of the positive's are returned.  A positive with a negative score has none, as its
    shares are in the wrong order.  Anchors with no positive and positives with no negative give no rows.

    Rows with a null vec_id, label, x or component, with an empty x, or of another length than most (of equally many, than the
    shorter) take no part; a row whose components are all zero does.  Of several rows of one vec_id the smallest
    by label, then x, counts.  Scores beyond a long's range are its ends.  An empty table gives no rows.
    Other columns are not read.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("shares are percents, the lower one first")
    spark = runtime.tune(vecs.sparkSession)
    rows = vecs.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("x").cast("array<long>").alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ~F.coalesce(F.exists("x", F.isnull), F.lit(True)))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row")).select("vec_id", "row.label", "row.x")
    rows = runtime.stored(rows)
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    size = F.greatest(F.abs(F.array_max("x").cast("decimal(20,0)")), F.abs(F.array_min("x").cast("decimal(20,0)")))
    shapes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("norm"), F.max(size).alias("largest")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not shapes:
        return spark.createDataFrame([], OUT_DDL)
    shape = shapes[0]
    rows = rows.where(F.size("x") == shape["d"])
    table = PivotTable(rows, shape["d"], shape["n"], shape["norm"], int(shape["largest"]))
    asked = runtime.stored(rows.where(anchors).withColumnRenamed("vec_id", "anchor_id"))
    every = asked.select("*", F.lit(0).cast("long").alias("band"), F.lit(LOW).alias("low"), F.lit(HIGH).alias("high"))
    close = table.best(every, True, positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # Shares of whole numbers in whole numbers, without products of large ones.  Positives of one score share a band.
    share = "(band div 100) * {0} + ((band % 100) * {0} + {1}) div 100"
    bands = close.where("positive_score >= 0").select("anchor_id", F.col("positive_score").alias("band")).distinct()
    bands = bands.select("*", F.expr(share.format(low, 99)).alias("low"), F.expr(share.format(high, 0)).alias("high"))
    found = table.best(bands.join(asked, "anchor_id"), False, negatives)
    hard = found.select("anchor_id", F.col("band").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return close.join(hard, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = runtime.read(spark, sf_dir, "embeddings").where(finite())
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vecs.select("vec_id", label.alias("label"), F.transform("embedding", lambda c: F.floor(c.cast("double") * 256)).alias("x")), "vec_id % 100 = 0")


def oracle() -> str:
    return """
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c: floor(256 * c::double)) as x
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
pairs as (
  select a.vec_id as anchor_id, o.vec_id as other_id, a.label = o.label as alike, list_inner_product(a.x, o.x)::bigint as score
  from usable a join usable o on a.vec_id % 100 = 0 and a.vec_id <> o.vec_id),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from pairs where alike
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id)::int as rank,
  other_id as negative_id, positive_score, score as negative_score
from positives p join pairs n on n.anchor_id = p.anchor_id and not alike and 80 * positive_score <= 100 * score and score <= positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) <= 5"""
