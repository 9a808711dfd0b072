"""Whitening of vectors by matrix-free block subspace iteration.

The covariance is never formed: each pass over the stored rows computes V Q = Xᵀ(X Q) / n on
centred rows for a block Q of a few columns, so a task sends one matrix of the block's size,
and these are added up in two steps.  QR makes the next block, Rayleigh-Ritz its
eigenpairs, and passes go on until the residuals |V z - e z| certify all components.  A block
whose residuals fall too slowly is doubled; one of all dimensions is exact after a single pass.

Rows are centred in whole numbers, n x - S, before anything is multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime, vectors

#: Residuals at most, in parts of the largest eigenvalue; a component has more than RANK parts of the trace.
TOLERANCE, RANK = 1e-12, 1e-13
#: Passes that a block may still need at its rate before it is doubled; tasks that add up matrices.
PATIENCE, ADDERS = 12, 16
#: Whole numbers beyond this have no exact double.
EXACT = 1 << 53

SUMS = pa.schema([("place", pa.int32()), ("n", pa.int64()), ("total", pa.string()), ("most", pa.int64())])
PART = pa.schema([("adder", pa.int32()), ("data", pa.binary())])
WHITE = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("deviation", pa.int64()), ("whitened", pa.float64())])


def _sums(dim: int):
    """Per dimension: rows, sum and largest size of a task's whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, most = 0, np.zeros(dim, object), np.zeros(dim, np.int64)
        for batch in batches:
            if len(batch):
                x = vectors.matrix(batch["x"], dim)
                n += len(x)
                most = np.maximum(most, np.abs(x).max(axis=0))
                total = total + (x.sum(axis=0).astype(object) if int(most.max()) * len(x) < 1 << 62 else x.astype(object).sum(axis=0))
        if n:
            yield runtime.emit(SUMS, [(i, n, str(total[i]), int(most[i])) for i in range(dim)])

    return run


class Centre:
    """n x - S of a batch in whole numbers, and as doubles over n."""

    def __init__(self, n: int, total: list[int], most: int) -> None:
        self.n, self.dim, self.narrow = n, len(total), 2 * n * max(most, 1) < 1 << 62
        self.total = np.array(total, np.int64 if self.narrow else object)

    def whole(self, batch: pa.RecordBatch) -> np.ndarray:
        x = vectors.matrix(batch["x"], self.dim)
        return (x if self.narrow else x.astype(object)) * self.n - self.total

    def rows(self, batch: pa.RecordBatch) -> np.ndarray:
        return (self.whole(batch) / self.n).astype(np.float64)


def _added(rows: DataFrame, centre: Centre, product: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``product(centred rows)`` over all rows; tasks add their own, ADDERS tasks those of others."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = product(centre.rows(batch))
                total = part if total is None else total + part
        if total is not None:
            yield runtime.emit(PART, [(TaskContext.get().partitionId() % ADDERS, total.tobytes())])

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch["data"]:
                part = np.frombuffer(data.as_buffer(), np.float64)
                total = part.copy() if total is None else total + part
        if total is not None:
            yield runtime.emit(PART, [(0, total.tobytes())])

    parts = rows.mapInArrow(own, "adder int, data binary").repartitionById(ADDERS, F.col("adder"))
    return np.sum([np.frombuffer(r["data"]) for r in parts.mapInArrow(all_of, "adder int, data binary").collect()], axis=0)


def eigenpairs(multiply: Callable[[np.ndarray], np.ndarray], dim: int, k: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors of the symmetric ``multiply``, certified by their residuals."""
    draw = np.random.default_rng(0)
    size, before = min(dim, 2 * k), None
    block = np.linalg.qr(draw.standard_normal((dim, size)))[0] if size < dim else np.eye(dim)
    while True:
        image = multiply(block)
        inner = block.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = block @ turn, image @ turn
        worst = np.linalg.norm(image - ritz * values, axis=0)[:k].max()
        if size == dim or worst <= tolerance * max(values[0], 0):
            return values[:k], ritz[:, :k]
        rate = 1.0 if before is None else min(1.0, worst / before)
        if before is not None and (rate >= 1 or math.log(tolerance * values[0] / worst) / math.log(rate) > PATIENCE):
            size, before = min(dim, 2 * size), None
            if size == dim:
                block = np.eye(dim)
                continue
            image = np.hstack([image, draw.standard_normal((dim, size - image.shape[1])) * values[0]])
        else:
            before = worst
        block = np.linalg.qr(image)[0]


def whiten(vecs: DataFrame, x: Column, k: int = 32, tolerance: float = TOLERANCE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per row of ``vecs`` and component.

    ``x`` makes an array of whole numbers of a row; rows where it is null, empty, holds a null or a number of 2^53 or more,
    or has another length than most (of equally many, than the shorter) are left out.  Components are unit
    eigenvectors of the covariance of ``x`` over all rows, divisor n, numbered from 1 by falling eigenvalue, their entry
    of the largest size positive.  ``k`` are returned, but never more than there are dimensions, nor any whose eigenvalue is zero
    but for rounding, as nothing can be divided by its root: constant columns or a single row have none, and an empty table gives no rows.
    Repeated rows count and come as often as they are there, rows with a null vec_id too.  ``deviation``, the sum of
    (n x - S)^2, is exact, and null where a long can't hold it.  Other columns are not read.
    """
    spark = runtime.tune(vecs.sparkSession)
    wide = F.exists("x", lambda v: v.isNull() | (F.abs(v) >= EXACT))
    rows = vecs.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<long>").alias("x"))
    rows = runtime.stored(rows.where(F.col("x").isNotNull() & (F.size("x") > 0) & ~F.coalesce(wide, F.lit(True))))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not lengths:
        return spark.createDataFrame([], ddl)
    dim = lengths[0]["d"]
    rows = rows.where(F.size("x") == dim)
    parts = rows.mapInArrow(_sums(dim), "place int, n long, total string, most long")
    sums = parts.groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("s"), F.max("most").alias("most")).orderBy("place").collect()
    n = sums[0]["n"]
    centre = Centre(n, [int(r["s"]) for r in sums], max(r["most"] for r in sums))
    trace = float(_added(rows, centre, lambda c: np.array([np.square(c).sum()]))[0]) / n
    k = min(k, dim)
    values, axes = eigenpairs(lambda q: _added(rows, centre, lambda c: c.T @ (c @ q)).reshape(q.shape) / n, dim, k, tolerance)
    found = int(np.count_nonzero(values > RANK * trace)) if trace else 0
    if not found:
        return spark.createDataFrame([], ddl)
    values, axes = values[:found], axes[:, :found]
    axes = axes * np.sign(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], axis=0))
    scaled = axes / np.sqrt(values)

    def spread(c: np.ndarray) -> np.ndarray:
        w = c @ scaled
        return np.vstack([w.T @ w, w.sum(axis=0)])

    moments = _added(rows, centre, spread).reshape(found + 1, found) / n
    error = float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(found)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(1, found + 1, dtype=np.int32)
        for batch in batches:
            if not len(batch):
                continue
            whole = centre.whole(batch)
            if centre.narrow and dim * int(np.abs(whole).max()) ** 2 < 1 << 63:
                deviation = pa.array(np.square(whole).sum(axis=1))
            else:
                sizes = np.square(whole.astype(object)).sum(axis=1).tolist()
                deviation = pa.array([s if s < 1 << 63 else None for s in sizes], pa.int64())
            which = pa.array(np.repeat(np.arange(len(batch)), found))
            whitened = centre.rows(batch) @ scaled
            yield pa.RecordBatch.from_arrays([batch["vec_id"].take(which), pa.array(np.tile(number, len(batch))), deviation.take(which), pa.array(whitened.ravel())], schema=WHITE)

    out = rows.mapInArrow(run, "vec_id long, component int, deviation long, whitened double")
    explained = F.element_at(F.array(*(F.lit(float(v) / trace) for v in values)), F.col("component"))
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def finite(embedding: str = "embedding") -> Column:
    """Whether a vector is there and holds neither nulls nor entries that are not finite."""
    bad = F.exists(embedding, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = runtime.read(spark, sf_dir, "embeddings").where(finite())
    # Beyond 2^60 a row is left out anyway; the bound keeps the sum within a long.
    return whiten(vecs, F.transform("embedding", lambda c: F.floor(F.least(F.greatest(c.cast("double") * 64, F.lit(-(2.0**60))), F.lit(2.0**60))) + 1_000_000))
