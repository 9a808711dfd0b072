"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors lexicographically by the concatenation of its random
hyperplane bits, ``LENGTH`` of them, and compares each row with the ``RUN`` rows before it.
Places in the order come from a sort by ranges and the sizes of these; strips of the order
are compared apart, each with the rows ahead of it that its first windows reach.  A pass
thus compares all rows that share so many first bits that scattered vectors fill a window
with them, and passes follow from these bits, so that a pair of the least cosine shares
them in no pass with a chance of ``MISS``.  A dense group puts more rows than a window
between such pairs: where these rows aren't one component yet, the whole run of rows with
equal first bits is compared tile by tile, so density costs time and no links.  Edges of
all passes are united; they span the linked vectors and aren't all pairs, so the links
within each component are then counted in full.  Equal vectors are one class throughout,
so copies cost nothing.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graphs, runtime, vectors

#: Rows of a window; chance that a pair is missed; rows of a tile of a component.
RUN, MISS, TILE = 2048, 1e-4, 1024
#: Bits of a row's place in the order of a pass.
LENGTH = 62
#: Steps of a window, rows of a step being compared at once, and steps of a strip.
STEPS, STRIP = 4, 16
#: Pairs are picked in single precision with this margin and confirmed in double.
MARGIN = 1e-4
#: Runs that are broadcast, at most; beyond, they are shuffled.
FEW = 1_000_000

SPANNED = pa.schema([("a", pa.int64()), ("b", pa.int64())])
TILED = pa.schema([("rep", pa.int64()), ("n", pa.int64())])


def plan(n: int, least: float, run: int, miss: float) -> tuple[int, int]:
    """(bits, passes) for ``n`` rows; a single pass without bits compares all."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / run)))
    same = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** bits
    return bits, 1 if same == 1 else math.ceil(math.log(miss) / math.log1p(-same))


def keys(own: np.ndarray, passes: int) -> np.ndarray:
    """A row's ``LENGTH`` bits in each pass, the first being the highest."""
    out = np.zeros((len(own), passes), np.int64)
    for number in range(passes):
        plane = np.random.default_rng([number, own.shape[1]]).standard_normal((LENGTH, own.shape[1]))
        out[:, number] = (own @ plane.T > 0) @ (1 << np.arange(LENGTH - 1, -1, -1, dtype=np.int64))
    return out


def _keyed(passes: int, dim: int):
    """(rep, own, embedding) to (rep, own, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = keys(vectors.unit(vectors.matrix(batch["embedding"], dim)), passes)
                yield pa.RecordBatch.from_arrays([batch["rep"], batch["own"], vectors.lists(found)], names=["rep", "own", "keys"])

    return run


def _near(one: np.ndarray, two: np.ndarray, least: float) -> np.ndarray:
    """Whether rows have a product of ``least``."""
    product = one.astype(np.float32) @ two.astype(np.float32).T
    near = product >= least - MARGIN
    i, j = np.nonzero(near & (product < least + MARGIN))
    for a in range(0, len(i), 65_536):
        p, q = i[a : a + 65_536], j[a : a + 65_536]
        near[p, q] = np.einsum("ij,ij->i", one[p], two[q]) >= least
    return near


def _spanning(near: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Edges of ids that connect what the links ``near`` of ids ``one`` to ids ``two`` connect."""
    if np.count_nonzero(near) <= 4 * (len(one) + len(two)):
        i, j = np.nonzero(near)
        edges = np.stack([one[i], two[j]], axis=1)
    else:
        out, rows, left = [], near.any(axis=1), np.ones(len(two), bool)
        while rows.any():
            start = rows.argmax()
            ahead = np.array([start])
            rows[start] = False
            while len(ahead):
                met = np.flatnonzero(near[ahead].any(axis=0) & left)
                left[met] = False
                ahead = np.flatnonzero(near[:, met].any(axis=1) & rows)
                rows[ahead] = False
                found = np.concatenate([two[met], one[ahead]])
                out.append(np.stack([np.full(len(found), one[start]), found], axis=1))
        edges = np.concatenate(out)
    return np.unique(np.sort(edges[edges[:, 0] != edges[:, 1]], axis=1), axis=0)


def _cells(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], columns: tuple[str, ...], dim: int) -> Iterator[tuple]:
    """(cell, columns' values, unit vectors) of sorted rows, a cell at a time."""
    now, held = None, []

    def whole() -> tuple:
        return now, [np.concatenate([h[k] for h in held]) for k in range(len(columns))], np.concatenate([h[-1] for h in held])

    for batch in batches:
        cell = np.array([batch[c].to_numpy() for c in by]).T
        edges = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist(), len(cell)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b == a:
                continue
            if now != tuple(cell[a].tolist()):
                if held:
                    yield whole()
                now, held = tuple(cell[a].tolist()), []
            part = batch.slice(a, b - a)
            held.append((*(part[c].to_numpy() for c in columns), vectors.unit(vectors.matrix(part["embedding"], dim))))
    if held:
        yield whole()


def _windowed(least: float, dim: int):
    """Edges that span the links of each row of a strip with its step and the ``STEPS`` steps before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, deque(maxlen=STEPS)
        for (number, strip, step), (ids,), rows in _cells(batches, ("pass", "strip", "step"), ("rep",), dim):
            if now != (number, strip):
                now = number, strip
                held.clear()
            held_ids, held_rows = [*(h[0] for h in held), ids], [*(h[1] for h in held), rows]
            held.append((ids, rows))
            if step // STRIP == strip:
                before = np.concatenate(held_ids)
                near = _near(rows, np.concatenate(held_rows), least)
                near &= ids[:, None] != before[None, :]
                edges = _spanning(near, ids, before)
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], schema=SPANNED)

    return run


def _linked(least: float, dim: int):
    """Edges that span the links between the two tiles of a cell, but those within a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (*_, t, u), (tile, ids, label), rows in _cells(batches, ("pass", "key", "t", "u"), ("tile", "rep", "component"), dim):
            one, two = np.flatnonzero(tile == t), np.flatnonzero(tile == u)
            apart = label[one][:, None] != label[two][None, :]
            if apart.any():
                edges = _spanning(_near(rows[one], rows[two], least) & apart, ids[one], ids[two])
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], schema=SPANNED)

    return run


def _tile_counts(least: float, dim: int):
    """Links between the two tiles of a cell, per vector, each weighted with its partner's copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, t, u), (tile, ids, copies), rows in _cells(batches, ("component", "t", "u"), ("tile", "rep", "copies"), dim):
            one, two = np.flatnonzero(tile == t), np.flatnonzero(tile == u)
            near = _near(rows[one], rows[two], least)
            near &= ids[one][:, None] != ids[two][None, :]
            out = [ids[one]], [near @ copies[two]]
            if t != u:
                out[0].append(ids[two])
                out[1].append(copies[one] @ near)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], schema=TILED)

    return run


def ordered(keyed: DataFrame, n: int) -> DataFrame:
    """(rep, own, pass, key, place): each row's place, from 0, in the order of each pass, stored; ``keyed`` has ``n`` rows of (rep, own, keys)."""
    spark = keyed.sparkSession
    rows = keyed.select("rep", "own", F.posexplode("keys").alias("pass", "key"))
    sorted_ = rows.repartitionByRange(runtime.shards(spark), "pass", "key", "rep", "own").sortWithinPartitions("pass", "key", "rep", "own")
    # The high bits of an id are its partition, the others its place there.
    sorted_ = runtime.stored(sorted_.withColumn("_id", F.monotonically_increasing_id()).select("rep", "own", "pass", "key", F.shiftright("_id", 33).alias("part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    # A row per partition.
    sizes = {r["part"]: r["n"] for r in sorted_.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    known = sorted_.join(F.broadcast(spark.createDataFrame(starts, "part long, start long")), "part")
    return runtime.stored(known.select("rep", "own", "pass", "key", (F.col("start") + F.col("at") - F.col("pass").cast("long") * n).alias("place")))


def spanned(classes: DataFrame, n: int, dim: int, least: float, run: int, miss: float) -> DataFrame:
    """(node, component) of the linked ones among ``n`` different vectors, (rep, embedding)."""
    spark = classes.sparkSession
    # Different vectors may share a vec_id.
    classes = classes.select("rep", F.xxhash64("embedding").alias("own"), "embedding")
    bits, passes = plan(n, least, run, miss)
    placed = ordered(classes.mapInArrow(_keyed(passes, dim), "rep long, own long, keys array<long>"), n)
    # A row goes to its strip, and to the next one if windows there reach it.
    places = placed.groupBy("rep", "own").agg(F.collect_list(F.struct("pass", F.floor(F.col("place") / max(1, run // STEPS)).alias("step"))).alias("places"))
    steps = classes.join(places, ["rep", "own"]).select("rep", "embedding", F.inline("places"))
    own = F.floor(F.col("step") / STRIP)
    strips = steps.withColumn("strip", F.explode(F.when(F.col("step") % STRIP >= STRIP - STEPS, F.array(own, own + 1)).otherwise(F.array(own))))
    strips = strips.repartition(runtime.shards(spark), "pass", "strip").sortWithinPartitions("pass", "strip", "step", "rep")
    pairs = runtime.stored(strips.mapInArrow(_windowed(least, dim), "a long, b long").distinct())
    found = graphs.components(pairs)
    # Runs of equal first bits that no window holds, unless windows have made them one component.
    in_runs = placed.withColumn("key", F.shiftright("key", LENGTH - bits))
    long = runtime.stored(in_runs.groupBy("pass", "key").agg(F.count("*").alias("n"), F.min("place").alias("first")).where(F.col("n") > run))
    count = long.count()
    if not count:
        return found
    few = lambda df, rows: F.broadcast(df) if rows <= FEW else df
    held = in_runs.join(few(long, count), ["pass", "key"]).select("rep", "own", "pass", "key", F.floor((F.col("place") - F.col("first")) / run).alias("tile"), F.ceil(F.col("n") / run).alias("tiles"))
    held = held.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    held = runtime.stored(held)
    apart = runtime.stored(held.groupBy("pass", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("pass", "key"))
    cells = held.join(few(apart, apart.count()), ["pass", "key"]).join(classes, ["rep", "own"])
    cells = cells.withColumn("other", F.explode(F.expr("filter(sequence(0L, tiles - 1), x -> x <> tile)")))
    cells = cells.select("pass", "key", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), "tile", "rep", "component", "embedding")
    met = cells.repartition(runtime.shards(spark), "pass", "key", "t", "u").sortWithinPartitions("pass", "key", "t", "u", "tile")
    more = runtime.stored(met.mapInArrow(_linked(least, dim), "a long, b long").distinct())
    return graphs.components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more)) if more.take(1) else found


def near_duplicates(vecs: DataFrame, least: float = 0.9, run: int = RUN, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors are linked when their cosine is ``least`` or more; a link is missed with a
    chance of at most ``miss`` unless others bring its ends into one component, and none is
    where a window of ``run`` rows has all.  ``n_links`` counts the
    other rows linked directly, copies included; ``component_id`` is the smallest vec_id
    reachable, the row's own included, and ``kept`` tells whether it is the row's own.
    Vectors that are null, empty, zero or not finite, or of another length than most, are
    linked with nothing, and so are rows with a null vec_id, whose component_id and kept
    are null.  Rows of equal vec_id and vector count as copies.  An empty table gives no
    rows.  Columns besides vec_id and embedding are not read.
    """
    spark = runtime.tune(vecs.sparkSession)
    taking = runtime.stored(vectors.taking_part(vecs))
    lengths = taking.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = lengths[0]["d"] if lengths else 0
    classes = runtime.stored(taking.where(F.size("embedding") == dim).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    found = spanned(classes, classes.count(), dim, least, run, miss)
    sizes = found.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    grouped = runtime.stored(graphs.lookup(found, runtime.stored(sizes), "component").withColumnRenamed("node", "rep"))
    rows = grouped.join(classes, "rep").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    cells = cells.select("component", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), "tile", "rep", "copies", "embedding")
    tiled = cells.repartition(runtime.shards(spark), "component", "t", "u").sortWithinPartitions("component", "t", "u", "tile")
    counts = tiled.mapInArrow(_tile_counts(least, dim), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    linked = found.withColumnRenamed("node", "rep").join(counts, "rep", "left")
    by_class = runtime.stored(classes.join(linked, "rep", "left").select("embedding", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    own = taking.withColumn("class", F.xxhash64("embedding"))
    named = graphs.lookup(runtime.stored(own.withColumnRenamed("embedding", "_e")), by_class.withColumn("class", F.xxhash64("embedding")), "class").where(F.col("_e") == F.col("embedding"))
    named = named.select("vec_id", "n_links", "component_id")
    # The others are linked with nothing.
    other = ~(vectors.usable() & (F.size("embedding") == dim))
    apart = vecs.where(other).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    out = apart.unionByName(named)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(runtime.read(spark, sf_dir, "embeddings"))
