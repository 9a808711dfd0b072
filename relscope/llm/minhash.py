"""Near-duplicates by bottom-k sketches of word shingles.

One hash function orders the shingles; a document's sketch is the ``K`` smallest of its
set.  Documents with equal sets form a class at once; the rest runs on one representative
per class:

1. inverted lists of retained values generate candidates.  Linked sets share at least
   :func:`least` of the values in their sketches but for a chance of ``MISS``, so it is
   enough to list each document under all but that many, less one, of its values, the
   rarest ones: common passages fill lists only when a document has little else;
2. the bottom-k of the union of two sketches estimates their similarity and filters;
3. the exact similarity of the full sets verifies.

Only the connected components are wanted, so a list does not emit all its pairs.  First
each member meets the list's most typical one, the one with the most shared values; members
already in one component need no further comparison.  The members of a list that still has
several components meet in tiles, cell by cell, by their sketches alone; a pair counts in
one list only, that of the smallest value that both are listed under.  Texts go to the
cells of those that the union sketches leave over, where their full sets are compared by
products of 0/1 matrices; a cell passes on one link per pair of components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import graphs, runtime
from .shingles import shingle_sets

K = 32
#: Chance that sketches of a linked pair share fewer values than are asked of them.
MISS = 2e-6
#: Documents of a tile, and columns of a 0/1 matrix.
TILE, WIDTH = 256, 8192
#: Pairs that one task verifies with one copy of their common document.
CELL = 64
#: Ids that are broadcast to pick texts: 1 MB; with more, the texts are shuffled.
FEW = 100_000

SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("sketch", pa.list_(pa.int64())), ("text", pa.string())])
SIGNED_DDL = "doc_id long, n_shingles long, set_id binary, sketch array<long>, text string"


def _sets(rows: Iterator[tuple], n: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """Rows, whose last column is a text, with the text's set."""
    held, size = [], 0

    def flush():
        yield from zip(held, shingle_sets([r[-1].encode() for r in held], n), strict=True)

    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > 1_000_000:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _signatures(docs: DataFrame, n: int, k: int) -> DataFrame:
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (doc_id, text), s in _sets(rows, n):
            yield doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s[:k].tolist(), text

    return runtime.with_text(docs).mapInArrow(runtime.by_rows(run, SIGNED, 256), SIGNED_DDL)


@lru_cache(maxsize=8)
def least(k: int, percent: int) -> list[int]:
    """For sketches of 0 to ``k`` values, how many of them a linked pair shares at least.

    Where one set lies within the other, each value of the larger one's sketch is shared with a chance of the
    similarity; other pairs share more.
    """
    p, out = percent / 100, [0]
    for size in range(1, k + 1):
        below, m = 0.0, 0
        while m < size and (below := below + math.comb(size, m) * p**m * (1 - p) ** (size - m)) <= MISS:
            m += 1
        out.append(max(1, m))
    return out


def _needed(n: Column, k: int, percent: int) -> Column:
    """Values that the sketches of linked documents share at least.

    Up to the similarity * k shingles both sketches are whole sets, and that share of the larger is common.
    """
    some = F.element_at(F.array(*map(F.lit, least(k, percent)[1:])), F.greatest(F.lit(1), F.least(n, F.lit(k))).cast("int"))
    return F.when(n * 100 <= k * percent, F.ceil(n * percent / 100)).otherwise(some).cast("int")


def _listed(reps: DataFrame, k: int, percent: int) -> DataFrame:
    """(rep, n, sketch, listed, typical): each representative with the rarest values of its sketch, where others share them."""
    entries = reps.select("rep", "set_id", F.explode("sketch").alias("value"))
    shared = runtime.stored(entries.groupBy("value").agg(F.count("*").alias("c")).where("c > 1"))
    common = entries.join(shared, "value").groupBy("rep", "set_id").agg(F.sort_array(F.collect_list(F.struct("c", "value"))).alias("vs"))
    both = reps.join(common, ["rep", "set_id"])
    # Values of its own stand before all shared ones.
    size = F.least("n", F.lit(k))
    take = F.greatest(F.lit(0), size - _needed(F.col("n"), k, percent) + 1 - (size - F.size("vs"))).cast("int")
    return both.select("rep", "n", "sketch", F.slice(F.transform("vs", lambda v: v["value"]), F.lit(1), take).alias("listed"), F.size("vs").alias("typical"))


def _estimated(pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs that the union sketch doesn't rule out."""
    b = runtime.stored(pairs.join(reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb")), "b"))
    both = graphs.lookup(b, reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na")), "a", "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return both.where(fits & (shared >= F.element_at(F.array(*map(F.lit, least(k, percent)[1:])), F.size(union)))).select("a", "b").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs whose full sets are similar.  ``a`` may be hot: its pairs are spread over cells of ``CELL``."""
    spark = pairs.sparkSession
    cells = runtime.stored(graphs.parts(pairs, "a", "b", CELL)[0].select("a", F.col("part").alias("cell"), "b"))
    members = runtime.stored(cells.withColumn("rep", F.col("b")).unionByName(cells.select("a", "cell").distinct().withColumn("rep", F.col("a")), allowMissingColumns=True))
    needed = members.select("rep").distinct()
    if needed.count() <= FEW:
        texts = texts.join(F.broadcast(needed), "rep")
    placed = members.join(texts, "rep").select("a", "cell", "b", "text")
    placed = placed.repartition(runtime.shards(spark), "a", "cell").sortWithinPartitions("a", "cell", F.col("b").asc_nulls_first())
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, own = None, []
        for (a, cell, b, _), s in _sets(rows, n):
            if (a, cell) != now:
                now, own = (a, cell), []
            if b is None:
                own.append(s)
                continue
            for t in own:
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    yield a, b

    return runtime.stored(placed.mapInArrow(runtime.by_rows(run, schema), "a long, b long").distinct())


def _matches(sets: list[np.ndarray], split: int, percent: int) -> np.ndarray:
    """Which of the first ``split`` sets are similar to which of the others."""
    sizes = np.array([len(x) for x in sets])
    values, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    # Values of one set add to no intersection.
    place = np.cumsum(often > 1) - 1
    shared = often[code] > 1
    owner, code = owner[shared], place[code[shared]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    both = np.zeros((split, len(sets) - split), np.float64)
    for low in range(0, int(place[-1]) + 1, WIDTH):
        a, b = np.searchsorted(code, (low, low + WIDTH))
        part = np.zeros((len(sets), WIDTH), np.float32)
        part[owner[a:b], code[a:b] - low] = 1
        both += part[:split] @ part[split:].T
    return 100 * both >= percent * (sizes[:split, None] + sizes[None, split:] - both)


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows, filled up with the largest integer."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), max(width, 1)), np.iinfo(np.int64).max)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def _left_over(value: int, tile: np.ndarray, t: int, u: int, component: np.ndarray, n: np.ndarray, sketch: np.ndarray, listed: np.ndarray, k: int, percent: int) -> np.ndarray:
    """Rows of a cell that have a pair which this list is to judge and the sketches don't rule out."""
    none = np.iinfo(np.int64).max
    one, two = np.flatnonzero(tile == t), np.flatnonzero(tile == u)
    codes, code = np.unique(sketch, return_inverse=True)
    held = np.zeros((len(n), len(codes)), np.float32)
    np.put_along_axis(held, code.reshape(sketch.shape), 1, axis=1)
    if len(codes) and codes[-1] == none:
        held[:, -1] = 0
    bound = np.array(least(k, percent))
    needed = np.where(n * 100 <= k * percent, -(-n * percent // 100), bound[np.minimum(n, k)])
    near = held[one] @ held[two].T >= np.minimum(needed[one][:, None], needed[two][None, :])
    near &= component[one][:, None] != component[two][None, :]
    near &= 100 * np.minimum(n[one][:, None], n[two][None, :]) >= percent * np.maximum(n[one][:, None], n[two][None, :])
    i, j = np.nonzero(near)
    out = np.zeros(len(n), bool)
    for at in range(0, len(i), 8192):
        a, b = one[i[at : at + 8192]], two[j[at : at + 8192]]
        meet = np.where((listed[a][:, :, None] == listed[b][:, None, :]).any(axis=2), listed[a], none).min(axis=1) == value
        a, b = a[meet], b[meet]
        both = np.sort(np.concatenate([sketch[a], sketch[b]], axis=1), axis=1)
        again = np.zeros(both.shape, bool)
        again[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != none)
        place = np.cumsum(~again & (both != none), axis=1)
        shared = (again & (place <= k)).sum(axis=1)
        good = shared >= bound[np.minimum(place[:, -1], k)]
        out[a[good]] = True
        out[b[good]] = True
    return out


MET = pa.schema([("value", pa.int64()), ("t", pa.int32()), ("u", pa.int32()), ("tile", pa.int32()), ("rep", pa.int64()), ("component", pa.int64())])
MET_DDL = "value long, t int, u int, tile int, rep long, component long"


def _remaining(cells: DataFrame, k: int, percent: int) -> DataFrame:
    """Members of cells, by sketches, whose full sets are to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (value, t, u), own in runtime.groups(batches, "value", "t", "u"):
            table = pa.Table.from_batches(own).combine_chunks()
            tile, component, n, rep = (table[c].to_numpy() for c in ("tile", "component", "n", "rep"))
            sketch, listed = (_padded(table[c].chunk(0), k) for c in ("sketch", "listed"))
            keep = _left_over(value, tile, t, u, component, n, sketch, listed, k, percent)
            if keep.any():
                m = keep.sum()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, value)), pa.array(np.full(m, t, np.int32)), pa.array(np.full(m, u, np.int32)), pa.array(tile[keep]), pa.array(rep[keep]), pa.array(component[keep])], schema=MET)

    return cells.mapInArrow(run, MET_DDL)


def _tiled(lists: DataFrame, reps: DataFrame, found: DataFrame, texts: DataFrame, n: int, k: int, percent: int) -> DataFrame:
    """Links between the components of one list, of which all members are compared."""
    spark = lists.sparkSession
    label = lists.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    label = runtime.stored(label.select("value", "rep", F.coalesce("component", "rep").alias("component")))
    several = label.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("c")).where("low < high")
    mixed = runtime.stored(several.select("value", F.ceil(F.col("c") / TILE).cast("int").alias("tiles")))
    placed = graphs.lookup(label, mixed, "value", "rep").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    whole = placed.join(reps.select("rep", "n", "sketch", "listed"), "rep").withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    cells = whole.select("value", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), "tile", "rep", "component", "n", "sketch", "listed")
    cells = cells.repartition(runtime.shards(spark), "value", "t", "u").sortWithinPartitions("value", "t", "u", "tile", "rep")
    left = runtime.stored(_remaining(cells, k, percent).distinct())
    needed = left.select("rep").distinct()
    if needed.count() <= FEW:
        texts = texts.join(F.broadcast(needed), "rep")
    full = left.join(texts, "rep").select("value", "t", "u", "tile", "rep", "component", "text")
    full = full.repartition(runtime.shards(spark), "value", "t", "u").sortWithinPartitions("value", "t", "u", "tile", "rep")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, held = None, []

        def compared() -> Iterator[tuple]:
            one = [h for h in held if h[0] == now[1]]
            two = [h for h in held if h[0] == now[2]]
            if not one or not two:
                return
            seen = set()
            for i, j in np.argwhere(_matches([h[3] for h in one + two], len(one), percent)):
                (_, a, ca, _), (_, b, cb, _) = one[i], two[j]
                if ca != cb and (ca, cb) not in seen:
                    seen |= {(ca, cb), (cb, ca)}
                    yield min(a, b), max(a, b)

        for (value, t, u, tile, rep, component, _), own in _sets(rows, n):
            if (value, t, u) != now:
                if held:
                    yield from compared()
                now, held = (value, t, u), []
            held.append((tile, rep, component, own))
        if held:
            yield from compared()

    return runtime.stored(full.mapInArrow(runtime.by_rows(run, schema), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Documents are linked when 100 * |intersection| >= percent * |union| of their sets of
    ``words``-word shingles; ``component_id`` is the smallest doc_id reachable by links and
    ``kept`` tells whether it is the row's own.  A text with fewer words is one shingle; a
    null text or one without words has none and is linked with nothing.  Rows of equal
    doc_id count as one document, with the links of each of its rows.  A row with a null
    doc_id is linked with nothing; its component_id and kept are null.  An empty table
    gives no rows.  Columns besides doc_id and text are not read.
    """
    spark = runtime.tune(docs.sparkSession)
    signed = runtime.stored(_signatures(docs, words, k))
    nodes = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = runtime.stored(nodes.groupBy("set_id").agg(F.min("doc_id").alias("rep")))
    members = runtime.stored(graphs.lookup(nodes.select("doc_id", "n_shingles", "set_id"), classes, "set_id"))
    # Of the rows that name a class, one: its sketch stands for the set.
    firsts = nodes.select("set_id", F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sketch").join(classes, ["set_id", "rep"])
    reps = runtime.stored(firsts.dropDuplicates(["set_id"]))
    texts = nodes.select(F.col("doc_id").alias("rep"), "text")
    listed = runtime.stored(_listed(reps, k, percent))
    lists = runtime.stored(listed.select(F.explode("listed").alias("value"), "rep", "n", "typical").distinct())
    # Rows of one doc_id in several classes tie these together.
    several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    tied = members.join(F.broadcast(several) if several.count() <= FEW else several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    links = runtime.stored(tied.distinct())

    typical = F.max_by(F.struct("rep", "n"), F.struct("typical", -F.col("rep"))).alias("first")
    leaders = runtime.stored(lists.groupBy("value").agg(typical, F.count("*").alias("c")).where("c > 1").select("value", F.col("first.rep").alias("a"), F.col("first.n").alias("na")))
    fits = F.least("n", "na") * 100 >= F.greatest("n", "na") * percent
    pairs = graphs.lookup(lists, leaders, "value", "rep").where(fits & (F.col("a") != F.col("rep"))).select("a", F.col("rep").alias("b")).distinct()
    candidates = runtime.stored(_estimated(pairs, reps, k, percent))
    links = runtime.stored(links.union(_verified(candidates, texts, words, percent)))
    found = graphs.components(links)
    found = graphs.components(links.union(_tiled(lists, listed, found, texts, words, k, percent)))
    out = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = out.unionByName(signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group: of the rows with its smallest doc_id, that with the smallest text, then by its other columns' hash; rows with a null doc_id stay."""
    gone = near_duplicates(docs, words, percent).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = runtime.stored(gone)
    left = docs.join(F.broadcast(gone) if gone.count() <= FEW else gone, docs.doc_id == gone["_gone"], "left_anti")
    named = left.where("doc_id IS NOT NULL")
    if named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        first = F.min_by(F.struct(*docs.columns), F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*docs.columns)))
        left = left.where("doc_id IS NULL").unionByName(named.groupBy("doc_id").agg(first.alias("_row")).select("_row.*"))
    return left


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(runtime.read(spark, sf_dir, "documents"), words=4)
