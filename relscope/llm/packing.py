"""Best-fit packing of token sequences, planned on the histogram of lengths.

Which sequence a piece goes to depends on its length alone, and lengths run from 1 to the
capacity.  So the plan is made once for the *counts* per length: large items (over a third
of the capacity, at most two fit together) are paired by greedy matching, largest with the
largest that still fits, which leaves as few sequences as any pairing; smaller ones then go
by decreasing length into the tightest gap that takes them.  The plan is a list of
placements of equal pieces on runs of equal sequences; its size depends on the capacity and
not on the number of pieces.  Pieces find their placement by their rank among those of the
same length.  The task that cuts them numbers them per length, and the ranks follow from
the tasks' totals, so pieces and their ids are never shuffled and a common length is no hot
key.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pretoken, runtime, vocab

CAPACITY = 2048
#: Totals by task and length that are broadcast, at most; beyond, pieces are shuffled to them.
FEW = 1_000_000
PART_CHARS = 500_000


class Placement(NamedTuple):
    """Pieces of a length with ranks from ``rank`` on go to as many sequences from ``sequence`` on, at ``offset``."""

    length: int
    rank: int
    count: int
    sequence: int
    offset: int


class _Plan:
    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, dict(histogram)
        self.rank: dict[int, int] = defaultdict(int)
        self.sequences = 0
        self.out: list[Placement] = []
        self.gaps: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.out.append(Placement(length, self.rank[length], count, sequence, offset))
        self.rank[length] += count
        self.left[length] -= count

    def opened(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def free(self, gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if gap not in self.runs:
                insort(self.gaps, gap)
                self.runs[gap] = []
            self.runs[gap].append((sequence, count))

    def take(self, gap: int) -> tuple[int, int]:
        run = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap]
            del self.gaps[bisect_left(self.gaps, gap)]
        return run

    def match_large(self) -> None:
        large = sorted(x for x, n in self.left.items() if 3 * x > self.capacity and n)
        for length in reversed(large):
            while n := self.left[length]:
                at = bisect_left(large, min(length, self.capacity - length) + 1) - 1
                while at >= 0 and self.left[large[at]] < 1 + (large[at] == length):
                    at -= 1
                if at < 0:
                    first = self.opened(n)
                    self.place(length, n, first, 0)
                    self.free(self.capacity - length, first, n)
                    break
                other = large[at]
                n = n // 2 if other == length else min(n, self.left[other])
                first = self.opened(n)
                self.place(length, n, first, 0)
                self.place(other, n, first, length)
                self.free(self.capacity - length - other, first, n)

    def fit_small(self) -> None:
        for length in sorted((x for x, n in self.left.items() if n), reverse=True):
            while n := self.left[length]:
                at = bisect_left(self.gaps, length)
                gap = self.gaps[at] if at < len(self.gaps) else self.capacity
                each = gap // length
                if at < len(self.gaps):
                    first, count = self.take(gap)
                else:
                    count = -(-n // each)
                    first = self.opened(count)
                used = min(count, n // each)
                if used < count and n < each * count and not used:
                    used, each = 1, n
                for k in range(each):
                    self.place(length, used, first, self.capacity - gap + k * length)
                self.free(gap - each * length, first, used)
                if gap == self.capacity and used < count:
                    self.sequences -= count - used
                else:
                    self.free(gap, first + used, count - used)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Placement]:
    """Placements of all pieces, given how many there are of each length (1 to the capacity)."""
    p = _Plan({x: n for x, n in histogram.items() if n}, capacity)
    p.match_large()
    p.fit_small()
    return sorted(p.out)


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("_task", pa.int64()), ("_at", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, _task long, _at long"


def _tokenised(path: str, end: bytes, capacity: int, keep: bool):
    table = pretoken.table_data("tokenizers")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        pretoken.use("tokenizers", table)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        special = vocab.special_pattern(path)
        special_ids = {s: np.array([i], "<u4").tobytes() for s, i in vocab.special_tokens(path).items()}
        ids_of = vocab.PieceIds(vocab.json_as_ranks(path))

        def parts() -> Iterator[tuple]:
            """(document, text, ids that follow it); at a document's end None instead of ids."""
            for doc_id, text in rows:
                at = 0
                for m in special.finditer(text):
                    yield from ((doc_id, p, b"") for p in pretoken.cuts(text[at : m.start()], PART_CHARS))
                    yield doc_id, "", special_ids[m.group()]
                    at = m.end()
                yield from ((doc_id, p, b"") for p in pretoken.cuts(text[at:], PART_CHARS))
                yield doc_id, "", None

        def gathered() -> Iterator[list]:
            held, size = [], 0
            for x in parts():
                held.append(x)
                size += len(x[1]) + 1
                if size > 1_000_000:
                    yield held
                    held, size = [], 0
            yield held

        ids: list[bytes] = []
        for held in gathered():
            pieces, counts = pretoken.split_batch([x[1] for x in held], "tokenizers")
            edges = np.concatenate([[0], np.cumsum(counts)]).tolist()
            for k, (doc_id, _, also) in enumerate(held):
                ids += map(ids_of.__getitem__, pieces[edges[k] : edges[k + 1]])
                if also is not None:
                    ids.append(also)
                    continue
                whole = b"".join([*ids, end])
                ids = []
                n = len(whole) // 4
                first = (n - 1) % capacity + 1
                for piece, to in enumerate(range(first, n + 1, capacity)):
                    start = max(0, to - capacity) if piece else 0
                    own = whole[4 * start : 4 * to]
                    yield doc_id, piece, start, to - start, zlib.crc32(own), own if keep else None, task, int(seen[to - start])
                    seen[to - start] += 1
            ids_of.trim()

    return run


def cut_documents(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Every document's ids and ``end_id``; those longer than the capacity in pieces, the first of which may be shorter.

    ``_task`` and ``_at`` number the pieces of a length for :func:`packed`; they hold once the table is stored.
    """
    runtime.tune(docs.sparkSession)
    run = _tokenised(path, np.array([end_id], "<u4").tobytes(), capacity, keep_ids)
    return runtime.with_text(docs).mapInArrow(runtime.by_rows(run, PIECES), PIECES_DDL)


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` (from 0) and ``offset``, for a stored table of :func:`cut_documents`.

    Pieces of equal length are interchangeable; equal rows differ in their place only.
    """
    totals = runtime.stored(pieces.groupBy("_task", "length").agg(F.count("*").alias("_n")))
    # A length's totals are a row per task, of three numbers each.
    base = totals.withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_task")) - F.col("_n")).drop("_n")
    # At most as many rows as the capacity.
    placements = plan({r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("_n").alias("n")).collect()}, capacity)
    columns = np.array(placements, np.int64).reshape(-1, 5)
    span = np.int64(1) << 50
    key = columns[:, 0] * span + columns[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            length, rank = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(key, length * span + rank, "right") - 1
            table = table.drop_columns(["_rank"])
            table = table.append_column("sequence_id", pa.array(columns[at, 3] + rank - columns[at, 1]))
            yield from table.append_column("offset", pa.array(columns[at, 4])).to_batches()

    ranked = pieces.join(F.broadcast(base) if totals.count() <= FEW else base, ["length", "_task"])
    names = [c for c in pieces.columns if c not in ("_task", "_at")]
    ranked = ranked.select(*names, (F.col("_base") + F.col("_at")).alias("_rank"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*names).schema.fields)
    return ranked.mapInArrow(place, f"{ddl}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Packs all documents; one row per piece, with its ids unless ``keep_ids`` is false.

    A null text counts as empty and makes one piece, the end id alone.  Repeated rows, and
    rows with a null doc_id, are packed each on its own; an empty table gives no rows.
    Columns besides doc_id and text are not read.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    pieces = cut_documents(docs, path, 0, capacity, keep_ids)
    return packed(runtime.stored(pieces if keep_ids else pieces.drop("ids")), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(runtime.read(spark, sf_dir, "documents"), keep_ids=False)
