"""Sparse document-by-key counts in blocks, joined to a value per key.

A join of (document, key, frequency) rows to a table of values by key would shuffle one
row per document and key.  Here documents are gathered into blocks with a dictionary of
their own, so only a block's *distinct* keys travel:

1. each task packs its documents into blocks: one row with the documents' sparse counts
   over the block's dictionary, and one row of dictionary keys per shard of the keys;
2. each shard of the keys answers with a value per dictionary entry;
3. the answers meet their block again, and each document's sum is a dot product.

A key comes at most once per block, so a very common key is no hot key; a block holds a
bounded amount of text; no step collects anything on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

BLOCKS = pa.schema([("block", pa.string()), ("shard", pa.int32()), ("data", pa.binary())])
#: Shard number of the rows that hold counts; dictionary rows have their keys' shard.
COUNTS = -1


class Counts(NamedTuple):
    """One block: per document an identity and what to add to its sum; its counts by (owner, code)."""

    ids: list
    extra: list
    owner: np.ndarray
    code: np.ndarray
    freq: np.ndarray
    keys: np.ndarray


def sparse(owner: np.ndarray, code: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, frequency) of equal pairs."""
    pair, freq = np.unique(owner.astype(np.int64) * max(n_keys, 1) + code, return_counts=True)
    return (pair // max(n_keys, 1)).astype(np.uint32), (pair % max(n_keys, 1)).astype(np.uint32), freq


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """A key's shard, the same on every executor."""
    return (pd.util.hash_array(keys, categorize=False) % np.uint64(shards)).astype(np.int64)


def _planes(a: np.ndarray) -> np.ndarray:
    """Bytes by significance: zstd packs such planes well."""
    return np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4).T.copy()


def _whole(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a.T).view("<u4").ravel().astype(np.int64)


def _steps(code: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Codes that rise within each owner, as differences: small numbers."""
    steps = np.diff(code.astype(np.int64), prepend=0)
    first = (np.cumsum(by) - by)[by > 0]
    steps[first] = code[first]
    return steps


def _codes(steps: np.ndarray, by: np.ndarray) -> np.ndarray:
    upto = np.cumsum(steps)
    by = by[by > 0]
    first = np.cumsum(by) - by
    return upto - np.repeat(upto[first] - steps[first], by)


def _keys(keys: np.ndarray) -> tuple:
    """Sorted keys, strings as one."""
    if keys.dtype != object:
        return "numbers", np.diff(keys, prepend=0)
    keys = keys.tolist()
    return ("strings", "\0".join(keys)) if not any("\0" in k for k in keys) else ("list", keys)


def keys_of(data: tuple) -> list | np.ndarray:
    kind, keys = data
    return np.cumsum(keys) if kind == "numbers" else keys.split("\0") if kind == "strings" else keys


def packed(docs: DataFrame, extract: Callable[[Iterator[tuple]], Iterator[Counts]], shards: int) -> DataFrame:
    """Block rows of the documents; ``extract`` makes Counts of a task's rows.

    A block's codes follow the order of shard and key, so a shard's keys are a range of them.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        task = TaskContext.get().partitionId()
        for n, c in enumerate(extract(rows)):
            block = f"{task}-{n}"
            shard = shard_of(c.keys, shards) if len(c.keys) else np.zeros(0, np.int64)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1)).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = order[a:b]
                order[a:b] = own[np.argsort(c.keys[own])] if c.keys.dtype != object else sorted(own.tolist(), key=c.keys.__getitem__)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            code = place[c.code]
            rise = np.lexsort((code, c.owner))
            by = np.bincount(c.owner, minlength=len(c.ids))
            yield block, COUNTS, runtime.pack((c.ids, c.extra, by, _planes(_steps(code[rise], by)), _planes(c.freq[rise]), len(c.keys)))
            for s in np.flatnonzero(np.diff(edges)).tolist():
                yield block, s, runtime.pack((_keys(c.keys[order[edges[s] : edges[s + 1]]]), edges[s]))

    return docs.mapInArrow(runtime.by_rows(run, BLOCKS, 16), "block string, shard int, data binary")


def answered(blocks: DataFrame, extra: DataFrame | None, answer: Callable[[Iterator[tuple]], Iterator[tuple]], shards: int) -> DataFrame:
    """(block, shard, data) answers; ``answer`` gets a shard's rows, those of ``extra`` first.

    ``extra``, if given, has rows (block '', shard, data), the values to look up.
    """
    asked = blocks.where(F.col("shard") != COUNTS)
    asked = asked if extra is None else asked.unionByName(extra)
    placed = asked.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "block")
    return placed.mapInArrow(runtime.by_rows(answer, BLOCKS, 16), "block string, shard int, data binary")


def summed(blocks: DataFrame, answers: DataFrame, shards: int, finish: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """One row per document: ``finish(id, extra, sum, n)``, with the sum of values and of frequencies."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []
        for _, shard, data in rows:
            if shard != COUNTS:
                held.append(runtime.unpack(data))
                continue
            ids, extra, by, code, freq, n_keys = runtime.unpack(data)
            value = np.zeros(n_keys)
            for at, v in held:
                value[at : at + len(v)] = v
            held = []
            owner, freq = np.repeat(np.arange(len(ids)), by), _whole(freq).astype(float)
            total = np.bincount(owner, freq * value[_codes(_whole(code), by)], len(ids)) if n_keys else np.zeros(len(ids))
            n = np.bincount(owner, freq, len(ids)) if n_keys else np.zeros(len(ids))
            yield from (finish(*x) for x in zip(ids, extra, total.tolist(), n.tolist(), strict=True))

    both = blocks.where(F.col("shard") == COUNTS).unionByName(answers)
    placed = both.repartition(shards, "block").sortWithinPartitions("block", F.desc("shard"))
    return placed.mapInArrow(runtime.by_rows(run, schema), ddl)
