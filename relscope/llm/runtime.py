"""Session helpers: the shared folder, cut lineage, small Arrow batches."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches that reach Python workers: rows and bytes at most.  Rows hold whole texts.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches, so that a worker's memory doesn't follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; one of our own where it is unset and Spark runs on this machine alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = own.get() if own.isDefined() else None
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they share")
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="relscope-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where


def stored(df: DataFrame, *partitioned_by: str) -> DataFrame:
    """The frame written as a table in the shared folder and read again: cuts its lineage.

    A lost executor costs no more than the tasks that read the table.  The table stays
    until it is :func:`released` or the folder is emptied, as frames that read it may still
    be waiting.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/relscope-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partitioned_by:
        writer = writer.partitionBy(*partitioned_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shards(spark: SparkSession) -> int:
    """Shuffle partitions; the cluster sizes them to its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pack(value: Any) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, 5))


def unpack(data: bytes) -> Any:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data, 1 << 31))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def groups(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Rows of batches that are sorted by whole numbers, a value of these at a time."""
    now, held = None, []
    for batch in batches:
        cell = np.array([batch[c].to_numpy() for c in by]).T
        edges = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist(), len(cell)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b == a:
                continue
            if now != tuple(cell[a].tolist()):
                if held:
                    yield now, held
                now, held = tuple(cell[a].tolist()), []
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


def emit(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def emitted(schema: pa.Schema, rows: Iterator[tuple], most: int = 1024) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of bounded length."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield emit(schema, held)
            held = []
    if held:
        yield emit(schema, held)


def by_rows(f: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema, most: int = 1024) -> Callable:
    """A function over tuples as one for ``mapInArrow``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emitted(schema, f(rows_of(batches)), most)

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_text(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, the text with null as empty, and other columns asked for; no more is read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))
