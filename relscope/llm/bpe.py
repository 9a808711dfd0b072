"""Byte-level BPE encoding in overlapping chunks, and decoding.

Texts up to a chunk's length are encoded where they are read.  Longer ones are cut into
chunks that overlap; each chunk is pre-tokenised on its own, from a start that may lie
within a pre-token.  Where the pre-token boundaries of two neighbours agree within their
overlap, both scans go on alike from there: the texts between such places are encoded
apart, and their ids in a row are those of the whole text.  A boundary after white space is
never used, since the pattern looks ahead there.  Where neighbours don't agree (one
pre-token as long as the overlap), they become one longer chunk, which is scanned again
and meets the next one; cutting resumes there.
Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pretoken, runtime, vocab

#: Characters of a chunk and of the overlap that follows it.
CHUNK, OVERLAP = 32_768, 1_024
#: At a chunk's end the scan lacks what follows: its last boundaries count for nothing.
BLIND = 8
#: Times that chunks are joined at most; then the rest of such a text is encoded in one piece.
ROUNDS = 6

SEGMENTS = pa.schema([("key", pa.string()), ("doc_id", pa.int64()), ("copies", pa.int64()), ("segment", pa.int64()), ("ids", pa.binary())])
SEGMENTS_DDL = "key string, doc_id long, copies long, segment long, ids binary"


def _encoded(path: str):
    """(key, doc_id, copies, segment, text) to the same with ids for the text."""
    table = pretoken.table_data("tiktoken")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        pretoken.use("tiktoken", table)
        ids_of = vocab.PieceIds(vocab.rank_encoding(path))
        for heads, texts in pretoken.batches(((tuple(head), text) for *head, text in rows), 1_000_000):
            pieces, counts = pretoken.split_batch(texts, "tiktoken")
            at = 0
            for head, n in zip(heads, counts.tolist(), strict=True):
                yield *head, b"".join(map(ids_of.__getitem__, pieces[at : at + n]))
                at += n
            ids_of.trim()

    return run


CHUNKS = pa.schema([("key", pa.string()), ("doc_id", pa.int64()), ("copies", pa.int64()), ("n", pa.int64()), ("span", pa.int64()), ("text", pa.string()), ("last", pa.bool_())])
CHUNKS_DDL = "key string, doc_id long, copies long, n long, span long, text string, last boolean"


def _chunks(chunk: int, overlap: int):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, doc_id, copies, text in rows:
            last = max(0, len(text) - overlap - 1) // chunk
            for n in range(last + 1):
                yield key, doc_id, copies, n, 1, text[n * chunk :] if n == last else text[n * chunk : (n + 1) * chunk + overlap], n == last

    return run


SCANNED = pa.schema([*CHUNKS, ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])
SCANNED_DDL = CHUNKS_DDL + ", head array<long>, tail array<long>"


def _scan(chunk: int, overlap: int):
    """Adds the boundaries in the overlap with the chunk before and with the one after, as places in the text."""
    table = pretoken.table_data("tiktoken")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        pretoken.use("tiktoken", table)
        for key, doc_id, copies, n, span, text, last in rows:
            at = pretoken.boundaries(text, "tiktoken")
            at = at[at > 0]
            solid = pretoken.class_table("tiktoken")[pretoken.code_points(text)[at - 1]] != pretoken.WHITE
            at = at[solid & (last | (at <= len(text) - BLIND))]
            place = at + n * chunk
            yield key, doc_id, copies, n, span, text, last, place[at < overlap].tolist() if n else [], place[at >= span * chunk].tolist() if not last else []

    return run


def _met(scanned: DataFrame) -> DataFrame:
    """(key, n, at, end): chunk ``n`` meets chunk ``at`` at ``end``, null where they have no boundary in common; stored."""
    tails = scanned.where(~F.col("last")).select("key", "n", (F.col("n") + F.col("span")).alias("at"), "tail")
    heads = scanned.where("n > 0").select("key", F.col("n").alias("at"), "head")
    return runtime.stored(tails.join(heads, ["key", "at"]).select("key", "n", "at", F.array_min(F.array_intersect("tail", "head")).alias("end")))


def _joined(scanned: DataFrame, met: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """The chunks, those that have no boundary in common with the next ones joined to these and scanned again; stored."""
    failing = met.where("end IS NULL").select("key", F.col("at").alias("n"), F.lit(True).alias("on"))
    # A text has few chunks, and their texts stay out of the window.
    chunks = scanned.select("key", "n").join(failing.select("key").distinct(), "key").join(failing, ["key", "n"], "left")
    by_place = Window.partitionBy("key").orderBy("n")
    runs = chunks.withColumn("first", F.last(F.when(F.col("on").isNull(), F.col("n")), ignorenulls=True).over(by_place))
    whole = Window.partitionBy("key", "first")
    runs = runs.withColumn("ends", F.max("n").over(whole)).where("first < ends").select("key", "n", "first", "ends")
    parts = scanned.join(runs, ["key", "n"])
    own = F.when(F.col("n") == F.col("ends"), F.col("text")).otherwise(F.col("text").substr(F.lit(1), (F.col("span") * chunk).cast("int")))
    texts = F.array_sort(F.collect_list(F.struct("n", own.alias("text"))))
    joined = parts.groupBy("key", "doc_id", "copies", F.col("first").alias("n")).agg(F.sum("span").alias("span"), F.array_join(F.transform(texts, lambda x: x["text"]), "").alias("text"), F.max("last").alias("last"))
    again = joined.mapInArrow(runtime.by_rows(_scan(chunk, overlap), SCANNED, 16), SCANNED_DDL)
    return runtime.stored(scanned.join(runs.select("key", "n"), ["key", "n"], "left_anti").select(*SCANNED.names).unionByName(again))


def _long_segments(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, doc_id, copies, segment, text) of texts longer than a chunk."""
    # Equal rows are encoded once; the key is theirs alone.
    rows = docs.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    rows = runtime.stored(rows.select(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"), 256).alias("key"), "doc_id", "copies", "text"))
    chunks = rows.mapInArrow(runtime.by_rows(_chunks(chunk, overlap), CHUNKS, 16), CHUNKS_DDL)
    spread = chunks.repartition(runtime.shards(docs.sparkSession), "key", "n")
    scanned = runtime.stored(spread.mapInArrow(runtime.by_rows(_scan(chunk, overlap), SCANNED, 16), SCANNED_DDL))
    met = _met(scanned)
    for _ in range(ROUNDS):
        if not met.where("end IS NULL").take(1):
            break
        scanned = _joined(scanned, met, chunk, overlap)
        met = _met(scanned)
    # From the first pair still without a common boundary on, the text stays in one piece.
    apart = met.where("end IS NULL").groupBy("key").agg(F.min("n").alias("apart"))
    ends = met.join(apart, "key", "left").where("apart IS NULL OR n < apart").select("key", "n", "at", "end")
    starts = ends.select("key", F.col("at").alias("n"), F.col("end").alias("start"))
    ends = ends.drop("at")
    base = F.col("n") * chunk
    cut = scanned.drop("head", "tail").join(ends, ["key", "n"], "left").join(starts, ["key", "n"], "left").join(apart, "key", "left")
    length = F.coalesce(F.col("end") - base, F.length("text").cast("long")) - F.coalesce(F.col("start") - base, F.lit(0))
    own = F.col("text").substr((F.coalesce(F.col("start") - base, F.lit(0)) + 1).cast("int"), length.cast("int"))
    whole = cut.where("apart IS NULL OR n < apart").select("key", "doc_id", "copies", F.col("n").alias("segment"), own.alias("text"))
    rest = rows.join(apart.join(starts.withColumnRenamed("n", "apart"), ["key", "apart"], "left"), "key")
    rest = rest.select("key", "doc_id", "copies", F.col("apart").alias("segment"), F.expr("substring(text, CAST(coalesce(start, 0) + 1 AS INT))").alias("text"))
    return whole.unionByName(rest)


def encode_apart(docs: DataFrame, path: str | None = None, chunk: int | None = None, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """What :func:`encode` returns, texts in one segment and longer ones apart."""
    runtime.tune(docs.sparkSession)
    path, chunk = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), chunk or CHUNK
    texts = runtime.with_text(docs)
    short = texts.where(F.length("text") <= chunk).select(F.lit(None).cast("string").alias("key"), "doc_id", F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("segment"), "text")
    long = _long_segments(texts.where(F.length("text") > chunk), chunk, overlap).repartition(runtime.shards(docs.sparkSession), "key", "segment")
    run = runtime.by_rows(_encoded(path), SEGMENTS, 256)
    return short.mapInArrow(run, SEGMENTS_DDL), long.mapInArrow(run, SEGMENTS_DDL)


def encode(docs: DataFrame, path: str | None = None, chunk: int | None = None, overlap: int = OVERLAP) -> DataFrame:
    """Ids of every text, as tiktoken's ``encode_ordinary`` gives them, in segments.

    Returns (key, doc_id, copies, segment, ids): ``ids`` are little-endian unsigned 32-bit
    integers, and those of one key in the order of ``segment`` belong to one text.  ``key``
    is null for a text in one segment.  ``copies`` tells how many equal rows it stands for.
    A null text counts as empty; a null doc_id stays null; an empty table gives no rows.
    Columns besides doc_id and text are not read.
    """
    short, long = encode_apart(docs, path, chunk, overlap)
    return short.unionByName(long)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``bytes``, what the ids of each segment stand for."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    schema = pa.schema([*SEGMENTS, ("bytes", pa.binary())])

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        core = vocab.rank_encoding(path)._core_bpe
        for row in rows:
            yield *row, core.decode_bytes(np.frombuffer(row[-1], "<u4").tolist())

    return encoded.select(*SEGMENTS.names).mapInArrow(runtime.by_rows(run, schema, 256), SEGMENTS_DDL + ", bytes binary")


DIGESTS = pa.schema([("doc_id", pa.int64()), ("copies", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DIGESTS_DDL = "doc_id long, copies long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Digests of texts from their segments in a row; holds one segment at a time."""
    now = None
    for key, doc_id, copies, _, ids, data in rows:
        if now is None or now[0] != key:
            if now:
                yield *now[1:4], now[4].hexdigest(), now[5].hexdigest()
            now = [key, doc_id, copies, 0, hashlib.sha256(), hashlib.sha256()]
        now[3] += len(ids) // 4
        now[4].update(ids)
        now[5].update(data)
    if now:
        yield *now[1:4], now[4].hexdigest(), now[5].hexdigest()


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A filter wouldn't pass the Python steps: each branch encodes its own texts only.
    short, long = encode_apart(runtime.read(spark, sf_dir, "documents"))
    single = decode(short).select("doc_id", "copies", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
    placed = decode(long).repartition(runtime.shards(spark), "key").sortWithinPartitions("key", "segment")
    both = single.unionByName(placed.mapInArrow(runtime.by_rows(_digest, DIGESTS), DIGESTS_DDL))
    return both.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.explode(F.expr("sequence(1L, copies)")).alias("_copy")).drop("_copy")
