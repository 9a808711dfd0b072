"""Lines that several documents share, by two Bloom filters.

1. Each task puts the digests of its lines into filters of its own: *once* for those met, *twice*
   for those met again.  Merged filters have (once | once', twice | twice' | once & once'), segment by
   segment; a segment holds a share of the digests and some 16 bits for each of its lines.
2. A second pass looks every line up in the *twice* filter.  Only lines found there, the
   suspected repeats, are shuffled, as digests: the smallest and the largest doc_id of each tell
   whether two documents hold it, and which is first.  What one document alone holds drops out.
3. A third pass leaves out the repeats.

A digest is the SHA-256 of a line's key.  Filters and repeats of a checked size go to the tasks; beyond
it digests meet their segment of the filter, and texts their list of repeats, by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graphs, runtime

#: Bits of a segment, bits that a digest sets in it, and lines that a segment is meant for.
SEGMENT, HASHES, LINES = 1 << 20, 4, 1 << 16
#: Digests that a task holds before it sends them as filters.
HELD = 1 << 20
#: Segments of the filter (128 KB each) and repeats (40 bytes each) that go to tasks, at most.
SEGMENTS, FEW = 512, 500_000
SPACE = b" \t\n\x0b\x0c\r"

FILTERS = pa.schema([("segment", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])
FILTERS_DDL = "segment long, once binary, twice binary"
SUSPECTED = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary())])
ASKED = pa.schema([("segment", pa.int64()), ("role", pa.int32()), ("doc_id", pa.int64()), ("digest", pa.binary())])
ASKED_DDL = "segment long, role int, doc_id long, digest binary"
KEPT = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
KEPT_DDL = "doc_id long, text binary, n_lines long, n_dropped long"


def key_of(line: bytes, least: int) -> bytes | None:
    """A line's key; none if it is shorter than ``least`` code points."""
    key = line.strip(SPACE).lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


def digests_of(text: bytes, least: int) -> list[bytes]:
    """Distinct digests of the text's keys."""
    keys = {key_of(line, least) for line in text.split(b"\n")}
    return [hashlib.sha256(k).digest() for k in keys if k is not None]


def numbers(digests: list[bytes]) -> np.ndarray:
    """Digests as four numbers each."""
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)


def places(found: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """A digest's segment, and the bits it sets there."""
    step = (found[:, 1] >> np.uint64(20)) | np.uint64(1)
    return (found[:, 0] % np.uint64(segments)).astype(np.int64), ((found[:, 1, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(SEGMENT)).astype(np.int64)


def _bitmap(bits: np.ndarray) -> np.ndarray:
    out = np.zeros(SEGMENT, bool)
    out[bits.ravel()] = True
    return np.packbits(out)


def _filters(segments: int, least: int):
    """A task's filters, a row per segment that it touches."""

    def emitted(held: list[bytes]) -> Iterator[tuple]:
        found = Counter(held)
        times = np.array(list(found.values()))
        segment, bits = places(numbers(list(found)), segments)
        order = np.argsort(segment, kind="stable")
        edges = np.searchsorted(segment[order], np.arange(segments + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[s] : edges[s + 1]]
            again = own[times[own] > 1]
            yield s, runtime.pack(_bitmap(bits[own])), runtime.pack(_bitmap(bits[again])) if len(again) else None

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[bytes] = []
        for (text,) in rows:
            held += digests_of(text, least)
            if len(held) >= HELD:
                yield from emitted(held)
                held = []
        if held:
            yield from emitted(held)

    return runtime.by_rows(run, FILTERS, 64)


def _merged(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Filters of one segment after the other, merged as they come."""
    now, once, twice = None, None, None
    for segment, o, t in rows:
        if segment != now:
            if now is not None and twice.any():
                yield now, None, runtime.pack(twice)
            now, once, twice = segment, np.zeros(SEGMENT // 8, np.uint8), np.zeros(SEGMENT // 8, np.uint8)
        own = runtime.unpack(o)
        twice |= once & own
        once |= own
        if t is not None:
            twice |= runtime.unpack(t)
    if now is not None and twice.any():
        yield now, None, runtime.pack(twice)


def _within(filter_bytes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether a filter has all bits of a row."""
    return ((filter_bytes[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8)) & 1).all(axis=1)


def twice_seen(docs: DataFrame, least: int, lines: int) -> tuple[DataFrame, int]:
    """(segment, twice) of the merged filter, as a stored table, and the number of segments, those without a repeat included."""
    segments = max(1, -(-lines // LINES))
    own = docs.select("text").mapInArrow(_filters(segments, least), FILTERS_DDL)
    placed = own.repartition(runtime.shards(docs.sparkSession), "segment").sortWithinPartitions("segment")
    return runtime.stored(placed.mapInArrow(runtime.by_rows(_merged, FILTERS, 16), FILTERS_DDL).select("segment", "twice")), segments


def _suspected(filters: dict[int, bytes], segments: int, least: int):
    """Lines of documents that a filter at hand has."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = np.zeros((segments, SEGMENT // 8), np.uint8)
        for s, twice in filters.value.items():
            own[s] = runtime.unpack(twice)
        own = own.ravel()
        for doc_id, text in rows:
            digests = digests_of(text, least)
            if digests:
                segment, bits = places(numbers(digests), segments)
                for at in np.flatnonzero(_within(own, segment[:, None] * SEGMENT + bits)).tolist():
                    yield doc_id, digests[at]

    return runtime.by_rows(run, SUSPECTED)


def _asking(segments: int, least: int):
    """All lines' digests with their segments."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            digests = digests_of(text, least)
            if digests:
                for d, s in zip(digests, places(numbers(digests), segments)[0].tolist(), strict=True):
                    yield s, 1, doc_id, d

    return runtime.by_rows(run, ASKED)


def _answering(segments: int):
    """Digests of a segment, whose filter comes first, that the filter has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, twice = None, None
        for (segment, role), own in runtime.groups(batches, "segment", "role"):
            if not role:
                now, twice = segment, runtime.unpack(own[0]["digest"][0].as_py())
            elif segment == now:
                for batch in own:
                    bits = places(numbers(batch["digest"].to_pylist()), segments)[1]
                    some = pa.array(_within(twice, bits))
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].filter(some), batch["digest"].filter(some)], schema=SUSPECTED)

    return run


def _left(repeats, least: int):
    """Texts without the lines of their repeats: those of all documents, or a list beside each text."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        first = dict(zip(*repeats.value, strict=True)) if repeats else None
        for doc_id, text, *listed in rows:
            lines = text.split(b"\n")
            own = set(listed[0] or ()) if listed else None
            kept = []
            for line in lines:
                key = key_of(line, least) if own or first else None
                if key is not None:
                    digest = hashlib.sha256(key).digest()
                    if digest in own if listed else doc_id is not None and doc_id > first.get(digest, doc_id):
                        continue
                kept.append(line)
            yield doc_id, b"\n".join(kept), len(lines), len(lines) - len(kept)

    return runtime.by_rows(run, KEPT, 64)


def without_repeats(docs: DataFrame, least: int = 10, segments: int = SEGMENTS, few: int = FEW) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every row's text without the lines that an earlier document has.

    Lines end at \\n; a line's key has spaces (0x20, 0x09 to 0x0D) stripped and A-Z lower-cased.  A key of ``least`` code points or
    more that two documents hold stays in that of the smallest doc_id, as often as it is there, and goes from all others; lines
    of shorter keys stay.  A null or empty text is one empty line.  A row without a doc_id is no
    document: it keeps its lines and makes none a repeat.  Rows of one doc_id are one document, and each comes
    back.  An empty table gives no rows.  Columns besides doc_id and text are not read.  At most
    ``segments`` of the filter and ``few`` repeats go to the tasks whole.
    """
    spark = runtime.tune(docs.sparkSession)
    docs = runtime.with_text(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    known = docs.where("doc_id is not null")
    text = F.col("text").cast("string")
    lines = known.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)).first()[0] or 0
    filters, n = twice_seen(known, least, lines)
    if n <= segments:
        own = spark.sparkContext.broadcast({r["segment"]: bytes(r["twice"]) for r in filters.collect()})
        suspected = known.mapInArrow(_suspected(own, n, least), "doc_id long, digest binary")
    else:
        asked = known.mapInArrow(_asking(n, least), ASKED_DDL)
        asked = filters.select("segment", F.lit(0).alias("role"), F.lit(None).cast("long").alias("doc_id"), F.col("twice").alias("digest")).unionByName(asked)
        placed = asked.repartition(runtime.shards(spark), "segment").sortWithinPartitions("segment", "role")
        suspected = placed.mapInArrow(_answering(n), "doc_id long, digest binary")
    suspected = runtime.stored(suspected)
    firsts = suspected.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    repeats = runtime.stored(firsts.where(F.col("first") < F.col("last")).select("digest", "first"))
    if repeats.count() <= few:
        found = repeats.collect()
        own = spark.sparkContext.broadcast(([bytes(r["digest"]) for r in found], [r["first"] for r in found]))
        out = docs.mapInArrow(_left(own, least), KEPT_DDL)
    else:
        drops = graphs.lookup(suspected, repeats, "digest", "doc_id").where(F.col("doc_id") > F.col("first"))
        drops = drops.groupBy("doc_id").agg(F.collect_set("digest").alias("digests"))
        out = docs.join(drops, "doc_id", "left").select("doc_id", "text", "digests").mapInArrow(_left(None, least), KEPT_DDL)
    return out.withColumn("text", F.col("text").cast("string"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(runtime.read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def oracle() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
parts as (select r, doc_id, string_split(text, chr(10)) as lines from docs),
lines as (select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from parts),
keyed as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{upper}', '{upper.lower()}') as key from lines),
repeats as (select key, min(doc_id) as first from keyed where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
judged as (select k.*, coalesce(k.doc_id > p.first, false) as gone from keyed k left join repeats p using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256
from judged group by r, doc_id"""
