"""WARC archives: a writer in DataFrame operations and a Python data source that reads them.

The writer makes one record per row, a gzip member of its own, so that archives can be read
from any record's offset; Spark's own committer places the files, so a lost executor leaves
no half-written archive.
The reader plans one partition per file, takes record-type and header predicates pushed
down by Spark, parses a record's headers first and passes over the blocks it doesn't need.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from . import runtime

CRLF = "\r\n"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Groups of equal payloads that are broadcast, at most; beyond, pages are shuffled.
FEW = 500_000
#: Records of an archive, at most, so that its size doesn't follow that of a partition.
MOST = 100_000
#: An empty gzip member, which goes between those of records; its bytes as ISO-8859-1.
GAP = gzip.compress(b"", mtime=0).decode("latin-1")

COLUMNS = {
    "record_id": "string",
    "record_type": "string",
    "target_uri": "string",
    "payload_digest": "string",
    "payload_bytes": "long",
    "page_id": "long",
    "refers_to": "long",
    "content_length": "long",
}


def sha1_base32(data: Column) -> Column:
    """SHA-1 in upper-case base32, 4 letters for each 5 hexadecimal digits."""
    digest = F.sha1(data)
    letters = []
    for k in range(8):
        five = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(five, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def with_digests(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every row.

    Among equal payloads of at least ``least`` bytes, the row with the largest page_id is
    the response and the others revisit it; rows with that page_id again are responses too.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", sha1_base32(F.encode("payload", "UTF-8")))
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
    groups = runtime.stored(groups.where("_n > 1").drop("_n"))
    joined = rows.join(F.broadcast(groups) if groups.count() <= FEW else groups, "payload_digest", "left")
    again = F.col("_first").isNotNull() & (F.col("payload_bytes") >= least) & ~F.col("_first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"))


def _id(page_id: Column) -> Column:
    digest = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("none"))))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def record(page_id: str = "page_id") -> Column:
    """A row of :func:`with_digests` as the text of a WARC record, without its closing line ends."""
    response = F.col("record_type") == "response"
    block = F.when(response, F.concat(F.lit(HTTP), F.col("payload"))).otherwise(F.lit(HTTP))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"))
    clean = F.regexp_replace("url", r"[\x00-\x1f\x7f]", " ")
    head = F.concat_ws(
        CRLF,
        F.lit("WARC/1.0"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _id(F.col(page_id))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes")),
        line("WARC-Page-ID", F.col(page_id)),
        F.when(~response, line("WARC-Refers-To", _id(F.col("refers_to")))),
        F.when(~response, line("WARC-Refers-To-Page-ID", F.col("refers_to"))),
        F.when(~response, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", F.octet_length(block)),
    )
    return F.concat(head, F.lit(CRLF + CRLF), block)


def _members(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Records as gzip members; those of equal records are equal, so a task that runs again writes the same."""
    for (data,) in rows:
        yield (gzip.compress(data + b"\r\n\r\n", 6, mtime=0),)


def write(pages: DataFrame, path: str, least: int = 0, most: int = MOST) -> None:
    """Writes archives of at most ``most`` gzipped records, one or more per task, of (page_id, url, html) rows."""
    runtime.tune(pages.sparkSession)
    records = with_digests(pages, least).select(record().cast("binary").alias("value"))
    members = records.mapInArrow(runtime.by_rows(_members, pa.schema([("value", pa.binary())]), runtime.BATCH_ROWS), "value binary")
    # The text writer puts down the bytes of strings as they are.
    writer = members.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", GAP)
    writer.option("compression", "none").option("maxRecordsPerFile", most).text(path)


@dataclass
class File(InputPartition):
    path: str


def _open(path: str):
    """A file of any store that pyarrow reaches, or a local one."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    raw = io.BufferedReader(store.open_input_stream(inner, compression=None), 1 << 20)
    return gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


def _files(path: str) -> list[str]:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(inner))
    scheme = path[: path.index(inner)] if inner in path else "file://"
    return [scheme + f.path for f in found if f.type == fs.FileType.File and not re.match(r"[_.]", f.base_name)]


def _line(stream, held: bytearray) -> bytes | None:
    while (at := held.find(b"\n")) < 0:
        more = stream.read(1 << 16)
        if not more:
            return None
        held += more
    line = bytes(held[:at])
    del held[: at + 1]
    return line.rstrip(b"\r")


def _block(stream, held: bytearray, length: int, wanted: bool) -> bytes:
    """The next bytes, if they are wanted; else they are passed over."""
    out = bytes(held[:length]) if wanted else b""
    left = length - min(length, len(held))
    del held[:length]
    parts = [out]
    while left:
        more = stream.read(min(left, 1 << 20))
        if not more:
            raise EOFError("the archive ends within a record")
        left -= len(more)
        if wanted:
            parts.append(more)
    return b"".join(parts)


def records(stream, keep, payload: bool) -> Iterator[tuple]:
    """Rows of an archive whose headers ``keep`` accepts."""
    held = bytearray()
    while (line := _line(stream, held)) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        head: dict[str, str] = {}
        while line := _line(stream, held):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            head[name.lower()] = value.strip()
        length = int(head["content-length"])
        number = lambda name: int(head[name]) if name in head else None  # noqa: E731, B023
        row = (
            head.get("warc-record-id"),
            head.get("warc-type"),
            head.get("warc-target-uri"),
            head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            number("warc-payload-length"),
            number("warc-page-id"),
            number("warc-refers-to-page-id"),
            length,
        )
        wanted = keep(dict(zip(COLUMNS, row, strict=True)))
        block = _block(stream, held, length, wanted and payload)
        if wanted:
            yield (*row, block.partition(b"\r\n\r\n")[2] if row[1] == "response" else None) if payload else row


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload, self.filters = options["path"], options.get("payload", "true").lower() == "true", []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in COLUMNS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [File(p) for p in _files(self.path)]

    def keep(self, row: dict) -> bool:
        for f in self.filters:
            value = row[f.attribute[0]]
            if value is None:
                return False
            if isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value or isinstance(f, StringStartsWith) and not value.startswith(f.value):
                return False
        return True

    def read(self, partition: File) -> Iterator[tuple]:
        if partition.path:
            with _open(partition.path) as stream:
                yield from records(stream, self.keep, self.payload)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; option ``payload`` false leaves blocks alone."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        columns = COLUMNS | ({"payload": "binary"} if self.options.get("payload", "true").lower() == "true" else {})
        return ", ".join(f"{n} {t}" for n, t in columns.items())

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives in a folder, which executors must reach by its path."""
    runtime.tune(spark).conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, from the archives: the digest of what was read for responses, that of the header for revisits.

    A null html counts as an empty payload; a null page_id revisits and is never revisited
    unless it is alone, and stays null; an empty table gives no rows.
    """
    path = f"{runtime.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(runtime.read(spark, sf_dir, "pages"), path)
    return read_back(spark, path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records in a folder, the digests of responses made from what was read.

    Responses are read with their payload, revisits by their headers alone; the source gets both conditions.
    """
    responses = read(spark, path).where("record_type = 'response'")
    responses = responses.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"), "record_type", "refers_to")
    revisits = read(spark, path, payload=False).where("record_type = 'revisit'")
    return responses.unionByName(revisits.select(*responses.columns))
