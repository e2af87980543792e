"""Web archives in the WARC format, and an index that finds captures in them.

Archives hold a record a page, uncompressed, written by Spark's text writer: a record
ends with two line breaks, which is what parts lines there. Pages with a payload that a
page of a smaller id has too become ``revisit`` records, which name that page and carry
no payload.

The index has two levels. Keys of reversed hosts (``org,example)/path``) are sorted over
all archives and cut into compressed blocks; a sparse directory holds the first and the
last key of each block. A search finds blocks by binary search in the directory, decodes
those alone, and reads the byte ranges that they name.

Defined results: a null html is an empty payload; a null url has the key of the empty
string and no target in its record; a null page id is never the response that others
refer to, unless no page of the payload has an id, in which case all are responses.
Pages of one payload that share the smallest id are all responses. Payloads under
``LEAST_REVISIT`` bytes are always stored. A repeated row is a record of its own. White
space and control characters of a url are percent-encoded. An empty table gives an empty
archive and index.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.durable import durable, ensure_checkpoint_dir, release

#: Equal payloads of so many bytes are stored once.
LEAST_REVISIT = 100
#: Payloads with copies are broadcast up to so many, some 300 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Captures of a block, and blocks of the directory that a search holds at a time; a larger directory is searched part by part.
BLOCK_ENTRIES, DIRECTORY_ROWS = 1024, 1 << 18
#: Bytes that are read at a time, and of an archive that one task reads.
WINDOW, SECTION = 1 << 20, 8 << 20
BREAK = "\r\n"
ENTRY = "surt string, page_id long, file string, offset long, length long"
CAPTURE = "page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def uri_of(url: Column) -> Column:
    """A url as it stands in a record: white space and control characters percent-encoded, so that it is one line."""
    coded = F.transform(F.regexp_extract_all(url, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c.rlike(r"[\x00-\x20\x7F]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), F.array_join(coded, "")).otherwise(url)


def surt(uri: Column) -> Column:
    """The sort key of a url: its host in lower case and reversed, then path and query; neither scheme, user, port nor fragment."""
    text = F.coalesce(uri, F.lit(""))
    host = F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def _record_id(page_id: Column, uri: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("-")), F.coalesce(uri, F.lit("-")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(BREAK)), F.lit(""))


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives of ``page_id, url, html`` in a new folder, one for each task that reads the pages.

    Payloads are not shuffled: only digests are grouped, and those of payloads with
    copies are joined back, by a broadcast where they are few.
    """
    payload = F.coalesce("html", F.lit(""))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), uri_of(F.col("url")).alias("uri"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    known = given.where((F.col("n") >= LEAST_REVISIT) & F.col("page_id").isNotNull())
    copies = given.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.count("*").alias("copies"))
    first = known.groupBy("digest").agg(F.min(F.struct("page_id", "uri")).alias("first"))
    shared = durable(copies.where("copies > 1").join(first, "digest").select("digest", "first"))
    few = shared.count() <= BROADCAST_ROWS
    joined = given.join(F.broadcast(shared) if few else shared, "digest", "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first.page_id")))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("n").cast("string"), F.lit(BREAK * 2))
    rows = joined.withColumns({"again": again, "head": head})
    record = F.concat(
        F.lit(f"WARC/1.1{BREAK}"),
        _field("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        _field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("uri"), F.col("digest"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("uri")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _field("WARC-Profile", F.when(F.col("again"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _field("WARC-Refers-To", F.when(F.col("again"), _record_id(F.col("first.page_id"), F.col("first.uri"), F.col("digest")))),
        _field("WARC-Refers-To-Target-URI", F.when(F.col("again"), F.col("first.uri"))),
        _field("X-Page-ID", F.col("page_id")),
        _field("X-Refers-To-Page-ID", F.when(F.col("again"), F.col("first.page_id"))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length("head") + F.when(F.col("again"), 0).otherwise(F.col("n"))),
        F.lit(BREAK),
        F.col("head"),
        F.when(F.col("again"), "").otherwise(F.col("payload")),
    )
    rows.select(record.alias("value")).write.option("lineSep", BREAK * 2).text(folder)
    release(shared)


def opened(uri: str) -> pa.NativeFile:
    """A file of the shared folder, for reads of ranges; stores that pyarrow knows: local and mounted ones, hdfs, s3, gs, abfs."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, path = fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else uri)
    return system.open_input_file(path)


class Ranges:
    """Byte ranges of a file; neighbours are read together."""

    def __init__(self, uri: str) -> None:
        self.file = opened(uri)
        self.size = self.file.size()
        self.start, self.held = 0, b""

    def get(self, at: int, length: int) -> bytes:
        if not self.start <= at or at + length > self.start + len(self.held):
            self.start, self.held = at, self.file.read_at(max(0, min(max(length, WINDOW), self.size - at)), at)
        return self.held[at - self.start : at - self.start + length]


def head_at(ranges: Ranges, at: int) -> bytes:
    """The header of the record at an offset, up to and with its empty line."""
    length = 4096
    while (end := (head := ranges.get(at, length)).find(b"\r\n\r\n")) < 0:
        if at + length >= ranges.size:
            raise ValueError(f"no whole record at byte {at}")
        length *= 4
    return head[: end + 4]


def fields(head: bytes) -> dict[str, str]:
    """Names and values of a header whose first line says what it is."""
    return dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split(BREAK)[1:] if line)


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Uri, page id, file, offset and length of each record of the given archives."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            ranges, at, found = Ranges(path), 0, []
            while at < ranges.size:
                head = head_at(ranges, at)
                named = fields(head)
                length = len(head) + int(named["Content-Length"])
                found.append((named.get("WARC-Target-URI"), _number(named.get("X-Page-ID")), path.rsplit("/", 1)[-1], at, length))
                at += length + 4
                if len(found) >= 10_000 or at >= ranges.size:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["uri", "page_id", "file", "offset", "length"])
                    found = []


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted keys and places as compressed blocks of a bounded number of lines."""
    part, n, held = TaskContext.get().partitionId(), 0, []

    def block() -> pa.RecordBatch:
        text = "\n".join("\t".join(("" if v is None else str(v)) for v in e) for e in held)
        return pa.RecordBatch.from_pylist([{"block": (part << 32) + n, "first": held[0][0], "last": held[-1][0], "entries": len(held), "data": zlib.compress(text.encode())}])

    for batch in batches:
        for entry in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
            held.append(entry)
            if len(held) == BLOCK_ENTRIES:
                yield block()
                n, held = n + 1, []
    if held:
        yield block()


def write_index(spark: SparkSession, archives: str, folder: str) -> None:
    """The two levels of the index of all archives of a folder, in a new folder."""
    files = spark.read.format("binaryFile").load(archives).where("length > 0").select("path")  # without their content
    listed = files.mapInArrow(_listed, "uri string, page_id long, file string, offset long, length long")
    entries = durable(listed.select(surt(F.col("uri")).alias("surt"), "page_id", "file", "offset", "length"))
    in_order = entries.repartitionByRange("surt", "page_id").sortWithinPartitions("surt", "page_id", "file", "offset")
    in_order.mapInArrow(_blocks, "block long, first string, last string, entries long, data binary").write.parquet(f"{folder}/blocks")
    release(entries)
    spark.read.parquet(f"{folder}/blocks").select("block", "first", "last", "entries").write.parquet(f"{folder}/directory")


@dataclass(frozen=True)
class Store:
    """Archives and their index."""

    archives: str
    index: str

    @staticmethod
    def made(pages: DataFrame, folder: str | None = None) -> Store:
        """Archives and index of pages in a new folder, of the shared one where none is named."""
        spark = pages.sparkSession
        root = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
        write_archives(pages, f"{root}/archives")
        write_index(spark, f"{root}/archives", f"{root}/index")
        return Store(f"{root}/archives", f"{root}/index")

    def located(self, wanted: DataFrame, on: tuple[str, ...] = ("surt",)) -> DataFrame:
        """``surt, page_id, file, offset, length`` of the captures of wanted keys: all of a ``surt``, or those with its ``page_id`` too.

        The directory is searched a bounded number of blocks at a time; of the blocks, only
        those that may hold a wanted key are decoded.
        """
        spark = wanted.sparkSession
        keys = wanted.select(*on).distinct()
        directory = spark.read.parquet(f"{self.index}/directory")
        hit, last = None, None
        key = F.struct("first", "block")
        while some := (directory if last is None else directory.where(key > last)).orderBy(key).limit(DIRECTORY_ROWS).collect():
            last = F.struct(F.lit(some[-1]["first"]).alias("first"), F.lit(some[-1]["block"]).alias("block"))
            found = _searched(keys.select("surt"), some).distinct()
            hit = found if hit is None else hit.unionByName(found).distinct()
        if hit is None:
            return spark.createDataFrame([], ENTRY)
        blocks = spark.read.parquet(f"{self.index}/blocks").select("block", "data").join(hit, "block", "left_semi")
        entries = blocks.select("data").mapInArrow(_decoded, ENTRY)
        same = [entries[c].eqNullSafe(keys[c]) for c in on]
        return entries.join(keys, same, "left_semi")

    def captures(self, wanted: DataFrame, on: tuple[str, ...] = ("surt",), payload: bool = True) -> DataFrame:
        """What the archives hold for wanted keys: page_id, uri, record_type, payload_bytes, payload_digest, refers_to and, if asked for, payload.

        The ranges of a section of an archive are read in their order by one task. A stored
        payload must have the length and the digest that its record states; a revisit has
        those of the page that it refers to, and no payload.
        """
        places = self.located(wanted, on).select(F.concat(F.lit(f"{self.archives}/"), "file").alias("path"), "offset", "length")
        dealt = places.repartition("path", F.floor(F.col("offset") / SECTION)).sortWithinPartitions("path", "offset")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
                for path, of_file in groupby(rows, lambda r: r[0]):
                    ranges, found, size = Ranges(path), [], 0
                    for _, at, length in of_file:
                        found.append(capture(ranges.get(at, length), payload))
                        size += length
                        if len(found) >= 1000 or (payload and size > 16 * WINDOW):
                            yield pa.RecordBatch.from_pylist(found, _SCHEMA)
                            found, size = [], 0
                    if found:
                        yield pa.RecordBatch.from_pylist(found, _SCHEMA)

        out = dealt.mapInArrow(read, CAPTURE)
        return out if payload else out.drop("payload")


_SCHEMA = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def capture(record: bytes, with_payload: bool) -> dict:
    """A record's columns; ValueError where it does not hold what it states."""
    head, _, block = record.partition(b"\r\n\r\n")
    named = fields(head)
    http, _, payload = block.partition(b"\r\n\r\n")
    n, digest = int(fields(http)["Content-Length"]), named["WARC-Payload-Digest"].removeprefix("sha256:")
    stored = named["WARC-Type"] == "response"
    if int(named["Content-Length"]) != len(block) or (stored and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest)):
        raise ValueError(f"the record {named['WARC-Record-ID']} does not hold what it states")
    return {
        "page_id": _number(named.get("X-Page-ID")),
        "uri": named.get("WARC-Target-URI"),
        "record_type": named["WARC-Type"],
        "payload_bytes": n,
        "payload_digest": digest,
        "refers_to": _number(named.get("X-Refers-To-Page-ID")),
        "payload": payload if stored and with_payload else None,
    }


def _searched(keys: DataFrame, directory: list) -> DataFrame:
    """Blocks that may hold a key: binary searches among the last and the first keys."""
    firsts, lasts, ids = ([r[c] for r in directory] for c in ("first", "last", "block"))
    sent = keys.sparkSession.sparkContext.broadcast(([f.encode() for f in firsts], [x.encode() for x in lasts], ids))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts, ids = sent.value
        for batch in batches:
            hits: set[int] = set()
            for key in batch.column(0).cast(pa.binary()).to_pylist():
                hits.update(range(bisect_left(lasts, key), bisect_right(firsts, key)))
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in sorted(hits)], pa.int64())], ["block"])

    return keys.mapInArrow(search, "block long")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            rows = [line.split("\t") for line in zlib.decompress(data).decode().split("\n")]
            surts, pages, names, offsets, lengths = zip(*rows, strict=True)
            numbers = ([int(x) if x else None for x in c] for c in (pages, offsets, lengths))
            page, offset, length = (pa.array(c, pa.int64()) for c in numbers)
            yield pa.RecordBatch.from_arrays([pa.array(surts), page, pa.array(names), offset, length], ["surt", "page_id", "file", "offset", "length"])
