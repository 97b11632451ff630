"""WARC archives: writing captures, reading records back, and assembling transactions.

Each row of pages becomes three records: a request, a response (or a revisit of the response that has the same payload) and a metadata
record. Request and metadata name the response or revisit by WARC-Concurrent-To. Archives are written by Spark's text writer, whose
line separator is the blank lines that end a record, so they go through the committer to whatever store the folder is in.

Reading parses records by their Content-Length, so payloads may hold anything. Gzipped archives of any size are streamed through Spark's
text reader, line by line, and put together again, a bounded part at a time; others come whole through its binary reader, which takes
files of up to 2 GB. Transactions are assembled by joins on record ids: one nested row per capture. What a capture's payload is, and which
page a revisit refers to, is read from the records alone: the digest and length of the response's block, and the page that the metadata
concurrent to the response names.

Nulls: a null html is an empty payload, a null url the target about:blank, a null page_id stays null. Of rows with equal payloads of at
least ``min_bytes`` bytes the one with the smallest page_id is the response; rows that tie on it are all responses. A group whose ids are
all null has a response for each row. Each row gives its own records and its own capture: where page_ids repeat, rows are numbered in a
table, so that records of equal rows have ids of their own. Records that repeat an id (in archives of others) are taken once. Without
rows no capture comes back. Of pages only page_id, url and html are read, whatever else is there. Very long payloads: a task holds one
record, its block twice at most.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ids_unique, tidy

MIN_BYTES = 100
VERSION = "WARC/1.1"
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(*parts: Column) -> Column:
    """A URN made of the parts, of which none may hold a line feed but the last."""
    h = F.md5(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, n),)), F.lit(">"))


def _record(kind: str | Column, ident: Column, extra: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """One record without the blank lines at its end; a null header is left out."""
    head = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: "), ident), F.lit(f"WARC-Date: {DATE}")]
    head += [F.concat(F.lit(f"{name}: "), value) for name, value in extra]  # concat_ws drops nulls
    head += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2), block)


def plan_captures(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, digest, n_bytes, number, first, first_url, first_number, is_revisit: the firsts are those of the response that has the row's payload."""
    html = F.coalesce(F.col("html"), F.lit(""))
    # a URI holds no blanks or controls
    url = F.coalesce(F.regexp_replace(F.col("url"), r"[\x00-\x20]+", ""), F.lit("about:blank"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"))
    rows = rows.withColumn("number", F.lit(0).cast("long")) if ids_unique(pages, "page_id") else cut(rows.withColumn("number", F.monotonically_increasing_id()))
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "number"))
    firsts = rows.filter(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min(named).alias("f"), F.count("*").alias("c"))
    # as a table of its own it is dealt anew for the join, whose hot digests can then be split
    firsts = cut(firsts.filter("c > 1").select("digest", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url"), F.col("f.number").alias("first_number")))
    first = rows.join(firsts.hint("shuffle_hash"), "digest", "left")
    return first.withColumn("is_revisit", F.coalesce((F.col("n_bytes") >= min_bytes) & F.coalesce(F.col("page_id") > F.col("first"), F.col("page_id").isNull() & F.col("first").isNotNull()), F.lit(False)))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, records_per_file: int = 2_000) -> str:
    """Writes the captures of pages (page_id, url, html) as gzipped WARC files into folder."""
    c = plan_captures(pages, min_bytes)
    page, url, digest, number = F.col("page_id"), F.col("url"), F.col("digest"), F.col("number")
    c = c.withColumn("rid", F.when(F.col("is_revisit"), _uuid(F.lit("revisit"), page, digest, number, url)).otherwise(_uuid(F.lit("response"), page, digest, number, url)))
    c = c.withColumn("payload_digest", F.concat(F.lit("sha256:"), digest))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    target = ("WARC-Target-URI", url)
    about = [target, ("WARC-Payload-Digest", F.col("payload_digest"))]
    response = _record("response", F.col("rid"), about, "application/http; msgtype=response", F.concat(http, F.col("html")))
    refers = _uuid(F.lit("response"), F.col("first"), digest, F.col("first_number"), F.col("first_url"))
    revisit = _record("revisit", F.col("rid"), [*about, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", refers)], "application/http; msgtype=response", http)
    line = F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1" + CRLF * 2))
    request = _record("request", _uuid(F.lit("request"), page, digest, number, url), [target, ("WARC-Concurrent-To", F.col("rid"))], "application/http; msgtype=request", line)
    meta = F.concat_ws(CRLF, F.concat(F.lit("pageId: "), page.cast("string")), F.concat(F.lit("payloadBytes: "), F.col("n_bytes").cast("string")))
    metadata = _record("metadata", _uuid(F.lit("metadata"), page, digest, number, url), [target, ("WARC-Concurrent-To", F.col("rid"))], "application/warc-fields", meta)
    records = c.select(F.concat_ws(CRLF * 2, request, F.when(F.col("is_revisit"), revisit).otherwise(response), metadata).alias("value"))
    records.write.mode("append").option("compression", "gzip").option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).text(folder)
    return folder


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an uncompressed stream; a truncated last record is an error."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("a record's headers are cut off")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length", 0))
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record is cut off")
        yield headers, block


RECORD = ("record_id", "kind", "concurrent_to", "url", "payload_digest", "refers_to", "content_length", "fields", "payload_bytes", "digest", "payload")
SCHEMA = "record_id string, kind string, concurrent_to string, url string, payload_digest string, refers_to string, content_length long, fields string, payload_bytes long, digest string, payload binary"
TYPES = (*[pa.string()] * 6, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())


def _row(headers: dict[str, str], block: bytes, payload: bool) -> tuple:
    kind, fields, n, digest, body = headers.get("warc-type"), None, None, None, None
    if kind == "response":
        content = block.partition(b"\r\n\r\n")[2]
        n, digest = len(content), "sha256:" + hashlib.sha256(content).hexdigest()
        body = content if payload else None
    elif kind == "metadata":
        fields = block.decode("utf-8", "replace")
    return (headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-payload-digest"), headers.get("warc-refers-to"), len(block), fields, n, digest, body)


def _emit(stream: io.BufferedIOBase, payload: bool) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], RECORD)

    for headers, block in parse_records(stream):
        rows.append(_row(headers, block, payload))
        size += len(block) * payload
        if len(rows) == 5_000 or size > 16 << 20:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


class Lines(io.RawIOBase):
    """A file's chunks, one after the other, as a stream."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.left = chunks, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        while not len(self.left):
            if (chunk := next(self.chunks, None)) is None:
                return 0
            self.left = memoryview(chunk)
        n = min(len(into), len(self.left))
        into[:n] = self.left[:n]
        self.left = self.left[n:]
        return n


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """file and joined lines of each run of rows from one file."""
    for b in batches:
        files, at = b.column("file").to_pylist(), 0
        for file, same in itertools.groupby(files):
            n = sum(1 for _ in same)
            yield file, b"\n".join([*b.column("line").slice(at, n).to_pylist(), b""])
            at += n


def read_records(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """A row for each record of the WARC files in folder, gzipped (names that end in .gz) or not; without payload the responses' bodies stay behind."""

    def streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in itertools.groupby(_chunks(batches), key=lambda x: x[0]):
            yield from _emit(io.BufferedReader(Lines(x for _, x in parts), 1 << 16), payload)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                data = content.as_buffer()
                raw = io.BytesIO(data)
                yield from _emit(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if len(data) > 1 and data[:2].to_pybytes() == b"\x1f\x8b" else raw, payload)

    # a gzipped file cannot be split: its lines come in order, in one task. Lines stay bytes.
    packed = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(folder)
    packed = packed.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line")).mapInArrow(tidy(streamed), SCHEMA)
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*[!z]").load(folder)
    return packed.unionByName(plain.select("content").mapInArrow(tidy(whole), SCHEMA))


def _page(fields: str) -> Column:
    """The page that a metadata record names."""
    return F.nullif(F.regexp_extract(fields, r"(?m)^pageId: (\d+|-\d+)\r?$", 1), F.lit("")).cast("long")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response (or revisit), its request and its metadata, joined by the ids they name; page_id and refers_to, a page.

    payload_bytes and payload_digest are those of the payload as read, a revisit's those of the response it refers to (null if that is not
    there); digest_agrees says whether the digest is the one in the record's header. The records are read several times: a table serves best.
    """
    main = records.filter("kind IN ('response', 'revisit')").dropDuplicates(["record_id"])
    side = records.filter("concurrent_to IS NOT NULL").dropDuplicates(["record_id"])
    requests = side.filter("kind = 'request'").groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min(F.struct(F.col("record_id").alias("id"), "url")).alias("request"))
    metas = side.filter("kind = 'metadata'").groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min(F.struct(F.col("record_id").alias("id"), "fields")).alias("metadata"))
    read = records.filter("kind = 'response'").groupBy("record_id").agg(F.min(F.struct("digest", "payload_bytes")).alias("body")).join(metas, "record_id", "left")
    # a table of its own, so that the join with a response that very many revisits refer to can be split
    read = cut(read.select(F.col("record_id").alias("refers"), F.col("body.digest").alias("read_digest"), F.col("body.payload_bytes").alias("read_bytes"), _page("metadata.fields").alias("read_page")))
    # a response refers to itself
    main = main.drop("digest", "payload_bytes").withColumn("refers", F.coalesce("refers_to", "record_id")).join(read, "refers", "left")
    response = F.struct(
        F.col("record_id").alias("id"), "kind", "url", F.col("read_digest").alias("payload_digest"), F.col("read_digest").eqNullSafe(F.col("payload_digest")).alias("digest_agrees"), "refers_to", F.col("read_bytes").alias("payload_bytes"), "payload"
    ).alias("response")
    page = F.when(F.col("refers_to").isNotNull(), F.col("read_page")).alias("refers_page")
    whole = main.select("record_id", response, page).join(requests, "record_id", "left").join(metas, "record_id", "left")
    return whole.select(_page("metadata.fields").alias("page_id"), "request", "response", "metadata", F.col("refers_page").alias("refers_to"))


def captures(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, payload: bool = True) -> DataFrame:
    """Archives pages in folder and reads them back: page_id, request, response, metadata, refers_to (a page_id). Without payload, the folder is not needed afterwards."""
    write_archives(pages, folder, min_bytes)
    return assemble(cut(read_records(pages.sparkSession, folder, payload)))
