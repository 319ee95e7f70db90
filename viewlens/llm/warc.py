"""WARC records as a table of chunks.

An archive is a Parquet table of (``archive``, ``record``, ``chunk``, ``data``, ``digest``). The
data of an archive's rows, in the order of record and chunk, are a WARC 1.1 file: chunk 0 is a
record's headers, each further chunk a part of its payload of bounded size, and the last one ends
the record. ``digest`` is the SHA-1 of the payload up to and with that chunk, so a reader can check
every chunk as it comes and needs no record as a whole; neither does the writer, whose Python step
sees one chunk at a time.

Of records with equal payloads, the one with the smallest id is a response and the others revisit
it. Payloads are equal if their SHA-256 and lengths are.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlens.llm.tables import written

CHUNK_BYTES = 1 << 18
END = b"\r\n\r\n"
ARCHIVE = "archive int, record bigint, chunk int, data binary, digest binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: each five digits are four letters."""

    def letters(part: Column) -> Column:
        number = F.conv(part, 16, 10).cast("int")
        fives = (F.shiftright(number, s).bitwiseAND(31) + 1 for s in (15, 10, 5, 0))
        return F.concat(*(F.substring(F.lit(_ALPHABET), n, F.lit(1)) for n in fives))

    return F.concat(*(letters(F.substring(hex_digest, 5 * k + 1, 5)) for k in range(8)))


def header_value(name: str) -> Column:
    """Percent-encodes what would break a header line; null is an absent header."""
    text = F.col(name).cast("string")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "%", "%25"), "\r", "%0D"), "\n", "%0A")


# --- writing ------------------------------------------------------------------------------


def first_of_equal(records: DataFrame, min_bytes: int) -> DataFrame:
    """(sha256, first, first_uri): the smallest id of records that share a payload with another id,
    or null, and a URI that it has."""
    groups = records.filter(F.col("bytes") >= min_bytes).groupBy("sha256")
    some_null = F.max(F.col("id").isNull())
    ends = F.min("id").alias("first"), F.max("id").alias("last")
    groups = groups.agg(*ends, F.min_by("uri", "id").alias("first_uri"), some_null.alias("some_null"))
    return groups.filter("first <> last OR some_null AND first IS NOT NULL").select("sha256", "first", "first_uri")


def record_uri(write: str, id_: Column, uri: Column, sha256: Column, number: Column) -> Column:
    """A record's name, from the write, its id, URI and payload, so that whoever refers to it can name
    it, and no other write has it. Without an id the row's number takes its place."""
    of = F.coalesce(F.concat(F.lit("i"), id_.cast("string")), F.concat(F.lit("n"), number.cast("string")))
    digits = F.sha2(F.concat_ws(" ", F.lit(write), sha256, of, F.coalesce(F.concat(F.lit("u"), uri), F.lit("-"))), 256)
    parts = [F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    parts[2], parts[3] = F.concat(F.lit("8"), parts[2]), F.concat(F.lit("a"), parts[3])
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record_headers(refers_to: Column, write: str, date: datetime) -> Column:
    """Chunk 0 of the row's record, as text."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit("\r\n\r\n"))
    body = F.when(refers_to.isNull(), F.col("bytes")).otherwise(0)
    response = record_uri(write, refers_to, F.col("first_uri"), F.col("sha256"), F.col("record"))
    optional = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(refers_to.isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "),
        record_uri(write, F.col("id"), F.col("uri"), F.col("sha256"), F.col("record")),
        F.lit(f"\r\nWARC-Date: {date.astimezone(timezone.utc):%Y-%m-%dT%H:%M:%SZ}\r\n"),
        optional("WARC-Target-URI", header_value("uri")),
        optional("X-Page-ID", F.col("id").cast("string")),
        optional("WARC-Refers-To", F.when(refers_to.isNotNull(), response)),
        optional("X-Refers-To-Page-ID", refers_to.cast("string")),
        F.when(refers_to.isNotNull(), F.lit(f"WARC-Profile: {PROFILE}\r\n")).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"),
        base32(F.col("sha1")),
        F.lit("\r\nX-Payload-Length: "),
        F.col("bytes").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.length(http) + body).cast("string"),
        F.lit("\r\n\r\n"),
        http,
    )


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the running digest to chunks that come in order, record by record."""
    record, running = None, hashlib.sha1()
    for batch in batches:
        digests = []
        for of, chunk, part in zip(batch.column("record").to_pylist(), batch.column("chunk").to_pylist(), batch.column("payload")):
            if chunk == 0 or of != record:
                record, running = of, hashlib.sha1()
            running.update(part.as_buffer())
            digests.append(running.digest())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("archive", "record", "chunk", "data")), pa.array(digests, pa.binary())],
            ["archive", "record", "chunk", "data", "digest"],
        )


def write_records(
    df: DataFrame,
    path: str,
    id_col: str,
    payload_col: str,
    uri_col: str | None = None,
    min_bytes: int = 0,
    chunk_bytes: int = CHUNK_BYTES,
    date: datetime | None = None,
) -> None:
    """Writes a record for each row of ``df`` to an archive table at ``path``, captured at ``date``,
    by default now.

    The payload is a text, in UTF-8, or bytes; null is empty. Records below ``min_bytes`` are all
    responses. A null id never is the smallest; where all of a payload's ids are null, or the
    smallest is that of several rows, each of those rows is a response; rows that are
    equal are one record written more than once, under one name. Other columns of ``df`` aren't stored.
    """
    write, date = uuid.uuid4().hex, date or datetime.now(timezone.utc)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    uri = F.col(uri_col).cast("string") if uri_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("id"), uri.alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("bigint"), "sha256": F.sha2("payload", 256)})
    shared = written(first_of_equal(rows.select("id", "uri", "sha256", "bytes"), min_bytes), "shared")
    rows = rows.join(shared.withColumnRenamed("sha256", "_of"), F.col("sha256") == F.col("_of"), "left")
    revisits = (F.col("bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("first"))
    refers_to = F.when(F.col("first").isNotNull() & revisits, F.col("first"))
    rows = rows.withColumns({"refers_to": refers_to, "sha1": F.sha1("payload"), "record": F.monotonically_increasing_id(), "archive": F.spark_partition_id()})
    stored = F.when(F.col("refers_to").isNull(), F.col("bytes")).otherwise(0)
    last = F.ceil(stored / chunk_bytes).cast("int")
    rows = rows.withColumns({"head": record_headers(F.col("refers_to"), write, date), "last": last})
    chunks = rows.select("archive", "record", "last", "head", "payload", F.explode(F.sequence(F.lit(0), "last")).alias("chunk"))
    part = F.when(F.col("chunk") == 0, F.lit(b"")).otherwise(
        F.substring("payload", (F.col("chunk") - 1) * chunk_bytes + 1, F.lit(chunk_bytes))
    )
    before = F.when(F.col("chunk") == 0, F.encode("head", "utf-8")).otherwise(F.lit(b""))
    after = F.when(F.col("chunk") == F.col("last"), F.lit(END)).otherwise(F.lit(b""))
    chunks = chunks.select("archive", "record", "chunk", part.alias("payload"), before.alias("before"), after.alias("after"))
    chunks = chunks.select("archive", "record", "chunk", F.concat("before", "payload", "after").alias("data"), "payload")
    chunks.mapInArrow(digest_batches, ARCHIVE).write.option("compression", "zstd").parquet(path)


# --- reading ------------------------------------------------------------------------------

RECORDS = "id string, uri string, record_type string, refers_to string, payload_bytes bigint, payload_digest string"


class RecordReader:
    """Reads one record's chunks in order and keeps nothing but its headers and two counters."""

    def __init__(self, data: bytes):
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError("not a WARC record")
        self.headers = dict(line.split(": ", 1) for line in lines)
        http, _, rest = rest.partition(b"\r\n\r\n")
        self._left = int(self.headers["Content-Length"]) - len(http) - 4
        self._sha1 = hashlib.sha1()
        self._tail = 0
        self.payload_bytes = 0

    def take(self, data, digest: bytes) -> None:
        """The next bytes of the payload, and what ends the record after them."""
        part = data[: max(self._left, 0)]
        self._left -= len(part)
        self._tail += len(data) - len(part)
        self._sha1.update(part)
        self.payload_bytes += len(part)
        if self._sha1.digest() != digest:
            raise ValueError(f"a damaged chunk in record {self.headers['WARC-Record-ID']}")

    def end(self) -> None:
        if self._left or self._tail != len(END):
            raise ValueError(f"record {self.headers['WARC-Record-ID']} is cut short")
        if self.headers["WARC-Type"] == "response":
            if f"sha1:{base64.b32encode(self._sha1.digest()).decode()}" != self.headers["WARC-Payload-Digest"]:
                raise ValueError(f"record {self.headers['WARC-Record-ID']} has another digest")

    def row(self) -> tuple:
        get = self.headers.get
        refers = get("X-Refers-To-Page-ID")
        uri = get("WARC-Target-URI")
        for code, mark in (("%0A", "\n"), ("%0D", "\r"), ("%25", "%")):
            uri = uri and uri.replace(code, mark)
        size = int(get("X-Payload-Length")) if refers else self.payload_bytes
        return get("X-Page-ID"), uri, get("WARC-Type"), refers, size, get("WARC-Payload-Digest")[5:]


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, rows = None, []

    def table() -> pa.RecordBatch:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string()]
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names)

    for batch in batches:
        for chunk, data, digest in zip(batch.column("chunk").to_pylist(), batch.column("data"), batch.column("digest").to_pylist()):
            data = memoryview(data.as_buffer())
            if chunk == 0:
                if reader:
                    reader.end()
                    rows.append(reader.row())
                reader = RecordReader(bytes(data))
                data = data[len(data) - reader_tail(reader, data) :]
            reader.take(data, digest)
        yield table()
        rows = []
    if reader:
        reader.end()
        rows.append(reader.row())
    yield table()


def reader_tail(reader: RecordReader, data: memoryview) -> int:
    """Bytes of chunk 0 after the headers: the record's end, if it has no payload."""
    return len(END) if int(reader.headers["X-Payload-Length"]) == 0 or reader.headers["WARC-Type"] == "revisit" else 0


def read_records(archives: DataFrame) -> DataFrame:
    """``RECORDS`` of an archive table, each checked chunk by chunk against its digests. Records
    stream through a task one chunk at a time, however long they are."""
    rows = archives.repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return rows.mapInArrow(read_batches, RECORDS)
