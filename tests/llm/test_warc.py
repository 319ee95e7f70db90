"""Archives against a plain reading of their bytes."""

import base64
import hashlib
import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from viewlens.llm import registry, warc
from viewlens.llm.tables import load

SCHEMA = "page_id bigint, url string, html string"


def plain(rows, min_bytes=0):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= min_bytes:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        refers = first.get(data) if first.get(data) != i else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, url, "response" if refers is None else "revisit", refers, len(data), digest))
    return sorted(out, key=str)


def stored(spark, tmp_path, rows, **options):
    path = str(tmp_path / "archive")
    df = spark.createDataFrame(rows, SCHEMA).withColumn("record", F.lit("clash")).withColumn("sha1", F.lit(1))
    warc.write_records(df, path, "page_id", "html", "url", **options)
    return spark.read.parquet(path)


def as_rows(df):
    number = lambda x: None if x is None else int(x)
    return sorted(((number(r[0]), r[1], r[2], number(r[3]), *r[4:]) for r in df.collect()), key=str)


ROWS = [
    (5, "http://a/%\n", "same"), (3, None, "same"), (9, "u", "same"), (None, "u", "same"), (3, "x", "same"),
    (1, "e", None), (2, "e", ""), (7, "long", "é€𝄞\r\n\r\n" * 90_000), (8, "long", "é€𝄞\r\n\r\n" * 90_000), (None, "n", "alone"), (4, "ß", "WARC/1.1\r\n"),
]


def test_awkward_rows_and_chunks(spark, tmp_path):
    archive = stored(spark, tmp_path, ROWS, chunk_bytes=1000)
    assert as_rows(warc.read_records(archive)) == plain(ROWS)
    assert archive.agg(F.max(F.octet_length("data"))).first()[0] < 1100
    assert archive.filter("chunk > 500").count() > 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    assert as_rows(warc.read_records(stored(spark, tmp_path, ROWS, min_bytes=5))) == plain(ROWS, 5)


def test_the_data_are_a_warc_file(spark, tmp_path):
    archive = stored(spark, tmp_path, ROWS, chunk_bytes=7777).orderBy("archive", "record", "chunk").collect()
    data = b"".join(r["data"] for r in archive)
    bodies = []
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        size = int(head.split(b"\r\nContent-Length: ")[1])
        if b"Type: response" in head:
            bodies.append(data[:size].partition(b"\r\n\r\n")[2])
        assert data[size : size + 4] == b"\r\n\r\n"
        data = data[size + 4 :]
    assert sorted(bodies) == sorted(x.encode() for x in ("same", "same", "", ROWS[7][2], "alone", "WARC/1.1\r\n"))


#: What every record must have, and a revisit besides.
MANDATORY = {"WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type"}
REVISIT = {"WARC-Profile", "WARC-Refers-To"}


def strict_headers(archive):
    """The headers of all records, by a reader that asks for what the format makes mandatory."""
    out = []
    for r in archive.filter("chunk = 0").collect():
        version, *lines = bytes(r["data"]).partition(b"\r\n\r\n")[0].decode().split("\r\n")
        names = [line.split(": ", 1)[0] for line in lines]
        headers = dict(line.split(": ", 1) for line in lines)
        assert version == "WARC/1.1" and len(names) == len(set(names)) and set(names) >= MANDATORY
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}>", headers["WARC-Record-ID"])
        datetime.strptime(headers["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ")
        if headers["WARC-Type"] == "revisit":
            assert set(names) >= REVISIT
        out.append(headers)
    return out


def test_mandatory_headers_and_references(spark, tmp_path):
    headers = strict_headers(stored(spark, tmp_path / "a", ROWS))
    ids = [h["WARC-Record-ID"] for h in headers]
    assert len(set(ids)) == len(ROWS) == len(ids)
    responses = {h["WARC-Record-ID"]: h for h in headers if h["WARC-Type"] == "response"}
    revisits = [h for h in headers if h["WARC-Type"] == "revisit"]
    assert revisits
    for h in revisits:
        to = responses[h["WARC-Refers-To"]]
        assert to["X-Page-ID"] == h["X-Refers-To-Page-ID"] and to["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
    again = strict_headers(stored(spark, tmp_path / "b", ROWS, date=datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)))
    assert not set(ids) & {h["WARC-Record-ID"] for h in again}
    assert {h["WARC-Date"] for h in again} == {"2024-01-02T03:04:05Z"}


def test_damage_is_found(spark, tmp_path):
    archive = stored(spark, tmp_path, [(1, "u", "x" * 5000)], chunk_bytes=1000)
    with pytest.raises(Exception, match="damaged chunk"):
        warc.read_records(archive.withColumn("data", F.when(F.col("chunk") == 3, F.encode(F.lit("y" * 1000), "utf-8")).otherwise(F.col("data")))).collect()
    with pytest.raises(Exception, match="cut short"):
        warc.read_records(archive.filter("chunk < 5")).collect()


def test_empty_table(spark, tmp_path):
    assert warc.read_records(stored(spark, tmp_path, [])).collect() == []


def test_query_equals_brute_force_on_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in load(spark, sf_dir, "pages").select("page_id", "url", "html").collect()]
    got = registry.op2_warc(spark, sf_dir).select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((r[0], *r[2:]) for r in plain(rows)), key=str)
