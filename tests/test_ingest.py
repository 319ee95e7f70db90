"""Raw file, messages, the file log, and the activity table at rest."""

import json

import pytest
from builders import activity, record, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from viewlens.functions import avro
from viewlens.functions.partitions import murmur2, partition_of
from viewlens.functions.scalar import SPACE_FORMAT, T_FORMAT, epoch_roundtrip, parse_event_time
from viewlens.operators.record import activity_record, with_event_time
from viewlens.plans import metrics as M
from viewlens.schema import ACTIVITY_COLUMNS, RESULTS, avro_schema, columns
from viewlens.session import new_run_dir
from viewlens.sources import files, messages

CSV = ''',datetime,duration,title,genres,release_date,movie_id,user_id
0,2024-01-01 10:00:00,12.9,"Comma, and ""quote""","Drama, Comedy",2001-02-03,m1,u1
1,2024-01-01 11:00:00,0.0,Zero,NOT AVAILABLE,,m2,u2
2,2024-01-01 12:00:00,,Missing,Drama,2001-02-03,m3,u3
3,bad,NaN,,Drama,2001-02-03,m4,
'''


def logged(df):
    headers = (F.lit(0).alias("partition"), F.col("arrival").alias("offset"), F.current_timestamp().alias("timestamp"))
    return messages.encode_activity(df, headers=headers)


@pytest.fixture
def raw(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(CSV, encoding="utf-8")
    return files.read_raw_csv(spark, str(path))


def test_csv_to_record(raw):
    assert raw.columns == ["datetime", "duration", "title", "genres", "release_date", "movie_id", "user_id"]
    got = {r.TITLE_ID: r for r in activity_record(raw).collect()}
    assert list(got["m1"].asDict()) == ACTIVITY_COLUMNS
    assert got["m1"].TITLE == 'Comma, and "quote"' and got["m1"].GENRES == "Drama, Comedy"
    assert [got[m].DURATION for m in ("m1", "m2", "m3", "m4")] == [12, 0, None, None]
    assert {r.ACTIVITY_TYPE for r in got.values()} == {"view"}
    assert {(r.DEVICE_TYPE, r.LOCATION) for r in got.values()} == {(None, None)}
    assert (got["m4"].TITLE, got["m4"].USER_ID, got["m2"].RELEASE_DATE) == (None, None, None)
    assert all(r.MOVIE_ID == r.TITLE_ID for r in got.values())


def test_csv_with_only_a_header(spark, tmp_path):
    path = tmp_path / "empty.csv"
    path.write_text(CSV.splitlines()[0] + "\n", encoding="utf-8")
    assert activity_record(files.read_raw_csv(spark, str(path))).collect() == []


def test_messages_round_trip(spark):
    df = activity(spark, [record(user=None, genres=None), record(title='"quoted", \\ and\nnew line', duration=0)])
    path = new_run_dir(spark, "messages")
    messages.write_messages(logged(df), path)
    decoded = messages.decode_activity(messages.read_messages(spark, path))
    assert rows(decoded.select(*ACTIVITY_COLUMNS)) == rows(df.select(*ACTIVITY_COLUMNS))


def test_message_key_and_null_fields(spark):
    (row,) = messages.encode_activity(activity(spark, [record(user="u7")])).collect()
    assert row.key == "u7"
    assert list(json.loads(row.value)) == ACTIVITY_COLUMNS
    assert json.loads(row.value)["DEVICE_TYPE"] is None


def test_messages_read_the_same_as_a_stream(spark):
    path = new_run_dir(spark, "messages")
    messages.write_messages(logged(activity(spark, [record(user=f"u{i}") for i in range(5)])), path)
    out = f"{path}-out"
    stream = messages.decode_activity(messages.read_messages(spark, path, streaming=True))
    stream.writeStream.option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start(out).awaitTermination()
    batch = messages.decode_activity(messages.read_messages(spark, path))
    assert rows(spark.read.parquet(out).select(*batch.columns)) == rows(batch)


def test_log_position_orders_by_time_partition_offset(spark):
    big = 2**63 - 1
    order = [
        (None, 5, 5),
        ("2024-01-01 00:00:00.000100", 7, big),
        ("2024-01-01 00:00:00.000900", 0, 0),
        ("2024-01-01 00:00:00.000900", 99999, big),
        ("2024-01-01 00:00:00.000900", 100000, 0),
        ("2300-01-01 00:00:00", 0, 0),
        ("2300-01-01 00:00:00", 0, 1),
    ]
    value = lambda i: json.dumps({"TIMESTAMP": "2024-01-01 10:00:00", "TITLE": "A", "DURATION": 1, "GENRES": f"g{i}"})
    df = spark.createDataFrame([(value(i), *m) for i, m in enumerate(order)], "value string, timestamp string, partition int, offset bigint")
    decoded = messages.decode_activity(df.withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    assert [r.GENRES for r in decoded.orderBy("arrival").collect()] == [f"g{i}" for i in range(len(order))]
    for n in range(2, len(order) + 1):
        some = decoded.filter(F.substring("GENRES", 2, 9).cast("int") < n)
        assert M.title_metrics_latest(with_event_time(some)).collect()[0].genres == f"g{n - 1}"


def test_undecodable_messages_keep_their_text(spark):
    good = json.dumps(dict.fromkeys(ACTIVITY_COLUMNS) | {"TITLE": "A"})
    values = [good, good[:20], "", None, "[1]", "{}"]
    df = spark.createDataFrame([(f"k{i}", v, 0, i) for i, v in enumerate(values)], "key string, value string, partition int, offset bigint")
    df = df.withColumn("timestamp", F.current_timestamp())
    assert sorted(r.offset for r in messages.decode_activity(df).collect()) == [0, 5]
    dead = messages.undecodable(df)
    assert dead.columns == df.columns
    assert sorted((r.key, r.value) for r in dead.collect() if r.value) == [("k1", good[:20]), ("k4", "[1]")]
    assert sorted(r.offset for r in dead.collect()) == [1, 2, 3, 4]


def test_result_messages(spark):
    df = M.daily_title_engagement(with_event_time(activity(spark, [record(genres=None)])))
    (row,) = messages.encode_result(df, RESULTS["daily_title_engagement"].key).collect()
    assert json.loads(row.key) == {"view_date": "2024-01-01", "title": "A"}
    assert json.loads(row.value)["genres"] is None
    (row,) = messages.encode_result(df, ("title",), key_format="plain", key_in_value=False).collect()
    assert row.key == "A" and "title" not in json.loads(row.value)
    with pytest.raises(ValueError):
        messages.encode_result(df, ("view_date", "title"), key_format="plain")


def test_avro_schema():
    schema = json.loads(avro_schema())
    assert [f["name"] for f in schema["fields"]] == ACTIVITY_COLUMNS
    assert all(f["type"][0] == "null" and f["default"] is None for f in schema["fields"])


FIELDS = columns("a string, n int, b string")


def avro_bytes(*values):
    """A record by the format's own words, in plain Python."""

    def number(n):
        z, out = (n << 1) ^ (n >> 63), bytearray()
        while z > 127:
            out.append(z & 127 | 128)
            z >>= 7
        return bytes([*out, z])

    def field(v):
        if v is None:
            return b"\x00"
        return b"\x02" + (number(v) if isinstance(v, int) else number(len(v.encode())) + v.encode())

    return b"".join(map(field, values))


RECORDS = [
    ("hé", 5, None),
    (None, None, None),
    ("", 0, ""),
    ("x" * 63, 63, "y" * 64),
    ("z" * 9000, -1, "😀"),
    ("\x00", 64, "q"),
    ("w" * 70_000, 2**31 - 1, "q"),
    (None, -(2**31), None),
    (None, -65, "\n"),
]


def test_avro_bytes_and_back(spark):
    assert avro_bytes("hé", 5, None) == bytes.fromhex("020668c3a9020a00")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(RECORDS)], StructType([*columns("i int").fields, *FIELDS]))
    coded = df.withColumn("payload", avro.encode(FIELDS))
    assert {r.i: bytes(r.payload) for r in coded.collect()} == {i: avro_bytes(*r) for i, r in enumerate(RECORDS)}
    read = avro.with_record(coded.select("i", "payload"), F.col("payload"), FIELDS, "record")
    assert read.columns == ["i", "payload", "record"]
    assert {r.i: tuple(r.record) for r in read.collect()} == dict(enumerate(RECORDS))
    assert read.filter("record.n < 0").count() == 3


def test_avro_bytes_that_are_no_record(spark):
    whole = avro_bytes("hé" * 40, -70000, "end")
    bad = [None, b"", whole + b"\x00", b"\x04" + whole, b"\x02\x01" + whole, b"\x02\x04\xff\xfe\x00\x00"]
    bad += [b"\x00\x02\x80\x80\x80\x80\x80\x01\x00", b"\x00\x02\xff\xff\xff\xff\x7f\x00", b"\x02\xfe\xff\xff\xff\x0fab"]
    bad += [whole[:k] for k in range(len(whole))]
    df = spark.createDataFrame([(None if b is None else bytearray(b),) for b in [whole, *bad]], "payload binary")
    read = avro.with_record(df, F.col("payload"), FIELDS, "record").collect()
    assert [bytes(r.payload) for r in read if r.record is not None] == [whole]


def test_registry_header(spark):
    coded = avro.framed(F.encode(F.lit("payload"), "utf-8"), 258)
    other = avro.unframed(coded, 259)
    (row,) = spark.range(1).select(coded.alias("f"), avro.unframed(coded, 258).alias("p"), avro.unframed(coded).alias("q"), other.alias("o")).collect()
    assert bytes(row.f) == b"\x00\x00\x00\x01\x02payload"
    assert bytes(row.p) == bytes(row.q) == b"payload" and row.o is None
    (row,) = spark.range(1).select(avro.unframed(F.unhex(F.lit("0100000007AA"))).alias("a"), avro.unframed(F.unhex(F.lit("0000"))).alias("b")).collect()
    assert row.a is None and row.b is None


def test_avro_messages_as_a_stream(spark):
    path = new_run_dir(spark, "messages")
    df = activity(spark, [record(user=f"u{i}", genres=None if i % 2 else "g") for i in range(5)])
    headers = (F.lit(0).alias("partition"), F.col("arrival").alias("offset"), F.current_timestamp().alias("timestamp"))
    messages.write_messages(messages.encode_activity(df, "avro", 7, headers), path)
    out = f"{path}-out"
    stream = messages.decode_activity(messages.read_messages(spark, path, streaming=True, binary=True), "avro", framed=True)
    stream.writeStream.option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start(out).awaitTermination()
    assert rows(spark.read.parquet(out).select(*ACTIVITY_COLUMNS)) == rows(df.select(*ACTIVITY_COLUMNS))


# What producers' own tests expect of the hash, as signed numbers.
HASHES = {
    "21": -973932308,
    "foobar": -790332482,
    "a-little-bit-long-string": -985981536,
    "a-little-bit-longer-string": -1486304829,
    "lkjh234lh9fiuh90y23oiuhsafujhadof229phr9h19h89h8": -58897971,
    "abc": 479470107,
}


def test_partition_of_a_key(spark):
    df = spark.createDataFrame([(k,) for k in [*HASHES, "", None]], "key string")
    got = {r.key: (r.h, r.p) for r in df.select("key", murmur2(F.col("key")).alias("h"), partition_of(F.col("key"), 6).alias("p")).collect()}
    for key, signed in HASHES.items():
        assert got[key] == (signed % 2**32, (signed % 2**31) % 6)
    assert got[""][0] == 275646681 and got[None] == (None, 0)


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_a_log_numbers_each_partition_without_gaps(spark, hot):
    """Also with most messages in one partition, which several tasks then number."""
    rows_ = spark.range(3000).selectExpr(f"CASE WHEN id % 100 < {hot * 100} THEN 'hot' ELSE CAST(id AS STRING) END AS key", "id * 7919 % 3001 AS at")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log = messages.keyed_log(rows_, 3, ("at",), new_run_dir(spark, "log"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert log.groupBy("key").agg(F.count_distinct("partition").alias("n")).filter("n > 1").count() == 0
    found = {}
    for r in log.orderBy("partition", "at").collect():
        found.setdefault(r.partition, []).append(r.offset)
    assert set(found) == {0, 1, 2} and all(v == list(range(len(v))) for v in found.values())


def test_unknown_formats_are_refused(spark):
    df = activity(spark, [record()])
    with pytest.raises(ValueError):
        messages.encode_activity(df, value_format="xml")
    with pytest.raises(ValueError):
        messages.decode_activity(df, value_format="xml")


def test_activity_table_prunes_days(spark, tmp_path):
    path = str(tmp_path / "table")
    df = with_event_time(activity(spark, [record(time=f"2024-01-0{d} 10:00:00") for d in (1, 2, 3, 3)]))
    files.write_activity_table(df, path)
    two = files.read_activity_table(spark, path, "2024-01-02", "2024-01-03")
    assert two.count() == 3
    assert len(two.inputFiles()) <= 3
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(view_date" in plan
    stored = M.title_metrics_max(files.read_activity_table(spark, path), stamp=False)
    assert rows(stored) == rows(M.title_metrics_max(df, stamp=False))


def test_epoch_roundtrip_keeps_milliseconds(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 10:00:00.123456' AS ts")
    (row,) = df.select(epoch_roundtrip("ts").alias("t")).collect()
    assert row.t.microsecond == 123000


pieces = st.sampled_from(list("0123456789-: T+Z") + ["2024", "-02-", "-12-31", "00:00:00", "23:59:59", "24", "\n", "٣"])
near = st.builds(
    lambda y, mo, d, s, h, m, sec, tail: f"{y}-{mo}-{d}{s}{h}:{m}:{sec}{tail}",
    *[st.sampled_from(v) for v in (
        ["2024", "0000", "0001", "9999", "12024", "+2024", "24"],
        ["01", "02", "12", "13", "00", "2"],
        ["01", "29", "30", "31", "32", "00", "1"],
        [" ", "T", "  ", ""],
        ["00", "23", "24", "7"],
        ["00", "59", "60"],
        ["00", "59", "60", "5", "5Z"],
        ["", " ", "Z", ".5", "\n"],
    )],
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(near, st.lists(pieces, max_size=8).map("".join)), min_size=150, max_size=300))
def test_fast_parse_equals_the_pattern_parser(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for fmt in (SPACE_FORMAT, T_FORMAT):
        both = df.select("t", parse_event_time("t", fmt).alias("fast"), F.try_to_timestamp("t", F.lit(fmt)).alias("slow"))
        assert both.filter(~F.col("fast").eqNullSafe(F.col("slow"))).collect() == []
