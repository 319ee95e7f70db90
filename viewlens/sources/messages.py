"""Keyed messages: the contract between the event log and the activity relation.

A message has ``key`` and ``value``; read back from a log it also has ``partition``,
``offset`` and ``timestamp``. The Kafka functions are thin adapters over that contract.
They need the Kafka package on the class path, which is not bundled with PySpark, so in this
repository they have not been run. The same contract over Parquet files
(``write_messages``/``read_messages``), with JSON or Avro values, is what the tests run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from viewlens.functions import avro
from viewlens.functions.partitions import partition_of
from viewlens.schema import ACTIVITY_COLUMNS, ACTIVITY_SCHEMA, POSITION, columns
from viewlens.streaming import settings

MESSAGE_SCHEMA = columns("key STRING, value STRING, partition INT, offset BIGINT, timestamp TIMESTAMP")
#: The same with values in binary form.
BINARY_SCHEMA = StructType(
    [StructField("value", BinaryType()) if f.name == "value" else f for f in MESSAGE_SCHEMA]
)

_BROKEN = "_broken"

def _json(columns: list[str]) -> Column:
    """JSON object keeping null fields, which ``to_json`` would silently leave out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def encode_activity(
    activity: DataFrame,
    value_format: str = "json",
    schema_id: int | None = None,
    headers: tuple[Column, ...] = (),
) -> DataFrame:
    """One message per row, keyed by user. Only the record's columns travel in the value;
    ``headers`` are columns put beside it, such as a log position known beforehand."""
    if value_format == "json":
        value = _json(ACTIVITY_COLUMNS)
    elif value_format == "avro":
        value = avro.encode(ACTIVITY_SCHEMA)
        value = value if schema_id is None else avro.framed(value, schema_id)
    else:
        raise ValueError(f"unknown value format: {value_format}")
    return activity.select(F.col("USER_ID").alias("key"), value.alias("value"), *headers)


def log_position() -> Column:
    """A total order over messages: broker time, then partition, then offset, as offsets do not
    compare across partitions. A message without a time orders before all others."""
    return F.struct("timestamp", "partition", "offset")


def _decoded(messages: DataFrame, value_format: str, framed: bool) -> DataFrame:
    """Messages with ``record``, null where the value cannot be decoded."""
    if value_format == "json":
        schema = StructType([*ACTIVITY_SCHEMA.fields, StructField(_BROKEN, StringType())])
        parsed = F.from_json(F.col("value").cast("string"), schema, {"columnNameOfCorruptRecord": _BROKEN})
        messages = messages.withColumn("parsed", parsed)
        fields = F.struct(*(F.col(f"parsed.{c}").alias(c) for c in ACTIVITY_COLUMNS))
        return messages.withColumn("record", F.when(F.col(f"parsed.{_BROKEN}").isNull() & F.col("parsed").isNotNull(), fields))
    if value_format == "avro":
        payload = avro.unframed(F.col("value")) if framed else F.col("value")
        return avro.with_record(messages, payload, ACTIVITY_SCHEMA, "record")
    raise ValueError(f"unknown value format: {value_format}")


def decode_activity(messages: DataFrame, value_format: str = "json", framed: bool = False) -> DataFrame:
    """Messages to the activity record and its log position. Works on streams. What cannot be
    decoded is left to :func:`undecodable`."""
    decoded = _decoded(messages, value_format, framed).filter(F.col("record").isNotNull())
    return decoded.select(
        "record.*", log_position().alias(POSITION), "partition", "offset", F.col("timestamp").alias("logged_at")
    )


def undecodable(messages: DataFrame, value_format: str = "json", framed: bool = False) -> DataFrame:
    """The messages that :func:`decode_activity` leaves out, as they came, for a dead-letter table."""
    return _decoded(messages, value_format, framed).filter(F.col("record").isNull()).select(*messages.columns)


def encode_result(result: DataFrame, key: tuple[str, ...], key_format: str = "json", key_in_value: bool = True) -> DataFrame:
    """A result table as keyed JSON messages; ``key_format='plain'`` takes one text key."""
    if key_format == "json":
        key_column = _json(list(key))
    elif key_format == "plain":
        if len(key) != 1:
            raise ValueError("a plain key has exactly one column")
        key_column = F.col(key[0]).cast("string")
    else:
        raise ValueError(f"unknown key format: {key_format}")
    fields = [c for c in result.columns if key_in_value or c not in key]
    return result.select(key_column.alias("key"), _json(fields).alias("value"))


# --- messages as Parquet files ------------------------------------------------------------


def write_messages(messages: DataFrame, path: str) -> None:
    """Append messages with their log headers to a folder; binary values stay binary."""
    schema = BINARY_SCHEMA if isinstance(messages.schema["value"].dataType, BinaryType) else MESSAGE_SCHEMA
    messages.select(*(F.col(f.name).cast(f.dataType) for f in schema)).write.mode("append").parquet(path)


def read_messages(spark: SparkSession, path: str, streaming: bool = False, binary: bool = False) -> DataFrame:
    """All messages of a folder, and as a stream those to come."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(BINARY_SCHEMA if binary else MESSAGE_SCHEMA).parquet(path)


def keyed_log(messages: DataFrame, partitions: int, order: tuple[str, ...], path: str) -> DataFrame:
    """``messages`` with ``partition`` and ``offset``, as a log of so many partitions numbers them.

    A key's messages are all in the partition that its hash names, and a partition's offsets are 0
    to n - 1 in the order of ``order``, messages that tie there in any. Sorted ranges of partition and
    order are written to ``path`` once, each row with its place in its task; a range knows how many
    rows of a partition the ranges before it hold from their counts alone. So a partition with most
    of the messages is spread over many tasks and no task numbers a whole one.
    """
    spark, place = messages.sparkSession, "_place"
    by = ("partition", *order)
    ranged = messages.withColumn("partition", partition_of(F.col("key"), partitions)).repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).withColumn(place, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_task", F.shiftright(place, 33))
    counts = rows.groupBy("partition", "_task").agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    before = Window.partitionBy("partition").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = rows.join(starts, ["partition", "_task"])
    offset = F.col("_before") + F.col(place) - F.col("_first")
    return numbered.withColumn("offset", offset).drop(place, "_task", "_before", "_first")


# --- the log in Kafka (not run here) ------------------------------------------------------


def read_topic(spark: SparkSession, servers: str, topic: str, streaming: bool = True, **options: str) -> DataFrame:
    """A topic from its beginning; ``options`` carries security and rate settings."""
    reader = spark.readStream if streaming else spark.read
    return (
        reader.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**options)
        .load()
    )


def write_topic(messages: DataFrame, servers: str, topic: str, **options: str) -> None:
    """Publish messages; the producer hashes keys to partitions, so none are moved first."""
    (
        messages.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .options(**options)
        .save()
    )


def stream_to_topic(
    messages: DataFrame, servers: str, topic: str, checkpoint: str, name: str, replay: bool = False, **options: str
) -> StreamingQuery:
    """Publish every change of a streaming result as it happens, unless a query of that name runs."""
    writer = (
        messages.writeStream.outputMode("update")
        .format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .options(**options)
    )
    return settings.start(writer, messages.sparkSession, name, replay)
