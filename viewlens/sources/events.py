"""Activity derived from the ``events`` table, in batch and as a stream.

``events`` has every column filled and no viewing attributes, so the mapping derives titles,
genres and release dates from its columns, leaves some genres and durations null, and gives
some rows a time that does not parse. No row is left out here: the awkward ones are there
for the filters and the rejects to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlens.functions.scalar import SPACE_FORMAT
from viewlens.operators.record import with_event_time
from viewlens.schema import POSITION, columns
from viewlens.session import pin_utc

EVENTS_SCHEMA = columns(
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)


def events_path(sf_dir: str) -> str:
    return f"{sf_dir.rstrip('/')}/events.parquet"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pin_utc(spark).read.schema(EVENTS_SCHEMA).parquet(events_path(sf_dir))


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """Events that land as files in a folder, from the first one."""
    return pin_utc(spark).readStream.schema(EVENTS_SCHEMA).parquet(path)


def in_order(events: DataFrame, parts: int, late: Column | None = None) -> list[DataFrame]:
    """The whole table in parts that follow each other in event time, each a range of whole
    days; rows that are ``late`` come in a part of their own after all others."""
    day = F.to_date("ts")
    first, last = events.agg(F.min(day), F.max(day)).first()
    days = (last - first).days + 1 if first else 1
    number = F.coalesce(F.floor(F.datediff(day, F.lit(first)) * parts / days), F.lit(0))
    number = number if late is None else F.when(late, parts).otherwise(number)
    return [events.filter(number == k) for k in range(parts + (late is not None))]


# As SQL text: one call per column builds in a fraction of the time that the same
# expressions take call by call, and every job on ``events`` starts with them.
_TIME_TEXT = f"CASE WHEN event_id % 97 = 0 THEN 'bad' ELSE date_format(ts, '{SPACE_FORMAT}') END"
_TITLE_NUMBER = "get_json_object(props, '$.k')"
_TITLE = f"concat('title_', {_TITLE_NUMBER})"
_GENRES = "CASE WHEN event_id % 11 <> 0 THEN concat('genre_', CAST(event_id % 6 AS STRING)) END"
_RELEASE_DATE = "date_format(date_add(DATE'2000-01-01', CAST(event_id % 365 AS INT)), 'yyyy-MM-dd')"


def raw_rows(events: DataFrame) -> DataFrame:
    """Events in the shape of the raw file, all text but for the leading index."""
    return events.selectExpr(
        "event_id",
        f"{_TIME_TEXT} AS datetime",
        "CASE WHEN event_type = 'signup' THEN '0.0'"
        " WHEN event_type <> 'error' THEN CAST(value AS STRING) END AS duration",
        f"{_TITLE} AS title",
        f"{_GENRES} AS genres",
        f"{_RELEASE_DATE} AS release_date",
        f"{_TITLE_NUMBER} AS movie_id",
        "CAST(user_id AS STRING) AS user_id",
    )


def activity(events: DataFrame, *keep: str) -> DataFrame:
    """Events as activity records with a log position that differs from event order: each 1024 ids
    arrive mixed, and no two at the same position.

    ``keep`` names event columns to carry along.
    """
    return events.selectExpr(
        "CAST(user_id AS STRING) AS USER_ID",
        f"{_TIME_TEXT} AS TIMESTAMP",
        "event_type AS ACTIVITY_TYPE",
        f"{_TITLE_NUMBER} AS TITLE_ID",
        "CASE WHEN event_type = 'signup' THEN 0 WHEN event_type <> 'error' THEN CAST(value AS INT) END AS DURATION",
        "CAST(NULL AS STRING) AS DEVICE_TYPE",
        "CAST(NULL AS STRING) AS LOCATION",
        f"{_TITLE} AS TITLE",
        f"{_GENRES} AS GENRES",
        f"{_RELEASE_DATE} AS RELEASE_DATE",
        f"{_TITLE_NUMBER} AS MOVIE_ID",
        f"event_id - event_id % 1024 + event_id % 1024 * 7919 % 1024 AS {POSITION}",
        *keep,
    )


def load_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(read_events(spark, sf_dir))


def load_timed_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_event_time(load_activity(spark, sf_dir))


def stream_timed_activity(spark: SparkSession, path: str) -> DataFrame:
    return with_event_time(activity(stream_events(spark, path)))
