"""Declared schemas: raw file, activity record, and the result tables."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def columns(text: str) -> T.StructType:
    """A schema from ``"name type, name type"``; unlike ``fromDDL`` it needs no session."""
    pairs = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind.lower()]) for name, kind in pairs])


# The unnamed leading column holds the file's row index and is dropped after the read.
INDEX_COLUMN = "row_index"
RAW_SCHEMA = columns(
    f"{INDEX_COLUMN} STRING, datetime STRING, duration STRING, title STRING, genres STRING, "
    "release_date STRING, movie_id STRING, user_id STRING"
)

ACTIVITY_SCHEMA = columns(
    "USER_ID STRING, TIMESTAMP STRING, ACTIVITY_TYPE STRING, TITLE_ID STRING, DURATION INT, "
    "DEVICE_TYPE STRING, LOCATION STRING, TITLE STRING, GENRES STRING, RELEASE_DATE STRING, "
    "MOVIE_ID STRING"
)
ACTIVITY_COLUMNS = ACTIVITY_SCHEMA.fieldNames()

EVENT_TIME = "event_timestamp"
POSITION = "arrival"


def avro_schema(record_name: str = "ActivityRecord") -> str:
    """The activity record as Avro JSON: every field a nullable union defaulting to null."""
    avro_types = {"string": "string", "int": "int"}
    fields = [
        {
            "name": f.name,
            "type": ["null", avro_types[f.dataType.simpleString()]],
            "default": None,
        }
        for f in ACTIVITY_SCHEMA
    ]
    return json.dumps({"type": "record", "name": record_name, "fields": fields})


@dataclass(frozen=True)
class ResultTable:
    """A result's declared columns and its (not enforced) primary key."""

    name: str
    schema: T.StructType
    key: tuple[str, ...]

    def conform(self, df: DataFrame, *more: str) -> DataFrame:
        """Project and cast to the declared columns, in the declared order, and ``more``.

        ``update_time`` may be missing: it is processing time, and callers that compare
        results leave it out.
        """
        return df.select(
            *[
                F.col(f.name).cast(f.dataType).alias(f.name)
                for f in self.schema
                if f.name in df.columns or f.name != "update_time"
            ],
            *more,
        )


def _table(name: str, ddl: str, *key: str) -> ResultTable:
    return ResultTable(name, columns(ddl), key)


_TITLE = "title STRING, total_views BIGINT, avg_duration DOUBLE, total_duration BIGINT, genres STRING, release_date STRING"
_DAY = "total_unique_users BIGINT, total_views BIGINT, total_watch_time BIGINT, avg_watch_time DOUBLE, most_watched_title STRING, most_watched_genre STRING"

RESULTS: dict[str, ResultTable] = {
    t.name: t
    for t in (
        _table("title_metrics_windowed", f"{_TITLE}, window_start STRING", "title", "window_start"),
        _table("daily_engagement_windowed", f"view_date STRING, {_DAY}, window_hour STRING", "view_date"),
        _table("title_metrics_rowtime", f"{_TITLE}, update_time TIMESTAMP", "title"),
        _table("daily_engagement_rowtime", f"view_date STRING, {_DAY}, peak_hour INT, update_time TIMESTAMP", "view_date"),
        _table("title_metrics_latest", _TITLE, "title"),
        _table("hourly_engagement", f"view_date STRING, {_DAY}, hour_of_day STRING", "view_date", "hour_of_day"),
        _table("title_metrics_max", f"{_TITLE}, update_time TIMESTAMP", "title"),
        _table(
            "daily_title_engagement",
            "view_date DATE, title STRING, daily_views BIGINT, total_watch_time BIGINT, "
            "avg_watch_time DOUBLE, unique_viewers BIGINT, genres STRING, release_date STRING, "
            "update_time TIMESTAMP",
            "view_date",
            "title",
        ),
        _table("daily_engagement_documented", f"view_date DATE, {_DAY}, peak_hour INT, update_time TIMESTAMP", "view_date"),
    )
}
