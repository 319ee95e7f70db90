"""Row-level operators: reshape raw rows, derive event time, split rejects, filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens.functions.scalar import SPACE_FORMAT, duration_seconds, parse_event_time
from viewlens.schema import EVENT_TIME


def activity_record(raw: DataFrame) -> DataFrame:
    """Raw viewing rows to the eleven-field record. Missing text stays null."""
    text = lambda name: F.col(name).cast("string")
    return raw.select(
        text("user_id").alias("USER_ID"),
        text("datetime").alias("TIMESTAMP"),
        F.lit("view").alias("ACTIVITY_TYPE"),
        text("movie_id").alias("TITLE_ID"),
        duration_seconds(text("duration")).alias("DURATION"),
        F.lit(None).cast("string").alias("DEVICE_TYPE"),
        F.lit(None).cast("string").alias("LOCATION"),
        text("title").alias("TITLE"),
        text("genres").alias("GENRES"),
        text("release_date").alias("RELEASE_DATE"),
        text("movie_id").alias("MOVIE_ID"),
    )


def with_event_time(activity: DataFrame, fmt: str = SPACE_FORMAT, column: str = "TIMESTAMP") -> DataFrame:
    """Add the event-time column and drop rows whose time does not parse."""
    return activity.withColumn(EVENT_TIME, parse_event_time(column, fmt)).filter(F.col(EVENT_TIME).isNotNull())


def event_time_rejects(activity: DataFrame, fmt: str = SPACE_FORMAT, column: str = "TIMESTAMP") -> DataFrame:
    """The rows ``with_event_time`` drops, unchanged, for a dead-letter table."""
    return activity.filter(parse_event_time(column, fmt).isNull())


def keep_viewed(activity: DataFrame) -> DataFrame:
    """Rows with a duration. Zero is a duration and stays."""
    return activity.filter(F.col("DURATION").isNotNull())
