"""Facets of a day: its titles, genres, hours and users, each with views and watch time.

A viewing is one row to each facet, combined before it moves, so a day's most watched title and
genre, its peak hour and its users come from one pass and one state: a row for each title, genre,
hour and user of a day, and none for their combinations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlens.functions import aggregates as A
from viewlens.operators.cells import BUCKET, USER, Cells
from viewlens.operators.record import keep_viewed
from viewlens.schema import EVENT_TIME

FACET, VALUE = "facet", "value"
TITLE, GENRE, HOUR, VIEWER = "title", "genre", "hour", "user"


@dataclass(frozen=True)
class Facets(Cells):
    """Cells by day, facet and value. Rows without a title, genre or user have no such facet."""

    bucket: str | None = "1 day"

    @property
    def key(self) -> tuple[str, ...]:
        return (BUCKET, FACET, VALUE)

    def of(self, activity: DataFrame, expire: bool = False) -> DataFrame:
        start = F.window(EVENT_TIME, "1 day") if expire else F.date_trunc("DAY", EVENT_TIME)
        values = {TITLE: F.col("TITLE"), GENRE: F.col("GENRES"), HOUR: F.date_format(EVENT_TIME, "HH"), VIEWER: F.col(USER)}
        rows = F.array(*(F.struct(F.lit(f).alias(FACET), v.alias(VALUE)) for f, v in values.items()))
        viewed = keep_viewed(activity).select(start.alias(BUCKET), "DURATION", F.explode(rows).alias("f"))
        cells = viewed.select(BUCKET, "DURATION", "f.*").filter(F.col(VALUE).isNotNull()).groupBy(*self.key)
        cells = cells.agg(A.view_count().alias("views"), A.total_duration().alias("watch_time"))
        return cells.withColumn(BUCKET, F.col(f"{BUCKET}.start")) if expire else cells


def of(facet: str) -> Column:
    return F.col(FACET) == facet


def winner(facet: str) -> Column:
    """Ranked by views, then watch time, then the smaller value."""
    rank = F.struct((-F.col("views")).alias("v"), (-F.col("watch_time")).alias("w"), F.col(VALUE).alias("value"))
    return F.min(F.when(of(facet), rank)).getField("value")


def peak_hour() -> Column:
    """Ranked by views, then the earlier hour."""
    rank = F.struct((-F.col("views")).alias("v"), F.col(VALUE).cast("int").alias("value"))
    return F.min(F.when(of(HOUR), rank)).getField("value")


def total(column: str) -> Column:
    """Over the hours, of which every viewing has one."""
    return F.sum(F.when(of(HOUR), F.col(column)))


def users() -> Column:
    return F.count(F.when(of(VIEWER), F.col(VALUE)))
