"""Aggregate expressions of the metric queries.

Each is a plain ``Column`` so one definition serves batch and streaming group-bys.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from viewlens.schema import EVENT_TIME, POSITION

# Relative standard deviation of the approximate distinct count.
APPROX_RSD = 0.02


def view_count() -> Column:
    """Rows; every query keeps only rows with a duration, so counting it counts them."""
    return F.count("DURATION")


def average_duration() -> Column:
    return F.avg(F.col("DURATION").cast("double"))


def total_duration() -> Column:
    return F.sum(F.col("DURATION").cast("bigint"))


def latest(column: str, position: str = POSITION) -> Column:
    """Last non-null value by log position; equal positions resolve to the larger value."""
    return newest(column, position).getField("value")


def newest(column: str, position: str = POSITION) -> Column:
    """The same with its position, so that newest values can be compared again."""
    value = F.col(column)
    return F.max(F.when(value.isNotNull(), F.struct(F.col(position).alias("position"), value.alias("value"))))


def approx_users(column: str = "USER_ID") -> Column:
    return F.approx_count_distinct(column, APPROX_RSD)


def row_time() -> Column:
    """Event time of the newest contributing row."""
    return F.max(EVENT_TIME)


def busiest_hour(hour: str) -> Column:
    """Hour 0-23 with most rows, the earliest on a tie, from 24 counters in one group.

    The counters are fixed-width aggregation state, so the peak needs no second grouping
    and runs on update-mode streams, where grouping a grouped result is refused.
    """
    counters = ", ".join(f"count(CASE WHEN {hour} = {h} THEN 1 END)" for h in range(24))
    counts = F.expr(f"array({counters})")
    return (F.array_position(counts, F.array_max(counts)) - 1).cast("int")
