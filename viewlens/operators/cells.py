"""Cells: one partial result for each key and user, from which exact user counts follow.

Cells come from one pass with map-side aggregation, and a key with a third of the rows is spread
over its users. They are what a stream keeps, a state row for each (key, user), never a set of
users in one row; grouping them again on read gives the result, with its users counted exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from viewlens.functions import aggregates as A
from viewlens.functions.scalar import view_date
from viewlens.operators.record import keep_viewed
from viewlens.schema import EVENT_TIME, POSITION

USER, BUCKET = "USER_ID", "bucket"


@dataclass(frozen=True)
class Cells:
    """How a result's cells are grouped, and what each keeps beside views and watch time."""

    #: Columns of the key beside the time bucket.
    columns: tuple[str, ...] = ()
    #: ``1 day`` or ``1 hour``, or none for a key without time.
    bucket: str | None = None
    newest: tuple[str, ...] = ()
    largest: tuple[str, ...] = ()
    row_time: bool = False

    @property
    def key(self) -> tuple[str, ...]:
        return (*((BUCKET,) if self.bucket else ()), *self.columns, USER)

    def of(self, activity: DataFrame, expire: bool = False) -> DataFrame:
        """The cells of an activity relation, batch or stream.

        ``expire`` groups by the same buckets as tumbling windows, so that a watermarked stream
        can drop closed ones from its state; the plain form keeps each bucket for late rows.
        """
        viewed = keep_viewed(activity)
        if self.bucket:
            unit = {"1 day": "DAY", "1 hour": "HOUR"}[self.bucket]
            start = F.window(EVENT_TIME, self.bucket) if expire else F.date_trunc(unit, EVENT_TIME)
            viewed = viewed.withColumn(BUCKET, start)
        kept = [A.view_count().alias("views"), A.total_duration().alias("watch_time")]
        kept += [A.newest(c).alias(f"newest_{c}") for c in self.newest]
        kept += [F.max(c).alias(f"largest_{c}") for c in self.largest]
        kept += [A.row_time().alias("row_time")] if self.row_time else []
        cells = viewed.groupBy(*self.key).agg(*kept)
        return cells.withColumn(BUCKET, F.col(f"{BUCKET}.start")) if self.bucket and expire else cells

    def units(self, activity: DataFrame) -> DataFrame:
        """A cell for each row, of the schema of :meth:`of` without expiry."""
        viewed = keep_viewed(activity)
        if self.bucket:
            viewed = viewed.withColumn(BUCKET, F.date_trunc({"1 day": "DAY", "1 hour": "HOUR"}[self.bucket], EVENT_TIME))
        newest = lambda c: F.when(
            F.col(c).isNotNull(), F.struct(F.col(POSITION).alias("position"), F.col(c).alias("value"))
        )
        kept = [F.lit(1).cast("bigint").alias("views"), F.col("DURATION").cast("bigint").alias("watch_time")]
        kept += [newest(c).alias(f"newest_{c}") for c in self.newest]
        kept += [F.col(c).alias(f"largest_{c}") for c in self.largest]
        kept += [F.col(EVENT_TIME).alias("row_time")] if self.row_time else []
        return viewed.select(*self.key, *kept)

    def merged(self, cells: DataFrame) -> DataFrame:
        """Cells of equal keys, as from :meth:`units` or kept before, made one."""
        values = [c for c in cells.columns if c not in self.key]
        sums = ("views", "watch_time")
        return cells.groupBy(*self.key).agg(*((F.sum if c in sums else F.max)(c).alias(c) for c in values))

    def from_state(self, state: DataFrame, schema: StructType) -> DataFrame:
        """The cells from ``key`` and ``value`` in a query's state; ``schema`` is that of :meth:`of`.

        Every value has one column there, in the order in which it is computed.
        """
        values = StructType([f for f in schema if f.name not in self.key])
        key = state.schema["key"].dataType.fieldNames()
        named = [F.col("key").getField(k).alias(n) for k, n in zip(key, self.key)]
        if self.bucket and isinstance(state.schema["key"].dataType[0].dataType, StructType):
            named[0] = F.col("key").getField(key[0]).getField("start").alias(BUCKET)
        return state.select(*named, F.col("value").cast(values.simpleString()).alias("value")).select(*self.key, "value.*")


def views() -> Column:
    return F.sum("views")


def watch_time() -> Column:
    return F.sum("watch_time")


def average_watch_time() -> Column:
    return F.sum("watch_time").cast("double") / F.sum("views")


def users(finer: bool = False) -> Column:
    """Exact users of a group of cells; ``finer`` where a user can have several cells in it."""
    return F.count_distinct(USER) if finer else F.count(USER)


def newest(column: str) -> Column:
    return F.max(f"newest_{column}").getField("value")


def largest(column: str) -> Column:
    return F.max(f"largest_{column}")


def row_time() -> Column:
    return F.max("row_time")


def day() -> Column:
    return view_date(BUCKET)


def busiest_hour() -> Column:
    """Hour 0-23 with most views, the earliest on a tie, from hourly cells: 24 sums in one group."""
    sums = ", ".join(f"coalesce(sum(CASE WHEN hour({BUCKET}) = {h} THEN views END), 0)" for h in range(24))
    counts = F.expr(f"array({sums})")
    return (F.array_position(counts, F.array_max(counts)) - 1).cast("int")


@dataclass(frozen=True)
class UserMetric:
    """A result with exact users: its cells, and how they become the result."""

    cells: Cells
    finish: Callable[[DataFrame], DataFrame]

    def __call__(self, activity: DataFrame) -> DataFrame:
        """The result of a batch."""
        return self.finish(self.cells.of(activity))
