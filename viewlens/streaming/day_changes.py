"""Changes of the documented daily result, as a stream: a day comes when its row has changed.

The input is the changelog of a table of facets (:mod:`viewlens.operators.facets`), whose rows are
totals, so a change that comes twice changes nothing. Two stateful steps follow each other: the
first keeps slices of a day's facets, so that a day with most of the changes is spread over its
slices, and passes a slice's summary on when it has changed; the second keeps the summaries of a day
and passes its row on when that has. Totals only grow, so a slice's winner is the former one or
among the changes; users and hours are remembered one by one. Behind the watermark, timers remove
both states of a day.
"""

from __future__ import annotations

import calendar
from collections.abc import Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from viewlens.operators import facets as FC
from viewlens.operators.cells import BUCKET
from viewlens.schema import RESULTS
from viewlens.streaming import upsert

#: Slices of a day's titles, genres and users.
SLICES = 16
#: A facet's day may change until the newest day is two days ahead: one day is allowed lateness, and
#: another lies between the start of a day and its end.
DELAY = "48 hours"

SLICE = "rows bigint, views bigint, watch_time bigint, value string, best_views bigint, best_watch_time bigint"
SUMMARY = f"{BUCKET} timestamp, facet string, slice int, {SLICE}"
DAY = (
    "view_date date, total_unique_users bigint, total_views bigint, total_watch_time bigint, avg_watch_time double, "
    "most_watched_title string, most_watched_genre string, peak_hour int"
)
_SLICE = [c.split()[0] for c in SLICE.split(", ")]
_DAY = [c.split()[0] for c in DAY.split(", ")]


def _after(day: datetime) -> int:
    """A millisecond behind a day's start, which like every time here is in UTC."""
    return calendar.timegm(day.timetuple()) * 1000 + 1


def _beats(a: tuple, b: tuple) -> bool:
    """More views, then more watch time, then the smaller value."""
    return (-a[1], -a[2], a[0].encode()) < (-b[1], -b[2], b[0].encode())


class _Slices(StatefulProcessor):
    """Keyed by day, facet and slice: the summary of the slice, and what it has of users and hours."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.summary = handle.getValueState("summary", SLICE)
        self.seen = handle.getMapState("seen", "value string", "views bigint, watch_time bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        day, facet, number = key
        changed: dict[str, tuple[int, int, int]] = {}
        for some in rows:
            for value, *change in zip(some["value"], some[upsert.BATCH], some["views"], some["watch_time"]):
                changed[value] = max(changed.get(value, (-1, 0, 0)), tuple(map(int, change)))
        if not self.summary.exists():
            self.handle.registerTimer(_after(day))
        before = self.summary.get() if self.summary.exists() else (0, 0, 0, None, 0, 0)
        count, views, watched = before[:3]
        best = tuple(before[3:])
        for value, (_, now, now_watched) in changed.items():
            if facet in (FC.VIEWER, FC.HOUR):
                known = self.seen.containsKey((value,))
                if facet == FC.HOUR:
                    old = self.seen.getValue((value,)) if known else (0, 0)
                    views, watched = views + now - old[0], watched + now_watched - old[1]
                if not known or facet == FC.HOUR:
                    self.seen.updateValue((value,), (now, now_watched))
                count += not known
            # hours rank by views alone
            mine = (value, now, 0 if facet == FC.HOUR else now_watched)
            if facet != FC.VIEWER and (best[0] is None or best[0] == value or _beats(mine, best)):
                best = mine
        after = (count, views, watched, *best)
        if after != tuple(before):
            self.summary.update(after)
            yield pd.DataFrame([(day, facet, number, *after)], columns=[BUCKET, "facet", "slice", *_SLICE])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.summary.clear()
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Days(StatefulProcessor):
    """Keyed by day: the summaries of its slices, and the row that was last passed on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", DAY.replace("view_date date", "view_date string"))
        self.slices = handle.getMapState("slices", "facet string, slice int", SLICE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        (day,) = key
        for some in rows:
            for facet, number, *summary in some[["facet", "slice", *_SLICE]].itertuples(index=False, name=None):
                summary = [v if i == 3 else int(v) for i, v in enumerate(summary)]
                summary[3] = None if pd.isna(summary[3]) else summary[3]
                self.slices.updateValue((facet, int(number)), tuple(summary))
        best: dict[str, tuple] = {}
        users = views = watched = 0
        for (facet, _), summary in self.slices.iterator():
            if facet == FC.VIEWER:
                users += summary[0]
            elif facet == FC.HOUR:
                views, watched = views + summary[1], watched + summary[2]
            mine = tuple(summary[3:])
            if mine[0] is not None and (facet not in best or _beats(mine, best[facet])):
                best[facet] = mine
        if not views:
            return
        won = lambda facet: best[facet][0] if facet in best else None
        hour = int(won(FC.HOUR))
        row = (str(day.date()), users, views, watched, watched / views, won(FC.TITLE), won(FC.GENRE), hour)
        known = self.row.exists()
        if not known:
            self.handle.registerTimer(_after(day))
        if not known or tuple(self.row.get()) != row:
            self.row.update(row)
            yield pd.DataFrame([(day.date(), *row[1:])], columns=_DAY)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.row.clear()
        self.slices.clear()
        return iter(())

    def close(self) -> None:
        pass


def daily_documented_changes(changes: DataFrame, delay: str = DELAY, slices: int = SLICES) -> DataFrame:
    """The stream of changed days, to be written in append mode, from the changelog of the facets
    that ``plans.metrics.daily_engagement_documented`` keeps. A day's newest row is its result."""
    number = F.when(F.col("facet") == FC.HOUR, 0).otherwise(F.pmod(F.xxhash64("value"), F.lit(slices))).cast("int")
    sliced = changes.withWatermark(BUCKET, delay).withColumn("slice", number)
    summaries = sliced.groupBy(BUCKET, "facet", "slice").transformWithStateInPandas(
        _Slices(), StructType.fromDDL(SUMMARY), "Append", "EventTime", eventTimeColumnName=BUCKET
    )
    days = summaries.groupBy(BUCKET).transformWithStateInPandas(_Days(), StructType.fromDDL(DAY), "Append", "EventTime")
    return RESULTS["daily_engagement_documented"].conform(days)
