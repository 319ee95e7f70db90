"""The metric queries: activity in, one declared result table out.

``activity`` carries the record columns, ``event_timestamp`` and ``arrival`` (the log
position). The functions run on batch and on streaming input. Results with exact users are a
:class:`viewlens.operators.cells.UserMetric`: called on a batch it gives the result; on a stream
its cells are kept, and finished on read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlens.functions import aggregates as A
from viewlens.functions import sketches as K
from viewlens.functions.scalar import format_time, processing_time
from viewlens.operators import cells as C
from viewlens.operators import facets as FC
from viewlens.operators.record import keep_viewed
from viewlens.schema import EVENT_TIME, RESULTS

DAY = "yyyy-MM-dd"
HOUR = "HH"
SECOND = "yyyy-MM-dd HH:mm:ss"


def day_window() -> Column:
    return F.window(EVENT_TIME, "1 day")


def _title_metrics() -> list[Column]:
    return [
        A.view_count().alias("total_views"),
        A.average_duration().alias("avg_duration"),
        A.total_duration().alias("total_duration"),
    ]


def _engagement() -> list[Column]:
    return [
        A.view_count().alias("total_views"),
        A.total_duration().alias("total_watch_time"),
        A.average_duration().alias("avg_watch_time"),
    ]


def _latest_attributes() -> list[Column]:
    return [A.latest("GENRES").alias("genres"), A.latest("RELEASE_DATE").alias("release_date")]


def _latest_watched() -> list[Column]:
    return [A.latest("TITLE").alias("most_watched_title"), A.latest("GENRES").alias("most_watched_genre")]


def _max_attributes() -> list[Column]:
    return [F.max("GENRES").alias("genres"), F.max("RELEASE_DATE").alias("release_date")]


def title_metrics_windowed(activity: DataFrame) -> DataFrame:
    """Per title and tumbling day, with the latest attributes."""
    grouped = (
        keep_viewed(activity)
        .groupBy(day_window().alias("day"), F.col("TITLE").alias("title"))
        .agg(*_title_metrics(), *_latest_attributes())
    )
    return RESULTS["title_metrics_windowed"].conform(
        grouped.withColumn("window_start", format_time("day.start", SECOND))
    )


def daily_engagement_windowed(activity: DataFrame) -> DataFrame:
    """Per tumbling day, with estimated users. ``most_watched_*`` is the latest value and
    ``window_hour`` the hour a day window starts at, both as the query states them."""
    grouped = (
        keep_viewed(activity)
        .groupBy(day_window().alias("day"))
        .agg(*_engagement(), *_latest_watched(), A.approx_users().alias("total_unique_users"))
    )
    return _daily_windowed(grouped, "day.start")


def _daily_windowed(grouped: DataFrame, start: str, *more: str) -> DataFrame:
    return RESULTS["daily_engagement_windowed"].conform(
        grouped.withColumn("view_date", format_time(start, DAY)).withColumn("window_hour", format_time(start, HOUR)),
        *more,
    )


def _watched_users() -> list[Column]:
    return [
        C.views().alias("total_views"),
        C.watch_time().alias("total_watch_time"),
        C.average_watch_time().alias("avg_watch_time"),
        C.newest("TITLE").alias("most_watched_title"),
        C.newest("GENRES").alias("most_watched_genre"),
    ]


def _checked_users() -> list[Column]:
    """Exact users, and whether the estimate of them is within four standard deviations, or within
    one user where those are less: two users of a few may share a register."""
    bound = F.greatest(F.lit(1.0), 4 * A.APPROX_RSD * C.users())
    return [
        C.users().alias("total_unique_users"),
        (F.abs(A.approx_users() - C.users()) <= bound).alias("within_bound"),
    ]


def daily_users_checked(activity: DataFrame) -> DataFrame:
    """Exact users per date, with ``within_bound``."""
    cells = C.Cells(bucket="1 day").of(activity)
    return cells.groupBy(C.day().alias("view_date")).agg(*_checked_users())


def _finish_daily_windowed(cells: DataFrame) -> DataFrame:
    users = C.users().alias("total_unique_users")
    return _daily_windowed(cells.groupBy(C.BUCKET).agg(*_watched_users(), users), C.BUCKET)


def daily_engagement_checked(activity: DataFrame) -> DataFrame:
    """Per tumbling day, with exact users and whether their estimate is ``within_bound``."""
    cells = daily_engagement_exact.cells.of(activity)
    return _daily_windowed(cells.groupBy(C.BUCKET).agg(*_watched_users(), *_checked_users()), C.BUCKET, "within_bound")


#: Per tumbling day, with exact users.
daily_engagement_exact = C.UserMetric(C.Cells(bucket="1 day", newest=("TITLE", "GENRES")), _finish_daily_windowed)


def title_metrics_rowtime(activity: DataFrame) -> DataFrame:
    """Per title over all time, stamped with the newest contributing event time."""
    grouped = (
        keep_viewed(activity)
        .groupBy(F.col("TITLE").alias("title"))
        .agg(*_title_metrics(), *_latest_attributes(), A.row_time().alias("update_time"))
    )
    return RESULTS["title_metrics_rowtime"].conform(grouped)


def _finish_daily_rowtime(cells: DataFrame) -> DataFrame:
    grouped = cells.groupBy(C.day().alias("view_date")).agg(
        *_watched_users(),
        C.users(finer=True).alias("total_unique_users"),
        C.busiest_hour().alias("peak_hour"),
        C.row_time().alias("update_time"),
    )
    return RESULTS["daily_engagement_rowtime"].conform(grouped.withColumn("view_date", format_time("view_date", DAY)))


#: Per date, with exact users, the busiest hour and the newest event time.
daily_engagement_rowtime = C.UserMetric(
    C.Cells(bucket="1 hour", newest=("TITLE", "GENRES"), row_time=True), _finish_daily_rowtime
)


def title_metrics_latest(activity: DataFrame) -> DataFrame:
    """Per title over all time, with the latest attributes."""
    grouped = (
        keep_viewed(activity)
        .groupBy(F.col("TITLE").alias("title"))
        .agg(*_title_metrics(), *_latest_attributes())
    )
    return RESULTS["title_metrics_latest"].conform(grouped)


def _finish_title_viewers(cells: DataFrame) -> DataFrame:
    return cells.groupBy(F.col("TITLE").alias("title")).agg(
        C.views().alias("total_views"),
        C.average_watch_time().alias("avg_duration"),
        C.watch_time().alias("total_duration"),
        C.newest("GENRES").alias("genres"),
        C.newest("RELEASE_DATE").alias("release_date"),
        C.users().alias("unique_viewers"),
    )


#: Per title over all time, with the latest attributes and exact viewers.
title_metrics_with_viewers = C.UserMetric(
    C.Cells(columns=("TITLE",), newest=("GENRES", "RELEASE_DATE")), _finish_title_viewers
)


def title_days_max(activity: DataFrame) -> DataFrame:
    """Per title and tumbling day, with the largest attributes."""
    grouped = (
        keep_viewed(activity)
        .groupBy(day_window().alias("day"), F.col("TITLE").alias("title"))
        .agg(*_title_metrics(), *_max_attributes())
    )
    return grouped.withColumn("window_start", format_time("day.start", SECOND)).drop("day")


def hourly_engagement(activity: DataFrame) -> DataFrame:
    """Per date and hour of day, with estimated users."""
    grouped = (
        keep_viewed(activity)
        .groupBy(F.date_trunc("HOUR", EVENT_TIME).alias(C.BUCKET))
        .agg(*_engagement(), *_latest_watched(), A.approx_users().alias("total_unique_users"))
    )
    return _hourly(grouped)


def _hourly(grouped: DataFrame, *more: str) -> DataFrame:
    return RESULTS["hourly_engagement"].conform(
        grouped.withColumn("view_date", format_time(C.BUCKET, DAY)).withColumn(
            "hour_of_day", format_time(C.BUCKET, HOUR)
        ),
        *more,
    )


def _finish_hourly(cells: DataFrame) -> DataFrame:
    return _hourly(cells.groupBy(C.BUCKET).agg(*_watched_users(), C.users().alias("total_unique_users")))


def hourly_engagement_checked(activity: DataFrame) -> DataFrame:
    """Per date and hour of day, with exact users and whether their estimate is ``within_bound``."""
    cells = hourly_engagement_exact.cells.of(activity)
    return _hourly(cells.groupBy(C.BUCKET).agg(*_watched_users(), *_checked_users()), "within_bound")


#: Per date and hour of day, with exact users.
hourly_engagement_exact = C.UserMetric(C.Cells(bucket="1 hour", newest=("TITLE", "GENRES")), _finish_hourly)


def title_metrics_max(activity: DataFrame, stamp: bool = True) -> DataFrame:
    """Per title over all time, with the largest attributes; ``stamp`` adds processing time."""
    grouped = (
        keep_viewed(activity)
        .groupBy(F.col("TITLE").alias("title"))
        .agg(*_title_metrics(), *_max_attributes())
    )
    return RESULTS["title_metrics_max"].conform(_stamped(grouped, stamp))


def _finish_daily_titles(cells: DataFrame, stamp: bool = True) -> DataFrame:
    grouped = cells.groupBy(C.day().alias("view_date"), F.col("TITLE").alias("title")).agg(
        C.views().alias("daily_views"),
        C.watch_time().alias("total_watch_time"),
        C.average_watch_time().alias("avg_watch_time"),
        C.users().alias("unique_viewers"),
        C.largest("GENRES").alias("genres"),
        C.largest("RELEASE_DATE").alias("release_date"),
    )
    return RESULTS["daily_title_engagement"].conform(_stamped(grouped, stamp))


#: Per date and title, with exact viewers, stamped with processing time.
daily_title_engagement = C.UserMetric(
    C.Cells(columns=("TITLE",), bucket="1 day", largest=("GENRES", "RELEASE_DATE")), _finish_daily_titles
)


def _finish_daily_documented(cells: DataFrame, stamp: bool = True) -> DataFrame:
    days = cells.groupBy(C.day().alias("view_date")).agg(
        FC.users().alias("total_unique_users"),
        FC.total("views").alias("total_views"),
        FC.total("watch_time").alias("total_watch_time"),
        FC.winner(FC.TITLE).alias("most_watched_title"),
        FC.winner(FC.GENRE).alias("most_watched_genre"),
        FC.peak_hour().alias("peak_hour"),
    )
    days = days.withColumn("avg_watch_time", F.col("total_watch_time").cast("double") / F.col("total_views"))
    return RESULTS["daily_engagement_documented"].conform(_stamped(days, stamp))


#: Per date: exact users, most watched title and genre, peak hour; stamped with processing time.
#: All come from the same facets, so on a stream from the same position of the log.
daily_engagement_documented = C.UserMetric(FC.Facets(), _finish_daily_documented)


def hourly_sketches(activity: DataFrame, expire: bool = False) -> DataFrame:
    """Per hour: views, watch time and a sketch of the users, from one pass; batch or stream. With
    ``expire`` a watermarked stream drops closed hours from its state."""
    start = F.window(EVENT_TIME, "1 hour") if expire else F.date_trunc("HOUR", EVENT_TIME)
    hours = (
        keep_viewed(activity)
        .groupBy(start.alias(C.BUCKET))
        .agg(A.view_count().alias("views"), A.total_duration().alias("watch_time"), K.user_sketch().alias("users"))
    )
    return hours.withColumn(C.BUCKET, F.col(f"{C.BUCKET}.start")) if expire else hours


def days_of_sketches(hours: DataFrame) -> DataFrame:
    """Per date, merged from hours: estimated users, views, total and average watch time."""
    days = hours.groupBy(C.day().alias("view_date")).agg(
        K.estimate(K.merged("users")).alias("estimated_users"),
        C.views().alias("total_views"),
        C.watch_time().alias("total_watch_time"),
    )
    return days.withColumn("avg_watch_time", F.col("total_watch_time").cast("double") / F.col("total_views"))


def users_of_days(activity: DataFrame) -> DataFrame:
    """Per date: exact users, and their estimate from a sketch of the day's rows."""
    cells = C.Cells(bucket="1 day").of(activity)
    return cells.groupBy(C.day().alias("view_date")).agg(
        C.users().alias("total_unique_users"), K.estimate(K.user_sketch()).alias("estimate_of_rows")
    )


def unstamped(result: DataFrame) -> DataFrame:
    """Without processing time, to compare results."""
    return result.drop("update_time")


def _stamped(df: DataFrame, stamp: bool) -> DataFrame:
    return df.withColumn("update_time", processing_time()) if stamp else df
