"""Edge rows, each stated by hand."""

import datetime

import pytest
from builders import SCHEMA, activity, record, rows
from pyspark.sql import functions as F

from viewlens.functions.scalar import T_FORMAT, duration_seconds
from viewlens.operators.record import event_time_rejects, keep_viewed, with_event_time
from viewlens.plans import metrics as M
from viewlens.plans.query_files import run_query_file
from viewlens.schema import RESULTS


def timed(spark, *records, **kw):
    return with_event_time(activity(spark, records), **kw)


def one(df):
    (row,) = df.collect()
    return row


def test_null_duration_is_dropped_and_zero_kept(spark):
    got = one(M.title_metrics_max(timed(spark, record(duration=10), record(duration=0), record(duration=None))))
    assert (got.total_views, got.avg_duration, got.total_duration) == (2, 5.0, 10)


def test_durations_from_text(spark):
    texts = ["12.9", "-3.9", "0.0", " 7 ", "NaN", "abc", "", None, "1e400", "99999999999"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.d for r in df.select("i", duration_seconds("t").alias("d")).orderBy("i").collect()]
    assert got == [12, -3, 0, 7, None, None, None, None, None, None]


def test_times_that_do_not_parse_are_split_off(spark):
    times = ["2024-01-01 10:00:00", "bad", None, "2024-01-01T10:00:00", "2024-02-30 10:00:00", "2024-01-01", "2024-01-01 10:00:00 "]
    df = activity(spark, [record(time=t) for t in times])
    assert [r.TIMESTAMP for r in with_event_time(df).collect()] == times[:1]
    assert sorted(r.TIMESTAMP or "" for r in event_time_rejects(df).collect()) == sorted(t or "" for t in times[1:])
    assert [r.TIMESTAMP for r in with_event_time(df, T_FORMAT).collect()] == [times[3]]


def test_other_formats_and_columns(spark):
    df = spark.createDataFrame([("31/01/2024 05-06",), ("x",)], "seen string")
    got = with_event_time(df, "dd/MM/yyyy HH-mm", "seen").collect()
    assert [r.event_timestamp for r in got] == [datetime.datetime(2024, 1, 31, 5, 6)]


def test_latest_skips_null_and_columns_are_independent(spark):
    got = one(
        M.title_metrics_latest(
            timed(
                spark,
                record(genres="old", release="1", arrival=1),
                record(genres="new", release=None, arrival=3),
                record(genres=None, release="2", arrival=2),
                record(genres=None, release=None, arrival=9),
            )
        )
    )
    assert (got.genres, got.release_date) == ("new", "2")


def test_latest_differs_from_max(spark):
    df = timed(spark, record(genres="z", arrival=1), record(genres="a", arrival=2))
    assert one(M.title_metrics_latest(df)).genres == "a"
    assert one(M.title_metrics_max(df)).genres == "z"


def test_attributes_all_null(spark):
    df = timed(spark, record(genres=None, release=None))
    assert one(M.title_metrics_latest(df)).genres is None
    assert one(M.title_metrics_max(df)).release_date is None


def test_null_title_is_one_group(spark):
    got = M.title_metrics_max(timed(spark, record(title=None), record(title=None), record(title="B"))).collect()
    assert sorted((r.title or "", r.total_views) for r in got) == [("", 2), ("B", 1)]


def test_null_title_or_genre_does_not_win(spark):
    df = timed(spark, record(title=None, genres=None), record(title=None, genres=None), record(title="B", genres="g"))
    got = one(M.daily_engagement_documented(df))
    assert (got.most_watched_title, got.most_watched_genre, got.total_views) == ("B", "g", 3)


def test_most_watched_breaks_ties_by_watch_time_then_value(spark):
    got = one(
        M.daily_engagement_documented(
            timed(
                spark,
                record(title="B", genres="x", duration=5),
                record(title="A", genres="y", duration=5),
                record(title="C", genres="x", duration=4),
                record(title="D", genres="y", duration=7),
            )
        )
    )
    assert got.most_watched_title == "D"
    assert got.most_watched_genre == "y"
    tied = M.daily_engagement_documented(timed(spark, record(title="B"), record(title="A")))
    assert one(tied).most_watched_title == "A"


def test_peak_hour_takes_the_earlier_of_two(spark):
    df = timed(
        spark,
        record(time="2024-01-01 22:00:00"),
        record(time="2024-01-01 09:59:59"),
        record(time="2024-01-01 22:30:00"),
        record(time="2024-01-01 09:00:00"),
        record(time="2024-01-01 03:00:00"),
    )
    assert one(M.daily_engagement_documented(df)).peak_hour == 9
    assert one(M.daily_engagement_rowtime(df)).peak_hour == 9


def test_peak_hour_at_the_ends_of_the_day(spark):
    assert one(M.daily_engagement_rowtime(timed(spark, record(time="2024-01-01 00:00:00")))).peak_hour == 0
    assert one(M.daily_engagement_rowtime(timed(spark, record(time="2024-01-01 23:59:59")))).peak_hour == 23


def test_days_split_at_utc_midnight(spark):
    df = timed(spark, record(time="2024-01-01 23:59:59"), record(time="2024-01-02 00:00:00"))
    dates = [datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)]
    assert sorted(r.view_date for r in M.daily_title_engagement(df).collect()) == dates
    assert sorted(r.view_date for r in M.daily_engagement_windowed(df).collect()) == [str(d) for d in dates]
    starts = sorted(r.window_start for r in M.title_metrics_windowed(df).collect())
    assert starts == [f"{d} 00:00:00" for d in dates]


def test_same_user_counts_once_per_key(spark):
    df = timed(
        spark,
        record(user="u"),
        record(user="u"),
        record(user=None),
        record(user="u", time="2024-01-02 10:00:00"),
    )
    got = {r.view_date.day: (r.unique_viewers, r.daily_views) for r in M.daily_title_engagement(df).collect()}
    assert got == {1: (1, 3), 2: (1, 1)}
    rowtime = {r.view_date[-2:]: r.total_unique_users for r in M.daily_engagement_rowtime(df).collect()}
    assert rowtime == {"01": 1, "02": 1}


def test_days_without_users(spark):
    df = timed(spark, record(user=None))
    for metric in (M.daily_engagement_documented, M.daily_engagement_rowtime):
        assert one(metric(df)).total_unique_users == 0
    assert one(M.daily_engagement_exact(df)).total_unique_users == 0


def test_users_of_several_cells_count_once(spark):
    at = ("2024-01-01 10:00:00", "2024-01-01 11:00:00", "2024-01-01 11:30:00")
    df = timed(spark, *[record(user=u, time=t, title=t[-8:]) for u in ("u", "v", None) for t in at])
    for metric in (M.daily_engagement_documented, M.daily_engagement_rowtime):
        assert (one(metric(df)).total_unique_users, one(metric(df)).total_views, one(metric(df)).peak_hour) == (2, 9, 11)


def test_window_hour_is_always_midnight(spark):
    assert one(M.daily_engagement_windowed(timed(spark, record(time="2024-01-01 17:00:00")))).window_hour == "00"


def test_hour_of_day_is_two_digits(spark):
    df = timed(spark, record(time="2024-01-01 07:30:00"))
    exact = M.hourly_engagement_exact
    for result in (M.hourly_engagement(df), exact(df), exact.finish(exact.cells.of(df, expire=True))):
        assert (one(result).view_date, one(result).hour_of_day) == ("2024-01-01", "07")


def test_row_time_is_the_newest_event_not_the_newest_arrival(spark):
    df = timed(spark, record(time="2024-01-05 00:00:00", arrival=1), record(time="2024-01-01 00:00:00", arrival=2))
    assert one(M.title_metrics_rowtime(df)).update_time == datetime.datetime(2024, 1, 5)


ALL = {
    "title_metrics_windowed": M.title_metrics_windowed,
    "daily_engagement_windowed": M.daily_engagement_windowed,
    "title_metrics_rowtime": M.title_metrics_rowtime,
    "daily_engagement_rowtime": M.daily_engagement_rowtime,
    "title_metrics_latest": M.title_metrics_latest,
    "hourly_engagement": M.hourly_engagement,
    "title_metrics_max": M.title_metrics_max,
    "daily_title_engagement": M.daily_title_engagement,
    "daily_engagement_documented": M.daily_engagement_documented,
}


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_input_gives_the_declared_schema(spark, name):
    result = ALL[name](with_event_time(spark.createDataFrame([], SCHEMA)))
    assert [(f.name, f.dataType) for f in result.schema] == [(f.name, f.dataType) for f in RESULTS[name].schema]
    assert result.collect() == []


def test_processing_time_is_now_in_milliseconds(spark):
    row = one(M.title_metrics_max(timed(spark, record())).withColumn("us", F.unix_micros("update_time")))
    assert row.us % 1000 == 0
    assert abs(row.us / 1e6 - datetime.datetime.now().timestamp()) < 120


def test_partitioning_and_order_change_nothing(spark):
    records = [
        record(
            user=f"u{i % 7}",
            time=f"2024-01-0{1 + i % 3} {i % 24:02d}:00:00",
            duration=i % 5,
            title=f"t{i % 4}",
            genres=None if i % 6 == 0 else f"g{i % 5}",
            arrival=1 + (i * 37) % 50,
        )
        for i in range(200)
    ]
    df = timed(spark, *records)
    other = df.orderBy(F.xxhash64("USER_ID", "TIMESTAMP", "arrival").desc()).repartition(13, "arrival")
    for name, metric in ALL.items():
        keep = [c for c in metric(df).columns if c != "update_time" or name.endswith("rowtime")]
        assert rows(metric(df).select(*keep)) == rows(metric(other).select(*keep)), name


def test_totals_add_up(spark):
    df = timed(spark, *[record(user=f"u{i}", title=f"t{i % 3}", duration=None if i % 4 == 0 else i) for i in range(40)])
    n = keep_viewed(df).count()
    assert sum(r.total_views for r in M.title_metrics_max(df).collect()) == n
    assert sum(r.daily_views for r in M.daily_title_engagement(df).collect()) == n


def test_query_file_parameters(spark):
    df = activity(spark, [record(duration=5), record(duration=50, time="2024-01-01T10:00:00")])
    sql = lambda **p: run_query_file(spark, "title_metrics", df, **p)
    assert one(sql(time_format=T_FORMAT, min_duration=0)).total_duration == 50
    assert sql(time_format=T_FORMAT, min_duration=60).collect() == []
    with pytest.raises(Exception, match="min_duration"):
        sql(time_format=T_FORMAT)
    with pytest.raises(ValueError, match="min_duration"):
        sql(time_format=T_FORMAT, min_duration=None)


def test_query_file_equals_the_same_metric(spark):
    records = [record(user=f"u{i % 3}", time=f"2024-01-01 {i % 5:02d}:00:00", title=f"t{i % 2}") for i in range(30)]
    got = run_query_file(spark, "hourly_engagement", activity(spark, records), time_format="yyyy-MM-dd HH:mm:ss")
    assert rows(got) == rows(M.hourly_engagement(timed(spark, *records)))
    exact = run_query_file(spark, "hourly_engagement_exact", activity(spark, records), time_format="yyyy-MM-dd HH:mm:ss")
    assert rows(exact) == rows(M.hourly_engagement_exact(timed(spark, *records)))
