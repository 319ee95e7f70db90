"""Every registered query, over the ``events`` table of a data folder.

Streams run as replays: the whole table lands in parts, each is read by a run that resumes the one
before, the result is kept as an upsert table below the shared folder, and that table is returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlens.functions import aggregates as A
from viewlens.functions import scalar as S
from viewlens.functions import sketches as K
from viewlens.operators import record
from viewlens.operators.cells import UserMetric
from viewlens.plans import metrics as M
from viewlens.plans.query_files import run_query_file
from viewlens.schema import ACTIVITY_COLUMNS, EVENT_TIME, POSITION, RESULTS
from viewlens.session import new_run_dir
from viewlens.sources import events as E
from viewlens.sources import messages
from viewlens.sources.files import read_activity_table, write_activity_table
from viewlens.streaming import continuous, day_changes, late, pipeline, rescale, savepoints, state_feed, status, upsert
from viewlens.streaming.settings import GRACE, OUT_OF_ORDERNESS, with_watermark

Query = Callable[[SparkSession, str], DataFrame]


def _text_time(df: DataFrame, column: str) -> DataFrame:
    """Timestamps leave as text, which compares the same in every engine."""
    return df.withColumn(column, S.format_time(column, S.SPACE_FORMAT))


def _batch(metric: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: metric(E.load_timed_activity(spark, sf_dir))


def _viewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.keep_viewed(E.load_timed_activity(spark, sf_dir))


def _by_title(aggregates: Callable[[], list[Column]]) -> Query:
    """Aggregates per title. They come as a function: columns need a running session."""
    return lambda spark, sf_dir: (
        _viewed(spark, sf_dir).groupBy(F.col("TITLE").alias("title")).agg(*aggregates())
    )


# --- rows and messages --------------------------------------------------------------------


#: Partitions of the log, and the number of the record's schema in the values' header.
LOG_PARTITIONS, SCHEMA_ID = 6, 7


def _logged(spark: SparkSession, sf_dir: str, value_format: str = "json") -> DataFrame:
    """Activity as messages of a log: a partition for each key, and offsets in order of arrival."""
    activity = E.activity(E.read_events(spark, sf_dir), "event_id")
    headers = (F.timestamp_micros(F.col(POSITION)).alias("timestamp"), F.col("event_id"))
    sent = messages.encode_activity(activity, value_format, SCHEMA_ID if value_format == "avro" else None, headers)
    return messages.keyed_log(sent, LOG_PARTITIONS, ("timestamp",), new_run_dir(spark, "log"))


def _keyed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logged(spark, sf_dir).select("event_id", "key", "partition", "offset")


def _stored_messages(spark: SparkSession, sf_dir: str, value_format: str = "json") -> DataFrame:
    path = new_run_dir(spark, "messages")
    messages.write_messages(_logged(spark, sf_dir, value_format), path)
    return messages.read_messages(spark, path, binary=value_format == "avro")


def _avro_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity through framed Avro values and back."""
    decoded = messages.decode_activity(_stored_messages(spark, sf_dir, "avro"), "avro", framed=True)
    return decoded.select(*ACTIVITY_COLUMNS, "partition", "offset")


def _avro_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thirteenth Avro value is cut short; those come back as they were."""
    cut = F.expr("CASE WHEN offset % 13 = 0 THEN substring(value, 1, 20) ELSE value END")
    stored = _stored_messages(spark, sf_dir, "avro").withColumn("value", cut)
    dead = messages.undecodable(stored, "avro", framed=True)
    return dead.select("key", F.hex("value").alias("value"), "partition", "offset")


def _activity_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = messages.decode_activity(_stored_messages(spark, sf_dir))
    return decoded.select(*ACTIVITY_COLUMNS, "partition", "offset")


def _log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write messages, read them back from the start, and aggregate what was logged."""
    timed = record.with_event_time(messages.decode_activity(_stored_messages(spark, sf_dir)))
    return M.title_metrics_max(timed, stamp=False)


def _latest_by_log_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest values by time, partition and offset of messages."""
    timed = record.with_event_time(messages.decode_activity(_stored_messages(spark, sf_dir)))
    latest = [A.latest("GENRES").alias("genres"), A.latest("RELEASE_DATE").alias("release_date")]
    return record.keep_viewed(timed).groupBy(F.col("TITLE").alias("title")).agg(*latest)


def _dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thirteenth message is cut short; those come back with their key and text."""
    cut = F.expr("CASE WHEN offset % 13 = 0 THEN left(value, 20) ELSE value END")
    return messages.undecodable(_stored_messages(spark, sf_dir).withColumn("value", cut)).select(
        "key", "value", "partition", "offset"
    )


def _event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = _text_time(E.load_timed_activity(spark, sf_dir), EVENT_TIME)
    return timed.select("USER_ID", "TIMESTAMP", POSITION, EVENT_TIME)


def _event_time_t_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = E.load_activity(spark, sf_dir).withColumn("TIMESTAMP", F.replace("TIMESTAMP", F.lit(" "), F.lit("T")))
    timed = record.with_event_time(written, S.T_FORMAT)
    return _text_time(timed, EVENT_TIME).select("USER_ID", "TIMESTAMP", POSITION, EVENT_TIME)


def _scalar_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.load_timed_activity(spark, sf_dir).select(
        POSITION,
        S.view_date(EVENT_TIME).alias("view_date"),
        S.format_time(EVENT_TIME, M.DAY).alias("view_date_text"),
        S.format_time(EVENT_TIME, M.HOUR).alias("hour_text"),
        F.hour(EVENT_TIME).alias("hour_of_day"),
    )


def _scalar_epoch_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = E.load_timed_activity(spark, sf_dir).withColumn("same_time", S.epoch_roundtrip(EVENT_TIME))
    return _text_time(timed, "same_time").select(POSITION, "TIMESTAMP", "same_time")


def _scalar_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = E.raw_rows(E.read_events(spark, sf_dir))
    return raw.select("event_id", "duration", S.duration_seconds("duration").alias("duration_seconds"))


def _param_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_query_file(
        spark, "title_metrics", E.load_activity(spark, sf_dir), time_format=S.SPACE_FORMAT, min_duration=1
    )


def _param_query_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_query_file(spark, "hourly_engagement_exact", E.load_activity(spark, sf_dir), time_format=S.SPACE_FORMAT)


def _metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = M.unstamped(M.daily_title_engagement(E.load_timed_activity(spark, sf_dir)))
    return messages.encode_result(result, RESULTS["daily_title_engagement"].key)


def _upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity log itself as a changelog: each user's newest record."""
    events = E.read_events(spark, sf_dir)
    changes = E.activity(events, "event_id").select("USER_ID", "TITLE", "DURATION", "GENRES", "event_id")
    return upsert.latest_per_key(changes, ("USER_ID",), "event_id")


# --- aggregates on their own --------------------------------------------------------------


def _most_watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = M.daily_engagement_documented(E.load_timed_activity(spark, sf_dir))
    return days.select("view_date", "most_watched_title", "most_watched_genre")


def _peak_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = _viewed(spark, sf_dir).withColumn("hour", F.hour(EVENT_TIME))
    return timed.groupBy(S.view_date(EVENT_TIME).alias("view_date")).agg(A.busiest_hour("hour").alias("peak_hour"))


def _approx_distinct_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = M.daily_users_checked(E.load_timed_activity(spark, sf_dir))
    return days.withColumnRenamed("total_unique_users", "exact_users")


def _checked_sketches(spark: SparkSession, sf_dir: str, hours: DataFrame) -> DataFrame:
    """Days merged from hours, beside exact users and sketches of whole days."""
    days = M.days_of_sketches(hours).join(M.users_of_days(E.load_timed_activity(spark, sf_dir)), "view_date")
    return days.select(
        "view_date",
        "total_unique_users",
        "total_views",
        "total_watch_time",
        "avg_watch_time",
        (F.col("estimated_users") == F.col("estimate_of_rows")).alias("same_from_rows"),
        K.within_bound(F.col("estimated_users"), F.col("total_unique_users")).alias("within_bound"),
    )


def _daily_users_mergeable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked_sketches(spark, sf_dir, M.hourly_sketches(E.load_timed_activity(spark, sf_dir)))


def _stream_daily_users_mergeable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches kept by hour on a stream whose closed hours leave the state, merged to days on read."""
    hours = _replay(spark, sf_dir, _start(lambda a: M.hourly_sketches(a, expire=True), ("bucket",), GRACE)).read()
    return _checked_sketches(spark, sf_dir, hours)


def _tumbling_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _viewed(spark, sf_dir).groupBy(M.day_window().alias("day")).agg(A.view_count().alias("total_views"))
    return grouped.select(
        S.format_time("day.start", M.SECOND).alias("window_start"),
        S.format_time("day.end", M.SECOND).alias("window_end"),
        "total_views",
    )


def _stored(metric: Callable[[DataFrame], DataFrame]) -> Query:
    """Over the activity table at rest, written by day."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = new_run_dir(spark, "activity")
        write_activity_table(E.load_timed_activity(spark, sf_dir), path)
        return metric(read_activity_table(spark, path))

    return query


# --- streams ------------------------------------------------------------------------------

#: Parts in which a replay's events land, each read by a run of its own that resumes the one before.
PARTS = 3

#: Files in which each batch of a published result lands.
RESULT_FILES = 6

Start = Callable[[DataFrame, str, str], continuous.ContinuousTable]


def _replay(spark: SparkSession, sf_dir: str, start: Start, behind: Column | None = None) -> continuous.ContinuousTable:
    """The whole table as a stream of several micro-batches, in event-time order but for what comes
    behind. ``start`` gets the stream, the table's root and the query's name."""
    root = new_run_dir(spark, "stream")
    landed = f"{root}/events"
    table = None
    for part in E.in_order(E.read_events(spark, sf_dir), PARTS, behind):
        part.write.mode("append").parquet(landed)
        table = start(E.stream_timed_activity(spark, landed), f"{root}/table", root.rsplit("/", 1)[-1]).wait()
    return table


def _start(
    metric: Callable[[DataFrame], DataFrame],
    key: tuple[str, ...],
    watermark: str | None = None,
    files: int | None = None,
    snapshot_every: int = upsert.SNAPSHOT_EVERY,
) -> Start:
    def start(stream: DataFrame, root: str, name: str) -> continuous.ContinuousTable:
        stream = with_watermark(stream, watermark) if watermark else stream
        return continuous.maintain(metric(stream), key, root, name, replay=True, files=files, snapshot_every=snapshot_every)

    return start


def _stream(metric: Callable[[DataFrame], DataFrame], table: str, watermark: str | None = None) -> Query:
    return lambda spark, sf_dir: _replay(spark, sf_dir, _start(metric, RESULTS[table].key, watermark)).read()


def _stream_users(metric: UserMetric, watermark: str | None = None) -> Query:
    """A result with exact users from the cells that a stream keeps. With a watermark the cells'
    state expires."""

    def start(stream: DataFrame, root: str, name: str) -> continuous.ContinuousTable:
        stream = with_watermark(stream, watermark) if watermark else stream
        return continuous.maintain_cells(metric, stream, root, name, expire=bool(watermark), replay=True)

    return lambda spark, sf_dir: metric.finish(_replay(spark, sf_dir, start).read())


def _changelog_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscribe to a result's changelog with a second stream, and return the newest of what it
    received for each key."""
    key = RESULTS["title_metrics_max"].key
    table = _replay(spark, sf_dir, _start(lambda a: M.title_metrics_max(a, stamp=False), key))
    root = new_run_dir(spark, "subscriber")
    received = f"{root}/received"
    (
        table.subscribe()
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start(received)
        .awaitTermination()
    )
    return upsert.latest_per_key(spark.read.parquet(received), key)


def _stream_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result's changes as JSON keys and values, batch by batch: the newest value of each key."""
    result = lambda a: messages.encode_result(M.title_metrics_max(a, stamp=False), ("title",))
    return _replay(spark, sf_dir, _start(result, ("key",), files=RESULT_FILES)).read()


def _stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept and rows dropped behind the watermark, when every fiftieth event lands last."""
    key = ("title", "window_start")
    table = _replay(spark, sf_dir, _start(M.title_days_max, key, GRACE), F.col("event_id") % 50 == 7)
    viewed = _viewed(spark, sf_dir).select(F.lit(0).alias("kept"), F.lit(1).alias("viewed"))
    both = table.read().select(F.col("total_views").alias("kept"), F.lit(0).alias("viewed")).unionByName(viewed)
    kept = F.sum("kept")
    return both.agg(kept.alias("kept"), (F.sum("viewed") - kept).alias("dropped"))


def _stream_late_row_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the query of ``stream_late_rows`` left out."""
    read = lambda session, files: record.with_event_time(
        E.activity(session.read.schema(E.EVENTS_SCHEMA).parquet(*files), "event_id")
    )
    schema = read(spark, [E.events_path(sf_dir)]).schema

    def start(stream: DataFrame, root: str, name: str) -> continuous.ContinuousTable:
        days = M.title_days_max(with_watermark(stream, GRACE))
        wrap = lambda write: late.with_late_rows(write, root, read)
        return continuous.maintain(days, ("title", "window_start"), root, name, replay=True, wrap=wrap)

    table = _replay(spark, sf_dir, start, F.col("event_id") % 50 == 7)
    rows = _text_time(late.read_late(spark, table.root, schema), EVENT_TIME)
    return rows.select("event_id", "USER_ID", "TITLE", "DURATION", EVENT_TIME)


def _query_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over the whole stream and one that fails on its first row, as the status table tells."""
    with status.StatusTable(spark, new_run_dir(spark, "status")) as table:
        runs = []

        def start(stream: DataFrame, root: str, name: str) -> continuous.ContinuousTable:
            titles = continuous.maintain(
                M.title_metrics_max(stream, stamp=False), ("title",), root, f"titles-{name}", replay=True
            ).wait()
            broken = M.title_metrics_max(stream, stamp=False).withColumn("genres", F.raise_error(F.lit("broken")).cast("string"))
            failing = continuous.maintain(broken, ("title",), f"{root}-failing", f"failing-{name}", replay=True)
            steps = pipeline.run_steps([("failing", failing.wait)])
            runs.extend([titles.query.runId, failing.query.runId])
            assert not steps[0].ok
            return titles

        _replay(spark, sf_dir, start)
        table.wait_for(*runs)
        told = status.summary(table.read().filter(F.col("run_id").isin(list(map(str, runs)))))
        return told.select(
            F.substring_index("query", "-", 1).alias("query"),
            "status",
            "batches",
            "input_rows",
            "state_rows",
            F.col("error").contains("broken").alias("broken"),
        )


def _daily_documented_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets kept by one query, and after each part a second one that passes on the days whose
    result has changed; the newest row of each day."""
    metric, key = M.daily_engagement_documented, RESULTS["daily_engagement_documented"].key
    root = new_run_dir(spark, "days")
    days: list[continuous.ContinuousTable] = []

    def start(stream: DataFrame, facets: str, name: str) -> continuous.ContinuousTable:
        stream = with_watermark(stream, GRACE)
        table = continuous.maintain_cells(metric, stream, facets, name, expire=True, replay=True).wait()
        changes = day_changes.daily_documented_changes(table.subscribe())
        days.append(continuous.maintain(changes, key, root, f"{name}-days", replay=True, output_mode="append").wait())
        return table

    _replay(spark, sf_dir, start)
    return days[-1].read()


def _upsert_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells kept by key in buckets, merged after each part, from which the result is finished."""
    metric = M.daily_title_engagement

    def start(stream: DataFrame, root: str, name: str) -> continuous.ContinuousTable:
        table = continuous.maintain_cells(metric, stream, root, name, replay=True, buckets=RESULT_FILES).wait()
        table.bucketed.merge(fan=2)
        return table

    return M.unstamped(metric.finish(_replay(spark, sf_dir, start).read()))


def _stream_from_savepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts; a savepoint that lies a part with its rows behind; the third part on the first
    root; then the restored query, which reads the second part again, and the third."""
    start = _start(M.title_metrics_windowed, RESULTS["title_metrics_windowed"].key, GRACE)
    root = new_run_dir(spark, "savepoint")
    landed = f"{root}/events"
    stream = lambda: E.stream_timed_activity(spark, landed)
    parts = E.in_order(E.read_events(spark, sf_dir), PARTS)
    for number, part in enumerate(parts):
        part.write.mode("append").parquet(landed)
        table = start(stream(), f"{root}/table", f"{root.rsplit('/', 1)[-1]}").wait()
        if number == 1:
            # each part makes a batch of its rows and one that moves the watermark
            savepoints.save(table, f"{root}/saved", continuous.committed(spark, table.root)[-3])
    savepoints.restore(spark, f"{root}/saved", f"{root}/restored")
    return start(stream(), f"{root}/restored", f"{root.rsplit('/', 1)[-1]}-restored").wait().read()


def _stream_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts with two state partitions, then a savepoint moved to five, which read the third."""
    metric, root = M.daily_engagement_rowtime, new_run_dir(spark, "rescaled")
    landed, name = f"{root}/events", root.rsplit("/", 1)[-1]
    read = lambda path: E.stream_timed_activity(spark, path)
    *before, last = E.in_order(E.read_events(spark, sf_dir), PARTS)
    for part in before:
        part.write.mode("append").parquet(landed)
        table = continuous.maintain_cells(
            metric, read(landed), f"{root}/two", name, replay=True, state_partitions=2, bulk=True
        ).wait()
    savepoints.save(table, f"{root}/saved")
    rescale.move(spark, f"{root}/saved", metric, read, f"{root}/five", f"{name}-five", 5)
    last.write.mode("append").parquet(landed)
    moved = rescale.resume(spark, metric, read(landed), f"{root}/five", f"{name}-five", 5, replay=True, bulk=True).wait()
    return _text_time(metric.finish(moved.read()), "update_time")


def _state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result rebuilt from the state's changes, followed after each part."""
    metric, feed = M.daily_title_engagement, new_run_dir(spark, "feed")
    schema = metric.cells.of(E.load_timed_activity(spark, sf_dir)).schema

    def start(stream: DataFrame, root: str, name: str) -> continuous.ContinuousTable:
        table = continuous.maintain_cells(metric, stream, root, name, replay=True).wait()
        state_feed.follow(spark, root, feed)
        return table

    _replay(spark, sf_dir, start)
    state = state_feed.folded(state_feed.read_feed(spark, feed))
    return M.unstamped(metric.finish(metric.cells.from_state(state, schema)))


QUERIES: dict[str, Query] = {
    # sources, messages, sinks
    "activity_record": lambda spark, sf_dir: record.activity_record(E.raw_rows(E.read_events(spark, sf_dir))),
    "activity_source": _activity_source,
    "keyed_messages": lambda spark, sf_dir: messages.encode_activity(E.load_activity(spark, sf_dir)),
    "log_replay": _log_replay,
    "latest_by_log_position": _latest_by_log_position,
    "dead_letters": _dead_letters,
    "keyed_log": _keyed_log,
    "avro_messages": _avro_messages,
    "avro_dead_letters": _avro_dead_letters,
    "metrics_json": _metrics_json,
    "param_query": _param_query,
    "param_query_hourly": _param_query_hourly,
    "upsert_latest": lambda spark, sf_dir: _replay(
        spark, sf_dir, _start(lambda a: M.title_metrics_max(a, stamp=False), ("title",), snapshot_every=2)
    ).read(),
    "upsert_latest_rows": _upsert_rows,
    "upsert_bucketed": _upsert_bucketed,
    "changelog_read": _changelog_read,
    # rows and scalars
    "event_time": _event_time,
    "event_time_t_format": _event_time_t_format,
    "event_time_rejects": lambda spark, sf_dir: record.event_time_rejects(E.load_activity(spark, sf_dir)),
    "filter_duration": lambda spark, sf_dir: record.keep_viewed(E.load_activity(spark, sf_dir)),
    "scalar_time": _scalar_time,
    "scalar_epoch_roundtrip": _scalar_epoch_roundtrip,
    "scalar_duration": _scalar_duration,
    # aggregates
    "agg_count": _by_title(lambda: [A.view_count().alias("total_views")]),
    "agg_avg": _by_title(lambda: [A.average_duration().alias("avg_duration")]),
    "agg_sum": _by_title(lambda: [A.total_duration().alias("total_duration")]),
    "agg_max_string": _by_title(lambda: [F.max("GENRES").alias("genres"), F.max("RELEASE_DATE").alias("release_date")]),
    "agg_latest_by_offset": _by_title(
        lambda: [A.latest("GENRES").alias("genres"), A.latest("RELEASE_DATE").alias("release_date")]
    ),
    "agg_count_distinct": _by_title(lambda: [F.count_distinct("USER_ID").alias("unique_viewers")]),
    "agg_approx_distinct": _batch(M.daily_users_checked),
    "agg_approx_distinct_bound": _approx_distinct_bound,
    "agg_approx_distinct_mergeable": _daily_users_mergeable,
    "agg_rowtime": lambda spark, sf_dir: _text_time(
        _by_title(lambda: [A.row_time().alias("update_time")])(spark, sf_dir), "update_time"
    ),
    "agg_most_watched": _most_watched,
    "agg_peak_hour": _peak_hour,
    "tumbling_day": _tumbling_day,
    # the metric queries; estimated users come with the exact ones and their bound
    "title_metrics_windowed": _batch(M.title_metrics_windowed),
    "daily_engagement_windowed": _batch(M.daily_engagement_exact),
    "daily_engagement_windowed_approx": _batch(M.daily_engagement_checked),
    "title_metrics_rowtime": _batch(lambda a: _text_time(M.title_metrics_rowtime(a), "update_time")),
    "daily_engagement_rowtime": _batch(lambda a: _text_time(M.daily_engagement_rowtime(a), "update_time")),
    "title_metrics_latest": _batch(M.title_metrics_latest),
    "hourly_engagement": _batch(M.hourly_engagement_exact),
    "hourly_engagement_approx": _batch(M.hourly_engagement_checked),
    "title_metrics_max": _batch(lambda a: M.title_metrics_max(a, stamp=False)),
    "daily_title_engagement": _batch(lambda a: M.unstamped(M.daily_title_engagement(a))),
    "daily_engagement_documented": _batch(lambda a: M.unstamped(M.daily_engagement_documented(a))),
    # over the stored activity table
    "stored_title_metrics_windowed": _stored(M.title_metrics_windowed),
    "stored_daily_title_engagement": _stored(lambda a: M.unstamped(M.daily_title_engagement(a))),
    # the same on streams of several micro-batches
    "stream_title_metrics": _stream_users(M.title_metrics_with_viewers),
    "stream_tumbling_day": lambda spark, sf_dir: _replay(
        spark, sf_dir, _start(M.title_days_max, ("title", "window_start"), GRACE)
    ).read(),
    "stream_title_metrics_windowed": _stream(M.title_metrics_windowed, "title_metrics_windowed", GRACE),
    "stream_title_metrics_max": _stream(
        lambda a: M.title_metrics_max(a, stamp=False), "title_metrics_max", OUT_OF_ORDERNESS
    ),
    "stream_daily_engagement_windowed": _stream_users(M.daily_engagement_exact, GRACE),
    "stream_daily_engagement_rowtime": lambda spark, sf_dir: _text_time(
        _stream_users(M.daily_engagement_rowtime, GRACE)(spark, sf_dir), "update_time"
    ),
    "stream_daily_users_mergeable": _stream_daily_users_mergeable,
    "stream_hourly_engagement": _stream_users(M.hourly_engagement_exact, GRACE),
    "stream_daily_title_engagement": lambda spark, sf_dir: M.unstamped(
        _stream_users(M.daily_title_engagement, OUT_OF_ORDERNESS)(spark, sf_dir)
    ),
    "stream_daily_engagement_documented": lambda spark, sf_dir: M.unstamped(
        _stream_users(M.daily_engagement_documented, GRACE)(spark, sf_dir)
    ),
    "stream_daily_documented_changes": _daily_documented_changes,
    "stream_json_changelog": _stream_json,
    "stream_from_savepoint": _stream_from_savepoint,
    "state_changes": _state_changes,
    "stream_rescaled": _stream_rescaled,
    "stream_late_rows": _stream_late_rows,
    "stream_late_row_table": _stream_late_row_table,
    "query_status": _query_status,
}
