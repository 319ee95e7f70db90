"""Streams over several micro-batches: state, late rows, replays, resuming, control."""

import os
import time

import pytest
from builders import SCHEMA, activity, record, rows
from pyspark.sql import functions as F

from viewlens.operators.record import with_event_time
from viewlens.plans import metrics as M
from viewlens.schema import RESULTS, columns
from viewlens.session import new_run_dir
from viewlens.streaming import continuous, paths, pipeline, upsert
from viewlens.streaming.settings import GRACE, OUT_OF_ORDERNESS, state_partitions, stream_settings, with_watermark


class Replay:
    """A folder of activity files read one per micro-batch, in the order they were added."""

    def __init__(self, spark):
        self.spark = spark
        self.root = new_run_dir(spark, "replay").removeprefix("file:")
        self.added = 0

    def add(self, *records):
        out = f"{self.root}/staging-{self.added}"
        activity(self.spark, list(records)).coalesce(1).write.parquet(out)
        (part,) = [f for f in os.listdir(out) if f.endswith(".parquet")]
        os.makedirs(f"{self.root}/in", exist_ok=True)
        target = f"{self.root}/in/{self.added:04d}.parquet"
        os.link(f"{out}/{part}", target)
        stamp = time.time() - 1000 + self.added
        os.utime(target, (stamp, stamp))
        self.added += 1
        return self

    def stream(self):
        return with_event_time(
            self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in")
        )

    def batch(self):
        return with_event_time(self.spark.read.schema(SCHEMA).parquet(f"{self.root}/in"))

    def run(self, metric, key, table="out", **kw):
        name = f"{self.root.rsplit('/', 1)[-1]}-{table}"
        return continuous.maintain(metric(self.stream()), key, f"{self.root}/{table}", name, replay=True, **kw).wait()

    def cells(self, metric, expire=False, delay=GRACE, **kw):
        stream = with_watermark(self.stream(), delay) if expire else self.stream()
        root = f"{self.root}/cells-{expire}"
        table = continuous.maintain_cells(metric, stream, root, root, expire, replay=True, **kw).wait()
        object.__setattr__(table, "input_rows", sum(p["numInputRows"] for p in table.query.recentProgress))
        return table


def three_days(replay):
    for day in (1, 2, 3):
        replay.add(
            *[
                record(
                    user=f"u{(i * day) % 4}",
                    time=f"2024-01-0{day} {(i * 5) % 24:02d}:15:00",
                    duration=i,
                    title=f"t{i % 3}",
                    genres=None if i % 4 == 0 else f"g{(i + day) % 3}",
                    arrival=day * 100 + (i * 7) % 30 + 1,
                )
                for i in range(20)
            ]
        )
    return replay


CASES = {
    "title_metrics_windowed": (M.title_metrics_windowed, True),
    "daily_engagement_windowed": (M.daily_engagement_windowed, True),
    "title_metrics_rowtime": (M.title_metrics_rowtime, False),
    "title_metrics_latest": (M.title_metrics_latest, False),
    "hourly_engagement": (M.hourly_engagement, False),
    "title_metrics_max": (lambda a: M.title_metrics_max(a, stamp=False), False),
}
USER_CASES = {
    "daily_engagement_exact": M.daily_engagement_exact,
    "daily_engagement_rowtime": M.daily_engagement_rowtime,
    "hourly_engagement_exact": M.hourly_engagement_exact,
    "daily_title_engagement": M.daily_title_engagement,
    "daily_engagement_documented": M.daily_engagement_documented,
    "title_metrics_with_viewers": M.title_metrics_with_viewers,
}


def compared(result):
    """Without processing time; the newest event time of Q4's result stays."""
    return rows(M.unstamped(result))


@pytest.mark.parametrize("name", sorted(CASES))
def test_three_batches_equal_one_batch_job(spark, name):
    metric, watermark = CASES[name]
    replay = three_days(Replay(spark))
    table = replay.run(lambda a: metric(with_watermark(a)) if watermark else metric(a), RESULTS[name].key)
    assert rows(table.read()) == rows(metric(replay.batch()))


@pytest.mark.parametrize("expire", [False, True])
@pytest.mark.parametrize("name", sorted(USER_CASES))
def test_cells_of_three_batches_equal_one_batch_job(spark, name, expire):
    metric = USER_CASES[name]
    replay = three_days(Replay(spark))
    table = replay.cells(metric, expire and bool(metric.cells.bucket))
    assert compared(metric.finish(table.read())) == compared(metric(replay.batch()))
    assert table.input_rows == replay.batch().count()


def test_exact_viewers_across_batches(spark):
    replay = Replay(spark).add(record(user="u1"), record(user="u2")).add(record(user="u1"), record(user="u3"), record(user=None))
    metric = M.title_metrics_with_viewers
    (row,) = metric.finish(replay.cells(metric).read()).collect()
    assert (row.unique_viewers, row.total_views) == (3, 5)


def test_state_of_closed_buckets_goes(spark):
    """Days 1 to 3 with a watermark of five minutes: only the last day stays in the state."""
    replay = three_days(Replay(spark))
    kept = {}
    for expire in (False, True):
        table = replay.cells(M.daily_engagement_documented, expire, delay=OUT_OF_ORDERNESS)
        state = continuous.read_state(spark, table.root).select("key.*")
        start = "bucket.start" if expire else "bucket"
        kept[expire] = {r[0].day for r in state.select(start).collect()}
        assert {r.bucket.day for r in table.read().collect()} == {1, 2, 3}
    assert kept == {False: {1, 2, 3}, True: {3}}


def late_replay(spark):
    """Day 1, then day 5, then a row of day 1 again, far behind any watermark.

    Day 5 comes twice: lateness is judged by the watermark of the batch before.
    """
    return (
        Replay(spark)
        .add(record(time="2024-01-01 10:00:00"))
        .add(record(time="2024-01-05 10:00:00"))
        .add(record(time="2024-01-05 10:30:00"))
        .add(record(time="2024-01-01 11:00:00", duration=90), record(time="2024-01-05 11:00:00"))
    )


def test_late_row_counts_without_a_window(spark):
    replay = late_replay(spark)
    (row,) = replay.run(lambda a: M.title_metrics_latest(with_watermark(a)), ("title",)).read().collect()
    assert (row.total_views, row.total_duration) == (5, 130)
    by_date = M.daily_title_engagement.finish(replay.cells(M.daily_title_engagement).read())
    assert sorted(r.daily_views for r in by_date.collect()) == [2, 3]


def test_late_row_is_dropped_behind_the_watermark_of_a_window(spark):
    got = late_replay(spark).run(lambda a: M.title_metrics_windowed(with_watermark(a)), ("title", "window_start")).read()
    assert {r.window_start[:10]: r.total_views for r in got.collect()} == {"2024-01-01": 1, "2024-01-05": 3}


def test_late_row_within_the_delay_counts(spark):
    replay = (
        Replay(spark)
        .add(record(time="2024-01-01 10:00:00"), record(time="2024-01-02 00:04:00"))
        .add(record(time="2024-01-01 23:59:59"))
    )
    got = replay.run(
        lambda a: M.title_metrics_windowed(with_watermark(a, OUT_OF_ORDERNESS)), ("title", "window_start")
    ).read()
    assert {r.window_start[:10]: r.total_views for r in got.collect()} == {"2024-01-01": 2, "2024-01-02": 1}


def test_append_emits_closed_windows_once(spark):
    replay = three_days(Replay(spark))
    table = replay.run(
        lambda a: M.title_metrics_windowed(with_watermark(a, OUT_OF_ORDERNESS)),
        ("title", "window_start"),
        output_mode="append",
    )
    emitted = upsert.read_changelog(spark, table.root, table.schema).drop(upsert.BATCH)
    closed = M.title_metrics_windowed(replay.batch()).filter("window_start < '2024-01-03'")
    assert rows(emitted) == rows(closed)


def test_update_emits_only_changed_keys(spark):
    replay = Replay(spark).add(record(title="A"), record(title="B")).add(record(title="B"))
    table = replay.run(M.title_metrics_max, ("title",))
    changes = upsert.read_changelog(spark, table.root, table.schema).select(upsert.BATCH, "title", "total_views")
    assert rows(changes) == [(0, "A", 1), (0, "B", 1), (1, "B", 2)]


def test_replayed_batch_changes_nothing(spark):
    replay = three_days(Replay(spark))
    table = replay.run(M.title_metrics_max, ("title",))
    before = rows(table.read())
    again = upsert.read_changelog(spark, table.root, table.schema).filter("batch_id = 1").drop(upsert.BATCH)
    again = spark.createDataFrame(again.collect(), again.schema)
    write = upsert.changelog_writer(table.root, table.key, files=2)
    write(again, 1)
    write(again, 1)
    assert rows(table.read()) == before


def test_resume_continues_from_stored_state(spark):
    metric = M.title_metrics_with_viewers
    replay = Replay(spark).add(record(user="u1"), record(user="u2"))
    replay.cells(metric)
    replay.add(record(user="u2"), record(user="u3"))
    table = replay.cells(metric)
    (row,) = metric.finish(table.read()).collect()
    assert (row.total_views, row.unique_viewers) == (4, 3)
    assert table.input_rows == 2


def test_half_written_batches_do_not_count(spark):
    replay = three_days(Replay(spark))
    table = replay.run(lambda a: M.title_metrics_max(a, stamp=False), ("title",))
    before = rows(table.read())
    half = f"{upsert.changelog_path(table.root)}/batch_id=3"
    extra = spark.createDataFrame([("t0", 1, 1.0, 1, "x", "y")], table.schema)
    extra.write.parquet(half)
    assert rows(table.read()) != before
    os.remove(f"{half}/_SUCCESS".removeprefix("file:"))
    assert rows(table.read()) == before


def test_a_table_without_batches_has_no_rows(spark):
    replay = Replay(spark).add(record())
    root = f"{replay.root}/later"
    paths.create(spark, upsert.changelog_path(root))
    schema = M.title_metrics_max(replay.batch()).schema
    table = upsert.read_table(spark, root, schema, ("title",))
    assert table.schema.fieldNames() == schema.fieldNames() and table.collect() == []
    assert upsert.subscribe(spark, root, schema).isStreaming
    assert upsert.compact(spark, root, schema, ("title",)) is None


def test_compaction_and_pruning_run_with_the_job(spark):
    replay = Replay(spark)
    for i in range(5):
        replay.add(record(title=f"t{i % 2}", duration=i))
    table = replay.run(lambda a: M.title_metrics_max(a, stamp=False), ("title",), snapshot_every=2)
    assert sorted(upsert._complete(spark, upsert.snapshots_path(table.root))) == [1, 3]
    assert sorted(upsert._complete(spark, upsert.changelog_path(table.root))) == [0, 1, 2, 3, 4]
    assert rows(table.read()) == rows(M.title_metrics_max(replay.batch(), stamp=False))
    upsert.prune(spark, table.root, kept=1)
    assert sorted(upsert._complete(spark, upsert.changelog_path(table.root))) == [3, 4]
    assert rows(table.read()) == rows(M.title_metrics_max(replay.batch(), stamp=False))


def test_a_running_query_keeps_one_root(spark):
    replay = Replay(spark).add(record())
    start = lambda root: continuous.maintain(M.title_metrics_max(replay.stream()), ("title",), root, "one-root")
    table = start(f"{replay.root}/a")
    with pytest.raises(ValueError, match="one-root"):
        start(f"{replay.root}/b")
    table.query.stop()


def test_compaction_keeps_the_table_and_later_changes(spark):
    replay = three_days(Replay(spark))
    table = replay.run(lambda a: M.title_metrics_max(a, stamp=False), ("title",))
    before = rows(table.read())
    assert upsert.compact(spark, table.root, table.schema, table.key) == 2
    assert upsert.compact(spark, table.root, table.schema, table.key) == 2
    assert rows(table.read()) == before
    replay.add(record(title="t0", duration=1000, time="2024-01-04 00:00:00"))
    after = replay.run(lambda a: M.title_metrics_max(a, stamp=False), ("title",))
    assert rows(after.read()) == rows(M.title_metrics_max(replay.batch(), stamp=False))
    assert upsert.compact(spark, table.root, table.schema, table.key) == 3
    assert rows(after.read()) == rows(M.title_metrics_max(replay.batch(), stamp=False))


def test_upsert_keys_may_be_null(spark):
    changes = spark.createDataFrame([(None, 1, 0), (None, 2, 1), ("a", 3, 0)], "k string, v int, batch_id bigint")
    assert rows(upsert.latest_per_key(changes, ("k",))) == [("a", 3), (None, 2)]


def test_subscriber_sees_existing_then_new_changes(spark):
    replay = Replay(spark).add(record(title="A"))
    table = replay.run(M.title_metrics_max, ("title",))
    out = f"{replay.root}/received"

    def receive():
        writer = table.subscribe().writeStream.format("parquet").option("checkpointLocation", f"{out}-progress")
        writer.trigger(availableNow=True).start(out).awaitTermination()
        return rows(spark.read.parquet(out).select("batch_id", "title", "total_views"))

    assert receive() == [(0, "A", 1)]
    replay.add(record(title="A"))
    replay.run(M.title_metrics_max, ("title",))
    assert receive() == [(0, "A", 1), (1, "A", 2)]


def test_state_can_be_read(spark):
    replay = Replay(spark).add(record(title="A"), record(title="B")).add(record(title="B"))
    table = replay.run(M.title_metrics_max, ("title",))
    state = continuous.read_state(spark, table.root)
    # the state of the first aggregate, the row count, comes first
    assert {r.title: r.value[0] for r in state.select("key.title", "value").collect()} == {"A": 1, "B": 2}
    assert continuous.read_state_metadata(spark, table.root).count() >= 1


def test_settings_reach_the_query_and_leave_the_session(spark):
    key = "spark.sql.streaming.minBatchesToRetain"
    before = spark.conf.get(key)
    with stream_settings(spark, 3):
        assert spark.conf.get(key) == "3"
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert spark.conf.get(key) == before
    assert state_partitions(spark) == 2


def test_start_if_absent_then_teardown(spark):
    replay = Replay(spark).add(record())
    root = f"{replay.root}/live"
    start = lambda: continuous.maintain(M.title_metrics_max(replay.stream()), ("title",), root, "live-titles")
    first, second = start(), start()
    assert first.query.id == second.query.id
    first.query.processAllAvailable()
    assert first.read().count() == 1
    done = pipeline.teardown(spark, [root, f"{replay.root}/never-made"])
    assert all(s.ok for s in done)
    assert continuous.active_query(spark, "live-titles") is None
    assert not paths.exists(spark, root)


def test_steps_run_in_order_past_a_failure(spark):
    seen = []

    def fail():
        seen.append("second")
        raise KeyError("gone")

    got = pipeline.run_steps([("a", lambda: seen.append("first")), ("b", fail), ("c", lambda: seen.append("third"))])
    assert seen == ["first", "second", "third"]
    assert [(s.name, s.ok) for s in got] == [("a", True), ("b", False), ("c", True)]
    assert "gone" in got[1].error


def test_failed_query_is_reported(spark):
    replay = Replay(spark).add(record())
    bad = lambda a: M.title_metrics_max(a).withColumn("total_views", F.raise_error(F.lit("broken")).cast("bigint"))
    with pytest.raises(Exception, match="broken"):
        replay.run(bad, ("title",))


def test_columns_helper_shares_nothing():
    schema = columns("a string")
    upsert._with_batch(schema)
    assert schema.fieldNames() == ["a"]
