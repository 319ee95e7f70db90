"""Savepoints of a stream, and its state read while it runs and followed as changes."""

import os
import shutil

import pytest
from builders import record, rows
from test_streams import Replay, three_days

from viewlens.plans import metrics as M
from viewlens.streaming import continuous, paths, savepoints, state_feed, upsert
from viewlens.streaming.settings import OUT_OF_ORDERNESS, with_watermark

KEY = ("title", "window_start")


def windowed(activity):
    return M.title_metrics_windowed(with_watermark(activity))


def titles(activity):
    return M.title_metrics_max(activity, stamp=False)


def local(path):
    return path.removeprefix("file:")


def test_restored_query_reads_again_what_came_after(spark):
    """Three days, a batch each: a savepoint of the first, restored, reads the other two."""
    replay = three_days(Replay(spark))
    table = replay.run(titles, ("title",))
    before = rows(table.read())
    saved = savepoints.save(table, f"{replay.root}/saved", 0)
    assert saved == savepoints.opened(spark, f"{replay.root}/saved") == savepoints.Savepoint(f"{replay.root}/saved", 0)
    assert savepoints.restore(spark, saved.path, f"{replay.root}/again").batch == 0
    first = upsert.read_table(spark, f"{replay.root}/again", table.schema, table.key)
    assert rows(first) == rows(table.read().limit(0).union(upsert.read_table(spark, table.root, table.schema, table.key, 0)))
    assert rows(first) != before
    again = replay.run(titles, ("title",), table="again")
    assert rows(again.read()) == before == rows(titles(replay.batch()))
    assert sum(p["numInputRows"] for p in again.query.recentProgress) == 40
    assert again.query.id != table.query.id


def test_newest_batch_and_both_go_on(spark):
    replay = Replay(spark).add(record(title="A"))
    table = replay.run(windowed, KEY)
    saved = savepoints.save(table, f"{replay.root}/saved")
    assert saved.batch == max(continuous.committed(spark, table.root))
    savepoints.restore(spark, saved.path, f"{replay.root}/again")
    replay.add(record(title="A"), record(title="B"))
    both = [replay.run(windowed, KEY, table=t) for t in ("out", "again")]
    assert rows(both[0].read()) == rows(both[1].read()) == rows(windowed(replay.batch()))


def test_state_with_whole_versions_below_the_changes(spark):
    """Ten batches write whole versions in between; each retained batch can be saved and restored."""
    before = spark.conf.get("spark.sql.streaming.stateStore.minDeltasForSnapshot")
    spark.conf.set("spark.sql.streaming.stateStore.minDeltasForSnapshot", "2")
    try:
        replay = Replay(spark)
        for i in range(10):
            replay.add(record(title=f"t{i % 3}", duration=i))
        table = replay.run(titles, ("title",))
        for batch in continuous.committed(spark, table.root)[-3:]:
            path, root = f"{replay.root}/saved-{batch}", f"{replay.root}/again-{batch}"
            savepoints.restore(spark, savepoints.save(table, path, batch).path, root)
            again = replay.run(titles, ("title",), table=f"again-{batch}")
            assert rows(again.read()) == rows(titles(replay.batch()))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.minDeltasForSnapshot", before)


def test_versions_are_chosen_store_by_store():
    files = ["state/0/_metadata/schema", "state/0/0/3.zip", "state/0/0/SSTs/1-a.sst"]
    files += [f"state/0/{p}/{v}.changelog" for p in (0, 1) for v in (1, 2, 3, 4, 5)] + ["state/0/0/5.zip"]
    chosen = savepoints._state_files(files, 4)
    assert sorted(chosen) == sorted(
        [*files[:3], "state/0/0/4.changelog", *(f"state/0/1/{v}.changelog" for v in (1, 2, 3, 4))]
    )
    with pytest.raises(savepoints.SavepointError, match="no complete state"):
        savepoints._state_files([f for f in files if f != "state/0/1/2.changelog"], 4)
    with pytest.raises(savepoints.SavepointError, match="gone"):
        savepoints._state_files(["state/0/0/9.zip"], 4)
    assert savepoints._state_files([], 4) == []


def test_what_cannot_be_saved_or_restored(spark):
    replay = three_days(Replay(spark))
    table = replay.run(titles, ("title",))
    for batch in (3, -1):
        with pytest.raises(savepoints.SavepointError, match="committed"):
            savepoints.save(table, f"{replay.root}/never", batch)
    saved = savepoints.save(table, f"{replay.root}/saved").path
    with pytest.raises(savepoints.SavepointError, match="already"):
        savepoints.restore(spark, saved, table.root)

    def broken(name, change, match):
        copy = f"{replay.root}/{name}"
        shutil.copytree(saved, copy)
        change(copy)
        with pytest.raises(savepoints.SavepointError, match=match):
            savepoints.restore(spark, copy, f"{replay.root}/{name}-root")
        assert not paths.exists(spark, f"{replay.root}/{name}-root")

    def first(folder, end):
        found = [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(end)]
        return min(f for f in found if not os.path.basename(f).startswith("."))

    def flip(copy):
        path = first(f"{copy}/checkpoint/state", ".changelog")
        data = bytearray(open(path, "rb").read())
        data[len(data) // 2] ^= 1
        open(path, "wb").write(data)
        crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
        if os.path.exists(crc):
            os.remove(crc)

    broken("flipped", flip, "damaged")
    broken("cut", lambda copy: os.remove(first(f"{copy}/table", ".parquet")), "lacks")
    broken("unfinished", lambda copy: os.remove(f"{copy}/manifest/_SUCCESS"), "manifest")


def test_state_of_a_running_query_read_at_a_batch(spark):
    replay = Replay(spark).add(record(title="A"), record(title="B"))
    live = continuous.maintain(titles(replay.stream()), ("title",), f"{replay.root}/live", "state-live")
    views = lambda batch: {r.title: r.value[0] for r in continuous.read_state(spark, live.root, batch=batch).select("key.title", "value").collect()}
    try:
        live.query.processAllAvailable()
        pinned = continuous.read_state(spark, live.root, batch=0).select("key.title", "value")
        replay.add(record(title="B"), record(title="C"))
        deadline = 60
        while continuous.committed(spark, live.root) != [0, 1] and deadline:
            live.query.awaitTermination(1)
            deadline -= 1
        assert live.query.isActive
        assert {r.title: r.value[0] for r in pinned.collect()} == views(0) == {"A": 1, "B": 1}
        assert views(1) == views(None) == {"A": 1, "B": 2, "C": 1}
        feed = f"{replay.root}/feed"
        assert state_feed.follow(spark, live.root, feed) == 1
        changes = state_feed.read_feed(spark, feed)
        assert rows(changes.select("batch_id", "change_type", "key.title")) == [
            (0, "update", "A"), (0, "update", "B"), (1, "update", "B"), (1, "update", "C"),
        ]
        as_of = {r.key[0]: r.value[0] for r in state_feed.folded(changes, upto=0).collect()}
        assert as_of == {"A": 1, "B": 1}
    finally:
        live.query.stop()


def test_feed_keeps_what_the_state_has_dropped(spark):
    replay = Replay(spark)
    metric, feed = M.daily_title_engagement, f"{replay.root}/feed"
    for day in (1, 2, 3):
        replay.add(*[record(time=f"2024-01-0{day} 1{h}:00:00", user=f"u{h}") for h in range(3)])
        table = replay.cells(metric, expire=True, delay=OUT_OF_ORDERNESS)
        state_feed.follow(spark, table.root, feed)
        assert state_feed.follow(spark, table.root, feed) == max(continuous.committed(spark, table.root))
    changes = state_feed.read_feed(spark, feed)
    schema = table.schema
    days = lambda state: {r.bucket.day for r in metric.cells.from_state(state, schema).collect()}
    assert days(state_feed.folded(changes)) == {1, 2, 3}
    now = state_feed.folded(changes, keep_expired=False)
    assert days(now) == days(continuous.read_state(spark, table.root)) == {3}
    finished = metric.finish(metric.cells.from_state(state_feed.folded(changes), schema))
    assert rows(M.unstamped(finished)) == rows(M.unstamped(metric(replay.batch())))


def test_feed_must_be_followed_in_time(spark):
    replay = Replay(spark)
    for i in range(7):
        replay.add(record(title=f"t{i}"))
    table = replay.run(titles, ("title",))
    assert continuous.committed(spark, table.root)[0] > 0
    with pytest.raises(ValueError, match="no longer retained"):
        state_feed.follow(spark, table.root, f"{replay.root}/feed")
