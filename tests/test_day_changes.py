"""The stream of changed days: what it emits, that it agrees with the batch, and its state."""

from builders import record, rows
from test_streams import Replay, three_days

from viewlens.plans import metrics as M
from viewlens.schema import RESULTS
from viewlens.streaming import continuous, day_changes, upsert
from viewlens.streaming.settings import GRACE, with_watermark

KEY = RESULTS["daily_engagement_documented"].key


def run(replay, expire=True):
    """Both queries over what there is; the table of days."""
    metric = M.daily_engagement_documented
    table = replay.cells(metric, expire=expire)
    changes = day_changes.daily_documented_changes(table.subscribe(), slices=3)
    root = f"{replay.root}/days"
    return continuous.maintain(changes, KEY, root, root, replay=True, output_mode="append").wait()


def emitted(days, batch=None):
    found = upsert.read_changelog(days.spark, days.root, days.schema)
    found = found if batch is None else found.filter(found[upsert.BATCH] >= batch)
    return sorted((r.view_date.day, r.total_views, r.total_unique_users, r.most_watched_title, r.peak_hour) for r in found.collect())


def agrees(replay, days):
    want = M.daily_engagement_documented(with_watermark(replay.batch(), GRACE))
    assert rows(days.read()) == rows(M.unstamped(want))


def test_only_changed_days_come(spark):
    replay = Replay(spark).add(
        record(user="u1", title="A", time="2024-01-01 10:00:00"), record(user="u2", title="B", time="2024-01-02 10:00:00")
    )
    days = run(replay)
    assert emitted(days) == [(1, 1, 1, "A", 10), (2, 1, 1, "B", 10)]
    agrees(replay, days)
    seen = max(continuous.committed(spark, days.root)) + 1
    replay.add(
        record(user="u2", title="C", time="2024-01-02 12:00:00", duration=50),
        record(user="u3", title="C", time="2024-01-02 12:30:00"),
    )
    days = run(replay)
    assert emitted(days, seen) == [(2, 3, 2, "C", 12)]
    agrees(replay, days)


def test_a_change_that_comes_again_changes_nothing(spark):
    replay = three_days(Replay(spark))
    days = run(replay)
    seen = max(continuous.committed(spark, days.root)) + 1
    facets = f"{replay.root}/cells-True"
    again = spark.read.parquet(f"{upsert.changelog_path(facets)}/batch_id=2")
    again.write.parquet(f"{upsert.changelog_path(facets)}/batch_id=999")
    days = run(replay)
    assert emitted(days, seen) == []


def test_agrees_with_the_batch_and_state_goes_with_the_days(spark):
    replay = three_days(Replay(spark))
    days = run(replay)
    agrees(replay, days)
    replay.add(*[record(user=None, title=None, genres=None, time=f"2024-01-0{d} 23:59:59") for d in (7, 8, 9)])
    days = run(replay)
    agrees(replay, days)
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "row")
    kept = {r.key[0].day for r in state.load(upsert.checkpoint_path(days.root)).select("key").collect()}
    assert kept and kept <= {7, 8, 9}


def test_ties_go_to_the_smaller_value_whichever_comes_first(spark):
    replay = Replay(spark)
    for title in ("B", "É", "A", "a"):
        replay.add(record(title=title, genres=title, user=title))
    days = run(replay)
    agrees(replay, days)
    assert [r.most_watched_title for r in days.read().collect()] == ["A"]
