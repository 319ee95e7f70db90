"""Late rows as a second output, and the table of what queries did."""

import pytest
from builders import SCHEMA, record, rows
from pyspark.sql import functions as F
from test_streams import Replay, late_replay, three_days

from viewlens.operators.record import with_event_time
from viewlens.plans import metrics as M
from viewlens.session import new_run_dir
from viewlens.streaming import continuous, late, paths, status, upsert
from viewlens.streaming.settings import OUT_OF_ORDERNESS, with_watermark

KEY = ("title", "window_start")


def read_files(session, files):
    return with_event_time(session.read.schema(SCHEMA).parquet(*files))


def run(replay, delay="24 hours", table="out"):
    root = f"{replay.root}/{table}"
    wrap = lambda write: late.with_late_rows(write, root, read_files)
    out = replay.run(lambda a: M.title_metrics_windowed(with_watermark(a, delay)), KEY, table=table, wrap=wrap)
    return out, late.read_late(replay.spark, root, replay.batch().schema)


def test_rows_left_out_are_kept_and_no_others(spark):
    replay = late_replay(spark)
    replay.add(record(time="2024-01-02 12:00:00", duration=7), record(time="2024-01-01 10:00:00", duration=None), record(time="bad"))
    table, rows_ = run(replay)
    # the row without a duration counts nowhere, late or not
    assert rows(rows_.select("TIMESTAMP", "DURATION", upsert.BATCH)) == [
        ("2024-01-01 11:00:00", 90, 3),
        ("2024-01-02 12:00:00", 7, 4),
    ]
    counted = sum(r.total_views for r in table.read().collect())
    assert counted + rows_.count() == replay.batch().filter("DURATION IS NOT NULL").count()


@pytest.mark.parametrize("delay", ["0 seconds", OUT_OF_ORDERNESS, "24 hours"])
def test_table_and_late_rows_are_the_input(spark, delay):
    """Rows shuffled over batches, so that some of each day come late."""
    replay = Replay(spark)
    for n in range(6):
        replay.add(*[record(user=f"u{i}", title=f"t{i % 2}", duration=i, time=f"2024-01-0{1 + (n * 5 + i * 3) % 7} 1{i}:00:00") for i in range(8)])
    table, rows_ = run(replay, delay)
    assert rows_.count() > 0
    kept = replay.batch().exceptAll(rows_.drop(upsert.BATCH))
    assert rows(table.read()) == rows(M.title_metrics_windowed(kept))


def test_no_late_rows_and_a_repeated_batch(spark):
    replay = three_days(Replay(spark))
    table, rows_ = run(replay)
    assert rows_.collect() == [] and rows_.columns[-1] == upsert.BATCH
    assert late.read_late(spark, f"{replay.root}/never", rows_.drop(upsert.BATCH).schema).collect() == []
    write = late.with_late_rows(lambda batch, n: None, table.root, read_files)
    newest = max(continuous.committed(spark, table.root))
    write(spark.range(0), newest)
    write(spark.range(0), newest)
    assert late.read_late(spark, table.root, rows_.drop(upsert.BATCH).schema).count() == 0


def test_files_of_a_batch_when_the_source_log_was_compacted(spark):
    before = spark.conf.get("spark.sql.streaming.fileSource.log.compactInterval")
    spark.conf.set("spark.sql.streaming.fileSource.log.compactInterval", "2")
    try:
        replay = Replay(spark)
        for day in range(1, 6):
            replay.add(record(time=f"2024-01-0{day} 10:00:00"), record(time="2024-01-01 09:00:00"))
        table, rows_ = run(replay, OUT_OF_ORDERNESS)
        assert paths.matching(spark, f"{upsert.checkpoint_path(table.root)}/sources/0/*.compact")
        # a batch is judged by the watermark that the one before it began with
        assert rows(rows_.select(F.col("event_timestamp").cast("string"))) == [("2024-01-01 09:00:00",)] * 2
    finally:
        spark.conf.set("spark.sql.streaming.fileSource.log.compactInterval", before)


def test_status_of_queries(spark):
    replay = three_days(Replay(spark))
    with status.StatusTable(spark, new_run_dir(spark, "status")) as table:
        good = replay.run(lambda a: M.title_metrics_max(a, stamp=False), ("title",))
        bad = lambda a: M.title_metrics_max(a).withColumn("genres", F.raise_error(F.lit("broken")).cast("string"))
        with pytest.raises(Exception, match="broken"):
            replay.run(bad, ("title",), table="bad")
        failed = next(r for r in table._names if r != str(good.query.runId))
        live = continuous.maintain(M.title_metrics_max(replay.stream()), ("title",), f"{replay.root}/live", f"{replay.root}-live")
        live.query.processAllAvailable()
        table.wait_for(good.query.runId, failed)
        told = {r["query"].rsplit("-", 1)[-1]: r for r in status.summary(table.read()).collect()}
        assert {k: r["status"] for k, r in told.items()} == {"out": "stopped", "bad": "failed", "live": "running"}
        assert (told["out"]["batches"], told["out"]["input_rows"], told["out"]["state_rows"]) == (3, 60, 3)
        assert told["out"]["error"] is None and "broken" in told["bad"]["error"] and told["bad"]["input_rows"] == 0
        live.query.stop()
        table.wait_for(live.query.runId)
        now = {r["query"].rsplit("-", 1)[-1]: r["status"] for r in status.summary(table.read()).collect()}
        assert now["live"] == "stopped"
        with pytest.raises(TimeoutError):
            table.wait_for("another", seconds=0.1)
    progress = spark.read.schema(status.SCHEMA).parquet(f"{table.path}/*").filter("event = 'progress' AND input_rows > 0")
    out = progress.filter(F.col("run_id") == str(good.query.runId)).orderBy("batch_id").collect()
    assert [(r.batch_id, r.input_rows) for r in out] == [(0, 20), (1, 20), (2, 20)]
    assert all("logOffset" in r.offsets and r.duration_ms > 0 for r in out)


def test_rows_behind_the_watermark_are_told(spark):
    with status.StatusTable(spark, new_run_dir(spark, "status")) as table:
        run_id = late_replay(spark).run(lambda a: M.title_metrics_windowed(with_watermark(a)), KEY).query.runId
        table.wait_for(run_id)
        behind = table.read().agg(F.sum("rows_behind_watermark")).first()[0]
    assert behind == 1


def test_empty_status_table(spark):
    with status.StatusTable(spark, new_run_dir(spark, "status")) as table:
        assert status.summary(table.read()).collect() == []
