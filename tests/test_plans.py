"""What the physical plans must look like for the queries to hold up on large inputs."""

import re

import pytest
from builders import SCHEMA, activity, record

from viewlens.operators.cells import UserMetric
from viewlens.operators.record import with_event_time
from viewlens.plans import metrics as M
from viewlens.session import new_run_dir
from viewlens.sources import files
from viewlens.streaming import continuous, upsert

METRICS = {
    "title_metrics_windowed": M.title_metrics_windowed,
    "daily_engagement_windowed": M.daily_engagement_windowed,
    "daily_engagement_exact": M.daily_engagement_exact,
    "title_metrics_rowtime": M.title_metrics_rowtime,
    "daily_engagement_rowtime": M.daily_engagement_rowtime,
    "title_metrics_latest": M.title_metrics_latest,
    "hourly_engagement": M.hourly_engagement,
    "hourly_engagement_exact": M.hourly_engagement_exact,
    "title_metrics_max": M.title_metrics_max,
    "daily_title_engagement": M.daily_title_engagement,
    "daily_engagement_documented": M.daily_engagement_documented,
}


@pytest.fixture(scope="module")
def table(spark):
    path = new_run_dir(spark, "plans")
    activity(spark, [record(title=f"t{i}") for i in range(10)]).write.parquet(path)
    return with_event_time(spark.read.parquet(path))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(METRICS))
def test_filter_reaches_the_scan_and_columns_are_pruned(table, name):
    text = plan(METRICS[name](table))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas
    for schema in schemas:
        read = {f.split(":")[0] for f in schema.split(",")}
        assert read <= {"USER_ID", "TIMESTAMP", "DURATION", "TITLE", "GENRES", "RELEASE_DATE", "arrival"}
        assert "ACTIVITY_TYPE" not in read
    assert text.count("IsNotNull(DURATION)") >= len(schemas)


@pytest.mark.parametrize("name", sorted(METRICS))
def test_no_python_no_windows_no_cross_joins_no_single_partition(table, name):
    text = plan(METRICS[name](table))
    for bad in ("Python", "Arrow", "WindowExec", "Window [", "CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        assert bad not in text, bad


def assert_shuffles_are_combined(text):
    """Directly below every exchange stands an aggregate, or a projection or sort of one."""
    lines = text.splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert exchanges
    for i in exchanges:
        below = iter(lines[i + 1 :])
        line = next(below)
        while re.search(r"[ +*-](\(\d+\) )?(Project|Sort|WholeStageCodegen|InputAdapter)\b", line):
            line = next(below)
        assert re.search(r"(Hash|Sort|ObjectHash)Aggregate|StateStore", line), line


@pytest.mark.parametrize("name", sorted(METRICS))
def test_every_shuffle_follows_a_partial_aggregate(table, name):
    """Rows are combined on the map side before they move, so a hot key stays small."""
    assert_shuffles_are_combined(plan(METRICS[name](table)))


CELLS = {name: m for name, m in METRICS.items() if isinstance(m, UserMetric)} | {"viewers": M.title_metrics_with_viewers}


@pytest.mark.parametrize("name", sorted(CELLS))
def test_streams_read_once_and_combine_before_their_one_shuffle(spark, tmp_path, name):
    path = str(tmp_path / "in")
    activity(spark, [record(title=f"t{i}") for i in range(10)]).write.parquet(path)
    stream = with_event_time(spark.readStream.schema(SCHEMA).parquet(path))
    table = continuous.maintain_cells(CELLS[name], stream, str(tmp_path / "out"), f"plan-{name}", replay=True).wait()
    text = table.query._jsq.explainInternal(False)
    physical = text[text.index("== Physical Plan ==") :]
    assert physical.count("FileScan") == 1
    assert len(re.findall("Exchange hashpartitioning", physical)) == 1
    assert_shuffles_are_combined(physical)


@pytest.mark.parametrize("name", sorted(CELLS))
def test_exact_users_spread_a_hot_key_and_read_once(table, name):
    text = plan(CELLS[name](table))
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    # among the facets of a day, users are values
    user = "value" if name == "daily_engagement_documented" else "USER_ID"
    assert any(user in k for k in keys)
    assert text.count("FileScan") == 1


def test_stored_activity_prunes_days_and_pushes_filters(spark, tmp_path):
    path = str(tmp_path / "stored")
    days = [record(time=f"2024-01-0{d} 10:00:00") for d in (1, 2, 3)]
    files.write_activity_table(with_event_time(activity(spark, days)), path)
    text = plan(M.title_metrics_windowed(files.read_activity_table(spark, path, "2024-01-02", "2024-01-03")))
    assert re.search(r"PushedFilters: \[[^\]]*IsNotNull\(DURATION\)", text), text
    assert "PartitionFilters: [isnotnull(view_date" in text


def test_latest_per_key_combines_before_the_shuffle(spark):
    changes = spark.createDataFrame([("a", 1, 0)], "k string, v int, batch_id bigint")
    text = plan(upsert.latest_per_key(changes, ("k",)))
    assert text.index("Exchange") < text.index("partial_max_by")
    assert text.count("Exchange hashpartitioning") == 1
