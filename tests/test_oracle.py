"""Every registered query against DuckDB on the same tables."""

import pytest
from support import DATA, compare, duck

import __spark_entry__ as entry
from viewlens.oracle import ORACLE
from viewlens.plans import metrics as M
from viewlens.registry import QUERIES
from viewlens.sources.events import load_timed_activity


@pytest.fixture(scope="module")
def con():
    return duck()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    assert compare(QUERIES[name](spark, DATA), con, ORACLE[name]) == []


@pytest.mark.parametrize(
    ("key", "estimated", "exact"),
    [
        (["view_date"], M.daily_engagement_windowed, M.daily_engagement_exact),
        (["view_date", "hour_of_day"], M.hourly_engagement, M.hourly_engagement_exact),
    ],
)
def test_estimates_change_only_the_user_count(spark, key, estimated, exact):
    activity = load_timed_activity(spark, DATA)
    exact = {tuple(r[k] for k in key): r.asDict() for r in exact(activity).collect()}
    rough = {tuple(r[k] for k in key): r.asDict() for r in estimated(activity).collect()}
    assert exact.keys() == rough.keys()
    for k, row in exact.items():
        users, estimate = row.pop("total_unique_users"), rough[k].pop("total_unique_users")
        assert abs(users - estimate) <= max(1, 0.06 * users)
        assert row == rough[k]


def test_entry_has_rows(spark):
    result = entry.entry(spark)
    assert result.columns[:2] == ["view_date", "title"]
    assert result.limit(1).count() == 1
