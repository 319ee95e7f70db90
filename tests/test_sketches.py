"""Sketches of users: merging, small counts, and what the bound allows."""

import pytest
from pyspark.sql import functions as F

from viewlens.functions import sketches as K


def days(spark, users, hours, copies=1):
    """``users`` distinct ones dealt to hours, each in some of several."""
    return spark.range(users * copies).selectExpr(f"CAST(id % {users} AS STRING) AS USER_ID", f"hash(id) % {hours} AS hour")


@pytest.mark.parametrize("users", [1, 2, 7, 8, 9, 30, 200, 3000, 60_000])
def test_a_day_from_its_hours_is_the_day_from_its_rows(spark, users):
    rows = days(spark, users, 5, copies=3)
    by_hour = rows.groupBy("hour").agg(K.user_sketch().alias("users"))
    (merged,) = by_hour.agg(K.estimate(K.merged("users"))).first()
    for partitions in (1, 7):
        (direct,) = rows.repartition(partitions).agg(K.estimate(K.user_sketch())).first()
        assert merged == direct
    assert abs(merged - users) <= max(1, 4 * K.RSD * users)
    if users <= 200:
        assert merged == users


def test_no_users(spark):
    rows = spark.createDataFrame([(None,), (None,)], "USER_ID string")
    assert rows.agg(K.estimate(K.user_sketch())).first()[0] == 0


@pytest.mark.parametrize(("estimated", "exact", "fits"), [(0, 1, True), (3, 1, False), (7, 8, True), (1000, 1060, True), (1000, 1070, False)])
def test_bound(spark, estimated, exact, fits):
    assert spark.range(1).select(K.within_bound(F.lit(estimated), F.lit(exact))).first()[0] is fits
