"""How continuous queries run: state backend, checkpoints, trigger, lateness."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from viewlens.schema import EVENT_TIME
from viewlens.session import pin_utc

# Fixed values of the pipeline's declared configuration.
TRIGGER_INTERVAL = "30 seconds"
BATCHES_TO_RETAIN = 3
OUT_OF_ORDERNESS = "5 minutes"
GRACE = "24 hours"

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.minBatchesToRetain": str(BATCHES_TO_RETAIN),
}

#: For few large micro-batches. Each leaves its state whole, so that what starts from it replays no
#: changes, and keys aren't counted, which takes a read for every write, replayed ones included.
_BULK_CONF = {
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "false",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def state_partitions(spark: SparkSession) -> int:
    """State partitions are fixed when a query first starts, and not coalesced at run time."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def stream_settings(spark: SparkSession, partitions: int | None = None, bulk: bool = False) -> Iterator[None]:
    """Session settings that a query started inside the block keeps; restored afterwards."""
    wanted = {**_STATE_CONF, **_BULK_CONF} if bulk else dict(_STATE_CONF)
    wanted["spark.sql.shuffle.partitions"] = str(partitions or state_partitions(spark))
    pin_utc(spark)
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def active_query(spark: SparkSession, name: str) -> StreamingQuery | None:
    return next((q for q in spark.streams.active if q.name == name), None)


def start(
    writer: DataStreamWriter,
    spark: SparkSession,
    name: str,
    replay: bool = False,
    partitions: int | None = None,
    bulk: bool = False,
) -> StreamingQuery:
    """Start a query, unless one of that name is running, which is returned then.

    ``replay`` reads what is there and ends; otherwise a micro-batch starts every interval. ``bulk``
    is for few large micro-batches: the state is written whole with each, and the query's status has
    no state rows until it is started again without.
    """
    query = active_query(spark, name)
    if query is None:
        writer = writer.queryName(name)
        writer = writer.trigger(availableNow=True) if replay else writer.trigger(processingTime=TRIGGER_INTERVAL)
        with stream_settings(spark, partitions, bulk):
            query = writer.start()
    return query


def with_watermark(activity: DataFrame, delay: str = GRACE) -> DataFrame:
    """Bound lateness. Only groups with a window in their key drop late rows and expire."""
    return activity.withWatermark(EVENT_TIME, delay)
