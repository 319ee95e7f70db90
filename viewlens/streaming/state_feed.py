"""The changes of a running query's state, batch by batch, kept as a table of their own.

A query retains the state of a few batches; what its state source tells of them is appended here as
they are committed, so the whole history of the state stays readable when the query has moved on.

Layout below a feed's root: ``upto=N/`` holds the changes of the batches behind the one before it, up
to batch N; it counts once its success marker is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from viewlens.streaming import continuous, paths, upsert

UPTO = "upto"


def _distinct_names(kind: StructType) -> StructType:
    """Two maxima are both named ``max`` in the state; a file needs names of their own."""
    names = kind.fieldNames()
    return StructType([StructField(f.name if names.count(f.name) == 1 else f"{f.name}_{k}", f.dataType) for k, f in enumerate(kind)])


def read_changes(spark: SparkSession, root: str, first: int, last: int, operator_id: int = 0) -> DataFrame:
    """Changes of a query's state in a closed range of retained batches: ``batch_id``,
    ``change_type`` (``update`` or ``delete``), ``key``, ``value`` and ``partition_id``. Fields of
    the value that share a name are numbered."""
    changes = (
        spark.read.format("statestore")
        .option("operatorId", operator_id)
        .option("readChangeFeed", True)
        .option("changeStartBatchId", first)
        .option("changeEndBatchId", last)
        .load(upsert.checkpoint_path(root))
    )
    return changes.withColumn("value", F.col("value").cast(_distinct_names(changes.schema["value"].dataType)))


def _parts(spark: SparkSession, feed: str) -> dict[int, str]:
    marked = [p.rsplit("/", 1)[0] for p in paths.matching(spark, f"{feed}/{UPTO}=*/_SUCCESS")]
    return {int(p.rsplit("=", 1)[1]): p for p in marked}


def follow(spark: SparkSession, root: str, feed: str, operator_id: int = 0) -> int:
    """Append the changes of all batches committed since the last call; returns the newest batch in
    the feed, -1 if there is none yet.

    An attempt that was lost is written again. Raises ``ValueError`` if a batch was dropped from the
    checkpoint before it was followed: call at least once in as many batches as are retained.
    """
    newest = max(_parts(spark, feed), default=-1)
    batches = [b for b in continuous.committed(spark, root) if b > newest]
    if not batches:
        return newest
    if batches[0] != newest + 1:
        raise ValueError(f"the batches from {newest + 1} to {batches[0] - 1} are no longer retained")
    changes = read_changes(spark, root, batches[0], batches[-1], operator_id)
    changes.write.mode("overwrite").parquet(f"{feed}/{UPTO}={batches[-1]}")
    return batches[-1]


def read_feed(spark: SparkSession, feed: str) -> DataFrame:
    """Every change that was followed."""
    return spark.read.parquet(*_parts(spark, feed).values())


def folded(changes: DataFrame, keep_expired: bool = True, upto: int | None = None) -> DataFrame:
    """``key`` and its newest ``value`` as of a batch, the last one if none is named.

    Keys that left the state keep the value they left with, as the table that the query maintains
    does; without ``keep_expired`` they are gone, as they are from the state.
    """
    changes = changes if upto is None else changes.filter(F.col("batch_id") <= upto)
    deleted = F.col("change_type") == "delete"
    if keep_expired:
        changes = changes.filter(~deleted)
    order = F.struct("batch_id", deleted)
    newest = changes.groupBy("key").agg(
        F.max_by("value", order).alias("value"), F.max_by(deleted, order).alias("deleted")
    )
    return newest.filter(~F.col("deleted")).select("key", "value")
