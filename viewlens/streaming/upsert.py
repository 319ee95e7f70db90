"""Upsert tables without a table format: a changelog folder and latest-per-key reads.

Layout below a table's root::

    changelog/batch_id=N/    rows that changed in micro-batch N, as emitted
    snapshots/batch_id=N/    one row per key, everything up to and including batch N
    checkpoint/              the query's progress and state

A batch or snapshot counts once its success marker is there, so a read during a write sees the
table as it was before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from viewlens.streaming import paths

BATCH = "batch_id"
#: Batches between snapshots, and batches of the changelog kept behind the newest for subscribers.
SNAPSHOT_EVERY, BATCHES_KEPT = 50, 500


def changelog_path(root: str) -> str:
    return f"{root}/changelog"


def snapshots_path(root: str) -> str:
    return f"{root}/snapshots"


def checkpoint_path(root: str) -> str:
    return f"{root}/checkpoint"


def changelog_writer(
    root: str,
    key: tuple[str, ...],
    files: int | None = None,
    snapshot_every: int = SNAPSHOT_EVERY,
    kept: int = BATCHES_KEPT,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function. A replayed batch replaces its own folder and nothing else.

    ``files`` bounds the files per batch; the rows of a batch are already grouped, so merging
    their partitions moves no hot key. Every ``snapshot_every`` batches the table is compacted,
    and what lies more than ``kept`` batches behind the snapshot goes.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch if files is None else batch.coalesce(files)
        out.write.mode("overwrite").parquet(f"{changelog_path(root)}/{BATCH}={batch_id}")
        if (batch_id + 1) % snapshot_every == 0:
            compact(batch.sparkSession, root, batch.schema, key)
            prune(batch.sparkSession, root, kept)

    return write


def _with_batch(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(BATCH, LongType())])


def _complete(spark: SparkSession, folder: str) -> dict[int, str]:
    """The folders of complete batches by number."""
    marked = [p.rsplit("/", 1)[0] for p in paths.matching(spark, f"{folder}/{BATCH}=*/_SUCCESS")]
    return {int(p.rsplit("=", 1)[1]): p for p in marked}


def read_changelog(spark: SparkSession, root: str, schema: StructType, after: int = -1) -> DataFrame:
    """Every change of the complete batches after a given one, with its batch."""
    batches = [p for n, p in _complete(spark, changelog_path(root)).items() if n > after]
    if not batches:
        return spark.createDataFrame([], _with_batch(schema))
    return spark.read.schema(_with_batch(schema)).option("basePath", changelog_path(root)).parquet(*batches)


def subscribe(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The changelog as a stream: existing changes first, then new ones as they land.

    Each change arrives at least once. A micro-batch that its query has to repeat is written
    anew, under the same ``batch_id``: a subscriber that keeps the latest row of each key and
    batch sees no difference. Batches that were pruned before they were read don't arrive.
    """
    return spark.readStream.schema(_with_batch(schema)).parquet(changelog_path(root))


def latest_per_key(changes: DataFrame, key: tuple[str, ...], order: str = BATCH) -> DataFrame:
    """One row per key, from the newest batch that touched it.

    A key occurs once per batch, and the maximum pre-aggregates before the shuffle.
    """
    values = [c for c in changes.columns if c not in key and c != order]
    newest = changes.groupBy(*key).agg(F.max_by(F.struct(*values), order).alias("newest"))
    return newest.select(*key, "newest.*").select(*[c for c in changes.columns if c != order])


def _changes_since_snapshot(spark: SparkSession, root: str, schema: StructType, upto: int | None = None) -> DataFrame:
    snapshots = _complete(spark, snapshots_path(root))
    newest = max((n for n in snapshots if upto is None or n <= upto), default=None)
    if newest is None:
        return read_changelog(spark, root, schema)
    snapshot = spark.read.schema(schema).parquet(snapshots[newest]).withColumn(BATCH, F.lit(newest).cast("bigint"))
    return snapshot.unionByName(read_changelog(spark, root, schema, after=newest))


def read_table(
    spark: SparkSession, root: str, schema: StructType, key: tuple[str, ...], upto: int | None = None
) -> DataFrame:
    """The current table: the newest snapshot with every later change applied. Before the first
    batch it has no rows. ``upto`` reads it as of a batch, as long as that one's changes are kept."""
    changes = _changes_since_snapshot(spark, root, schema, upto)
    return latest_per_key(changes if upto is None else changes.filter(F.col(BATCH) <= upto), key)


def start_from(spark: SparkSession, root: str, table: DataFrame, batch: int) -> None:
    """Begin a table with what another one held as of a batch."""
    table.write.mode("overwrite").parquet(f"{snapshots_path(root)}/{BATCH}={batch}")


def compact(spark: SparkSession, root: str, schema: StructType, key: tuple[str, ...]) -> int | None:
    """Write a snapshot of all complete batches and return the last one it covers. A lost attempt
    is written again by the next call."""
    upto = max(_complete(spark, changelog_path(root)), default=None)
    if upto is None or upto in _complete(spark, snapshots_path(root)):
        return upto
    covered = _changes_since_snapshot(spark, root, schema).filter(F.col(BATCH) <= upto)
    latest_per_key(covered, key).write.mode("overwrite").parquet(f"{snapshots_path(root)}/{BATCH}={upto}")
    return upto


def prune(spark: SparkSession, root: str, kept: int = BATCHES_KEPT) -> None:
    """Delete batches more than ``kept`` behind the newest snapshot, and all snapshots but two:
    a read that began with the one before the newest can end."""
    snapshots = _complete(spark, snapshots_path(root))
    newest = max(snapshots, default=-1)
    for n, path in _complete(spark, changelog_path(root)).items():
        if n <= newest - kept:
            paths.delete(spark, path)
    for n in sorted(snapshots)[:-2]:
        paths.delete(spark, snapshots[n])
