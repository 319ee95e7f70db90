"""Continuous metric queries: a streaming result kept as an upsert table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from viewlens.operators.cells import UserMetric
from viewlens.streaming import paths, upsert
from viewlens.streaming.buckets import BucketedTable
from viewlens.streaming.settings import active_query, start

#: Writes a micro-batch, given its number.
Writer = Callable[[DataFrame, int], None]

#: Where the queries started here keep their tables, by the query's id.
_roots: dict[str, str] = {}


@dataclass(frozen=True)
class ContinuousTable:
    """An upsert table that a streaming query maintains below ``root``."""

    spark: SparkSession
    root: str
    schema: StructType
    key: tuple[str, ...]
    query: StreamingQuery
    #: For a table in buckets, how many.
    buckets: int | None = None

    @property
    def bucketed(self) -> BucketedTable:
        return BucketedTable(self.spark, self.root, self.schema, self.key, self.buckets)

    def read(self, upto: int | None = None) -> DataFrame:
        """The current table, or as of a batch whose changes are kept."""
        if self.buckets:
            return self.bucketed.read(upto)
        return upsert.read_table(self.spark, self.root, self.schema, self.key, upto)

    def start_from(self, root: str, rows: DataFrame, batch: int) -> None:
        """Begin a table of the same layout under another root."""
        if self.buckets:
            BucketedTable(self.spark, root, self.schema, self.key, self.buckets).start_from(rows, batch)
        else:
            upsert.start_from(self.spark, root, rows, batch)

    def subscribe(self) -> DataFrame:
        """The table's changes as a stream. A table in buckets keeps none once its runs are merged."""
        if self.buckets:
            raise ValueError("a table in buckets has no changelog")
        return upsert.subscribe(self.spark, self.root, self.schema)

    def wait(self) -> ContinuousTable:
        """Until a replay has read everything; raises if the query failed."""
        self.query.awaitTermination()
        return self


def maintain(
    result: DataFrame,
    key: tuple[str, ...],
    root: str,
    name: str,
    replay: bool = False,
    output_mode: str = "update",
    files: int | None = None,
    state_partitions: int | None = None,
    snapshot_every: int = upsert.SNAPSHOT_EVERY,
    buckets: int | None = None,
    wrap: Callable[[Writer], Writer] | None = None,
    bulk: bool = False,
) -> ContinuousTable:
    """Start keeping ``result`` as an upsert table, unless a query of that name is running.

    Each micro-batch emits the rows that changed. ``replay`` reads what is there and ends;
    otherwise a micro-batch starts every trigger interval. Starting again on the same root
    resumes from the stored progress and state. A running query of that name that keeps another
    root is an error.

    With ``buckets`` the table is kept by key in so many of them, see :mod:`.buckets`: a batch then
    writes its changes only, and ``table.bucketed.merge()`` is to be called now and then. ``wrap``
    adds to what is written with each batch, such as :func:`.late.with_late_rows`. ``bulk`` is for few
    large micro-batches, see :func:`.settings.start`.
    """
    spark = result.sparkSession
    running = active_query(spark, name)
    if running is not None and _roots.get(running.id) != root:
        raise ValueError(f"query {name} keeps its table at {_roots.get(running.id)}, not at {root}")
    if buckets:
        write = BucketedTable(spark, root, result.schema, key, buckets).writer()
    else:
        paths.create(spark, upsert.changelog_path(root))
        write = upsert.changelog_writer(root, key, files, snapshot_every)
    writer = (
        result.writeStream.outputMode(output_mode)
        .foreachBatch(wrap(write) if wrap else write)
        .option("checkpointLocation", upsert.checkpoint_path(root))
    )
    query = start(writer, spark, name, replay, state_partitions, bulk)
    _roots[query.id] = root
    return ContinuousTable(spark, root, result.schema, key, query, buckets)


def maintain_cells(
    metric: UserMetric, activity: DataFrame, root: str, name: str, expire: bool = False, **options
) -> ContinuousTable:
    """Keep the cells of a result with exact users; ``metric.finish(table.read())`` is the result.

    With ``expire`` on a watermarked stream, cells leave the state once their bucket has closed;
    the table keeps them.
    """
    return maintain(metric.cells.of(activity, expire), metric.cells.key, root, name, **options)


def committed(spark: SparkSession, root: str) -> list[int]:
    """The batches that the query has committed and still has the progress of."""
    names = [p.rsplit("/", 1)[1] for p in paths.matching(spark, f"{upsert.checkpoint_path(root)}/commits/*")]
    return sorted(int(n) for n in names if n.isdigit())


def read_state(
    spark: SparkSession, root: str, operator_id: int = 0, batch: int | None = None, store: str | None = None
) -> DataFrame:
    """Keys and values in a query's state as of a committed batch, the newest if none is named.

    Reading is on the checkpoint's files, so it does not disturb the query, and a read that names
    its batch is not disturbed by batches that follow, as long as that batch is retained.
    """
    reader = spark.read.format("statestore").option("operatorId", operator_id)
    reader = reader if batch is None else reader.option("batchId", batch)
    reader = reader if store is None else reader.option("storeName", store)
    return reader.load(upsert.checkpoint_path(root))


def read_state_metadata(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("state-metadata").load(upsert.checkpoint_path(root))
