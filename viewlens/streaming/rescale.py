"""Move a query that keeps cells to another number of state partitions.

That number is fixed for a checkpoint. So the state of a savepoint is read back as cells and handed
to a query that merges cells, which shuffles them to its own partitions as its first micro-batch;
then the new checkpoint is told how far the saved one had read, and the query goes on from there.
Cells are partial results, so merging saved ones with those of new rows counts every row once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from viewlens.operators.cells import UserMetric
from viewlens.streaming import continuous, paths, savepoints, upsert
from viewlens.streaming.settings import stream_settings


def _seed(root: str) -> str:
    return f"{root}/seed"


def resume(
    spark: SparkSession, metric: UserMetric, activity: DataFrame, root: str, name: str, partitions: int, **options
) -> continuous.ContinuousTable:
    """Start, or start again, the query of a moved table: ``activity`` is the stream that the saved
    query read, from one folder of files."""
    cells = metric.cells
    units = cells.units(activity)
    merged = cells.merged(units.unionByName(spark.readStream.schema(units.schema).parquet(_seed(root))))
    return continuous.maintain(merged, cells.key, root, name, state_partitions=partitions, **options)


def move(
    spark: SparkSession,
    path: str,
    metric: UserMetric,
    read: Callable[[str], DataFrame],
    root: str,
    name: str,
    partitions: int,
) -> savepoints.Savepoint:
    """Lay a savepoint of :func:`.continuous.maintain_cells` out under a new root with so many state
    partitions; :func:`resume` continues it.

    ``read`` gives the stream of activity from a folder. The saved query must have one source of
    files and keep its buckets (no ``expire``). Nothing is moved from a damaged savepoint.
    """
    if paths.exists(spark, upsert.checkpoint_path(root)):
        raise savepoints.SavepointError(f"{root} has a checkpoint already")
    saved = savepoints.opened(spark, path)
    progress = f"{path}/checkpoint/offsets/{saved.batch}"
    *_, at = paths.read_text(spark, progress).splitlines()
    empty = f"{root}/empty"
    paths.create(spark, empty)
    with stream_settings(spark, bulk=True):
        state = spark.read.format("statestore").option("batchId", saved.batch).load(f"{path}/checkpoint")
        metric.cells.from_state(state, metric.cells.units(read(empty)).schema).write.parquet(_seed(root))
    # what the table held before is its beginning, behind which the first micro-batch comes
    upsert.start_from(spark, root, spark.read.parquet(f"{path}/table"), -1)
    resume(spark, metric, read(empty), root, name, partitions, replay=True, bulk=True).wait()
    if continuous.committed(spark, root) != [0]:
        raise savepoints.SavepointError(f"the state saved in {path} has no rows to move")
    sources = paths.files(spark, f"{path}/checkpoint/sources/0")
    log = f"{upsert.checkpoint_path(root)}/sources/0"
    paths.copy(spark, [(f"{path}/checkpoint/sources/0/{f}", f"{log}/{f}") for f in sources if not f.startswith(".")])
    first = f"{upsert.checkpoint_path(root)}/offsets/0"
    version, settings, _, seed = paths.read_text(spark, first).splitlines()
    paths.write_text(spark, first, "\n".join([version, settings, at, seed]))
    return saved
