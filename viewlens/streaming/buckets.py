"""Upsert tables kept by key in buckets, in runs that are merged in tiers outside the job.

Each micro-batch writes a *run*: the rows that changed, dealt to buckets by their key and sorted in
them, as Spark's bucketed tables are. So a batch writes what changed and no more, however large the
table, and the newest row of each key is found without moving a row. Runs of about the same number
of batches are merged to one, by a call of its own: a row is rewritten once for each tier.

Layout below a table's root::

    buckets/run=A-B/   the newest rows of the keys that changed in batches A to B, bucketed by key
    runs/A-B           says that the run is complete

A run counts once it is complete and no other complete run covers its batches. What a merge has
replaced stays until the next merge, so that a read that began before it can end.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from viewlens.streaming import paths

RUN = "run"
#: Runs of a tier that are merged to one of the next.
FAN = 4

Run = tuple[int, int]


def _name(run: Run) -> str:
    return f"{run[0]}-{run[1]}"


def _folder(root: str, run: Run) -> str:
    return f"{root}/buckets/{RUN}={_name(run)}"


def _marker(root: str, run: Run) -> str:
    return f"{root}/runs/{_name(run)}"


def complete_runs(spark: SparkSession, root: str) -> list[Run]:
    """Complete runs by their first and last batch."""
    names = [p.rsplit("/", 1)[1] for p in paths.matching(spark, f"{root}/runs/*-*")]
    return sorted((int(a), int(b)) for a, b in (n.split("-") for n in names))


def _covers(a: Run, b: Run) -> bool:
    return a != b and a[0] <= b[0] and b[1] <= a[1]


def live_runs(runs: list[Run], upto: int | None = None) -> list[Run]:
    """The runs that make up the table, oldest first, as of a batch if one is named."""
    runs = [r for r in runs if upto is None or r[1] <= upto]
    return sorted(r for r in runs if not any(_covers(o, r) for o in runs))


class BucketedTable:
    """The table below a root. Its bucketing is declared to the session, under a name of its own;
    it needs the same ``key`` and number of ``buckets`` whenever it is opened."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: tuple[str, ...], buckets: int):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root, schema, tuple(key), buckets
        self.columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        told = f"{root} {self.columns} {key} {buckets}"
        self.table = f"viewlens_{hashlib.sha256(told.encode()).hexdigest()[:24]}"

    def _declared(self, spark: SparkSession) -> str:
        by = ", ".join(f"`{k}`" for k in self.key)
        # jobs that overwrite by partition have a staging folder of their own: a merge may run beside a batch
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({self.columns}, {RUN} STRING) USING parquet "
            f"OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY ({RUN}) "
            f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/buckets'"
        )
        return self.table

    def write_run(self, rows: DataFrame, run: Run) -> None:
        """Write a run, in place of an earlier attempt at it. ``rows`` has each key once."""
        spark = rows.sparkSession
        table = self._declared(spark)
        for earlier in (_marker(self.root, run), _folder(self.root, run)):
            paths.delete(spark, earlier)
        dealt = rows.select(*self.schema.fieldNames()).repartition(self.buckets, *self.key)
        dealt.withColumn(RUN, F.lit(_name(run))).write.insertInto(table, overwrite=True)
        paths.create(spark, _marker(self.root, run))

    def writer(self) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function. A replayed batch replaces its own run."""
        return lambda batch, batch_id: self.write_run(batch, (batch_id, batch_id))

    def _newest(self, runs: list[Run]) -> DataFrame:
        """The newest row of each key in some runs: bucket by bucket, without an exchange."""
        table = self._declared(self.spark)
        self.spark.catalog.refreshTable(table)
        values = [n for n in self.schema.fieldNames() if n not in self.key]
        last = F.substring_index(RUN, "-", -1).cast("bigint")
        rows = self.spark.table(table).filter(F.col(RUN).isin([_name(r) for r in runs]))
        newest = rows.groupBy(*self.key).agg(F.max_by(F.struct(*values), last).alias("newest"))
        return newest.select(*self.key, "newest.*").select(*self.schema.fieldNames())

    def read(self, upto: int | None = None) -> DataFrame:
        """The current table, or as of a batch. Raises ``ValueError`` where that batch's runs have
        been merged with later ones and removed."""
        complete = complete_runs(self.spark, self.root)
        runs = live_runs(complete, upto)
        if upto is not None and complete and max((r[1] for r in runs), default=-1) != upto:
            raise ValueError(f"the runs up to batch {upto} have been merged with later ones")
        return self._newest(runs)

    def start_from(self, rows: DataFrame, batch: int) -> None:
        """Begin the table with what another one held as of a batch."""
        self.write_run(rows, (0, batch))

    def merge(self, fan: int = FAN) -> list[Run]:
        """Remove what earlier merges replaced, then merge until no tier has ``fan`` runs at its new
        end; returns the runs that were written.

        A run's tier is the power of ``fan`` in its number of batches. Only the runs of a merge are
        read and written. A merge that was lost leaves an incomplete run, which doesn't count.
        """
        runs = complete_runs(self.spark, self.root)
        for run in set(runs) - set(live_runs(runs)):
            paths.delete(self.spark, _marker(self.root, run))
            paths.delete(self.spark, _folder(self.root, run))
        live, written = live_runs(runs), []
        while True:
            tiers = [int(math.log(b - a + 1, fan) + 1e-9) for a, b in live]
            same = len(live)
            while same and tiers[same - 1] == tiers[-1]:
                same -= 1
            old = live[same:]
            if len(old) < fan:
                return written
            run = (old[0][0], old[-1][1])
            self.write_run(self._newest(old), run)
            written.append(run)
            live = [*live[:same], run]
