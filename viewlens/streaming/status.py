"""What the session's streaming queries do, as a table: a row for each start, micro-batch and end."""

from __future__ import annotations

import json
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from viewlens.streaming import paths

SCHEMA = (
    "query string, id string, run_id string, event string, at timestamp, batch_id bigint, input_rows bigint, "
    "state_rows bigint, rows_behind_watermark bigint, duration_ms bigint, offsets string, error string"
)
STARTED, PROGRESS, STOPPED, FAILED = "started", "progress", "stopped", "failed"
#: Rows held before they are written.
HELD = 200


class StatusTable(StreamingQueryListener):
    """A listener that keeps what it hears below a folder; use it as a context, or ``close`` it.

    Events reach it a little after they happen; ``wait_for`` waits for the end of some runs.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._rows: list[tuple] = []
        self._names: dict[str, str | None] = {}
        self._ended: set[str] = set()
        self._lock = threading.Lock()
        spark.streams.addListener(self)

    def __enter__(self) -> StatusTable:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Stop listening and write what is held."""
        self.spark.streams.removeListener(self)
        self.flush()

    def _add(self, event, kind: str, *values) -> None:
        row = (self._names.get(str(event.runId)), str(event.id), str(event.runId), kind, time.time(), *values)
        with self._lock:
            self._rows.append(row)
            full = len(self._rows) >= HELD
        if full:
            self.flush()

    def onQueryStarted(self, event) -> None:
        self._names[str(event.runId)] = event.name
        self._add(event, STARTED, *[None] * 7)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        states = p.stateOperators
        self._add(
            p,
            PROGRESS,
            p.batchId,
            p.numInputRows,
            sum(s.numRowsTotal for s in states),
            sum(s.numRowsDroppedByWatermark for s in states),
            p.durationMs.get("triggerExecution"),
            json.dumps([s.endOffset for s in p.sources]),
            None,
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add(event, FAILED if event.exception else STOPPED, *[None] * 6, event.exception)
        self._ended.add(str(event.runId))

    def flush(self) -> None:
        """Write the rows held so far."""
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            kinds = StructType.fromDDL(SCHEMA.replace("at timestamp", "at double"))
            df = self.spark.createDataFrame(rows, kinds).withColumn("at", F.timestamp_seconds("at"))
            df.coalesce(1).write.parquet(f"{self.path}/{uuid.uuid4().hex}")

    def wait_for(self, *run_ids: str, seconds: float = 60) -> None:
        """Until the ends of these runs were heard; raises ``TimeoutError`` after a while."""
        end = time.monotonic() + seconds
        while not self._ended.issuperset(map(str, run_ids)):
            if time.monotonic() > end:
                raise TimeoutError(f"no end heard of {set(map(str, run_ids)) - self._ended}")
            time.sleep(0.05)

    def read(self) -> DataFrame:
        """All rows so far."""
        self.flush()
        marked = [p.rsplit("/", 1)[0] for p in paths.matching(self.spark, f"{self.path}/*/_SUCCESS")]
        if not marked:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*marked)


def summary(status: DataFrame) -> DataFrame:
    """One row for each query: how its newest run ended or that it is ``running``, and over all runs
    its batches, input rows and rows behind the watermark, and the state rows of its newest batch."""
    progress = F.col("event") == PROGRESS
    order = F.struct("at", F.when(F.col("event").isin(STOPPED, FAILED), 1).otherwise(0))
    last = F.max_by("event", F.when(~progress, order))
    return status.groupBy("query").agg(
        F.when(last == STARTED, "running").otherwise(last).alias("status"),
        F.count_distinct(F.when(progress & (F.col("input_rows") > 0), F.col("batch_id"))).alias("batches"),
        F.coalesce(F.sum("input_rows"), F.lit(0)).alias("input_rows"),
        F.coalesce(F.max_by("state_rows", F.when(progress, F.col("batch_id"))), F.lit(0)).alias("state_rows"),
        F.max("error").alias("error"),
    )
