"""Rows behind the watermark as a second output of a continuous query.

An aggregate by time buckets leaves out rows whose bucket had closed before their micro-batch. While
that batch is written, its progress says which files it read and which watermark closed buckets, so
the same rows are read once more, by a job of its own, and those left out are kept beside the table,
batch by batch: whatever the query has not counted is there, and nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from viewlens.operators.record import keep_viewed
from viewlens.schema import EVENT_TIME
from viewlens.streaming import paths, upsert


def late_path(root: str) -> str:
    return f"{root}/late"


@dataclass(frozen=True)
class Progress:
    """What a micro-batch read, and the watermark that judged its rows."""

    files: list[str]
    watermark_ms: int


def _offsets(spark: SparkSession, checkpoint: str, batch: int) -> tuple[int, int]:
    """The watermark that a batch begins with, and the last entry of the file log that it reads."""
    if batch < 0:
        return 0, -1
    _, progress, *sources = paths.read_text(spark, f"{checkpoint}/offsets/{batch}").splitlines()
    if len(sources) != 1:
        raise ValueError("late rows are kept for queries with one source of files")
    at = -1 if sources[0] == "-" else json.loads(sources[0])["logOffset"]
    return json.loads(progress)["batchWatermarkMs"], at


def progress_of(spark: SparkSession, checkpoint: str, batch: int) -> Progress:
    """Of the batch that is being written, or one whose progress is retained. Its rows are judged by
    the watermark that the batch before it began with."""
    watermark, first = _offsets(spark, checkpoint, batch - 1)
    _, last = _offsets(spark, checkpoint, batch)
    if last == first:
        return Progress([], watermark)
    log = spark.read.text([p for p in paths.matching(spark, f"{checkpoint}/sources/0/*")])
    entry = F.from_json("value", "path string, batchId bigint")
    files = log.filter(F.col("value").startswith("{")).select(entry.alias("e")).select("e.*").distinct()
    return Progress([r["path"] for r in files.filter(F.col("batchId").between(first + 1, last)).collect()], watermark)


def with_late_rows(
    write: Callable[[DataFrame, int], None],
    root: str,
    read: Callable[[SparkSession, list[str]], DataFrame],
    bucket: str = "1 day",
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that also keeps the late rows of each batch. ``read`` turns files
    of the source to timed activity, as the query\'s own input is made of them. A replayed batch
    replaces its own late rows."""

    def both(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        spark = batch.sparkSession
        progress = progress_of(spark, upsert.checkpoint_path(root), batch_id)
        if progress.files:
            closed = F.window(EVENT_TIME, bucket).getField("end") <= F.timestamp_millis(F.lit(progress.watermark_ms))
            late = keep_viewed(read(spark, progress.files)).filter(closed)
            late.write.mode("overwrite").parquet(f"{late_path(root)}/{upsert.BATCH}={batch_id}")

    return both


def read_late(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """Every row that the query left out, with the batch that it came in."""
    marked = [p.rsplit("/", 1)[0] for p in paths.matching(spark, f"{late_path(root)}/{upsert.BATCH}=*/_SUCCESS")]
    kinds = StructType([*schema.fields, StructField(upsert.BATCH, LongType())])
    if not marked:
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).option("basePath", late_path(root)).parquet(*marked)
