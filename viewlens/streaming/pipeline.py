"""Pipeline control: run named steps in order, tear results down."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from viewlens.streaming import paths


@dataclass(frozen=True)
class StepStatus:
    name: str
    ok: bool
    error: str | None = None


def run_steps(steps: Iterable[tuple[str, Callable[[], object]]], pause_seconds: float = 0.0) -> list[StepStatus]:
    """Run every step in order; a failed one is reported and the rest still run.

    ``pause_seconds`` is waited after each step that succeeded.
    """
    statuses = []
    for name, step in steps:
        try:
            step()
        except Exception as error:  # noqa: BLE001 - any failure becomes the step's status
            statuses.append(StepStatus(name, False, f"{type(error).__name__}: {error}"))
        else:
            statuses.append(StepStatus(name, True))
            time.sleep(pause_seconds)
    return statuses


def stop_all(spark: SparkSession) -> list[str]:
    """Stop every running query of the session."""
    stopped = []
    for query in spark.streams.active:
        query.stop()
        stopped.append(query.name or query.id)
    return stopped


def drop_table(spark: SparkSession, root: str) -> bool:
    """Delete a continuous table with its data and checkpoint; false when there is none."""
    return paths.delete(spark, root)


def teardown(spark: SparkSession, roots: Iterable[str]) -> list[StepStatus]:
    """Stop all queries, then drop each table that exists."""
    return run_steps(
        [("stop", lambda: stop_all(spark))] + [(root, lambda r=root: drop_table(spark, r)) for root in roots]
    )
