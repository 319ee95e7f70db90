"""Query text kept in files, run with named parameters."""

from __future__ import annotations

from importlib import resources

from pyspark.sql import DataFrame, SparkSession


def load_query(name: str) -> str:
    return resources.files("viewlens.plans").joinpath("sql", f"{name}.sql").read_text(encoding="utf-8")


def run_query_file(spark: SparkSession, name: str, activity: DataFrame, **parameters) -> DataFrame:
    """Run ``sql/<name>.sql`` over ``activity``.

    Values are bound as SQL parameters, never pasted into the text; a parameter the text
    names and the caller leaves out, or sets to ``None``, ends the call with an error.
    """
    missing = [key for key, value in parameters.items() if value is None]
    if missing:
        raise ValueError(f"no value for query parameter: {', '.join(sorted(missing))}")
    return spark.sql(load_query(name), args=parameters, activity=activity)
