"""Raw file source and the activity table at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from viewlens.functions.scalar import view_date
from viewlens.schema import EVENT_TIME, INDEX_COLUMN, RAW_SCHEMA


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headed CSV with a leading index column; every field is read as text, none inferred.

    Fields are matched by position, so the unnamed index header needs no name. Quoted
    titles may hold commas and doubled quotes.
    """
    return (
        spark.read.schema(RAW_SCHEMA)
        .option("header", True)
        .option("enforceSchema", True)
        .option("escape", '"')
        .csv(path)
        .drop(INDEX_COLUMN)
    )


def write_activity_table(activity: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by day, with event time already parsed, so queries over a range of days prune.

    The rebalance hint lets adaptive execution split a day that holds far more than the
    others and merge small ones, instead of one writer task per day.
    """
    (
        activity.withColumn("view_date", view_date(EVENT_TIME))
        .hint("rebalance", "view_date")
        .write.mode(mode)
        .partitionBy("view_date")
        .parquet(path)
    )


def read_activity_table(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """The activity table, limited to a closed range of days when given."""
    table = spark.read.parquet(path)
    if first_day is not None:
        table = table.filter(table.view_date >= first_day)
    if last_day is not None:
        table = table.filter(table.view_date <= last_day)
    return table
