"""Session settings shared by every job, and where jobs keep intermediate files."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str = "viewlens", **conf: str) -> SparkSession:
    """A session with the settings every metric relies on; ``conf`` adds or overrides."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return pin_utc(builder.getOrCreate())


def pin_utc(spark: SparkSession) -> SparkSession:
    """Dates are cut at UTC midnight: ``to_date`` follows the session zone, ``window`` does not.
    The session stays in UTC afterwards."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` as the cluster names it, else
    a folder below the warehouse, on the file system that the warehouse is on."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    path = named or f"{spark.conf.get('spark.sql.warehouse.dir')}/viewlens-runs"
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    return handle.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(handle).toString()


def new_run_dir(spark: SparkSession, name: str) -> str:
    """A path no other run uses, below the shared folder. What a run leaves there goes when the
    driver's Python ends; results read from it are readable until then."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        handle = spark._jvm.org.apache.hadoop.fs.Path(path)
        handle.getFileSystem(spark._jsc.hadoopConfiguration()).delete(handle, True)
