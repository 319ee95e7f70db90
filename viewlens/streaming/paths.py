"""Folder operations on whatever file system a path names. Metadata only, but for ``copy``.

They go through the session's JVM, so they need a classic session and not a Connect one.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    return handle.getFileSystem(spark._jsc.hadoopConfiguration()), handle


def exists(spark: SparkSession, path: str) -> bool:
    fs, handle = _open(spark, path)
    return fs.exists(handle)


def create(spark: SparkSession, path: str) -> None:
    fs, handle = _open(spark, path)
    fs.mkdirs(handle)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder; false when there was none."""
    fs, handle = _open(spark, path)
    return fs.exists(handle) and fs.delete(handle, True)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Full paths for a pattern, in one call to the file system."""
    fs, handle = _open(spark, pattern)
    return sorted(status.getPath().toString() for status in fs.globStatus(handle) or [])


def files(spark: SparkSession, folder: str) -> dict[str, int]:
    """Every file below a folder by its path relative to it, with its length."""
    fs, handle = _open(spark, folder)
    found: dict[str, int] = {}
    if fs.exists(handle):
        top = fs.makeQualified(handle).toString().rstrip("/") + "/"
        listing = fs.listFiles(handle, True)
        while listing.hasNext():
            status = listing.next()
            found[status.getPath().toString().removeprefix(top)] = status.getLen()
    return found


def read_text(spark: SparkSession, path: str) -> str:
    """A small file: a line of progress, not data."""
    fs, handle = _open(spark, path)
    stream = fs.open(handle)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file."""
    fs, handle = _open(spark, path)
    stream = fs.create(handle, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def copy(spark: SparkSession, pairs: Iterable[tuple[str, str]], threads: int = 16) -> None:
    """Copy files, several at a time, through buffers of the file system's own client."""
    conf = spark._jsc.hadoopConfiguration()
    util = spark._jvm.org.apache.hadoop.fs.FileUtil

    def one(pair: tuple[str, str]) -> None:
        (source, at), (target, to) = _open(spark, pair[0]), _open(spark, pair[1])
        target.mkdirs(to.getParent())
        if not util.copy(source, at, target, to, False, True, conf):
            raise OSError(f"could not copy {pair[0]} to {pair[1]}")

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(one, pairs))
