"""Savepoints: a continuous table and its query as of a committed batch, kept apart from both.

Layout below a savepoint's folder::

    checkpoint/   the query's progress up to the batch, and the state that belongs to it
    table/        the table as of the batch, one row per key
    manifest/     every file of the two with its length and SHA-256; written last

A savepoint may be taken while the query runs, of any batch whose state is still retained, and a
query started on a restored root continues behind that batch: rows that came after it are read again.
State is copied file by file, the snapshot and the changes that make up the one version and no more;
the table is written and the hashes are taken by Spark jobs.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlens.streaming import continuous, paths, upsert

#: A state version's files: whole, or its changes to the version before.
_VERSION = re.compile(r"(?P<version>[0-9]+)(_[^.]*)?\.(?P<kind>zip|snapshot|changelog|delta)")
_WHOLE = ("zip", "snapshot")


class SavepointError(ValueError):
    """A batch that cannot be saved, or a savepoint that cannot be used."""


@dataclass(frozen=True)
class Savepoint:
    path: str
    batch: int


def _state_files(files: list[str], version: int) -> list[str]:
    """Of the files below ``state`` those that make up one version: in each store the newest whole
    one up to it and every later change. Schemas and shared tables go along."""
    chosen, stores = [], defaultdict(list)
    for path in files:
        folder, name = path.rsplit("/", 1)
        found = _VERSION.fullmatch(name)
        if found is None:
            chosen.append(path)
        elif int(found["version"]) <= version:
            stores[folder].append((int(found["version"]), found["kind"], path))
    for folder, versions in stores.items():
        base = max((n for n, kind, _ in versions if kind in _WHOLE), default=0)
        changes = {n: path for n, kind, path in versions if kind not in _WHOLE and n > base}
        if sorted(changes) != list(range(base + 1, version + 1)):
            raise SavepointError(f"{folder} has no complete state of version {version}")
        chosen += [path for n, kind, path in versions if kind in _WHOLE and n == base]
        chosen += changes.values()
    if any(_VERSION.fullmatch(p.rsplit("/", 1)[1]) for p in files) and not stores:
        raise SavepointError(f"the state of version {version} is gone")
    return chosen


def _progress_files(files: list[str], batch: int) -> list[str]:
    """Offsets and commits up to the batch, and what sources remember of their input."""
    kept = []
    for path in files:
        top, name = path.split("/", 1)[0], path.rsplit("/", 1)[-1]
        if top in ("offsets", "commits") and name.isdigit() and int(name) <= batch:
            kept.append(path)
        elif top == "sources" and not name.startswith("."):
            kept.append(path)
    return kept


def _hashed(spark: SparkSession, folder: str, files: list[str]) -> DataFrame:
    """Length and SHA-256 of files by their path relative to a folder; read by tasks."""
    top = folder.rstrip("/") + "/"
    found = spark.read.format("binaryFile").load([top + f for f in files])
    at = F.expr(f"substring(path, locate('{_plain(top)}', path) + {len(_plain(top))})")
    return found.select(at.alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def _plain(path: str) -> str:
    """Without scheme and repeated slashes, as the path stands within a qualified one."""
    return "/" + re.sub(r"^[a-z0-9]+:/+([^/]*:[0-9]+/)?", "", path).lstrip("/")


def save(table: continuous.ContinuousTable, path: str, batch: int | None = None) -> Savepoint:
    """Save a continuous table as of a committed batch, the newest if none is named.

    Raises :class:`SavepointError` where the batch is not committed or its state is not retained.
    """
    spark, checkpoint = table.spark, upsert.checkpoint_path(table.root)
    committed = continuous.committed(spark, table.root)
    batch = max(committed, default=None) if batch is None else batch
    if batch not in committed:
        raise SavepointError(f"batch {batch} is not among the committed ones, {committed}")
    files = list(paths.files(spark, checkpoint))
    chosen = _progress_files(files, batch)
    chosen += _state_files([f for f in files if f.startswith("state/") and not f.endswith(".crc")], batch + 1)
    source = _hashed(spark, checkpoint, chosen)
    paths.copy(spark, [(f"{checkpoint}/{f}", f"{path}/checkpoint/{f}") for f in chosen])
    as_of = table.read(upto=batch)
    as_of.write.parquet(f"{path}/table")
    written = [f for f in paths.files(spark, f"{path}/table") if f.endswith(".parquet")]
    manifest = source.withColumn("file", F.concat(F.lit("checkpoint/"), "file"))
    if written:
        tables = _hashed(spark, f"{path}/table", written)
        manifest = manifest.unionByName(tables.withColumn("file", F.concat(F.lit("table/"), "file")))
    manifest.withColumn("batch", F.lit(batch).cast("bigint")).write.parquet(f"{path}/manifest")
    return Savepoint(path, batch)


def opened(spark: SparkSession, path: str) -> Savepoint:
    """A savepoint found sound: every file is there as it was saved. Raises
    :class:`SavepointError` where one is missing or differs."""
    if not paths.exists(spark, f"{path}/manifest/_SUCCESS"):
        raise SavepointError(f"{path} has no complete manifest")
    manifest = spark.read.parquet(f"{path}/manifest")
    there = set(paths.files(spark, path))
    files = [r["file"] for r in manifest.select("file").collect()]
    missing = [f for f in files if f not in there]
    if missing:
        raise SavepointError(f"{path} lacks {len(missing)} files, such as {min(missing)}")
    now = _hashed(spark, path, files).select("file", "length", "sha256")
    damaged = manifest.select("file", "length", "sha256").exceptAll(now).select("file").limit(1).collect()
    if damaged:
        raise SavepointError(f"{path} is damaged: {damaged[0]['file']} differs from what was saved")
    return Savepoint(path, manifest.first()["batch"])


def restore(spark: SparkSession, path: str, root: str, like: continuous.ContinuousTable | None = None) -> Savepoint:
    """Lay a savepoint out under a new root, for a query of the same plan to be started there.

    The query gets an id of its own, so the one that was saved may go on. Everything is checked
    first; nothing is written where the savepoint is damaged or the root is in use. The table is laid
    out as that of ``like``, by default with a changelog.
    """
    if paths.exists(spark, upsert.checkpoint_path(root)):
        raise SavepointError(f"{root} has a checkpoint already")
    saved = opened(spark, path)
    files = [f for f in paths.files(spark, f"{path}/checkpoint") if not f.endswith(".crc")]
    rows = spark.read.parquet(f"{path}/table")
    if like is None:
        upsert.start_from(spark, root, rows, saved.batch)
    else:
        like.start_from(root, rows, saved.batch)
    paths.copy(spark, [(f"{path}/checkpoint/{f}", f"{upsert.checkpoint_path(root)}/{f}") for f in files])
    return saved
