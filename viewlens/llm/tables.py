"""Reading the given tables, and tables written half-way that later steps read again."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from viewlens.session import new_run_dir
from viewlens.streaming import paths

#: Bytes of text that a Python step works on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20


#: Rows, and bytes, that Spark hands to Python at once: texts are large rows, and both sides hold a
#: batch for each task.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Sets the session to batches fit for texts; it stays so."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{table}.parquet")


#: Where the ``settled`` call that is running in this thread keeps the paths that it wrote.
_own: ContextVar[list[str] | None] = ContextVar("own", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, whatever reads it, and
    still there when an executor is lost. Its size is known to the planner, which then chooses
    between broadcast and shuffle. Removed when the driver's Python ends, if not before."""
    spark = df.sparkSession
    path = new_run_dir(spark, name)
    df.write.parquet(path)
    own = _own.get()
    if own is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns as a written table; the tables it wrote on the way are removed, and no
    others, whatever else runs in this driver."""
    outer, own = _own.get(), []
    token = _own.set(own)
    try:
        out = written(make(), name)
    finally:
        _own.reset(token)
    *gone, kept = own
    for path in gone:
        paths.delete(out.sparkSession, path)
    if outer is not None:
        outer.append(kept)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns an operator is about to add; names compare as Spark's do, by
    default in either case."""
    clash = {n.lower() for n in names}
    kept = [c for c in df.columns if c.lower() not in clash]
    return df if len(kept) == len(df.columns) else df.select(*(f"`{c}`" for c in kept))


def free(df: DataFrame, *names: str) -> list[str]:
    """``names`` for helper columns beside those of ``df``, made longer where they clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def clear_of(*helpers: str) -> Callable:
    """For an operator (df, names of its columns, ...): a caller's column that is named as one of
    ``helpers`` bears another name while the operator works, and has its own again in the result."""

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def apply(df: DataFrame, *args, **named) -> DataFrame:
            clash = [c for c in df.columns if c.lower() in helpers]
            if not clash:
                return operator(df, *args, **named)
            aside = dict(zip(clash, free(df, *(f"{c}_" for c in clash))))
            lower = {c.lower(): new for c, new in aside.items()}
            of = lambda x: lower.get(x.lower(), x) if isinstance(x, str) else x
            out = operator(df.withColumnsRenamed(aside), *map(of, args), **{k: of(x) for k, x in named.items()})
            return out.withColumnsRenamed({new: c for c, new in aside.items()})

        return apply

    return wrap


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``PIECE_BYTES`` of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes, dtype=np.int64) // PIECE_BYTES
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(start, end - start)


def appended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *columns.values()], [*batch.schema.names, *columns]
    )
