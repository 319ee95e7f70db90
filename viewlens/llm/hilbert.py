"""Shards along a Hilbert curve through several metadata dimensions.

Each dimension is quantised to cells; rows are ordered by the curve's index of their cells and cut
into runs of equal length. A run covers a compact region, so a shard's cell ranges rule it out for
most conditions on any of the dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewlens.llm.tables import appended, free, without, written

SHARDS, BITS = 40, 6
#: monotonically_increasing_id() has the partition above these bits and the row below.
_ROW_BITS = 33


def category_cell(value: Column, bits: int = BITS) -> Column:
    """One of 2^bits cells by hash; null has a cell of its own choosing like any other value."""
    return F.pmod(F.xxhash64(value), F.lit(1 << bits)).cast("int")


def size_cell(value: Column, bits: int = BITS) -> Column:
    """Cells of equal ratio, up to 2^32; null is cell 0."""
    scaled = F.floor(F.log2(1 + F.coalesce(value, F.lit(0))) * ((1 << bits) / 32))
    return F.least(scaled, F.lit((1 << bits) - 1)).cast("int")


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of each column of ``cells`` (dimensions x rows), by Skilling's method."""
    x = [c.astype(np.int64) for c in cells]
    n = len(x)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(n):
            inverted = (x[i] & q) != 0
            swapped = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inverted, x[0] ^ low, x[0] ^ swapped)
            if i:
                x[i] = x[i] ^ swapped
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flips = np.zeros_like(x[0])
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        flips = np.where(x[n - 1] & q, flips ^ (q - 1), flips)
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for part in x:
            index = index << 1 | ((part ^ flips) >> bit & 1)
    return index


def index_batches(batches: Iterator[pa.RecordBatch], cells: list[str], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = curve_index(np.array([batch.column(c).to_numpy() for c in cells]), bits)
        yield appended(batch, hilbert=pa.array(found, pa.int64()))


def assign(
    df: DataFrame, dimensions: dict[str, Column], order: list[Column], shards: int = SHARDS, bits: int = BITS
) -> DataFrame:
    """``df`` with a cell column for each of ``dimensions`` (its name ending in ``_cell``),
    ``hilbert``, ``shard`` (int) and ``slot`` (bigint, from 0 without gaps in each shard). Columns
    of these names are replaced; others stay, whatever their names. Shards' row counts differ by one at most.

    ``order`` decides among rows of one index, so that a hot cell is spread over tasks; rows that
    are equal in it are interchangeable. With fewer rows than shards some shards stay empty.
    """
    names = [f"{name}_cell" for name in dimensions]
    df = without(df, *names, "hilbert", "shard", "slot")
    rows = df.select("*", *(cell.alias(name) for name, cell in zip(names, dimensions.values())))
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "hilbert bigint"])
    rows = rows.mapInArrow(lambda batches: index_batches(batches, names, bits), kinds)
    rows = rows.repartitionByRange(F.col("hilbert"), *order).sortWithinPartitions(F.col("hilbert"), *order)
    at, own, all_, before, rank = free(rows, "_at", "_task", "_all", "_before", "_rank")
    rows = written(rows.withColumn(at, F.monotonically_increasing_id()), "curve")
    task = F.shiftright(at, _ROW_BITS)
    # a row for each task that wrote; its running sums say where the task's rows begin
    counts = rows.groupBy(task.alias(own)).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.orderBy(own)) - F.col("n")
    starts = counts.select(own, so_far.alias(before), F.sum("n").over(Window.partitionBy()).alias(all_))
    rows = rows.withColumn(own, task).join(F.broadcast(starts), own)
    rows = rows.withColumn(rank, F.col(before) + F.col(at).bitwiseAND((1 << _ROW_BITS) - 1))
    # exact in whole numbers: the first rank of a shard
    shard = F.expr(f"CAST({rank} * {shards} DIV {all_} AS INT)")
    first = F.expr(f"(CAST(shard AS BIGINT) * {all_} + {shards - 1}) DIV {shards}")
    rows = rows.withColumn("shard", shard).withColumn("slot", F.col(rank) - first)
    return rows.drop(at, own, before, all_, rank)


def manifest(assigned: DataFrame) -> DataFrame:
    """(shard, n_rows, and the least and greatest cell of each dimension): what a reader needs to
    leave out shards."""
    cells = [c for c in assigned.columns if c.endswith("_cell")]
    ranges = [f(c).alias(f"{f.__name__}_{c}") for c in cells for f in (F.min, F.max)]
    return assigned.groupBy("shard").agg(F.count("*").alias("n_rows"), *ranges)


def shards_for(manifest: DataFrame, **cells: int) -> DataFrame:
    """The shards that can hold rows of the given cells, by dimension."""
    for name, cell in cells.items():
        manifest = manifest.filter(F.lit(cell).between(F.col(f"min_{name}_cell"), F.col(f"max_{name}_cell")))
    return manifest.select("shard")


def write_shards(assigned: DataFrame, path: str) -> None:
    """A folder for each shard, each row in its slot's place among files of the shard."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
