"""Distinct users as sketches, which can be stored and merged: hours to days, streams to totals.

A sketch of few users holds each of them, so its estimate is right but for a collision of hashes; of
many it has 2**LOG_SIZE registers, and a relative standard deviation that follows from their number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base 2 logarithm of the registers.
LOG_SIZE = 12
#: Relative standard deviation of a merged sketch of that size.
RSD = 1.04 / 2 ** (LOG_SIZE / 2)


def user_sketch(column: str = "USER_ID") -> Column:
    """An aggregate: the distinct non-null values as a sketch. Null where there are none."""
    return F.hll_sketch_agg(column, LOG_SIZE)


def merged(sketch: str) -> Column:
    """An aggregate: the sketch of all values of several sketches."""
    return F.hll_union_agg(sketch)


def estimate(sketch: Column) -> Column:
    """The number of values. A sketch that was never merged would be estimated from the order in
    which its values came; merged with itself it is read as any other, so that a day comes out the
    same from its rows and from its hours."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_union(sketch, sketch)), F.lit(0).cast("bigint"))


def within_bound(estimated: Column, exact: Column) -> Column:
    """Within four standard deviations, or within one where those are less."""
    return F.abs(estimated - exact) <= F.greatest(F.lit(1.0), 4 * RSD * exact)
