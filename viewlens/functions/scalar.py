"""Scalar expressions over activity columns. All are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_FORMAT = "yyyy-MM-dd HH:mm:ss"
T_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"

# Shapes of the two layouts above. A string of this shape means the same to a cast as to
# the pattern, and the cast skips the pattern parser; the filter on unparsable rows makes
# Catalyst evaluate the parse twice per row, so its price counts. Naming the text once
# keeps whatever made it from being evaluated more often still.
_SHAPES = {
    SPACE_FORMAT: r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z",
    T_FORMAT: r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\z",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_event_time(text: Column | str, fmt: str = SPACE_FORMAT) -> Column:
    """Text to timestamp under exactly ``fmt``; null where it does not parse."""
    text = _col(text)
    shape = _SHAPES.get(fmt)
    if shape is None:
        return F.try_to_timestamp(text, F.lit(fmt))
    return F.regexp_extract(text, shape, 0).try_cast("timestamp")


def duration_seconds(text: Column | str) -> Column:
    """Number in text to int, truncated toward zero; missing, NaN or non-numeric gives null."""
    return _col(text).try_cast("double").try_cast("int")


def view_date(ts: Column | str) -> Column:
    return F.to_date(_col(ts))


def format_time(ts: Column | str, fmt: str) -> Column:
    return F.date_format(_col(ts), fmt)


def epoch_roundtrip(ts: Column | str) -> Column:
    """Through epoch milliseconds and back: the same instant, cut to the millisecond."""
    return F.timestamp_millis(F.unix_millis(_col(ts)))


def processing_time() -> Column:
    """When the query or micro-batch ran, at the declared millisecond precision."""
    return F.date_trunc("MILLISECOND", F.current_timestamp())
