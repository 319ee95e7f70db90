"""The partition of a keyed message, as the log's producers choose it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 32-bit Murmur2 hash that producers use.
MULTIPLIER = 0x5BD1E995
SEED = 0x9747B28C
SHIFT = 24

_LOW = (1 << 32) - 1


def _times(a: Column) -> Column:
    """The product with ``MULTIPLIER``, which has 31 bits, cut to 32 bits; the whole one fits 63."""
    return (a * F.lit(MULTIPLIER).cast("bigint")).bitwiseAND(F.lit(_LOW))


def _mixed(a: Column, shift: int) -> Column:
    return a.bitwiseXOR(F.shiftright(a, shift))


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def murmur2(key: Column) -> Column:
    """The hash of a key's bytes, as a bigint from 0 to 2**32 - 1."""
    digits = F.hex(key.cast("binary"))
    size = F.octet_length(key.cast("binary")).cast("bigint")

    def byte(at: Column, k: int) -> Column:
        """Byte ``k`` behind an offset, 0 behind the end."""
        two = F.substring(digits, (at + k) * 2 + 1, F.lit(2))
        return F.coalesce(F.conv(F.when(two != "", two), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))

    def word(at: Column) -> Column:
        return sum((F.shiftleft(byte(at, k), 8 * k) for k in range(1, 4)), byte(at, 0))

    def block(h: Column, at: Column) -> Column:
        k = _let(_times(word(at)), lambda w: _times(_mixed(w, SHIFT)))
        return _times(h).bitwiseXOR(k)

    whole = size - size % 4
    starts = F.when(whole > 0, F.sequence(F.lit(0).cast("bigint"), whole - 4, F.lit(4).cast("bigint")))
    starts = F.coalesce(starts, F.array().cast("array<bigint>"))
    hashed = F.aggregate(starts, F.lit(SEED).bitwiseXOR(size), block)

    def tail(h: Column) -> Column:
        rest = h.bitwiseXOR(word(whole))
        return F.when(size % 4 > 0, _times(rest)).otherwise(h)

    return _let(_let(hashed, tail), lambda h: _let(_times(_mixed(h, 13)), lambda m: _mixed(m, 15)))


def partition_of(key: Column, partitions: int) -> Column:
    """A key's partition: its hash without the sign, modulo their number. A null key has none in the
    log's terms and goes to partition 0 here, so that it too keeps its order."""
    positive = murmur2(key).bitwiseAND(F.lit(0x7FFFFFFF))
    return F.coalesce((positive % partitions).cast("int"), F.lit(0))
