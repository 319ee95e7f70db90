"""Records in Avro's binary form, written and read by column functions.

A record is its fields one after another. Each field here is a union of null and a string or an int:
the number of the branch, then for a string its length and its bytes in UTF-8, for an int the number.
Numbers are zig-zag coded, in groups of seven bits, the lowest first, a high bit where more follow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

#: Bytes of the longest number: lengths and ints are coded in at most five groups.
GROUPS = 5

#: The character set whose characters are the bytes.
BYTES = "ISO-8859-1"

_NULL, _SOME = "00", "02"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _byte(value: Column) -> Column:
    return F.encode(F.char(value), BYTES)


def number_bytes(n: Column) -> Column:
    """A number within 32 bits in zig-zag groups. Small ones, as most lengths are, need one."""
    zigzag = F.shiftleft(n.cast("bigint"), 1).bitwiseXOR(F.shiftright(n.cast("bigint"), 63))

    def groups(z: Column) -> Column:
        coded = None
        for size in range(1, GROUPS + 1):
            parts = [F.shiftright(z, 7 * k).bitwiseAND(F.lit(127)) + (128 if k + 1 < size else 0) for k in range(size)]
            fits, whole = z < F.lit(1 << 7 * size), F.concat(*map(_byte, parts))
            coded = F.when(fits, whole) if coded is None else coded.when(fits, whole)
        return coded

    return F.when(n.between(0, 63), _byte(n.cast("bigint") * 2)).otherwise(_let(zigzag, groups))


def encode(fields: StructType, column: Callable[[str], Column] = F.col) -> Column:
    """The record of the columns that ``fields`` names, strings and ints."""
    parts = []
    for field in fields:
        value = column(field.name)
        if isinstance(field.dataType, IntegerType):
            coded = number_bytes(value)
        else:
            text = value.cast("binary")
            coded = F.concat(number_bytes(F.octet_length(text)), text)
        some = F.concat(F.unhex(F.lit(_SOME)), coded)
        parts.append(F.when(value.isNull(), F.unhex(F.lit(_NULL))).otherwise(some))
    return F.concat(*parts)


def _byte_at(payload: Column, at: Column) -> Column:
    """A byte's number, null behind the end."""
    one = F.decode(F.substring(payload, at, F.lit(1)), BYTES)
    return F.when(at <= F.octet_length(payload), F.ascii(one).cast("bigint"))


def _packed(zigzag: Column, size: Column | int) -> Column:
    number = F.shiftrightunsigned(zigzag, 1).bitwiseXOR(-zigzag.bitwiseAND(F.lit(1)))
    return F.shiftleft(number, 3) + size


def _packed_number(payload: Column, at: Column) -> Column:
    """The number that begins at a byte, with its size in the three lowest bits, so that both are one
    column; null where the bytes end before it does or it does not fit 32 bits. Only one of several
    groups takes the longer way, which keeps the compiled code short."""

    def of_groups(v: Column) -> Column:
        size = F.array_position(F.transform(v, lambda b: b < 128), True)

        def value(n: Column) -> Column:
            groups = F.reverse(F.slice(v, 1, F.greatest(n, F.lit(1)).cast("int")))
            zigzag = F.aggregate(groups, F.lit(0).cast("bigint"), lambda z, b: z * 128 + b.bitwiseAND(F.lit(127)))
            return F.when(n > 0, _let(zigzag, lambda z: F.when(z < 1 << 32, _packed(z, n))))

        return _let(size, value)

    first = _byte_at(payload, at)
    bytes_ = F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda k: _byte_at(payload, at + k))
    return F.when(first < 128, _packed(first, 1)).when(first >= 128, _let(bytes_, of_groups))


def with_record(df: DataFrame, payload: Column, fields: StructType, name: str) -> DataFrame:
    """``df`` with a struct of the fields, null where the bytes are not exactly one such record.

    One step reads a number and the next the field behind it, each from the place that the one
    before has reached. The steps are generators of one row, as projections would be put into one
    another and into every filter above them, and grow with each field. Works on streams.
    """
    own = f"_{name}_"
    p = F.col(f"{own}payload")
    step = lambda steps, *columns: steps.select("*", F.inline(F.array(F.struct(*columns))))
    steps = df.select("*", payload.alias(f"{own}payload"), F.lit(1).alias(f"{own}at_0"))
    for k, field in enumerate(fields):
        at = F.col(f"{own}at_{k}")
        branch = F.hex(F.substring(p, at, 1))
        steps = step(steps, F.when(branch == _SOME, _packed_number(p, at + 1)).alias(f"{own}number_{k}"))
        number = F.col(f"{own}number_{k}")
        n, start = F.shiftright(number, 3).cast("int"), at + 1 + number.bitwiseAND(F.lit(7)).cast("int")
        if isinstance(field.dataType, IntegerType):
            value, after = n, start
        else:
            text = F.substring(p, start, n)
            whole = (n >= 0) & (n <= F.octet_length(p) + 1 - start) & F.is_valid_utf8(text.cast("string"))
            value, after = text.cast("string"), F.when(whole, start + n)
        steps = step(
            steps,
            F.when(branch == _SOME, value).alias(f"{own}value_{k}"),
            F.when(branch == _NULL, at + 1).when(number.isNotNull(), after).alias(f"{own}at_{k + 1}"),
        )
    values = F.struct(*(F.col(f"{own}value_{k}").alias(f.name) for k, f in enumerate(fields)))
    ends = F.col(f"{own}at_{len(fields)}") == F.octet_length(p) + 1
    return step(steps, F.when(ends, values).alias(name)).select(*(F.col(f"`{c}`") for c in df.columns), name)


def framed(payload: Column, schema_id: int) -> Column:
    """With a registry's header: a zero byte and the schema's number in four."""
    return F.concat(F.unhex(F.lit(f"00{schema_id:08x}")), payload)


def unframed(value: Column, schema_id: int | None = None) -> Column:
    """Without the header; null where there is none, or one of another schema than that named."""
    header = F.hex(F.substring(value, 1, 5))
    fits = F.length(header) == 10
    fits = fits & (header.startswith("00") if schema_id is None else header == f"00{schema_id:08X}")
    return F.when(fits, F.substring(value, 6, 2147483647))
