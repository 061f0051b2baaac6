"""Entry and file ids: arithmetic, widths, byte forms and the directory form of file ids.

Ids are BIGINT; sums that may pass 2^63 go through DECIMAL(38, 0), and `wide_key` orders ids of any width as BINARY.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The byte widths that an id or size field may have.
WIDTHS = (1, 2, 4, 8, 16)


def increment(a: Column) -> Column:
    return a + 1


def decrement(a: Column) -> Column:
    """Null at zero, where there is no smaller id."""
    return F.when(a > 0, a - 1)


def add(a: Column, b: Column) -> Column:
    return a + b


def add_wide(a: Column, b: Column) -> Column:
    return a.cast("decimal(38,0)") + b.cast("decimal(38,0)")


def subtract(a: Column, b: Column) -> Column:
    """Null where the result would be negative."""
    return F.when(a >= b, a - b)


def remainder(a: Column, b: Column) -> Column:
    """Null for a zero divisor."""
    return F.when(b != 0, a % b)


def middle(a: Column, b: Column) -> Column:
    """floor((a + b) / 2) without passing 2^63."""
    return F.shiftright(a, 1) + F.shiftright(b, 1) + (a.bitwiseAND(F.lit(1)) + b.bitwiseAND(F.lit(1)) >= 2).cast("bigint")


def in_step(entry: Column, start: Column, step: Column) -> Column:
    """Whether an id lies on the grid of `step` from `start`; ids before start never do."""
    return (entry >= start) & ((entry - start) % F.greatest(step, F.lit(1)) == 0)


#: 2^64, where numbers stop to fit eight bytes.
_TOP = "18446744073709551616"


def width(value: Column) -> Column:
    """Bytes of the smallest unsigned integer that holds the value, BIGINT or DECIMAL(38, 0)."""
    wide = value.cast("decimal(38,0)")
    return F.when(wide < 1 << 8, 1).when(wide < 1 << 16, 2).when(wide < 1 << 32, 4).when(wide < F.lit(_TOP).cast("decimal(38,0)"), 8).otherwise(16)


def can_fit(value: Column, size: int) -> Column:
    return width(value) <= size


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by value, whatever the types of the two ids."""
    x, y = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def wide_hex(value: Column) -> Column:
    """32 hex digits of a BIGINT or DECIMAL(38, 0)."""
    wide, top = value.cast("decimal(38,0)"), F.lit(_TOP).cast("decimal(38,0)")
    # the remainder is exact; a quotient would be rounded
    low = wide % top
    high = (wide - low) / top
    digits = lambda x: F.lpad(F.conv(x.cast("decimal(20,0)").cast("string"), 10, 16), 16, "0")
    return F.concat(digits(high), digits(low))


def is_width(size: Column) -> Column:
    return size.isin(*WIDTHS)


def narrowed(value: Column) -> Column:
    """The id as BIGINT, null if it doesn't fit. A cast that fails raises and catches an error for each row, some 25 times as slow as
    one that doesn't, so plain numbers are compared with the bounds first."""
    digits = value.cast("string")
    plain = digits.rlike("^[+-]?[0-9]{1,38}$")
    within = F.when(plain, digits).cast("decimal(38,0)").between(F.lit(-(1 << 63)), F.lit((1 << 63) - 1))
    return F.when(~(plain & ~within), value.try_cast("bigint"))


def to_little_endian(value: Column, size: int) -> Column:
    """`size` bytes, 1 to 16, least significant first."""
    return _flipped(F.unhex(F.right(wide_hex(value), F.lit(2 * size))), size)


def _flipped(raw: Column, size: int) -> Column:
    return F.concat(*[F.substring(raw, i, 1) for i in range(size, 0, -1)])


def from_little_endian(raw: Column, size: int) -> Column:
    """The id as BIGINT; null if it doesn't fit."""
    return narrowed(from_little_endian_wide(raw, size))


def from_little_endian_wide(raw: Column, size: int) -> Column:
    """The id as DECIMAL(38, 0); null if it has more digits."""
    digits = F.lpad(F.hex(_flipped(raw, size)), 32, "0")
    part = lambda at: F.conv(F.substring(digits, at, 16), 16, 10).cast("decimal(38,0)")
    return F.try_add(F.try_multiply(part(1), F.lit(_TOP).cast("decimal(20,0)")).cast("decimal(38,0)"), part(17)).cast("decimal(38,0)")


def wide_key(value: Column) -> Column:
    """A binary key whose byte order is the order of the ids: a length byte, then the bytes, most significant first."""
    # a BIGINT has its digits at once; only ids beyond take decimal arithmetic
    wide = value.cast("decimal(38,0)")
    narrow = wide.between(F.lit(0), F.lit((1 << 63) - 1))
    few = F.hex(F.when(narrow, wide).cast("bigint"))
    even = F.concat(F.when(F.length(few) % 2 == 1, "0").otherwise(""), few)
    digits = F.when(narrow, even).otherwise(F.regexp_replace(wide_hex(value), "^(?:00){0,15}", ""))
    return F.unhex(F.concat(F.lpad(F.hex((F.length(digits) / 2).cast("int")), 2, "0"), digits))


def file_path(file_id: Column, extension: str) -> Column:
    """Lower-case hex, padded to a multiple of three digits, three to a directory."""
    digits = F.lower(F.hex(file_id))
    padded = F.lpad(digits, F.ceil(F.length(digits) / 3).cast("int") * 3, F.lit("0"))
    return F.concat(F.regexp_replace(padded, "(.{3})(?=.)", "$1/"), F.lit(extension))


def path_to_id(path: Column) -> Column:
    """The id of a path as file_path writes it; null for any other name."""
    stem = F.regexp_extract(path, r"^((?:[0-9a-f]{3}/)*[0-9a-f]{3})(?:\.[a-z]+)?$", 1)
    return F.when(stem != "", F.conv(F.regexp_replace(stem, "/", ""), 16, 10).cast("bigint"))
