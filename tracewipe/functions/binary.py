"""Bit-level reading of binary columns, as Spark expressions (positions count from 0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(b: Column, at: int | Column, n: int) -> Column:
    """``n`` bytes, or null where they are not all there."""
    start = F.lit(at) if isinstance(at, int) else at
    return F.when((start >= 0) & (start + n <= F.length(b)), F.substring(b, (start + 1).cast("int"), F.lit(n)))


def big_endian(b: Column, at: int | Column, n: int) -> Column:
    """An unsigned integer of at most 7 bytes as a long, null where it is not whole."""
    return F.conv(F.hex(part(b, at, n)), 16, 10).cast("long")


def little_endian(b: Column, at: int | Column, n: int) -> Column:
    start = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.concat(*[part(b, start + i, 1) for i in range(n - 1, -1, -1)])), 16, 10).cast("long")


def contains_ascii(b: Column, needle: str) -> Column:
    """Whether the bytes hold an ASCII string, letter case aside."""
    return F.contains(F.lower(F.make_valid_utf8(b.cast("string"))), F.lit(needle.lower()))


def crc32(b: Column) -> Column:
    return F.crc32(b)


def all_zero(b: Column) -> Column:
    return F.regexp_replace(F.hex(b), "0", "") == ""
