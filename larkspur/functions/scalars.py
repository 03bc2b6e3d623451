"""Scalar functions over columns: literals of document types, tests of a value's kind, and arithmetic that widens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.compile import instant

__all__ = ["add", "append", "binary", "datetime", "drop_last", "hex_of", "i32", "instant", "is_datetime", "is_objectid", "length_of", "millis", "now", "objectid", "prepend"]


def datetime(ms: Column) -> Column:
    """The time that is ms milliseconds after 1970."""
    return F.timestamp_millis(ms)


def millis(at: Column) -> Column:
    """A time as milliseconds since 1970."""
    return F.unix_millis(at)


def now() -> Column:
    return F.current_timestamp()


def objectid(hex: Column) -> Column:  # noqa: A002
    """24 hexadecimal digits as 12 bytes; null for anything else."""
    return F.when(hex.rlike(r"\A[0-9a-fA-F]{24}\z"), F.unhex(hex))


def hex_of(value: Column) -> Column:
    """Bytes as hexadecimal digits in lower case."""
    return F.lower(F.hex(value))


def binary(text: Column) -> Column:
    return text.cast("binary")


def length_of(value: Column) -> Column:
    """The number of bytes."""
    return F.octet_length(value)


def i32(value: Column) -> Column:
    """The value as a 32-bit integer; null if it doesn't fit."""
    return value.try_cast("int")


def is_datetime(value: Column) -> Column:
    return F.typeof(value).startswith("timestamp")


def is_objectid(value: Column) -> Column:
    """Whether a value is 12 bytes."""
    return (F.typeof(value) == "binary") & (F.octet_length(value.cast("binary")) == 12)


def add(a: Column, b: Column) -> Column:
    """The sum as a long, or as a double where a long would overflow."""
    return F.coalesce(F.try_add(a.cast("long"), b.cast("long")).cast("double"), a.cast("double") + b.cast("double"))


def append(items: Column, value: Column) -> Column:
    return F.array_append(items, value)


def prepend(items: Column, value: Column) -> Column:
    return F.array_prepend(items, value)


def drop_last(items: Column) -> Column:
    """The items but the last; empty stays empty."""
    return F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0)))
