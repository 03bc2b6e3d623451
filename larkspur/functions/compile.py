"""Expressions to native Column predicates, by the static types of a schema.

Literals are brought to the stored type when the plan is made, so that predicates on plain columns stay plain and reach the
scan. A missing field and null are one. Comparisons of null are null, which a filter drops; negated() makes them false first.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.filters import All, Any_, Compare, Exists, Expression, Matches, ObjectId, java_pattern

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType)
_TIME = (T.TimestampType, T.TimestampNTZType)
_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_EXACT = 1 << 53


def compile_filter(expression: Expression, schema: T.StructType) -> Column:
    """The predicate of an expression over rows of a schema."""
    if isinstance(expression, All):
        return reduce(and_, (compile_filter(x, schema) for x in expression.parts), F.lit(True)) if len(expression.parts) != 1 else compile_filter(expression.parts[0], schema)
    if isinstance(expression, Any_):
        return reduce(or_, (compile_filter(x, schema) for x in expression.parts))
    found = resolve(expression.path, schema)
    if isinstance(expression, Exists):
        if found is None:
            return F.lit(not expression.there)
        return found[0].isNotNull() if expression.there else found[0].isNull()
    if isinstance(expression, Matches):
        if found is None or not isinstance(found[1], T.StringType):
            return F.lit(False)
        return found[0].rlike(java_pattern(expression.pattern, expression.flags))
    return _compare(expression, found)


def negated(condition: Column) -> Column:
    """True where the condition isn't, null included."""
    return ~F.coalesce(condition, F.lit(False))


def resolve(path: str, schema: T.StructType) -> tuple[Column, T.DataType] | None:
    """The column at a dotted path and its type; None if a schema has none. Arrays aren't gone through."""
    at: T.DataType = schema
    column: Column | None = None
    for name in path.split("."):
        if not isinstance(at, T.StructType) or name not in at.names:
            return None
        column = F.col(quoted(name)) if column is None else column.getField(name)
        at = at[name].dataType
    return column, at


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _compare(c: Compare, found: tuple[Column, T.DataType] | None) -> Column:
    if c.value is None:
        if c.op != "eq":
            return F.lit(False)
        return F.lit(True) if found is None else found[0].isNull()
    if found is None:
        return F.lit(False)
    column, kind = found
    if isinstance(kind, T.ArrayType):
        element = kind.elementType
        if isinstance(element, T.ArrayType):
            return F.lit(False)
        return F.exists(column, lambda x: F.coalesce(compare_value(c.op, x, element, c.value), F.lit(False)))
    return compare_value(c.op, column, kind, c.value)


def compare_value(op: str, column: Column, kind: T.DataType, value: Any) -> Column:
    """column op value, with value brought to the column's type; false where it can't be."""
    if isinstance(value, (dict, list, ObjectId)):
        return F.lit(False)
    if isinstance(kind, _WHOLE):
        return _whole(op, column, value)
    if isinstance(kind, _REAL):
        return _real(op, column, value)
    if isinstance(kind, T.StringType):
        return _plain(op, column, F.lit(value)) if isinstance(value, str) else F.lit(False)
    if isinstance(kind, T.BooleanType):
        if isinstance(value, str):
            value = {"true": True, "false": False}.get(value)
        return column == F.lit(value) if op == "eq" and isinstance(value, bool) else F.lit(False)
    if isinstance(kind, _TIME):
        at = instant(value)
        if at is None:
            return F.lit(False)
        return _plain(op, column, F.lit(at.replace(tzinfo=None) if isinstance(kind, T.TimestampNTZType) else at).cast(kind))
    return F.lit(False)


def _plain(op: str, a: Column, b: Column) -> Column:
    return {"eq": a == b, "gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]


def _whole(op: str, column: Column, value: Any) -> Column:
    """Whole numbers: a float literal is turned into the whole bound that means the same."""
    if isinstance(value, bool) or isinstance(value, dt.datetime):
        return F.lit(False)
    if isinstance(value, str):
        if not re.fullmatch(r"[+-]?[0-9]+", value) or not -(1 << 63) <= int(value) < 1 << 63:
            return F.lit(False)
        value = int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return column.isNotNull() if op in ("gte", "lte") else F.lit(False)
        if abs(value) >= _EXACT:
            return _plain(op, column.cast("double"), F.lit(value))
        if not value.is_integer():
            if op == "eq":
                return F.lit(False)
            return column > math.floor(value) if op in ("gt", "gte") else column < math.ceil(value)
        value = int(value)
    return _plain(op, column, F.lit(value).cast("long") if abs(value) >= 1 << 31 else F.lit(value))


def _real(op: str, column: Column, value: Any) -> Column:
    """Floats: nothing equals a NaN, but it is neither less nor greater than anything."""
    if isinstance(value, bool) or isinstance(value, dt.datetime):
        return F.lit(False)
    if isinstance(value, str):
        if not re.fullmatch(rf"{_NUMBER}|[+-]?(?:inf|infinity|nan)", value, re.I):
            return F.lit(False)
        value = float(value)
    value = float(value)
    if math.isnan(value):
        return column.isNotNull() if op in ("gte", "lte") else F.lit(False)
    bound = F.lit(value)
    if op == "gt":
        return (column > bound) & ~F.isnan(column)
    if op == "lte":
        return (column <= bound) | F.isnan(column)
    return _plain(op, column, bound)


def instant(value: Any) -> dt.datetime | None:
    """The time a literal means: a time, whole seconds since 1970, or an RFC 3339 string with its offset."""
    if isinstance(value, dt.datetime):
        return value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
    if isinstance(value, int) and not isinstance(value, bool):
        try:
            return dt.datetime.fromtimestamp(value, dt.timezone.utc)
        except (OverflowError, OSError, ValueError):
            return None
    if isinstance(value, str) and re.fullmatch(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)", value):
        try:
            return dt.datetime.fromisoformat(value.upper()).astimezone(dt.timezone.utc)
        except ValueError:
            return None
    return None
