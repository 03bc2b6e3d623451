"""The document layout: a primary key beside one VARIANT column, for documents whose fields differ in kind.

Filters are compiled to typed extractions behind guards of the stored kind, so that a string is never taken for a number.
Here a missing field and an explicit null differ: $exists is exact.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.compile import compare_value
from larkspur.functions.filters import All, Any_, Compare, Exists, Expression, Matches, java_pattern, parse_filter
from pyspark.sql import types as T

#: Stored kinds as schema_of_variant names them, and what they are compared as.
_KINDS = (("BIGINT", "bigint", T.LongType()), ("DOUBLE", "double", T.DoubleType()), ("DECIMAL", "double", T.DoubleType()), ("STRING", "string", T.StringType()), ("BOOLEAN", "boolean", T.BooleanType()), ("TIMESTAMP", "timestamp", T.TimestampType()))


def document_column(df: DataFrame) -> Column:
    """All columns of df as one VARIANT object."""
    return F.to_variant_object(F.struct(*df.columns))


def _path(path: str) -> str:
    return "$" + "".join(f"['{name}']" for name in path.replace("'", "\\'").split("."))


def compile_document(e: Expression, doc: str = "doc") -> Column:
    """The predicate of an expression over a VARIANT column."""
    if isinstance(e, All):
        return reduce(and_, (compile_document(x, doc) for x in e.parts), F.lit(True))
    if isinstance(e, Any_):
        return reduce(or_, (compile_document(x, doc) for x in e.parts))
    at = F.variant_get(F.col(doc), _path(e.path), "variant")
    if isinstance(e, Exists):
        return at.isNotNull() if e.there else at.isNull()
    if isinstance(e, Matches):
        said = F.schema_of_variant(at).startswith("STRING")
        return said & F.try_variant_get(F.col(doc), _path(e.path), "string").rlike(java_pattern(e.pattern, e.flags))
    if e.value is None:
        return (at.isNull() | F.is_variant_null(at)) if e.op == "eq" else F.lit(False)
    return _kinds(e, at) | _elements(e, at)


def _kinds(e: Compare, at: Column) -> Column:
    kind = F.schema_of_variant(at)
    checks = [kind.startswith(name) & F.coalesce(compare_value(e.op, F.try_variant_get(at, "$", spark), typed, e.value), F.lit(False)) for name, spark, typed in _KINDS]
    return F.coalesce(reduce(or_, checks), F.lit(False))


def _elements(e: Compare, at: Column) -> Column:
    items = F.try_variant_get(at, "$", "array<variant>")
    return F.coalesce(F.exists(items, lambda x: _kinds(e, x)), F.lit(False))


def find_documents(df: DataFrame, filter: Mapping[str, Any] | None, doc: str = "doc", pk: str = "_id") -> DataFrame:  # noqa: A002
    """The rows whose document matches."""
    return df.where(compile_document(parse_filter(filter), doc))


def distinct_documents(df: DataFrame, path: str, doc: str = "doc") -> DataFrame:
    """kind and value (as JSON): the distinct values at a path; equal numbers of different kinds are different."""
    at = F.variant_get(F.col(doc), _path(path), "variant")
    rows = df.select(F.explode(F.coalesce(F.try_variant_get(at, "$", "array<variant>"), F.array(at))).alias("v")).where(F.col("v").isNotNull() & ~F.is_variant_null("v"))
    return rows.select(F.schema_of_variant("v").alias("kind"), F.to_json("v").alias("value")).distinct()


def sort_documents(df: DataFrame, path: str, direction: int = 1, doc: str = "doc", pk: str = "_id") -> DataFrame:
    """Sorted by the value at a path: missing and null first, then numbers, strings, booleans, times; reversed by -1."""
    at = F.variant_get(F.col(doc), _path(path), "variant")
    kind = F.schema_of_variant(at)
    rank = F.when(at.isNull() | F.is_variant_null(at), 0).when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), 1).when(kind == "STRING", 2).when(kind == "BOOLEAN", 3).when(kind.startswith("TIMESTAMP"), 4).otherwise(5)
    keys = [rank, F.when(rank == 1, F.try_variant_get(at, "$", "double")), F.when(rank == 2, F.try_variant_get(at, "$", "string")), F.when(rank == 3, F.try_variant_get(at, "$", "boolean")), F.when(rank == 4, F.try_variant_get(at, "$", "timestamp"))]
    return df.orderBy(*(k.asc() if direction > 0 else k.desc() for k in keys), pk)


def as_epoch(value: dt.datetime) -> int:
    """A time as whole milliseconds since 1970."""
    return int(value.timestamp() * 1000)
