"""Reading: filter, sort, page and project; count and distinct."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import InvalidQuery
from larkspur.functions.compile import compile_filter, quoted, resolve
from larkspur.functions.filters import parse_filter


@dataclass
class FindOptions:
    """sort: (path, 1 or -1) pairs. columns: paths to keep, the primary key always; None keeps all."""

    sort: list[tuple[str, int]] = field(default_factory=list)
    skip: int = 0
    take: int | None = None
    columns: list[str] | None = None


def matching(df: DataFrame, filter: Mapping[str, Any] | None) -> DataFrame:  # noqa: A002
    return df.where(compile_filter(parse_filter(filter), df.schema)) if filter else df


def key_order(df: DataFrame, pk: str) -> list[Column]:
    """The order in which documents are stored: numbers by value, strings by length in bytes and then bytes."""
    column = F.col(quoted(pk))
    return [F.octet_length(column), column] if isinstance(df.schema[pk].dataType, T.StringType) else [column]


def sort_keys(df: DataFrame, sort: Iterable[tuple[str, int]]) -> list[Column]:
    """Sort columns, nulls and missing fields least; what has no order of its own (structs, arrays, bytes) doesn't sort."""
    keys = []
    for path, direction in sort:
        if direction not in (1, -1):
            raise InvalidQuery("a sort direction is 1 or -1")
        found = resolve(path, df.schema)
        if found and isinstance(found[1], T.AtomicType) and not isinstance(found[1], T.BinaryType):
            keys.append(found[0].asc_nulls_first() if direction > 0 else found[0].desc_nulls_last())
    return keys


def paged(df: DataFrame, skip: int, take: int | None) -> DataFrame:
    if skip < 0 or (take is not None and take < 0):
        raise InvalidQuery("skip and take aren't negative")
    df = df.offset(skip) if skip else df
    return df if take is None else df.limit(take)


def find(df: DataFrame, filter: Mapping[str, Any] | None = None, options: FindOptions | None = None, pk: str = "_id") -> DataFrame:  # noqa: A002
    """The documents that match, sorted, paged and projected in this order.

    Ties, and pages without a sort, follow the storage order, so that results are stable.
    """
    o = options or FindOptions()
    out = matching(df, filter)
    if o.sort or o.skip or o.take is not None:
        out = out.orderBy(*sort_keys(df, o.sort), *key_order(df, pk))
    return project(paged(out, o.skip, o.take), o.columns, pk)


def find_one(df: DataFrame, filter: Mapping[str, Any] | None = None, pk: str = "_id") -> DataFrame:  # noqa: A002
    return find(df, filter, FindOptions(take=1), pk)


def count(df: DataFrame, filter: Mapping[str, Any] | None = None) -> DataFrame:  # noqa: A002
    return matching(df, filter).agg(F.count(F.lit(1)).alias("count"))


def field_tree(paths: Iterable[str]) -> dict[str, Any]:
    """Paths as nested dictionaries; True keeps all below, and a shorter path wins over a longer one. `[]` is passed over."""
    tree: dict[str, Any] = {}
    for path in paths:
        at = tree
        names = [x for x in path.split(".") if x != "[]"]
        for name in names[:-1]:
            if at.get(name) is True:
                break
            at = at.setdefault(name, {})
        else:
            at[names[-1]] = True
    return tree


def project(df: DataFrame, columns: list[str] | None, pk: str = "_id") -> DataFrame:
    """df with the named paths and the primary key only, in the documents' own order of fields."""
    if columns is None:
        return df
    tree = field_tree([*columns, pk])
    return df.select(*(_trimmed(F.col(quoted(f.name)), f.dataType, tree[f.name], pk).alias(f.name) for f in df.schema.fields if f.name in tree))


def _trimmed(column: Column, kind: T.DataType, tree: Any, pk: str) -> Column:
    if tree is True:
        return column
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(column, lambda x: _trimmed(x, kind.elementType, tree, pk))
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if f.name in tree or f.name == pk]
        if not kept:
            return F.when(column.isNotNull(), F.struct())
        inner = F.struct(*(_trimmed(column.getField(f.name), f.dataType, tree.get(f.name, True), pk).alias(f.name) for f in kept))
        return F.when(column.isNotNull(), inner)
    return column


def distinct(df: DataFrame, path: str, filter: Mapping[str, Any] | None = None, sort: int | None = None, skip: int = 0, take: int | None = None, by: str | None = None) -> DataFrame:  # noqa: A002
    """value: the distinct non-null values at a path, through arrays; a leaf array counts by its elements.

    A missing field has none. sort is 1 or -1; pages without it follow ascending order where values have one. Values that are
    documents are sorted by the path by inside them, where that is missing first, and then as wholes.
    """
    rows = matching(df, filter)
    kind: T.DataType = df.schema
    out = rows
    first = True
    for name in [x for x in path.split(".") if x != "[]"]:
        while isinstance(kind, T.ArrayType):
            out, kind = out.select(F.explode("value").alias("value")), kind.elementType
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return df.sparkSession.createDataFrame([], T.StructType([T.StructField("value", T.StringType())]))
        out = out.select((F.col(quoted(name)) if first else F.col("value").getField(name)).alias("value"))
        kind, first = kind[name].dataType, False
    if isinstance(kind, T.ArrayType):
        out, kind = out.select(F.explode("value").alias("value")), kind.elementType
    out = out.where(F.col("value").isNotNull()).distinct()
    if (sort is not None or skip or take is not None) and not isinstance(kind, T.MapType):
        keys = sort_keys(out, [(f"value.{by}", sort or 1)]) if by else []
        out = out.orderBy(*keys, F.col("value").asc() if (sort or 1) > 0 else F.col("value").desc())
    return paged(out, skip, take)


def lookup(df: DataFrame, keys: DataFrame, pk: str = "_id") -> DataFrame:
    """The documents whose primary key is among those of keys; keys that no document has are passed over."""
    return df.join(keys.select(F.col(quoted(pk)).alias(pk)).distinct(), pk, "left_semi")


def merge_any(df: DataFrame, *filters: Mapping[str, Any]) -> DataFrame:
    """The documents that match any of the filters, once each, in one scan."""
    return df.where(compile_filter(parse_filter({"$or": list(filters)}), df.schema))


def merge_all(df: DataFrame, other: DataFrame, pk: str = "_id") -> DataFrame:
    """The documents of df that other has too, by primary key."""
    return lookup(df, other, pk)
