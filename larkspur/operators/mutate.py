"""Changing documents: update operators, replace, delete, insert, upsert and merge, as functions from DataFrame to DataFrame.

Rows keep their layout, so that an update is a projection. Where the operators would change a value's type row by row, the
column is widened: whole numbers to long by $inc, and to double by a float operand. A missing field and null are one: $unset
and $rename leave null.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import DuplicateKey, InvalidDocument, InvalidKey, InvalidQuery
from larkspur.functions.compile import compile_filter, negated, quoted
from larkspur.functions.filters import ObjectId, parse_filter
from larkspur.operators.find import key_order

_WIDTH = {T.ByteType: 0, T.ShortType: 1, T.IntegerType: 2, T.LongType: 3, T.FloatType: 4, T.DoubleType: 5}


@dataclass(frozen=True)
class Op:
    """One change: kind is set, unset, inc, rename, push, lpush or pop."""

    kind: str
    path: str
    value: Any = None


def parse_update(said: Mapping[str, Any], pk: str = "_id") -> list[Op]:
    """The changes in order; bare fields are set, and a bare primary key is passed over."""
    if not isinstance(said, Mapping):
        raise InvalidQuery("an update is a dictionary")
    ops: list[Op] = []
    for key, value in said.items():
        if key == pk:
            continue
        if not key.startswith("$"):
            ops.append(Op("set", key, value))
            continue
        kind = key[1:]
        if kind not in ("set", "unset", "inc", "rename", "push", "lpush", "pop"):
            raise InvalidQuery(f"no update operator {key}")
        if not isinstance(value, Mapping):
            raise InvalidQuery(f"{key} takes a dictionary of fields")
        for path, operand in value.items():
            if kind == "inc" and (isinstance(operand, bool) or not isinstance(operand, (int, float))):
                raise InvalidQuery("$inc takes numbers")
            if kind == "rename" and not (isinstance(operand, str) and operand):
                raise InvalidQuery("$rename takes the new name")
            ops.append(Op(kind, path, operand))
    if not ops:
        raise InvalidQuery("the update changes nothing")
    for op in ops:
        if pk in (op.path.split(".")[0], op.value if op.kind == "rename" and "." not in op.path else None):
            raise InvalidQuery(f"the primary key {pk} can't be changed")
    return ops


def type_of(value: Any) -> T.DataType:
    """The Spark type of a literal."""
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.IntegerType() if -(1 << 31) <= value < 1 << 31 else T.LongType()
    for python, kind in ((float, T.DoubleType), (str, T.StringType), (ObjectId, T.StringType), (dt.datetime, T.TimestampType), (bytes, T.BinaryType), (type(None), T.NullType)):
        if isinstance(value, python):
            return kind()
    if isinstance(value, Mapping):
        return T.StructType([T.StructField(str(k), type_of(v)) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return T.ArrayType(reduce(common_type, map(type_of, value), T.NullType()))
    raise InvalidDocument(f"a document can't hold a {type(value).__name__}")


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds values of both; numbers widen, structs unite."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if type(a) in _WIDTH and type(b) in _WIDTH:
        return T.DoubleType() if max(_WIDTH[type(a)], _WIDTH[type(b)]) >= 4 else max(a, b, key=lambda x: _WIDTH[type(x)])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = [*a.names, *(n for n in b.names if n not in a.names)]
        return T.StructType([T.StructField(n, common_type(a[n].dataType, b[n].dataType) if n in a.names and n in b.names else (a if n in a.names else b)[n].dataType) for n in names])
    if {type(a), type(b)} <= {T.TimestampType, T.TimestampNTZType}:
        return a
    raise InvalidDocument(f"{b.simpleString()} doesn't fit a field of {a.simpleString()}; keep such documents in the document layout")


def constant(value: Any, kind: T.DataType) -> Column:
    """A literal as a column of a type."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(value, ObjectId):
        return F.lit(value.hex).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*(constant(value.get(f.name), f.dataType).alias(f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return F.array(*(constant(v, kind.elementType) for v in value)).cast(kind)
    if isinstance(kind, T.TimestampNTZType) and isinstance(value, dt.datetime) and value.tzinfo:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(value).cast(kind)


def _convert(column: Column, have: T.DataType, want: T.DataType) -> Column:
    """column in a wider type; new fields of structs are null."""
    if have == want:
        return column
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        inner = F.struct(*((_convert(column.getField(f.name), have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields))
        return F.when(column.isNotNull(), inner)
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(column, lambda x: _convert(x, have.elementType, want.elementType))
    return column.cast(want)


class _Field:
    """A field's changed value beside its type, as the operators go over it."""

    def __init__(self, value: Column, kind: T.DataType) -> None:
        self.value, self.kind = value, kind


def _changed(op: Op, field: _Field | None) -> _Field:
    """The field after op; None is a field that no document has."""
    if op.kind == "set":
        kind = type_of(op.value) if field is None else common_type(field.kind, type_of(op.value))
        return _Field(constant(op.value, kind), kind)
    if op.kind == "unset":
        return _Field(F.lit(None).cast(field.kind if field else T.NullType()), field.kind if field else T.NullType())
    if op.kind == "inc":
        if field is None:
            kind = T.DoubleType() if isinstance(op.value, float) else T.LongType()
            return _Field(F.lit(op.value).cast(kind), kind)
        if type(field.kind) not in _WIDTH:
            raise InvalidDocument(f"$inc of {op.path}, which is {field.kind.simpleString()}")
        kind = T.DoubleType() if isinstance(op.value, float) or _WIDTH[type(field.kind)] >= 4 else T.LongType()
        return _Field(F.coalesce(field.value.cast(kind), F.lit(0).cast(kind)) + F.lit(op.value).cast(kind), kind)
    if field is not None and not isinstance(field.kind, T.ArrayType):
        raise InvalidDocument(f"${op.kind} of {op.path}, which is {field.kind.simpleString()}")
    if op.kind == "pop":
        if field is None:
            return _Field(F.lit(None), T.NullType())
        return _Field(F.slice(field.value, F.lit(1), F.greatest(F.size(field.value) - 1, F.lit(0))), field.kind)
    element = type_of(op.value) if field is None else common_type(field.kind.elementType, type_of(op.value))
    kind = T.ArrayType(element)
    old = F.array().cast(kind) if field is None else F.coalesce(_convert(field.value, field.kind, kind), F.array().cast(kind))
    add = F.array_append if op.kind == "push" else F.array_prepend
    return _Field(add(old, constant(op.value, element)), kind)


def _apply(op: Op, names: list[str], field: _Field | None) -> _Field:
    """The field after op at a path below it."""
    if not names:
        return _changed(op, field)
    if field is not None and not isinstance(field.kind, (T.StructType, T.NullType)):
        raise InvalidDocument(f"{op.path} goes through a {field.kind.simpleString()}")
    inner = field.kind if field is not None and isinstance(field.kind, T.StructType) else T.StructType([])
    fields = {f.name: _Field(field.value.getField(f.name), f.dataType) for f in inner.fields}
    if op.kind == "rename" and len(names) == 1:
        if names[0] not in fields:
            return field or _Field(F.lit(None), T.NullType())
        _rename(fields, names[0], op.value)
    else:
        after = _apply(op, names[1:], fields.get(names[0]))
        if isinstance(after.kind, T.NullType) and names[0] not in fields:
            return field or _Field(F.lit(None), T.NullType())
        fields[names[0]] = after
    kind = T.StructType([T.StructField(k, f.kind) for k, f in fields.items()])
    whole = F.struct(*(f.value.alias(k) for k, f in fields.items()))
    if op.kind in ("unset", "rename", "pop") and field is not None:
        whole = F.when(field.value.isNotNull(), whole)
    return _Field(whole, kind)


def _rename(fields: dict[str, _Field], old: str, new: str) -> None:
    """Move a field's value where it has one; the old field is null then."""
    source, target = fields[old], fields.get(new)
    kind = source.kind if target is None else common_type(target.kind, source.kind)
    moved = _convert(source.value, source.kind, kind)
    fields[new] = _Field(moved if target is None else F.coalesce(moved, _convert(target.value, target.kind, kind)), kind)
    fields[old] = _Field(F.lit(None).cast(source.kind), source.kind)


def apply_update(df: DataFrame, said: Mapping[str, Any], matched: Column, pk: str = "_id") -> tuple[DataFrame, Column]:
    """df with the update where matched holds, and whether a row of it differs (a condition over df)."""
    fields = {f.name: _Field(F.col(quoted(f.name)), f.dataType) for f in df.schema.fields}
    for op in parse_update(said, pk):
        names = op.path.split(".")
        if op.kind == "rename" and len(names) == 1:
            if names[0] in fields:
                _rename(fields, names[0], op.value)
            continue
        after = _apply(op, names[1:], fields.get(names[0]))
        if isinstance(after.kind, T.NullType) and names[0] not in fields:
            continue
        fields[names[0]] = after
    held = F.coalesce(matched, F.lit(False))
    differs = F.lit(False)
    out = []
    before = {f.name: f.dataType for f in df.schema.fields}
    for name, f in fields.items():
        if name not in before:
            out.append(F.when(held, f.value).alias(name))
            differs = differs | f.value.isNotNull()
            continue
        old = F.col(quoted(name))
        wide = _convert(old, before[name], f.kind)
        out.append(F.when(held, f.value).otherwise(wide).alias(name))
        differs = differs | ~f.value.eqNullSafe(wide)
    return df.select(*out), held & differs


def condition(df: DataFrame, filter: Mapping[str, Any]) -> Column:  # noqa: A002
    return compile_filter(parse_filter(filter, required=True), df.schema)


def first_match(df: DataFrame, filter: Mapping[str, Any], pk: str = "_id") -> DataFrame:  # noqa: A002
    """The primary key of the first matching document in storage order, as a table of one row or none."""
    return df.where(condition(df, filter)).orderBy(*key_order(df, pk)).limit(1).select(F.col(quoted(pk)).alias("__first"))


def _marked(df: DataFrame, filter: Mapping[str, Any], pk: str) -> DataFrame:  # noqa: A002
    """df with __hit: whether a row is the first match."""
    first = F.broadcast(first_match(df, filter, pk))
    return df.join(first, F.col(quoted(pk)) == F.col("__first"), "left").withColumn("__hit", F.col("__first").isNotNull()).drop("__first")


def update_many(df: DataFrame, filter: Mapping[str, Any], said: Mapping[str, Any], pk: str = "_id") -> DataFrame:  # noqa: A002
    return apply_update(df, said, condition(df, filter), pk)[0]


def update_one(df: DataFrame, filter: Mapping[str, Any], said: Mapping[str, Any], pk: str = "_id") -> DataFrame:  # noqa: A002
    marked = _marked(df, filter, pk)
    return apply_update(marked, said, F.col("__hit"), pk)[0].drop("__hit")


def documents(spark, rows: Sequence[Mapping[str, Any] | str] | DataFrame, pk: str = "_id", generate: bool = False) -> DataFrame:  # noqa: ANN001
    """Caller's documents as a DataFrame with the primary key first or where it stands; a missing key is generated if asked. Documents may be JSON texts."""
    if isinstance(rows, DataFrame):
        if pk not in rows.columns:
            if not generate:
                raise InvalidKey(f"the documents have no {pk}")
            rows = rows.withColumn(pk, F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 24))
        return rows
    rows = [dict(json.loads(r) if isinstance(r, (str, bytes)) else r) for r in rows]
    for r in rows:
        if r.get(pk) is None:
            if not generate:
                raise InvalidKey(f"a document has no {pk}")
            r[pk] = uuid.uuid4().hex[:24]
        if isinstance(r[pk], (Mapping, list, tuple)):
            raise InvalidKey(f"{pk} can't be a {type(r[pk]).__name__}")
    kind = reduce(common_type, (type_of(r) for r in rows), T.StructType([]))
    plain = lambda v: v.hex if isinstance(v, ObjectId) else {k: plain(x) for k, x in v.items()} if isinstance(v, Mapping) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    def fitted(v: Any, k: T.DataType) -> Any:
        if v is None:
            return None
        if isinstance(k, T.StructType):
            return tuple(fitted(v.get(f.name), f.dataType) for f in k.fields)
        if isinstance(k, T.ArrayType):
            return [fitted(x, k.elementType) for x in v]
        return float(v) if isinstance(k, T.DoubleType) else v

    kind = _without_nulls(kind)
    return spark.createDataFrame([fitted(plain(r), kind) for r in rows], kind)


def _without_nulls(kind: T.DataType) -> T.DataType:
    """kind with strings where only nulls were seen."""
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _without_nulls(f.dataType)) for f in kind.fields])
    return T.ArrayType(_without_nulls(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def aligned(df: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with all fields of either, in df's order and then other's, in types that hold both."""
    kind = common_type(df.schema, other.schema)
    cast = lambda x: x.select(*((_convert(F.col(quoted(f.name)), x.schema[f.name].dataType, f.dataType) if f.name in x.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields))
    return cast(df), cast(other)


def replace_one(df: DataFrame, filter: Mapping[str, Any], replacement: Mapping[str, Any], pk: str = "_id") -> DataFrame:  # noqa: A002
    """The first match keeps its primary key; all else of it is the replacement's."""
    new = {k: v for k, v in replacement.items() if k != pk}
    marked = _marked(df, filter, pk)
    if new:
        marked = update_schema(marked, _without_nulls(type_of(new)))
    out = []
    for f in marked.schema.fields:
        column = F.col(quoted(f.name))
        out.append(column if f.name in (pk, "__hit") else F.when(F.col("__hit"), constant(new.get(f.name), f.dataType)).otherwise(column).alias(f.name))
    return marked.select(*out).drop("__hit")


def update_schema(df: DataFrame, kind: T.StructType) -> DataFrame:
    """df with its fields widened to hold kind's too."""
    whole = common_type(df.schema, kind)
    return df.select(*((_convert(F.col(quoted(f.name)), df.schema[f.name].dataType, f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in whole.fields))


def delete_many(df: DataFrame, filter: Mapping[str, Any]) -> DataFrame:  # noqa: A002
    return df.where(negated(condition(df, filter)))


def delete_one(df: DataFrame, filter: Mapping[str, Any], pk: str = "_id") -> DataFrame:  # noqa: A002
    return df.join(F.broadcast(first_match(df, filter, pk)), F.col(quoted(pk)) == F.col("__first"), "left_anti")


def check_new(df: DataFrame, new: DataFrame, pk: str = "_id") -> None:
    """DuplicateKey if a primary key of new is null, twice in new, or in df. An action."""
    keys = new.groupBy(F.col(quoted(pk)).alias("k")).agg(F.count("*").alias("c"))
    here = df.select(F.col(quoted(pk)).alias("k"))
    bad = keys.where("c > 1 OR k IS NULL").select("k").unionByName(keys.select("k").join(here, "k", "left_semi")).limit(1).collect()
    if bad:
        raise DuplicateKey(f"{pk} {bad[0]['k']!r}")


def insert_many(df: DataFrame, new: DataFrame, pk: str = "_id") -> DataFrame:
    """df and new; DuplicateKey if a primary key of new is null, twice in new, or in df. The check is an action."""
    check_new(df, new, pk)
    a, b = aligned(df, new)
    return a.unionByName(b)


def last_of_each(new: DataFrame, pk: str, order: str | None = None) -> DataFrame:
    """The last row of each primary key by the column order, which goes; without it a key that stands twice is a DuplicateKey (an action)."""
    if order is None:
        twice = new.groupBy(F.col(quoted(pk)).alias("k")).agg(F.count("*").alias("c")).where("c > 1").limit(1).collect()
        if twice:
            raise DuplicateKey(f"{pk} {twice[0]['k']!r} stands twice in the batch, and no column says which row is the last")
        return new
    last = Window.partitionBy(quoted(pk)).orderBy(F.col(quoted(order)).desc())
    return new.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", order)


def upsert_many(df: DataFrame, new: DataFrame, pk: str = "_id", order: str | None = None) -> DataFrame:
    """Documents of new replace those of their primary key whole, or are added; of several in new the last by order counts."""
    a, b = aligned(df, last_of_each(new, pk, order))
    return a.join(b.select(F.col(quoted(pk)).alias("__k")), F.col(quoted(pk)) == F.col("__k"), "left_anti").unionByName(b)


def merge_many(df: DataFrame, new: DataFrame, pk: str = "_id", order: str | None = None) -> DataFrame:
    """The fields that new has overwrite those of documents of the same primary key; the others are added.

    new's columns are the fields it has; several rows of a key are folded by order, each over the one before.
    """
    names = [c for c in new.columns if c not in (pk, order)]
    if order is not None:
        new = new.groupBy(F.col(quoted(pk)).alias(pk)).agg(*(F.max_by(F.col(quoted(c)), F.col(quoted(order))).alias(c) for c in names))
    else:
        new = last_of_each(new, pk)
    a, b = aligned(df, new)
    b = b.select(*(F.col(quoted(c)).alias(f"__b_{c}") for c in a.columns))
    joined = a.join(b, F.col(quoted(pk)) == F.col(quoted(f"__b_{pk}")), "full_outer")
    new_row = F.col(quoted(f"__b_{pk}")).isNotNull()
    out = [F.coalesce(F.col(quoted(pk)), F.col(quoted(f"__b_{pk}"))).alias(pk) if c == pk else F.when(new_row, F.col(quoted(f"__b_{c}"))).otherwise(F.col(quoted(c))).alias(c) if c in names else F.col(quoted(c)) for c in a.columns]
    return joined.select(*out)


def affected(df: DataFrame, filter: Mapping[str, Any], said: Mapping[str, Any], pk: str = "_id") -> DataFrame:  # noqa: A002
    """matched and modified: how many rows an update_many meets, and how many it changes."""
    matched = condition(df, filter)
    changes = apply_update(df, said, matched, pk)[1]
    return df.agg(F.count(F.when(matched, 1)).alias("matched"), F.count(F.when(changes, 1)).alias("modified"))
