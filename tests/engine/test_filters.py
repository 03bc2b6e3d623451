import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import InvalidQuery
from larkspur.functions.compile import compile_filter, negated
from larkspur.functions.filters import All, Any_, Compare, Exists, Matches, ObjectId, parse_filter

OID = ObjectId("0123456789abcdef01234567")


def test_parse_shapes():
    assert parse_filter({}) == parse_filter(None) == All(())
    assert parse_filter({"a": 1}) == Compare("eq", "a", 1)
    assert parse_filter({"a": {"$gt": 1, "$lte": 5}}) == All((Compare("gt", "a", 1), Compare("lte", "a", 5)))
    assert parse_filter({"a": 1, "b.c": None}) == All((Compare("eq", "a", 1), Compare("eq", "b.c", None)))
    assert parse_filter({"$or": [{"a": 1}, {"$and": [{"b": 2}]}]}) == Any_((Compare("eq", "a", 1), All((Compare("eq", "b", 2),))))
    assert parse_filter({"a": {"b": 1}}) == Compare("eq", "a", {"b": 1})
    assert parse_filter({"a": {}}) == Compare("eq", "a", {})
    assert parse_filter({"a": {"$regex": "^x", "$options": "i"}}) == Matches("a", "^x", "i")
    assert parse_filter({"a": {"$exists": False}}) == Exists("a", False)
    assert parse_filter({"a": [1, "x", OID]}).value == [1, "x", OID]


@pytest.mark.parametrize(
    "said",
    [
        {"$nor": []}, {"$not": {}}, {"$or": {}}, {"$or": []}, {"$or": [1]}, {"$and": [{}]}, {"a": {"$ne": 1}}, {"a": {"$in": [1]}}, {"a": {"$size": 1}},
        {"a": {"$exists": 1}}, {"a": {"$options": "i"}}, {"a": {"$regex": "x", "$gt": 1}}, {"a": {"$regex": 1}}, {"a": {"$regex": "x", "$options": 1}},
        {"a": {"$regex": "x", "$options": "q"}}, {"a": {"$regex": "("}}, {"a": {"$regex": "(?=x)"}}, {"a": {"$regex": r"(a)\1"}}, {"a": b"raw"}, {"a": 1 << 63}, [], "x",
    ],
)
def test_parse_errors(said):
    with pytest.raises(InvalidQuery):
        parse_filter(said)


def test_empty_filter_where_one_is_required():
    with pytest.raises(InvalidQuery):
        parse_filter({}, required=True)


SCHEMA = T.StructType(
    [
        T.StructField("i", T.IntegerType()), T.StructField("l", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("b", T.BooleanType()),
        T.StructField("t", T.TimestampType()), T.StructField("n", T.TimestampNTZType()), T.StructField("st", T.StructType([T.StructField("x", T.IntegerType())])),
        T.StructField("ai", T.ArrayType(T.IntegerType())), T.StructField("aa", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("bin", T.BinaryType()),
    ]
)
AT = dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc)
ROW = (42, 42, 4.5, "42", True, AT, AT.replace(tzinfo=None), (7,), [1, 9], [[1]], b"x")
SECONDS = int(AT.timestamp())

CELLS = [
    # stored whole numbers
    ({"i": 42}, True), ({"i": 42.0}, True), ({"i": 42.5}, False), ({"i": "42"}, True), ({"i": "+42"}, True), ({"i": " 42"}, False), ({"i": "4.2e1"}, False), ({"i": "42.0"}, False),
    ({"i": True}, False), ({"i": AT}, False), ({"i": OID}, False), ({"i": {"x": 1}}, False), ({"i": [42]}, False), ({"l": {"$gt": 41.5}}, True), ({"l": {"$lt": 42.5}}, True), ({"l": {"$gte": 42.5}}, False),
    ({"l": {"$lt": 1e300}}, True), ({"i": {"$gte": math.nan}}, True), ({"i": math.nan}, False), ({"i": {"$gt": math.nan}}, False), ({"l": {"$gt": "x"}}, False), ({"i": {"$gt": None}}, False),
    # stored floats
    ({"d": 4.5}, True), ({"d": 4}, False), ({"d": {"$gt": 4}}, True), ({"d": "4.5"}, True), ({"d": "4.5 "}, False), ({"d": {"$lt": "inf"}}, True), ({"d": {"$gt": True}}, False), ({"d": "1_0"}, False),
    # stored strings
    ({"s": "42"}, True), ({"s": 42}, False), ({"s": {"$gt": "41"}}, True), ({"s": {"$lt": "5"}}, True), ({"s": True}, False),
    # stored booleans
    ({"b": True}, True), ({"b": "true"}, True), ({"b": "True"}, False), ({"b": 1}, False), ({"b": {"$gte": True}}, False), ({"b": False}, False),
    # stored times
    ({"t": AT}, True), ({"t": SECONDS}, True), ({"t": float(SECONDS)}, False), ({"t": "2024-01-02T03:04:05Z"}, True), ({"t": "2024-01-02T05:04:05+02:00"}, True), ({"t": "2024-01-02T03:04:05"}, False),
    ({"t": {"$lt": SECONDS + 1}}, True), ({"n": AT}, True), ({"n": SECONDS}, True), ({"n": {"$gt": "2024-01-02T03:04:04Z"}}, True), ({"t": True}, False),
    # documents, arrays, bytes
    ({"st": {"x": 7}}, False), ({"st.x": 7}, True), ({"st.y": None}, True), ({"st.x.y": 1}, False), ({"ai": 9}, True), ({"ai": 5}, False), ({"ai": [1, 9]}, False), ({"ai": {"$gt": 5, "$lt": 3}}, True),
    ({"aa": 1}, False), ({"ai.x": 1}, False), ({"bin": "x"}, False), ({"bin": None}, False), ({"none": None}, True), ({"none": {"$exists": False}}, True), ({"st": {"$exists": True}}, True),
]


def test_coercion_matrix(spark):
    df = spark.createDataFrame([ROW], SCHEMA)
    got = df.select(*(F.coalesce(compile_filter(parse_filter(f), SCHEMA), F.lit(False)).alias(f"c{k}") for k, (f, _) in enumerate(CELLS))).first()
    wrong = [(f, want) for (f, want), have in zip(CELLS, got, strict=True) if have != want]
    assert not wrong


def test_nulls_and_nan(spark):
    df = spark.createDataFrame([(1, None, math.nan), (2, 0, 0.0), (3, 5, -0.0)], "k int, i int, d double")
    keys = lambda f: sorted(r.k for r in df.where(compile_filter(parse_filter(f), df.schema)).collect())
    assert keys({"i": None}) == [1] and keys({"i": {"$lt": 9}}) == [2, 3] and keys({"d": 0}) == [2, 3]
    assert keys({"d": {"$gt": 1e300}}) == [] and keys({"d": {"$gte": 5}}) == [1] and keys({"d": {"$lte": -1}}) == [1]
    rest = df.where(negated(compile_filter(parse_filter({"i": {"$gt": 1}}), df.schema)))
    assert sorted(r.k for r in rest.collect()) == [1, 2]


def test_regex_dialect(spark):
    df = spark.createDataFrame([(1, "abc\n"), (2, "É"), (3, "٣"), (4, "a.b"), (5, "x\ny")], "k int, s string")
    keys = lambda p, o="": sorted(r.k for r in df.where(compile_filter(parse_filter({"s": {"$regex": p, "$options": o}}), df.schema)).collect())
    assert keys("c$") == [] and keys("c$", "m") == [1] and keys("é", "i") == [2] and keys(r"^\d$") == [3] and keys("[.$]b$") == [4]
    assert keys("x.y") == [] and keys("x.y", "s") == [5] and keys(r"a\.b") == [4] and keys("a b", "x") == [1]


def test_predicates_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    f = {"o_orderstatus": "F", "o_totalprice": {"$gte": 1000}, "o_custkey": {"$lt": 50.5}}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = df.where(compile_filter(parse_filter(f), df.schema)).select("o_orderkey")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all(x in plan for x in ("EqualTo(o_orderstatus,F)", "GreaterThanOrEqual(o_totalprice,1000.0)", "LessThan(o_custkey,51)")), plan
    assert "o_orderdate" not in plan
