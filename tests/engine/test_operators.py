import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from larkspur.errors import DuplicateKey, InvalidDocument, InvalidQuery
from larkspur.operators import mutate as M
from larkspur.operators.find import FindOptions, distinct, find, project
from larkspur.sources.document import distinct_documents, find_documents, sort_documents


def docs(spark, rows):
    return M.documents(spark, rows)


def values(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


ROWS = [
    {"_id": "b", "name": "B", "n": 1, "tags": ["x", "y"], "at": {"city": "Rome", "zip": 1}},
    {"_id": "aa", "name": "A", "n": 2, "tags": [], "items": [{"sku": "k1", "qty": 1}, {"sku": "k2", "qty": 2}]},
    {"_id": "c", "name": None, "n": 2, "tags": ["y"], "items": [{"sku": "k1", "qty": 5}], "at": {"city": None, "zip": 3}},
]


def test_storage_order_and_paging(spark):
    df = docs(spark, ROWS)
    assert [r._id for r in find(df, {}, FindOptions(take=10)).collect()] == ["b", "c", "aa"]
    assert [r._id for r in find(df, {}, FindOptions(sort=[("n", -1)])).collect()] == ["c", "aa", "b"]
    assert [r._id for r in find(df, {}, FindOptions(sort=[("name", 1)], skip=1, take=1)).collect()] == ["aa"]
    assert [r._id for r in find(df, {}, FindOptions(sort=[("tags", 1)])).collect()] == ["b", "c", "aa"]
    assert find(df, {}, FindOptions(take=0)).collect() == []
    with pytest.raises(InvalidQuery):
        find(df, {}, FindOptions(skip=-1))


def test_projection(spark):
    df = docs(spark, ROWS)
    assert project(df, ["tags", "name"]).columns == ["_id", "name", "tags"]
    assert project(df, []).columns == ["_id"]
    got = {r._id: r for r in project(df, ["at.city", "items.sku", "n.x"]).collect()}
    assert got["b"].at.asDict() == {"city": "Rome"} and got["aa"].at is None and got["aa"].n == 2
    assert [x.asDict() for x in got["aa"]["items"]] == [{"sku": "k1"}, {"sku": "k2"}] and got["b"]["items"] is None
    assert project(df, ["at.city", "at"]).schema["at"].dataType == df.schema["at"].dataType


def test_distinct(spark):
    df = docs(spark, ROWS)
    assert [r.value for r in distinct(df, "tags", sort=-1).collect()] == ["y", "x"]
    assert [r.value for r in distinct(df, "items.[].sku", sort=1).collect()] == ["k1", "k2"]
    assert [r.value for r in distinct(df, "at.city").collect()] == ["Rome"]
    assert distinct(df, "none").collect() == [] and distinct(df, "n", {"name": "A"}, 1, 0, 5).first().value == 2


@pytest.mark.parametrize(
    ("said", "name", "want"),
    [
        ({"$set": {"n": 9}}, "n", [9, 2, 2]), ({"n": 1.5}, "n", [1.5, 2.0, 2.0]), ({"$inc": {"n": 5}}, "n", [6, 2, 2]), ({"$inc": {"n": 0.5}}, "n", [1.5, 2.0, 2.0]),
        ({"$inc": {"new": 3}}, "new", [3, None, None]), ({"$unset": {"name": 1}}, "name", [None, "A", None]), ({"$push": {"tags": "z"}}, "tags", [["x", "y", "z"], [], ["y"]]),
        ({"$lpush": {"tags": "z"}}, "tags", [["z", "x", "y"], [], ["y"]]), ({"$pop": {"tags": 1}}, "tags", [["x"], [], ["y"]]), ({"$push": {"more": 1}}, "more", [[1], None, None]),
        ({"$rename": {"name": "title"}}, "title", ["B", None, None]), ({"$rename": {"name": "n2"}}, "name", [None, "A", None]), ({"$set": {"x.y.z": 1}}, "x", [((1,),), None, None]),
    ],
)
def test_update_operators(spark, said, name, want):
    got = {r._id: r[name] for r in M.update_many(docs(spark, ROWS), {"_id": "b"}, said).collect()}
    plain = lambda v: tuple(map(plain, v)) if isinstance(v, tuple) else v
    assert [plain(got[k]) for k in ("b", "aa", "c")] == want


def test_updates_see_earlier_ones_and_nested_parts_stay(spark):
    out = {r._id: r for r in M.update_many(docs(spark, ROWS), {"n": {"$gte": 1}}, {"$set": {"at.city": "Oslo"}, "$inc": {"n": 1}, "$rename": {"at.zip": "code"}}).collect()}
    assert out["b"]["at"].asDict() == {"city": "Oslo", "zip": None, "code": 1} and out["aa"]["at"].code is None and out["b"].n == 2
    out = {r._id: r.n for r in M.update_many(M.update_many(docs(spark, ROWS), {"n": 2}, {"$inc": {"n": 1}}), {"n": 3}, {"$inc": {"n": 1}}).collect()}
    assert out == {"b": 1, "aa": 4, "c": 4}


@pytest.mark.parametrize("said", [{}, {"$what": {"a": 1}}, {"$set": 1}, {"$inc": {"a": "1"}}, {"$inc": {"a": True}}, {"$rename": {"a": 1}}, {"$set": {"_id": 1}}, {"$rename": {"a": "_id"}}, {"$unset": {"_id.x": 1}}, {"_id": 5}])
def test_update_errors(said):
    with pytest.raises(InvalidQuery):
        M.parse_update(said)


@pytest.mark.parametrize("said", [{"$inc": {"name": 1}}, {"$push": {"n": 1}}, {"$pop": {"name": 1}}, {"$set": {"n.x": 1}}, {"$set": {"n": "text"}}])
def test_updates_that_types_forbid(spark, said):
    with pytest.raises(InvalidDocument):
        M.update_many(docs(spark, ROWS), {"_id": "b"}, said)


def test_one_document_writes(spark):
    df = docs(spark, ROWS)
    assert values(M.update_one(df, {"n": 2}, {"name": "Z"}), "_id", "name") == [("aa", "A"), ("b", "B"), ("c", "Z")]
    assert values(M.delete_one(df, {"n": 2}), "_id") == [("aa",), ("b",)]
    assert values(M.delete_many(df, {"name": "A"}), "_id") == [("b",), ("c",)]
    got = {r._id: r for r in M.replace_one(df, {"n": 2}, {"_id": "zz", "fresh": 1}).collect()}
    assert set(got) == {"b", "aa", "c"} and got["c"].fresh == 1 and got["c"].n is None and got["b"].n == 1
    assert M.update_one(df, {"n": 77}, {"name": "Z"}).count() == 3


def test_keyed_writes(spark):
    df = docs(spark, [{"_id": 1, "a": "x", "b": 1}, {"_id": 2, "a": "y", "b": 2}])
    new = docs(spark, [{"_id": 2, "a": None, "c": 7}, {"_id": 3, "a": "z", "c": 8}])
    assert values(M.upsert_many(df, new), "_id", "a", "b", "c") == [(1, "x", 1, None), (2, None, None, 7), (3, "z", None, 8)]
    assert values(M.merge_many(df, new), "_id", "a", "b", "c") == [(1, "x", 1, None), (2, None, 2, 7), (3, "z", None, 8)]
    assert M.insert_many(df, new.where("_id = 3")).count() == 3
    for bad in (new, docs(spark, [{"_id": 9, "a": "p"}, {"_id": 9, "a": "q"}])):
        with pytest.raises(DuplicateKey):
            M.insert_many(df, bad)
    turns = docs(spark, [{"_id": 1, "a": "first", "t": 1}, {"_id": 1, "a": "last", "t": 2}])
    assert ("last",) in values(M.upsert_many(df, turns, order="t"), "a") and M.upsert_many(df, turns, order="t").count() == 2
    counts = M.affected(df, {"b": {"$gte": 1}}, {"a": "x"}).first()
    assert (counts.matched, counts.modified) == (2, 1)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(low=st.integers(-5, 60), high=st.floats(-5, 60, allow_nan=False), status=st.sampled_from("FOP"), take=st.integers(0, 30))
def test_finds_equal_sql(spark, low, high, status, take):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").selectExpr("o_orderkey", "o_orderstatus", "o_custkey % 60 AS k")
    f = {"$or": [{"k": {"$gt": low, "$lt": high}}, {"o_orderstatus": status}]}
    got = [r.o_orderkey for r in find(df, f, FindOptions(sort=[("k", -1)], take=take), "o_orderkey").collect()]
    sql = f"SELECT o_orderkey FROM (SELECT *, o_custkey % 60 AS k FROM '/root/testdata/sf0.001/orders.parquet') WHERE (k > {low} AND k < {high!r}) OR o_orderstatus = '{status}' ORDER BY k DESC, o_orderkey LIMIT {take}"
    assert got == [r[0] for r in duckdb.sql(sql).fetchall()]


def test_document_layout(spark):
    rows = [(1, '{"a": 1, "s": "42"}'), (2, '{"a": "1", "l": [1, "x"]}'), (3, '{"a": null}'), (4, "{}"), (5, '{"a": 1.5, "o": {"p": true}}')]
    df = spark.createDataFrame(rows, "_id int, j string").selectExpr("_id", "parse_json(j) AS doc")
    keys = lambda f: sorted(r._id for r in find_documents(df, f).collect())
    assert keys({"a": 1}) == [1] and keys({"a": "1"}) == [1, 2] and keys({"a": None}) == [3, 4] and keys({"a": {"$exists": True}}) == [1, 2, 3, 5]
    assert keys({"a": {"$gt": 1}}) == [5] and keys({"l": "x"}) == [2] and keys({"o.p": True}) == [5] and keys({"s": 42}) == [] and keys({"s": {"$regex": "^4"}}) == [1]
    assert [r._id for r in sort_documents(df, "a").collect()] == [3, 4, 1, 5, 2] and [r._id for r in sort_documents(df, "a", -1).collect()][0] == 2
    assert len(distinct_documents(df, "a").collect()) == 3
