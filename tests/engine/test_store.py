import datetime as dt
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest

from larkspur.errors import CollectionNotFound, DuplicateKey, FunctionExists, HookError, IndexExists, InvalidKey, ReadOnly, StoreError
from larkspur.operators import mutate as M
from larkspur.operators.find import FindOptions
from larkspur.sources.store import Database
from larkspur.streaming.sinks import keyed_sink

NOW = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def db(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"), clock=lambda: NOW)
    with db.begin() as txn:
        txn.create_collection("c")
        txn.insert_many("c", [{"_id": "a", "n": 1}, {"_id": "b", "n": 2}, {"_id": "x", "n": 3}]).drain()
    return db


def ids(txn, name="c", filter=None, **options):  # noqa: A002
    return [d["_id"] for d in txn.find(name, filter, FindOptions(**options)).iter()]


def test_cursors_are_lazy_and_transactions_isolated(db):
    txn = db.begin()
    txn.delete_many("c", {"n": 1})
    assert txn.count("c") == 3
    cursor = txn.delete_many("c", {"n": 1})
    assert cursor.drain() == 1 and txn.count("c") == 2 and db.begin(True).count("c") == 3
    old = db.begin(True)
    txn.commit()
    assert old.count("c") == 3 and db.begin(True).count("c") == 2
    other, late = db.begin(), db.begin()
    other.insert_one("c", {"_id": "y", "n": 1}).drain()
    other.commit()
    late.insert_one("c", {"_id": "z", "n": 1}).drain()
    with pytest.raises(StoreError):
        late.commit()
    txn = db.begin()
    txn.delete_many("c", {"n": {"$gte": 0}}).drain()
    txn.rollback()
    assert sorted(ids(db.begin(True))) == ["b", "x", "y"]


def test_statements(db):
    with db.begin() as txn:
        assert txn.update_many("c", {"n": {"$gte": 2}}, {"$inc": {"n": 10}}).drain() == 2
        assert [d["n"] for d in txn.update_one("c", {"n": {"$gte": 12}}, {"$set": {"n": 0}}).iter()] == [0]
        assert txn.update_many("c", {"_id": "x"}, {"$set": {"n": 13}}).drain() == 1
        assert txn.replace_one("c", {"_id": "x"}, {"name": "X"}).drain() == 1
        assert txn.upsert_many("c", [{"_id": "a", "n": 5}, {"_id": "q", "n": 6}, {"_id": "q", "n": 7}]).drain() == 3
        assert txn.merge_many("c", [{"_id": "a", "name": "A"}, {"_id": "new", "n": 1}, {"_id": "a", "n": 8}]).drain() == 3
        txn.delete_range("c", low="new", high="o")
    got = {d["_id"]: (d["n"], d["name"]) for d in db.begin(True).find("c").iter()}
    assert got == {"a": (8, "A"), "b": (0, None), "x": (None, "X"), "q": (7, None)}
    assert db.begin(True).distinct("c", "n", sort=1) == [0, 7, 8] and db.begin(True).find_one("c", {"_id": "q"})["n"] == 7
    with pytest.raises(ReadOnly):
        db.begin(True).delete_many("c", {"n": 1})
    with db.begin() as txn, pytest.raises(DuplicateKey):
        txn.insert_one("c", {"_id": "a"}).drain()
    with db.begin() as txn:
        txn.insert_one("c", {"n": 1}).drain()
    assert any(len(i) == 24 for i in ids(db.begin(True)))


def test_catalog_and_backup(db, spark, tmp_path):
    with db.begin() as txn:
        txn.create_collection("c")
        txn.create_collection("k", cf="other", pk="key")
        txn.create_index("c", "n")
        assert txn.list_indexes("c") == ["n", "ttl"] and txn.list_collections() == [("default_cf", "c"), ("other", "k")]
        with pytest.raises(IndexExists):
            txn.create_index("c", "n")
        with pytest.raises(InvalidKey):
            txn.create_collection("bad", pk="a.b")
        with pytest.raises(CollectionNotFound):
            txn.count("none")
        txn.update_many("c", {"n": {"$gte": 0}}, {"$inc": {"n": 1}}).drain()
    assert ids(db.begin(True), filter={"n": {"$gte": 3}}) == ids(db.begin(True), filter={"$and": [{"n": {"$gte": 3}}]})
    db.backup(str(tmp_path / "copy"))
    with db.begin() as txn:
        txn.drop_index("c", "n")
        txn.drop_collection("c")
        txn.drop_collection("c")
    db.vacuum()
    assert db.list_collections() == [("other", "k")]
    assert Database(spark, str(tmp_path / "copy")).begin(True).count("c") == 3


def test_expiry(db, spark):
    at = lambda s: NOW + dt.timedelta(seconds=s)
    with db.begin() as txn:
        txn.create_collection("t")
        txn.insert_many("t", [{"_id": "old", "ttl": at(-60), "n": 1}, {"_id": "now", "ttl": NOW, "n": 1}, {"_id": "new", "ttl": at(600), "n": 1}, {"_id": "never", "ttl": None, "n": 1}]).drain()
    with db.begin() as txn:
        assert sorted(ids(txn, "t")) == ["never", "new", "now"] and txn.update_many("t", {"n": 1}, {"n": 2}).drain() == 3
        txn.merge_many("t", [{"_id": "old", "n": 5}]).drain()
        assert txn.find_one("t", {"_id": "old"}) == {"_id": "old", "ttl": None, "n": 5}
    with db.begin() as txn:
        txn.insert_one("t", {"_id": "gone", "ttl": at(-1), "n": 1}).drain()
    assert db.purge_expired() == 1 and db.purge_expired() == 0
    with db.begin() as txn:
        assert txn.purge_before("default_cf", "t", at(10_000)) == 2
    sweeping = Database(spark, db.root, clock=lambda: at(10_000), sweep_seconds=0.2)
    with db.begin() as txn:
        txn.insert_one("t", {"_id": "late", "ttl": at(1), "n": 1}).drain()
    for _ in range(60):
        time.sleep(0.5)
        if db.manifest()[0] > 0 and txn.db.begin(True).count("t", {"_id": "late"}) == 0:
            break
    sweeping.shutdown()
    assert db.begin(True).count("t", {"_id": "late"}) == 0


def test_hooks(db):
    seen = []

    def note(context, event):
        seen.append((event["action"], event["doc"]["_id"]))
        before = context.get("log", event["doc"]["_id"])
        context.put("log", {"_id": event["doc"]["_id"], "times": (before or {"times": 0})["times"] + 1})

    with db.begin() as txn:
        txn.create_collection("log")
        txn.register_trigger("note", "c", note)
        txn.register_validator("positive", "c", lambda d: (d["n"] or 0) > 0 or "n isn't positive")
        txn.register_udf("twice", "c", lambda v: v)
        with pytest.raises(FunctionExists):
            txn.register_udf("note", "c", lambda v: v)
        txn.insert_one("c", {"_id": "quiet", "n": -1}).drain()
    with db.begin() as txn:
        txn.insert_one("c", {"_id": "h", "n": 1}).drain()
        txn.update_one("c", {"_id": "h"}, {"n": 2}).drain()
        txn.upsert_many("c", [{"_id": "h", "n": 3}, {"_id": "i", "n": 3}]).drain()
        txn.delete_one("c", {"_id": "h"}).drain()
    assert seen == [("inserting", "h"), ("inserted", "h"), ("updating", "h"), ("updated", "h"), ("updating", "h"), ("inserting", "i"), ("updated", "h"), ("inserted", "i"), ("deleting", "h"), ("deleted", "h")]
    assert db.begin(True).find_one("log", {"_id": "h"})["times"] == 8
    txn = db.begin()
    with pytest.raises(HookError):
        txn.insert_one("c", {"_id": "bad", "n": 0}).drain()
    with pytest.raises(HookError):
        txn.update_one("c", {"_id": "quiet"}, {"n": 5}).drain()
    txn.rollback()
    with db.begin() as txn:
        txn.drop_trigger("note", "c")
        txn.drop_validator("positive", "c")
        txn.drop_udf("twice", "c")
    with db.begin() as txn:
        txn.insert_one("c", {"_id": "free", "n": 0}).drain()
    assert len(seen) == 10


def test_streams_into_collections(db, spark, tmp_path):
    rows = spark.createDataFrame([("a", 50, 1), ("s", 1, 1), ("s", 2, 2)], "_id string, n int, t int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    sink = keyed_sink(db, "c", order="t")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {d["_id"]: d["n"] for d in db.begin(True).find("c").iter()}
    assert got == {"a": 50, "b": 2, "x": 3, "s": 2}
    sink(rows.selectExpr("_id", "0 AS n", "t"), 0)
    assert db.begin(True).find_one("c", {"_id": "a"})["n"] == 50


def files(db, name="c"):
    return set(db.manifest()[1]["collections"][f"default_cf/{name}"]["files"])


def test_writes_touch_only_the_files_that_hold_their_documents(db, spark):
    db.create_collection("many", pk="id")
    db.insert_many("many", spark.range(1000).selectExpr("id", "id % 7 n").repartitionByRange(8, "id"))
    before = files(db, "many")
    assert len(before) == 8
    db.insert_many("many", spark.range(1000, 1010).selectExpr("id", "id % 7 n").coalesce(1))
    assert before < files(db, "many") and len(files(db, "many")) == 9
    before = files(db, "many")
    assert db.update_one("many", {"id": 3}, {"$set": {"n": 100, "new": "x"}}) == 1
    assert len(before - files(db, "many")) == 1
    before = files(db, "many")
    assert db.delete_many("many", {"id": {"$lt": 2}}) == 2 and len(before - files(db, "many")) == 1
    assert db.upsert_many("many", [{"id": 5, "n": 1}, {"id": 5000, "n": 2}]) == 2
    assert db.count("many") == 1009 and db.find_one("many", {"new": "x"}) == {"id": 3, "n": 100, "new": "x"}
    # a type that has to be widened is widened in all files
    assert db.update_one("many", {"id": 900}, {"$set": {"n": 0.5}}) == 1
    assert db.find("many").agg({"n": "sum"}).first()[0] == sum(i % 7 for i in range(1010)) - 3 + 100 - 1 - 5 + 1 + 2 - 900 % 7 + 0.5
    db.vacuum()
    assert db.count("many") == 1009


def test_of_two_commits_at_once_one_wins_unless_they_touch_different_collections(db):
    with db.begin() as txn:
        txn.create_collection("d")
    first, second, other = db.begin(), db.begin(), db.begin()
    for n, (txn, name) in enumerate(((first, "c"), (second, "c"), (other, "d"))):
        txn.insert_one(name, {"_id": f"new{n}", "n": n}).drain()
    done = []

    def commit(txn, name):
        try:
            txn.commit()
            done.append(name)
        except StoreError:
            pass

    threads = [threading.Thread(target=commit, args=x) for x in ((first, "c"), (second, "c"), (other, "d"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(done) == ["c", "d"] and db.count("c") == 4 and db.count("d") == 1
    with ThreadPoolExecutor(16) as pool:
        made = list(pool.map(lambda k: db.folder.create("manifests/m9999999999.json", str(k)), range(16)))
    assert sum(made) == 1 and db.folder.read("manifests/m9999999999.json") == str(made.index(True))


def test_keyed_writes_fire_around_the_write_and_keep_what_triggers_wrote(db):
    seen = []

    def note(context, event):
        seen.append((event["action"], event["doc"]["_id"], event["doc"]["n"]))
        if not event["doc"]["_id"].startswith("copy"):
            context.put("c", {"_id": "copy-" + event["doc"]["_id"], "n": 0})

    with db.begin() as txn:
        txn.register_trigger("note", "c", note)
    db.upsert_many("c", [{"_id": "a", "n": 7}, {"_id": "new", "n": 8}])
    assert seen == [("updating", "a", 1), ("inserting", "new", 8), ("updated", "a", 7), ("inserted", "new", 8)]
    db.merge_many("c", [{"_id": "b", "n": 2}, {"_id": "x", "n": 4}])
    assert seen[4:6] in ([("updating", "b", 2), ("updating", "x", 3)], [("updating", "x", 3), ("updating", "b", 2)]) and seen[6:] == [("updated", "x", 4)]
    assert {d["_id"] for d in db.begin(True).find("c").iter()} == {"a", "b", "x", "new", "copy-a", "copy-new", "copy-b", "copy-x"}


def test_batches_with_a_key_twice_need_an_order(db, spark):
    twice = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("z", 1, 7)], "_id string, at int, n int")
    with pytest.raises(DuplicateKey):
        db.upsert_many("c", twice)
    assert db.upsert_many("c", twice, order="at") == 3 and db.find_one("c", {"_id": "a"}) == {"_id": "a", "n": 6}
    with pytest.raises(DuplicateKey):
        M.last_of_each(twice, "_id")


def test_statements_of_the_database_json_texts_and_stores_that_pass(spark):
    db = Database(spark)
    db.create_collection("j")
    assert db.insert_many("j", ['{"_id": "a", "n": 1}', '{"_id": "b", "n": null}']) == 2 and db.insert_one("j", {"_id": "c", "n": 3}) == 1
    assert db.replace_one("j", {"_id": "a"}, {"n": 5}) == 1 and db.distinct("j", "n", sort=1) == [3, 5]
    db.delete_range("j", low="a", high="b", with_low=False, with_high=True)
    assert sorted(r._id for r in db.find("j").collect()) == ["a", "c"]
    with pytest.raises(HookError):
        db.register_validator("odd", "j", lambda d: d["n"] % 2 == 1)
        db.insert_one("j", {"_id": "e", "n": 4})
    with pytest.raises(HookError, match="failed"):
        db.insert_one("j", {"_id": "e", "n": None})
    db.shutdown()
    assert db.folder.names("data") == []
