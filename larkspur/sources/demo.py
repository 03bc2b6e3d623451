"""Whole round trips through a store, for the query catalogue."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.errors import HookError
from larkspur.session import ensure_checkpoint_dir
from larkspur.sources.store import Database


def _fresh(spark: SparkSession, name: str) -> Database:
    """A store of its own in the shared folder."""
    ensure_checkpoint_dir(spark)
    return Database(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/store-{name}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}")


def audited_update(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """The audit rows that a trigger writes for every nation of region 1 that an update changes."""
    db = _fresh(spark, "audit")

    def audit(context: Any, event: dict[str, Any]) -> None:
        if event["action"] == "updated":
            key = event["doc"]["n_nationkey"]
            context.put("audit", {"_id": f"{key}:updated", "action": "updated", "doc_id": key})

    with db.begin() as txn:
        txn.create_collection("nation", pk="n_nationkey")
        txn.create_collection("audit")
        txn.insert_many("nation", nation).drain()
        txn.register_trigger("audit", "nation", audit)
    with db.begin() as txn:
        txn.update_many("nation", {"n_regionkey": 1}, {"$set": {"n_name": "CHANGED"}}).drain()
    return db.begin(True).frame("audit")


def validated_insert(spark: SparkSession, region: DataFrame) -> DataFrame:
    """The regions that a validator lets in: all but key 0."""
    db = _fresh(spark, "checked")
    with db.begin() as txn:
        txn.create_collection("region", pk="r_regionkey")
        txn.register_validator("positive", "region", lambda doc: doc["r_regionkey"] > 0 or "not positive")
    for part in (region.where("r_regionkey = 0"), region.where("r_regionkey <> 0")):
        txn = db.begin()
        try:
            txn.insert_many("region", part).drain()
            txn.commit()
        except HookError:
            txn.rollback()
    return db.begin(True).frame("region")


def committed_changes(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """Nations after a commit of an update, a delete and an insert, a rolled back delete, and a reader that came before."""
    db = _fresh(spark, "nations")
    with db.begin() as txn:
        txn.create_collection("nation", pk="n_nationkey")
        txn.insert_many("nation", nation.withColumn("n_nationkey", F.col("n_nationkey").cast("int"))).drain()
    reader = db.begin(True)
    with db.begin() as txn:
        names = {r["n_nationkey"]: r["n_name"] for r in txn.find("nation", {"n_regionkey": 2}).iter()}
        txn.merge_many("nation", [{"n_nationkey": k, "n_name": f"ASIA:{v}"} for k, v in names.items()]).drain()
        txn.delete_one("nation", {"n_nationkey": 0}).drain()
        txn.insert_one("nation", {"n_nationkey": 500, "n_name": "NEW", "n_regionkey": 9}).drain()
    txn = db.begin()
    txn.delete_many("nation", {"n_regionkey": {"$gte": 0}}).drain()
    txn.rollback()
    if reader.count("nation") != nation.count():
        raise AssertionError("a reader saw a later commit")
    return db.begin(True).frame("nation").select("n_nationkey", "n_name")


def upserted_with_trigger(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """What a trigger notes of an upsert: the action, the document's name as it stood then, and that its own copies stay."""
    db = _fresh(spark, "upserts")

    def note(context: Any, event: dict[str, Any]) -> None:
        key = event["doc"]["n_nationkey"]
        if key < 1000:
            context.put("nation", {"n_nationkey": 1000 + key, "n_name": "copy"}, "n_nationkey")
            context.put("log", {"_id": f"{key}:{event['action']}", "name": event["doc"]["n_name"]})

    with db.begin() as txn:
        txn.create_collection("nation", pk="n_nationkey")
        txn.create_collection("log")
        txn.insert_many("nation", nation).drain()
        txn.register_trigger("note", "nation", note)
    with db.begin() as txn:
        rows = [{"n_nationkey": 3, "n_name": "NEW 3"}, {"n_nationkey": 500, "n_name": "NEW 500"}]
        txn.upsert_many("nation", rows).drain()
    reader = db.begin(True)
    copies = reader.frame("nation").where("n_nationkey >= 1000").select(F.col("n_nationkey").cast("string").alias("_id"), F.col("n_name").alias("name"))
    return reader.frame("log").select("_id", "name").unionByName(copies)


def merged_without_change(spark: SparkSession, region: DataFrame) -> DataFrame:
    """The actions that a trigger sees when one document is merged with what it holds already, and another changed."""
    db = _fresh(spark, "merges")

    def note(context: Any, event: dict[str, Any]) -> None:
        context.put("log", {"_id": f"{event['doc']['r_regionkey']}:{event['action']}"})

    with db.begin() as txn:
        txn.create_collection("region", pk="r_regionkey")
        txn.create_collection("log")
        txn.insert_many("region", region).drain()
        txn.register_trigger("note", "region", note)
    with db.begin() as txn:
        txn.merge_many("region", [{"r_regionkey": 1, "r_name": "AMERICA"}, {"r_regionkey": 2, "r_name": "changed"}]).drain()
    return db.begin(True).frame("log").select("_id")


def upserted_by_order(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """The last order of each customer by its key, upserted as one batch."""
    db = _fresh(spark, "batch")
    with db.begin() as txn:
        txn.create_collection("last", pk="o_custkey")
        txn.upsert_many("last", orders.select("o_custkey", "o_totalprice", "o_orderkey"), order="o_orderkey").drain()
        txn.upsert_many("last", orders.where("o_orderkey % 2 = 0").select("o_custkey", "o_totalprice", "o_orderkey"), order="o_orderkey").drain()
    return db.begin(True).frame("last")


def purged(spark: SparkSession, events: DataFrame, at: Any, before: Any) -> DataFrame:
    """What is left of expiring documents after a purge at one time, and then one of what expires before another; and how many went."""
    db = _fresh(spark, "expiry")
    db.clock = lambda: at
    with db.begin() as txn:
        txn.create_collection("events", pk="event_id")
        txn.insert_many("events", events).drain()
    gone = db.purge_expired()
    with db.begin() as txn:
        later = txn.purge_before("default_cf", "events", before)
    left = db.begin(True)._stored("default_cf", "events")
    return left.agg(F.count("*").alias("left_over")).withColumn("purged", F.lit(gone).cast("long")).withColumn("purged_before", F.lit(later).cast("long"))


def catalogued(spark: SparkSession, region: DataFrame) -> DataFrame:
    """The collections and indexes that a store and its backup list after some were made and dropped."""
    db = _fresh(spark, "catalogue")
    with db.begin() as txn:
        for name in ("a", "b", "c"):
            txn.create_collection(name, pk="r_regionkey")
        txn.create_collection("a", cf="other")
        txn.drop_collection("b")
        txn.create_index("a", "r_name")
        txn.create_index("a", "x")
        txn.drop_index("a", "x")
        txn.insert_many("a", region).drain()
    copy = _fresh(spark, "backup")
    db.backup(copy.root)
    db.drop_collection("c")
    rows = [(where, f"{cf}/{name}", ",".join(d.begin(True).list_indexes(name, cf)), d.count(name, None, cf)) for where, d in (("store", db), ("backup", copy)) for cf, name in d.list_collections()]
    return spark.createDataFrame(rows, "place string, name string, indexes string, documents long")


def ranges_deleted(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """Nations left by deletions of ranges with every kind of bound."""
    db = _fresh(spark, "ranges")
    db.create_collection("nation", pk="n_nationkey")
    db.insert_many("nation", nation)
    db.delete_range("nation", 2, 4)
    db.delete_range("nation", 6, 8, with_low=False, with_high=True)
    db.delete_range("nation", low=22)
    db.delete_range("nation", high=1)
    return db.find("nation").select("n_nationkey", "n_name")


def hooks_in_order(spark: SparkSession) -> DataFrame:
    """The order in which hooks of several names see statements, and that hooks count from the next transaction on."""
    db = _fresh(spark, "hooks")
    seen: list[tuple[int, str, str]] = []
    db.create_collection("c")
    with db.begin() as txn:
        for name in ("z", "a"):
            txn.register_trigger(name, "c", lambda context, event, name=name: seen.append((len(seen), name, event["action"])))
        txn.register_udf("shouted", "c", lambda v: v.upper() + "!")
        txn.insert_one("c", {"_id": "quiet"}).drain()
    db.insert_one("c", {"_id": "one", "n": 1})
    db.update_one("c", {"_id": "one"}, {"$inc": {"n": 1}})
    db.drop_trigger("z", "c")
    db.delete_one("c", {"_id": "one"})
    spark.createDataFrame([("udf",)], "v string").createOrReplaceTempView("larkspur_demo")
    said = spark.sql("SELECT shouted(v) AS v FROM larkspur_demo").first()["v"]
    return spark.createDataFrame([*seen, (len(seen), "udf", said)], "turn int, name string, action string")
