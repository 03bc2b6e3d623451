"""Queries over the provided tables, one or more for each operator, with the same results as SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import scalars
from larkspur.operators import mutate as M
from larkspur.operators.find import FindOptions, count, distinct, find, find_one, lookup, merge_all, merge_any
from larkspur.sources.document import document_column, find_documents
from larkspur.sources.ttl import expired, visible

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query by its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def finding(name: str, source: str, filter: Mapping[str, Any] | None, sql_where: str, columns: list[str], pk: str, options: FindOptions | None = None, sql_tail: str = "") -> None:  # noqa: A002
    """Register a find over a table: its columns are the primary key and what is named."""
    o = options or FindOptions()
    o.columns = columns

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return find(table(spark, sf_dir, source), filter, o, pk)

    QUERIES[name] = f
    ORACLE_SQL[name] = f"SELECT {', '.join(columns)} FROM {source} WHERE {sql_where} {sql_tail}"


# Reads: scans, predicates, coercions

_O = ["o_orderkey", "o_orderstatus", "o_totalprice"]
finding("find_flagship", "orders", {"o_orderstatus": "F", "o_totalprice": {"$gt": 100000}}, "o_orderstatus = 'F' AND o_totalprice > 100000", _O, "o_orderkey", FindOptions(sort=[("o_totalprice", -1)], take=10), "ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
finding("find_all", "region", {}, "true", ["r_regionkey", "r_name"], "r_regionkey")
finding("find_pk", "orders", {"o_orderkey": 7}, "o_orderkey = 7", _O, "o_orderkey")
finding("find_eq_string", "orders", {"o_orderstatus": "O"}, "o_orderstatus = 'O'", _O, "o_orderkey")
finding("find_eq_int_from_string", "customer", {"c_nationkey": "7"}, "c_nationkey = 7", ["c_custkey", "c_nationkey"], "c_custkey")
finding("find_eq_double_from_int", "lineitem", {"l_quantity": 10}, "l_quantity = 10", ["l_orderkey", "l_quantity", "l_extendedprice"], "l_orderkey")
finding("find_eq_unparsable_string", "customer", {"c_nationkey": "7.0"}, "false", ["c_custkey"], "c_custkey")
finding("find_eq_int_from_float", "customer", {"c_nationkey": 7.0}, "c_nationkey = 7", ["c_custkey", "c_nationkey"], "c_custkey")
finding("find_fraction_bound", "part", {"p_size": {"$gt": 10.5, "$lte": 20.25}}, "p_size > 10.5 AND p_size <= 20.25", ["p_partkey", "p_size"], "p_partkey")
finding("find_range_pair", "lineitem", {"l_quantity": {"$gte": 10, "$lte": 20}}, "l_quantity >= 10 AND l_quantity <= 20", ["l_orderkey", "l_quantity"], "l_orderkey")
finding("find_range_exclusive", "lineitem", {"l_quantity": {"$gt": 10, "$lt": 12}}, "l_quantity > 10 AND l_quantity < 12", ["l_orderkey", "l_quantity"], "l_orderkey")
finding("find_dt_epoch_seconds", "events", {"ts": {"$gte": 1705276800}}, "ts >= TIMESTAMP '2024-01-15 00:00:00'", ["event_id", "event_type"], "event_id")
finding("find_dt_rfc3339", "events", {"ts": {"$lt": "2024-01-10T02:00:00+02:00"}}, "ts < TIMESTAMP '2024-01-10 00:00:00'", ["event_id", "event_type"], "event_id")
finding("find_dt_literal", "orders", {"o_orderdate": {"$lt": dt.datetime(1995, 3, 1)}}, "o_orderdate < TIMESTAMP '1995-03-01 00:00:00'", ["o_orderkey", "o_orderstatus"], "o_orderkey")
finding("find_or", "orders", {"$or": [{"o_orderstatus": "P"}, {"o_totalprice": {"$gt": 300000}}]}, "o_orderstatus = 'P' OR o_totalprice > 300000", _O, "o_orderkey")
finding("find_or_same_field", "events", {"$or": [{"event_type": "click"}, {"event_type": "error"}]}, "event_type IN ('click', 'error')", ["event_id", "event_type"], "event_id")
finding("find_nested_or_and", "orders", {"$and": [{"$or": [{"o_orderstatus": "F"}, {"o_orderstatus": "P"}]}, {"$or": [{"o_totalprice": {"$lt": 5000}}, {"o_custkey": {"$lte": 10}}]}]}, "o_orderstatus IN ('F', 'P') AND (o_totalprice < 5000 OR o_custkey <= 10)", [*_O, "o_custkey"], "o_orderkey")
finding("find_implicit_and", "orders", {"o_orderstatus": "O", "o_orderpriority": "1-URGENT"}, "o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'", [*_O, "o_orderpriority"], "o_orderkey")
finding("find_regex", "customer", {"c_name": {"$regex": "1[0-3]$"}}, "regexp_matches(c_name, '1[0-3]$')", ["c_custkey", "c_name"], "c_custkey")
finding("find_regex_ci", "part", {"p_type": {"$regex": "^(eco|la).*", "$options": "i"}}, "regexp_matches(p_type, '(?i)^(eco|la).*')", ["p_partkey", "p_type"], "p_partkey")
finding("find_regex_text", "documents", {"text": {"$regex": r"\bLicensed\b"}}, r"regexp_matches(text, '\bLicensed\b')", ["doc_id", "lang"], "doc_id")
finding("find_missing_field_null", "region", {"r_comment": None}, "true", ["r_regionkey"], "r_regionkey")
finding("find_missing_field_eq", "region", {"r_comment": "x"}, "false", ["r_regionkey"], "r_regionkey")
finding("find_bool_literal_on_int", "customer", {"c_nationkey": True}, "false", ["c_custkey"], "c_custkey")
finding("find_sort_multi_page", "orders", {"o_orderstatus": "O"}, "o_orderstatus = 'O'", [*_O, "o_orderpriority"], "o_orderkey", FindOptions(sort=[("o_orderpriority", -1), ("o_totalprice", 1)], skip=20, take=30), "ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 30 OFFSET 20")
finding("find_topk", "lineitem", {}, "true", ["l_orderkey", "l_extendedprice", "l_partkey"], "l_orderkey", FindOptions(sort=[("l_extendedprice", -1), ("l_partkey", 1)], take=25), "ORDER BY l_extendedprice DESC, l_partkey, l_orderkey LIMIT 25")
finding("find_take_without_sort", "customer", {"c_mktsegment": "BUILDING"}, "c_mktsegment = 'BUILDING'", ["c_custkey", "c_mktsegment"], "c_custkey", FindOptions(take=40), "ORDER BY c_custkey LIMIT 40")
finding("find_string_pk_order", "customer", {}, "true", ["c_name"], "c_name", FindOptions(take=15), "ORDER BY octet_length(encode(c_name)), c_name LIMIT 15")
finding("project_flat", "orders", {}, "true", ["o_orderkey", "o_custkey"], "o_orderkey")
finding("project_pk_only", "orders", {"o_orderstatus": "F"}, "o_orderstatus = 'F'", ["o_orderkey"], "o_orderkey")
ORACLE_SQL["find_eq_double_from_int"] = "SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity = 10"


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1")
def find_one_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_one(table(spark, sf_dir, "orders").select(*_O), {"o_orderstatus": "F"}, "o_orderkey")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")


_LABELLED = "(SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"SELECT doc_id, lang FROM {_LABELLED} WHERE quality IS NULL")
def find_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(labelled(spark, sf_dir), {"quality": None}, FindOptions(columns=["lang"]), "doc_id")


@query(f"SELECT doc_id, lang, quality FROM {_LABELLED} WHERE quality IS NOT NULL")
def find_exists_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(labelled(spark, sf_dir), {"quality": {"$exists": True}}, FindOptions(columns=["lang", "quality"]), "doc_id")


@query(f"SELECT doc_id, lang FROM {_LABELLED} WHERE toxic IS NULL AND lang = 'en'")
def find_exists_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(labelled(spark, sf_dir), {"toxic": {"$exists": False}, "lang": "en"}, FindOptions(columns=["lang"]), "doc_id")


@query(f"SELECT doc_id, quality FROM {_LABELLED} ORDER BY quality ASC NULLS FIRST, doc_id LIMIT 50 OFFSET 10")
def sort_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(labelled(spark, sf_dir), {}, FindOptions(sort=[("quality", 1)], skip=10, take=50, columns=["quality"]), "doc_id")


@query(f"SELECT doc_id, quality FROM {_LABELLED} ORDER BY quality DESC NULLS LAST, doc_id LIMIT 50")
def sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(labelled(spark, sf_dir), {}, FindOptions(sort=[("quality", -1)], take=50, columns=["quality"]), "doc_id")


# Nested documents: orders with their customer, and with their line items


def with_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with a customer document, absent where its account is overdrawn."""
    c = table(spark, sf_dir, "customer")
    inner = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_nationkey").alias("key")).alias("nation"))
    held = c.select("c_custkey", F.when(F.col("c_acctbal") >= 0, inner).alias("customer"))
    return table(spark, sf_dir, "orders").join(held, F.col("o_custkey") == F.col("c_custkey"), "left").drop("c_custkey")


_CUSTOMER = "orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON o_custkey = c_custkey"


@query(f"SELECT o_orderkey, c_name AS name FROM {_CUSTOMER} WHERE c_mktsegment = 'BUILDING'")
def dot_filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(with_customer(spark, sf_dir), {"customer.segment": "BUILDING"}, FindOptions(columns=["customer.name"]), "o_orderkey").select("o_orderkey", "customer.name")


@query(f"SELECT o_orderkey, c_nationkey AS key FROM {_CUSTOMER} WHERE c_nationkey >= 20")
def dot_filter_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(with_customer(spark, sf_dir), {"customer.nation.key": {"$gte": 20}}, FindOptions(columns=["customer.nation.key"]), "o_orderkey").select("o_orderkey", "customer.nation.key")


@query(f"SELECT o_orderkey, c_name AS name FROM {_CUSTOMER} ORDER BY c_name NULLS FIRST, o_orderkey LIMIT 40")
def dot_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(with_customer(spark, sf_dir), {}, FindOptions(sort=[("customer.name", 1)], take=40, columns=["customer.name"]), "o_orderkey").select("o_orderkey", "customer.name")


@query(f"SELECT o_orderkey FROM {_CUSTOMER} WHERE c_name IS NULL")
def dot_null_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(with_customer(spark, sf_dir), {"customer.name": None}, FindOptions(columns=[]), "o_orderkey")


@query(f"SELECT o_orderkey, c_name AS name, c_nationkey AS key, c_custkey IS NULL AS absent FROM {_CUSTOMER}")
def project_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(with_customer(spark, sf_dir), {}, FindOptions(columns=["customer.name", "customer.nation"]), "o_orderkey")
    return out.select("o_orderkey", "customer.name", "customer.nation.key", F.col("customer").isNull().alias("absent"))


def with_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with their line items as documents, and return flags and quantities as arrays."""
    item = F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"))
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"), F.collect_list("l_returnflag").alias("flags"), F.collect_list("l_quantity").alias("qtys"))  # noqa: E741
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(l, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@query("SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
def array_any_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(with_items(spark, sf_dir), {"flags": "R"}, FindOptions(columns=[]), "o_orderkey")


@query("SELECT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING bool_or(l_quantity > 48) AND bool_or(l_quantity < 3)")
def array_any_range_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(with_items(spark, sf_dir), {"qtys": {"$gt": 48, "$lt": 3}}, FindOptions(columns=[]), "o_orderkey")


@query("SELECT o_orderkey, sum(l_partkey) AS parts, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey")
def project_array_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(with_items(spark, sf_dir), {"o_orderstatus": "P"}, FindOptions(columns=["items.part"]), "o_orderkey")
    return out.select("o_orderkey", F.explode("items").alias("i")).groupBy("o_orderkey").agg(F.sum("i.part").alias("parts"), F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90")
def json_prop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "events").select("event_id", "event_type", F.parse_json("props").alias("doc"))
    return find_documents(docs, {"k": {"$gte": 90}}, pk="event_id").select("event_id", "event_type")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000.5")
def document_layout_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    docs = orders.select("o_orderkey", document_column(orders.select("o_orderstatus", "o_totalprice")).alias("doc"))
    return find_documents(docs, {"o_orderstatus": "F", "o_totalprice": {"$gt": 250000.5}}, pk="o_orderkey").select("o_orderkey")


# Keys, unions and intersections of matches


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) OR o_totalprice < 2000")
def index_merge_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    keys = c.where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return lookup(orders, keys, "o_custkey").unionByName(merge_any(orders, {"o_totalprice": {"$lt": 2000}})).dropDuplicates(["o_orderkey"]).select(*_O)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000")
def index_merge_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(*_O)
    return merge_all(orders.where("o_orderstatus = 'O'"), orders.where("o_totalprice > 200000"), "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return lookup(table(spark, sf_dir, "orders").select(*_O), keys, "o_orderkey")


@query("SELECT o_totalprice FROM orders WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice DESC LIMIT 100")
def index_scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "orders"), {"o_totalprice": {"$exists": True}}, FindOptions(sort=[("o_totalprice", -1)], take=100, columns=["o_totalprice"]), "o_orderkey").select("o_totalprice")


# Counts and distinct values


@query("SELECT count(*) AS count FROM lineitem")
def count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "lineitem"))


@query("SELECT count(*) AS count FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 25")
def count_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "lineitem"), {"l_returnflag": "R", "l_quantity": {"$lt": 25}})


@query("SELECT DISTINCT o_orderpriority AS value FROM orders")
def distinct_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("SELECT DISTINCT l_returnflag AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def distinct_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct(with_items(spark, sf_dir), "flags")


@query("SELECT DISTINCT l_partkey AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def distinct_array_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct(with_items(spark, sf_dir), "items.[].part")


@query("SELECT DISTINCT o_custkey AS value FROM orders ORDER BY 1 DESC LIMIT 20 OFFSET 5")
def distinct_sort_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct(table(spark, sf_dir, "orders"), "o_custkey", sort=-1, skip=5, take=20)


@query("SELECT DISTINCT p_brand AS value FROM part WHERE p_size > 40")
def distinct_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct(table(spark, sf_dir, "part"), "p_brand", {"p_size": {"$gt": 40}})


@query("SELECT CAST(NULL AS VARCHAR) AS value WHERE false")
def distinct_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct(table(spark, sf_dir, "part"), "p_nothing")


@query(f"SELECT DISTINCT quality AS value FROM {_LABELLED} WHERE quality IS NOT NULL")
def distinct_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct(labelled(spark, sf_dir), "quality")


@query(f"SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS key FROM {_CUSTOMER} WHERE c_custkey IS NOT NULL")
def distinct_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_customer(spark, sf_dir).withColumn("customer", F.col("customer").dropFields("name"))
    return distinct(docs, "customer").select("value.segment", "value.nation.key")


# Updates


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer")


_C = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'OVERDRAWN' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.update_many(customers(spark, sf_dir), {"c_acctbal": {"$lt": 0}}, {"$set": {"c_mktsegment": "OVERDRAWN"}}, "c_custkey")


@query(f"SELECT {_C}, CASE WHEN c_nationkey = 5 THEN 'five' END AS note FROM customer")
def update_set_new_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.update_many(customers(spark, sf_dir), {"c_nationkey": 5}, {"note": "five"}, "c_custkey")


@query(f"SELECT o_orderkey, c_name AS name, CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE c_mktsegment END AS segment, CASE WHEN o_orderstatus = 'F' THEN 99 ELSE c_nationkey END AS key FROM {_CUSTOMER}")
def update_set_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.update_many(with_customer(spark, sf_dir), {"o_orderstatus": "F"}, {"$set": {"customer.segment": "CLOSED", "customer.nation.key": 99}}, "o_orderkey")
    return out.select("o_orderkey", "customer.name", "customer.segment", "customer.nation.key")


@query("SELECT c_custkey, CASE WHEN c_nationkey <> 1 THEN c_mktsegment END AS c_mktsegment FROM customer")
def update_unset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.update_many(customers(spark, sf_dir), {"c_nationkey": 1}, {"$unset": {"c_mktsegment": ""}}, "c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey + 100 ELSE c_nationkey END AS BIGINT) AS c_nationkey FROM customer")
def update_inc_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.update_many(customers(spark, sf_dir), {"c_mktsegment": "BUILDING"}, {"$inc": {"c_nationkey": 100}}, "c_custkey").select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, CASE WHEN c_nationkey >= 10 THEN c_nationkey + 0.5 ELSE c_nationkey END::DOUBLE AS c_nationkey FROM customer")
def update_inc_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.update_many(customers(spark, sf_dir), {"c_nationkey": {"$gte": 10}}, {"$inc": {"c_nationkey": 0.5}}, "c_custkey").select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 2 THEN CAST(3 AS BIGINT) END AS visits FROM customer")
def update_inc_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.update_many(customers(spark, sf_dir), {"c_nationkey": 2}, {"$inc": {"visits": 3}}, "c_custkey").select("c_custkey", "visits")


@query("SELECT c_custkey, CASE WHEN c_nationkey <> 4 THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_nationkey = 4 THEN c_mktsegment END AS segment FROM customer")
def update_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.update_many(customers(spark, sf_dir), {"c_nationkey": 4}, {"$rename": {"c_mktsegment": "segment"}}, "c_custkey").select("c_custkey", "c_mktsegment", "segment")


def parts_with_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_size") % 3 != 0, F.array("p_brand", "p_type")).alias("tags"))


_TAGS = "(SELECT p_partkey, p_size, CASE WHEN p_size % 3 <> 0 THEN p_brand || '|' || p_type END AS t FROM part)"


@query(f"SELECT p_partkey, CASE WHEN p_size > 20 THEN CASE WHEN t IS NULL THEN 'new' ELSE t || '|new' END ELSE t END AS tags FROM {_TAGS}")
def update_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.update_many(parts_with_tags(spark, sf_dir), {"p_size": {"$gt": 20}}, {"$push": {"tags": "new"}}, "p_partkey").select("p_partkey", F.array_join("tags", "|").alias("tags"))


@query(f"SELECT p_partkey, CASE WHEN p_size > 20 THEN CASE WHEN t IS NULL THEN 'new' ELSE 'new|' || t END ELSE t END AS tags FROM {_TAGS}")
def update_lpush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.update_many(parts_with_tags(spark, sf_dir), {"p_size": {"$gt": 20}}, {"$lpush": {"tags": "new"}}, "p_partkey").select("p_partkey", F.array_join("tags", "|").alias("tags"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN CASE WHEN p_size > 20 THEN p_brand ELSE p_brand || '|' || p_type END END AS tags FROM part")
def update_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.update_many(parts_with_tags(spark, sf_dir), {"p_size": {"$gt": 20}}, {"$pop": {"tags": 1}}, "p_partkey").select("p_partkey", F.array_join("tags", "|").alias("tags"))


@query("SELECT c_custkey, CAST(CASE WHEN c_nationkey = 6 THEN c_nationkey + 3 ELSE c_nationkey END AS BIGINT) AS c_nationkey, CASE WHEN c_nationkey = 6 THEN 'six' END AS note, CASE WHEN c_nationkey = 6 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_multi_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = {"$inc": {"c_nationkey": 1}, "$set": {"note": "six"}, "c_mktsegment": "X"} | {"$rename": {"nothing": "more"}}
    out = M.update_many(customers(spark, sf_dir), {"c_nationkey": 6}, said, "c_custkey")
    return M.update_many(out, {"note": "six"}, {"$inc": {"c_nationkey": 2}}, "c_custkey").select("c_custkey", "c_nationkey", "note", "c_mktsegment")


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey = (SELECT min(s_suppkey) FROM supplier WHERE s_acctbal > 0) THEN 'first' ELSE NULL END AS mark FROM supplier")
def update_one_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.update_one(table(spark, sf_dir, "supplier"), {"s_acctbal": {"$gt": 0}}, {"mark": "first"}, "s_suppkey").select("s_suppkey", "s_name", "mark")


@query("SELECT count(*) FILTER (c_nationkey < 10) AS matched, count(*) FILTER (c_nationkey < 10 AND c_mktsegment <> 'BUILDING') AS modified FROM customer")
def update_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.affected(customers(spark, sf_dir), {"c_nationkey": {"$lt": 10}}, {"c_mktsegment": "BUILDING"}, "c_custkey")


@query("SELECT s_suppkey, CASE WHEN f THEN 'replaced' ELSE s_name END AS s_name, CASE WHEN NOT f THEN s_nationkey END AS s_nationkey, CASE WHEN NOT f THEN s_acctbal END AS s_acctbal FROM (SELECT *, s_suppkey = (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey > 3) AS f FROM supplier)")
def replace_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.replace_one(table(spark, sf_dir, "supplier"), {"s_nationkey": {"$gt": 3}}, {"s_suppkey": 0, "s_name": "replaced"}, "s_suppkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey <> (SELECT min(s_suppkey) FROM supplier WHERE s_acctbal > 1000)")
def delete_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.delete_one(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), {"s_acctbal": {"$gt": 1000}}, "s_suppkey").select("s_suppkey")


@query(f"SELECT doc_id, lang, quality FROM {_LABELLED} WHERE quality IS NULL OR quality <> 0")
def delete_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.delete_many(labelled(spark, sf_dir), {"quality": 0}).select("doc_id", "lang", "quality")


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as customers: half of their keys are customers' already, half are new."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).otherwise(F.col("s_suppkey") + 100_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))


_NEW = "(SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE s_suppkey + 100000000 END AS k, s_name, s_acctbal FROM supplier)"


@query(f"SELECT {_C} FROM customer WHERE c_custkey NOT IN (SELECT k FROM {_NEW}) UNION ALL SELECT k, s_name, NULL, s_acctbal, NULL FROM {_NEW}")
def upsert_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.upsert_many(customers(spark, sf_dir), incoming(spark, sf_dir), "c_custkey")


@query(f"SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(s_name, c_name) AS c_name, c_nationkey, coalesce(s_acctbal, c_acctbal) AS c_acctbal, c_mktsegment FROM customer FULL JOIN {_NEW} ON c_custkey = k")
def merge_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_many(customers(spark, sf_dir), incoming(spark, sf_dir), "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, CAST(max(o_orderkey) AS VARCHAR) FROM orders GROUP BY o_custkey")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").cast("string").alias("c_name"), F.col("o_orderkey").alias("n"))
    return M.upsert_many(customers(spark, sf_dir).select("c_custkey", "c_name"), new, "c_custkey", "n")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 1000, n_name FROM nation")
def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000).alias("r_regionkey"), F.col("n_name").alias("r_name"))
    return M.insert_many(table(spark, sf_dir, "region"), new, "r_regionkey")


# Scalar functions


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, make_timestamp(epoch_us(ts) // 1000 * 1000) AS at FROM events WHERE event_type = 'error'")
def scalar_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = find(table(spark, sf_dir, "events"), {"event_type": "error"}, FindOptions(columns=["ts"]), "event_id")
    ms = scalars.millis(F.col("ts").cast("timestamp"))
    return e.select("event_id", ms.alias("ms"), scalars.datetime(ms).cast("timestamp_ntz").alias("at"))


@query("SELECT p_partkey, lower(hex(encode(p_name))) AS hex, octet_length(encode(p_name)) AS n FROM part")
def scalar_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = scalars.binary(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.hex_of(raw).alias("hex"), scalars.length_of(raw).cast("long").alias("n"))


# Expiry


def expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("ttl"))


_NOW = dt.datetime(2024, 1, 20, tzinfo=dt.timezone.utc)


@query("SELECT event_id, event_type FROM events WHERE NOT (ts + INTERVAL 7 DAYS < TIMESTAMP '2024-01-20 00:00:00')")
def ttl_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible(expiring(spark, sf_dir), "ttl", _NOW).select("event_id", "event_type")


@query("SELECT count(*) AS count FROM events WHERE ts + INTERVAL 7 DAYS < TIMESTAMP '2024-01-20 00:00:00'")
def ttl_purge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(expired(expiring(spark, sf_dir), "ttl", _NOW))


# Grouped conversations, and transactions with hooks


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns FROM conversations GROUP BY conv_id HAVING bool_or(role = 'system') OR count(*) >= 6")
def conversation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    docs = c.groupBy("conv_id").agg(F.collect_list("role").alias("roles"), F.count("*").alias("turns"), F.count(F.when(F.col("role") == "user", 1)).alias("user_turns"))
    return find(docs, {"$or": [{"roles": "system"}, {"turns": {"$gte": 6}}]}, FindOptions(columns=["turns", "user_turns"]), "conv_id")


@query("SELECT n_nationkey || ':updated' AS _id, 'updated' AS action, n_nationkey AS doc_id FROM nation WHERE n_regionkey = 1")
def trigger_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.sources.demo import audited_update

    return audited_update(spark, table(spark, sf_dir, "nation"))


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 0")
def validator_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.sources.demo import validated_insert

    return validated_insert(spark, table(spark, sf_dir, "region"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'ASIA:' || n_name ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 0 UNION ALL SELECT 500, 'NEW'")
def transaction_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.sources.demo import committed_changes

    return committed_changes(spark, table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


# Stores: keyed writes with triggers, batches, expiry, catalog, ranges, hooks


@query("SELECT * FROM (VALUES ('3:updating', (SELECT n_name FROM nation WHERE n_nationkey = 3)), ('3:updated', 'NEW 3'), ('500:inserting', 'NEW 500'), ('500:inserted', 'NEW 500'), ('1003', 'copy'), ('1500', 'copy')) t(_id, name)")
def trigger_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.sources.demo import upserted_with_trigger

    return upserted_with_trigger(spark, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


@query("SELECT r_regionkey || ':updating' AS _id FROM region WHERE r_regionkey IN (1, 2) UNION ALL SELECT r_regionkey || ':updated' FROM region WHERE r_regionkey = 2 OR (r_regionkey = 1 AND r_name <> 'AMERICA')")
def merge_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.sources.demo import merged_without_change

    return merged_without_change(spark, table(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@query("SELECT o_custkey, coalesce(max_by(o_totalprice, o_orderkey) FILTER (o_orderkey % 2 = 0), max_by(o_totalprice, o_orderkey)) AS o_totalprice FROM orders GROUP BY o_custkey")
def upsert_batch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.sources.demo import upserted_by_order

    return upserted_by_order(spark, table(spark, sf_dir, "orders"))


_LATER = dt.datetime(2024, 1, 28, tzinfo=dt.timezone.utc)


@query(
    "SELECT count(*) FILTER (NOT ts + INTERVAL 7 DAYS < TIMESTAMP '2024-01-28 00:00:00') AS left_over, count(*) FILTER (ts + INTERVAL 7 DAYS < TIMESTAMP '2024-01-20 00:00:00') AS purged, "
    "count(*) FILTER (ts + INTERVAL 7 DAYS >= TIMESTAMP '2024-01-20 00:00:00' AND ts + INTERVAL 7 DAYS < TIMESTAMP '2024-01-28 00:00:00') AS purged_before FROM events"
)
def ttl_purges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.sources.demo import purged

    return purged(spark, expiring(spark, sf_dir), _NOW, _LATER)


@query(
    "SELECT place, name, indexes, CASE WHEN name = 'default_cf/a' THEN (SELECT count(*) FROM region) ELSE 0 END AS documents FROM (VALUES ('store', 'default_cf/a', 'r_name,ttl'), ('store', 'other/a', 'ttl'), "
    "('backup', 'default_cf/a', 'r_name,ttl'), ('backup', 'default_cf/c', 'ttl'), ('backup', 'other/a', 'ttl')) t(place, name, indexes)"
)
def catalog_and_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.sources.demo import catalogued

    return catalogued(spark, table(spark, sf_dir, "region"))


@query("SELECT n_nationkey, n_name FROM nation WHERE NOT (n_nationkey >= 2 AND n_nationkey < 4) AND NOT (n_nationkey > 6 AND n_nationkey <= 8) AND n_nationkey < 22 AND n_nationkey >= 1")
def delete_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.sources.demo import ranges_deleted

    return ranges_deleted(spark, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


@query("SELECT * FROM (VALUES (0, 'a', 'inserting'), (1, 'z', 'inserting'), (2, 'a', 'inserted'), (3, 'z', 'inserted'), (4, 'a', 'updating'), (5, 'z', 'updating'), (6, 'a', 'updated'), (7, 'z', 'updated'), (8, 'a', 'deleting'), (9, 'a', 'deleted'), (10, 'udf', 'UDF!')) t(turn, name, action)")
def hook_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.sources.demo import hooks_in_order

    return hooks_in_order(spark)


# Distinct documents by a field, projection through scalars, literals, and scalar functions


@query("SELECT o_orderpriority || '|' || o_orderstatus AS value FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders ORDER BY o_orderpriority DESC, o_orderstatus DESC LIMIT 7)")
def distinct_docs_sorted_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("kind"))
    return distinct(docs, "kind", sort=-1, take=7, by="priority").select(F.concat_ws("|", "value.priority", "value.status").alias("value"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def project_branch_over_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "customer"), {"c_nationkey": 3}, FindOptions(columns=["c_name.first.letter"]), "c_custkey")


@query("SELECT c_custkey, c_acctbal > 5000 AS rich FROM customer WHERE c_acctbal > 5000")
def find_bool_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").withColumn("rich", F.col("c_acctbal") > 5000)
    return find(rich, {"rich": True}, FindOptions(columns=["rich"]), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 7")
def find_eq_parsable_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "customer"), {"c_nationkey": "7"}, FindOptions(columns=[]), "c_custkey")


@query("SELECT r_regionkey FROM region WHERE r_regionkey = 2")
def find_added_field_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = M.update_many(table(spark, sf_dir, "region"), {"r_regionkey": 2}, {"r_mark": "x"}, "r_regionkey")
    return find(marked, {"r_mark": "x"}, FindOptions(columns=[]), "r_regionkey")


@query("SELECT DISTINCT p_size AS value FROM part")
def distinct_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct(table(spark, sf_dir, "part"), "p_size")


@query("SELECT l_orderkey, l_linenumber, CAST(l_orderkey + l_linenumber AS DOUBLE) AS total, l_quantity + 0.5 AS half FROM lineitem")
def scalar_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", scalars.add(F.col("l_orderkey"), F.col("l_linenumber")).alias("total"), (F.col("l_quantity") + 0.5).alias("half"))


@query("SELECT event_id, printf('%024x', event_id) AS hex, 12 AS n, true AS is_id, false AS is_not, true AS is_time FROM events")
def scalar_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("oid", scalars.objectid(F.lower(F.lpad(F.hex("event_id"), 24, "0"))))
    return rows.select(
        "event_id", scalars.hex_of(F.col("oid")).alias("hex"), scalars.length_of(F.col("oid")).alias("n"), scalars.is_objectid(F.col("oid")).alias("is_id"),
        scalars.is_objectid(scalars.binary(F.col("event_type"))).alias("is_not"), scalars.is_datetime(F.col("ts")).alias("is_time"),
    )
