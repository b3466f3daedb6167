"""The query catalogue over the driver's tables: pipelines with equivalent SQL.

Every entry names a table, a pipeline (or a function) and the SQL that gives
the same rows.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.stages import aggregate

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """name to DataFrame of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def add(name: str, table: str, pipeline: list[dict[str, Any]], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = Tables(spark, sf_dir)
        return aggregate(tables(table), pipeline, tables)

    QUERIES[name] = run
    ORACLES[name] = sql


def keep(*names: str, **computed: Any) -> dict[str, Any]:
    return {"$project": {"_id": 0, **dict.fromkeys(names, 1), **computed}}


# ------------------------------------------------------------------ filters

_ORDER = keep("o_orderkey", "o_orderstatus", "o_totalprice")


def _filter(name: str, query: dict, where: str) -> None:
    add(name, "orders", [{"$match": query}, _ORDER], f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE {where}")


_filter("f_eq", {"o_orderstatus": "F"}, "o_orderstatus = 'F'")
_filter("f_all", {}, "true")
_filter("f_eq_operator", {"o_custkey": {"$eq": 42}}, "o_custkey = 42")
_filter("f_regex_literal", {"o_orderpriority": re.compile("urgent$", re.I)}, "regexp_matches(o_orderpriority, '(?i)urgent$')")
_filter("f_regex_unknown_group", {"o_orderpriority": {"$regex": "(?P<a>U)"}}, "false")
_filter("f_ne", {"o_orderstatus": {"$ne": "F"}}, "o_orderstatus <> 'F'")
_filter("f_gt", {"o_totalprice": {"$gt": 250000}}, "o_totalprice > 250000")
_filter("f_gte", {"o_orderkey": {"$gte": 5000}}, "o_orderkey >= 5000")
_filter("f_lt", {"o_totalprice": {"$lt": 50000.5}}, "o_totalprice < 50000.5")
_filter("f_lte", {"o_orderkey": {"$lte": 100}}, "o_orderkey <= 100")
_filter("f_in", {"o_orderstatus": {"$in": ["F", "P"]}}, "o_orderstatus IN ('F', 'P')")
_filter("f_nin", {"o_orderstatus": {"$nin": ["F", "P"]}}, "o_orderstatus NOT IN ('F', 'P')")
_filter("f_exists", {"o_totalprice": {"$exists": True}, "no_such_field": {"$exists": False}}, "o_totalprice IS NOT NULL")
_filter("f_regex", {"o_orderpriority": {"$regex": "^[12]-"}}, "regexp_matches(o_orderpriority, '^[12]-')")
_filter("f_regex_i", {"o_orderpriority": {"$regex": "HIGH|urgent", "$options": "i"}}, "regexp_matches(o_orderpriority, 'HIGH|urgent', 'i')")
_filter("f_and", {"$and": [{"o_orderstatus": "O"}, {"o_totalprice": {"$gt": 100000}}]}, "o_orderstatus = 'O' AND o_totalprice > 100000")
_filter("f_or", {"$or": [{"o_orderstatus": "P"}, {"o_orderkey": {"$lt": 50}}]}, "o_orderstatus = 'P' OR o_orderkey < 50")
_filter("f_expr", {"$expr": {"$gt": [{"$mod": ["$o_orderkey", 10]}, 7]}}, "o_orderkey % 10 > 7")
_filter("f_range_multi", {"o_totalprice": {"$gte": 1000, "$lt": 20000}}, "o_totalprice >= 1000 AND o_totalprice < 20000")
_filter("f_type_mismatch", {"$or": [{"o_orderstatus": {"$gt": 5}}, {"o_orderkey": 7}]}, "o_orderkey = 7")
_filter("f_options_alone", {"o_orderkey": {"$options": "i", "$lt": 20}}, "o_orderkey < 20")
add("f_array_contains", "documents", [{"$set": {"w": {"$split": ["$text", " "]}}}, {"$match": {"w": "the"}}, keep("doc_id")], "SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the')")
add("f_array_in", "documents", [{"$set": {"w": {"$split": ["$text", " "]}}}, {"$match": {"w": {"$in": ["der", "que"]}}}, keep("doc_id")], "SELECT doc_id FROM documents WHERE list_has_any(string_split(text, ' '), ['der', 'que'])")
add("f_array_index", "documents", [{"$set": {"w": {"$split": ["$text", " "]}}}, {"$match": {"w.1": {"$exists": True}}}, keep("doc_id")], "SELECT doc_id FROM documents WHERE len(string_split(text, ' ')) > 1")
add("f_nested_path", "nation", [{"$set": {"a": {"b": {"c": "$n_regionkey"}}}}, {"$match": {"a.b.c": {"$gt": 2}}}, keep("n_nationkey")], "SELECT n_nationkey FROM nation WHERE n_regionkey > 2")

# ------------------------------------------------------------------ stages

add("s_sort_limit", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 100}, _ORDER], "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
add("s_skip_limit", "orders", [{"$sort": {"o_orderkey": 1}}, {"$skip": 100}, {"$limit": 50}, _ORDER], "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
add("s_project_incl", "customer", [{"$project": {"_id": 0, "c_name": 1, "c_custkey": True}}], "SELECT c_name, c_custkey FROM customer")
add("s_sort_missing", "orders", [{"$sort": {"nothing_here": -1, "o_orderkey": 1}}, {"$limit": 20}, _ORDER], "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20")
add("s_sort_only_missing", "nation", [{"$sort": {"nothing_here": 1}}, keep("n_nationkey")], "SELECT n_nationkey FROM nation")
add("s_project_no_id", "orders", [{"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}}}, {"$project": {"_id": 0}}], "SELECT CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY o_orderstatus")
add("s_project_only_id", "orders", [{"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}}}, {"$project": {"_id": 1}}], "SELECT DISTINCT o_orderstatus AS _id FROM orders")
add("s_project_excl", "customer", [{"$project": {"c_name": 0, "c_acctbal": False}}], "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
add("s_project_computed", "lineitem", [keep("l_orderkey", net={"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]})], "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
add("s_set", "supplier", [{"$set": {"s_acctbal": {"$add": ["$s_acctbal", 1.5]}, "twice": {"$multiply": ["$s_suppkey", 2]}}}], "SELECT s_suppkey, s_name, s_nationkey, s_acctbal + 1.5 AS s_acctbal, s_suppkey * 2 AS twice FROM supplier")
add("s_add_fields", "region", [{"$addFields": {"kind": "region"}}], "SELECT r_regionkey, r_name, 'region' AS kind FROM region")
add("s_unset", "part", [{"$unset": ["p_name", "p_type", "p_retailprice"]}], "SELECT p_partkey, p_brand, p_size FROM part")
add("s_count", "lineitem", [{"$match": {"l_quantity": {"$gt": 25}}}, {"$count": "n"}], "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25 HAVING count(*) > 0")
add("s_count_empty", "lineitem", [{"$match": {"l_quantity": {"$gt": 1000000}}}, {"$count": "n"}], "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 1000000 HAVING count(*) > 0")
add("s_sort_by_count", "customer", [{"$sortByCount": "$c_mktsegment"}], 'SELECT c_mktsegment AS _id, count(*) AS "count" FROM customer GROUP BY 1')
add("s_replace_root", "nation", [{"$replaceRoot": {"newRoot": {"name": "$n_name", "region": "$n_regionkey"}}}], "SELECT n_name AS name, n_regionkey AS region FROM nation")
add("s_replace_with", "nation", [{"$replaceWith": {"$mergeObjects": [{"key": "$n_nationkey", "x": 0}, {"x": "$n_regionkey"}]}}], "SELECT n_nationkey AS key, n_regionkey AS x FROM nation")
add("s_unwind", "documents", [{"$set": {"w": {"$split": ["$text", " "]}}}, {"$unwind": "$w"}, {"$group": {"_id": "$w", "n": {"$sum": 1}}}], "SELECT w AS _id, CAST(count(*) AS DOUBLE) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1")
add("s_unwind_index", "embeddings", [{"$unwind": {"path": "$embedding", "includeArrayIndex": "i"}}, {"$match": {"i": {"$lt": 3}}}, keep("vec_id", "i", x={"$round": ["$embedding", 4]})], "SELECT vec_id, CAST(i AS BIGINT) AS i, round(CAST(embedding[i + 1] AS DOUBLE) * 10000) / 10000 AS x FROM embeddings, (SELECT unnest(range(3)) AS i)")
add("s_unwind_preserve", "nation", [keep("n_nationkey", a={"$range": [0, "$n_regionkey"]}), {"$unwind": {"path": "$a", "preserveNullAndEmptyArrays": True}}], "SELECT n_nationkey, unnest(CASE WHEN n_regionkey = 0 THEN [NULL] ELSE range(CAST(n_regionkey AS BIGINT)) END) AS a FROM nation")
add("s_group_const", "orders", [{"$group": {"_id": None, "n": {"$sum": 1}, "top": {"$max": "$o_totalprice"}}}, keep("n", "top")], "SELECT CAST(count(*) AS DOUBLE) AS n, max(o_totalprice) AS top FROM orders")
add("s_group_document_key", "lineitem", [{"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "n": {"$sum": 1}}}, keep("n", flag="$_id.flag", status="$_id.status")], "SELECT l_returnflag AS flag, l_linestatus AS status, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2")

# ------------------------------------------------------------------ accumulators


def _group(name: str, accumulator: dict, sql: str, *before: dict) -> None:
    add(name, "orders", [*before, {"$group": {"_id": "$o_orderpriority", "x": accumulator}}], f"SELECT o_orderpriority AS _id, {sql} AS x FROM orders GROUP BY 1")


_group("g_sum", {"$sum": "$o_custkey"}, "CAST(sum(o_custkey) AS DOUBLE)")
_group("g_min", {"$min": "$o_totalprice"}, "min(o_totalprice)")
_group("g_max", {"$max": "$o_orderdate"}, "max(o_orderdate)")
_group("g_first", {"$first": "$o_totalprice"}, "arg_min(o_totalprice, o_orderkey)", {"$sort": {"o_orderkey": 1}})
_group("g_last", {"$last": "$o_totalprice"}, "arg_max(o_totalprice, o_orderkey)", {"$sort": {"o_orderkey": 1}})
add("g_push", "orders", [{"$sort": {"o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "all": {"$push": "$o_orderkey"}}}, {"$project": {"n": {"$size": "$all"}, "second": {"$ifNull": [{"$arrayElemAt": ["$all", 1]}, -1]}}}], "SELECT o_custkey AS _id, count(*) AS n, coalesce(list(o_orderkey ORDER BY o_orderkey)[2], -1) AS second FROM orders GROUP BY 1")
add("g_avg", "orders", [{"$group": {"_id": "$o_orderpriority", "a": {"$avg": "$o_totalprice"}}}, {"$project": {"x": {"$round": ["$a", 2]}}}], "SELECT o_orderpriority AS _id, round(avg(o_totalprice), 2) AS x FROM orders GROUP BY 1")

# ------------------------------------------------------------------ lookups

_NATION = {"from": "nation", "localField": "r_regionkey", "foreignField": "n_regionkey", "as": "nations"}
_CUSTOMER = {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}
_RICH = {"from": "customer", "let": {"k": "$o_custkey"}, "pipeline": [{"$match": {"c_acctbal": {"$gt": 5000}, "$expr": {"$eq": ["$c_custkey", "$$k"]}}}], "as": "c"}
add("l_eq", "region", [{"$lookup": _NATION}, keep("r_name", n={"$size": "$nations"})], "SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region")
add("l_eq_unwind", "orders", [{"$lookup": _CUSTOMER}, {"$unwind": "$c"}, keep("o_orderkey", name="$c.c_name")], "SELECT o_orderkey, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
add("l_eq_unmatched_preserve", "orders", [{"$set": {"o_custkey": {"$cond": [{"$eq": [{"$mod": ["$o_orderkey", 2]}, 0]}, "$o_custkey", -1]}}}, {"$lookup": _CUSTOMER}, {"$unwind": {"path": "$c", "preserveNullAndEmptyArrays": True}}, keep("o_orderkey", name={"$ifNull": ["$c.c_name", "none"]})], "SELECT o_orderkey, coalesce(c_name, 'none') AS name FROM orders LEFT JOIN customer ON c_custkey = CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE -1 END")
add("l_anti", "orders", [{"$set": {"k": {"$add": ["$o_custkey", 1000]}}}, {"$lookup": {**_CUSTOMER, "localField": "k"}}, {"$match": {"c": []}}, keep("o_orderkey")], "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey + 1000)")
add("l_semi", "orders", [{"$set": {"k": {"$add": ["$o_custkey", 1000]}}}, {"$lookup": {**_CUSTOMER, "localField": "k"}}, {"$match": {"c.0": {"$exists": True}}}, {"$unset": "c"}, keep("o_orderkey")], "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey + 1000)")
add("l_pipeline_eq", "orders", [{"$lookup": _RICH}, keep("o_orderkey", n={"$size": "$c"})], "SELECT o_orderkey, (SELECT count(*) FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000) AS n FROM orders")
add("l_pipeline_theta", "region", [{"$lookup": {"from": "nation", "let": {"r": "$r_regionkey"}, "pipeline": [{"$match": {"$expr": {"$lte": ["$n_regionkey", "$$r"]}}}], "as": "ns"}}, keep("r_name", n={"$size": "$ns"})], "SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey <= r_regionkey) AS n FROM region")
add("l_pipeline_group", "region", [{"$lookup": {"from": "nation", "let": {"r": "$r_regionkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$n_regionkey", "$$r"]}}}, {"$group": {"_id": None, "top": {"$max": "$n_name"}}}], "as": "g"}}, keep("r_name", top={"$getField": {"field": "top", "input": {"$arrayElemAt": ["$g", 0]}}})], "SELECT r_name, (SELECT max(n_name) FROM nation WHERE n_regionkey = r_regionkey) AS top FROM region")
add("l_pipeline_sort_limit", "region", [{"$lookup": {"from": "nation", "let": {"r": "$r_regionkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$n_regionkey", "$$r"]}}}, {"$sort": {"n_name": -1}}, {"$limit": 2}, {"$project": {"n_name": 1}}], "as": "g"}}, {"$unwind": "$g"}, keep("r_name", name="$g.n_name")], "SELECT r_name, n_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC) AS rn FROM nation) JOIN region ON n_regionkey = r_regionkey WHERE rn <= 2")
_STATUS = {"$group": {"_id": "$o_custkey", "n": {"$sum": 1}}}
add("l_pipeline_after_group", "orders", [_STATUS, {"$lookup": {"from": "customer", "let": {"k": "$_id", "n": "$n"}, "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$c_custkey", "$$k"]}, {"$gt": ["$c_nationkey", "$$n"]}]}}}, {"$project": {"c_name": 1, "more": {"$add": ["$c_nationkey", "$$n"]}}}], "as": "c"}}, {"$unwind": "$c"}, keep(k="$_id", name="$c.c_name", more="$c.more")], "SELECT o_custkey AS k, c_name AS name, c_nationkey + n AS more FROM (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey AND c_nationkey > n")
add("l_pipeline_repeated_let", "nation", [{"$lookup": {"from": "region", "let": {"r": "$n_regionkey"}, "pipeline": [{"$match": {"$expr": {"$lt": ["$r_regionkey", "$$r"]}}}, {"$sort": {"r_name": 1}}, {"$limit": 1}], "as": "r"}}, keep("n_name", first={"$getField": {"field": "r_name", "input": {"$first": "$r"}}}, n={"$size": "$r"})], "SELECT n_name, (SELECT min(r_name) FROM region WHERE r_regionkey < n_regionkey) AS first, (SELECT least(1, count(*)) FROM region WHERE r_regionkey < n_regionkey) AS n FROM nation")
add("l_array_after_sort", "nation", [{"$sort": {"n_name": 1}}, {"$set": {"ks": ["$n_regionkey", 0, "$n_nationkey"]}}, {"$lookup": {"from": "region", "localField": "ks", "foreignField": "r_regionkey", "as": "rs"}}, keep("n_name", n={"$size": "$rs"})], "SELECT n_name, (SELECT count(*) FROM region WHERE r_regionkey IN (n_regionkey, 0, n_nationkey)) AS n FROM nation")
add("l_array_local", "nation", [{"$set": {"ks": ["$n_regionkey", 0]}}, {"$lookup": {"from": "region", "localField": "ks", "foreignField": "r_regionkey", "as": "rs"}}, keep("n_nationkey", n={"$size": "$rs"})], "SELECT n_nationkey, (SELECT count(*) FROM region WHERE r_regionkey = n_regionkey OR r_regionkey = 0) AS n FROM nation")
add("l_uncorrelated", "region", [{"$lookup": {"from": "nation", "pipeline": [{"$match": {"n_nationkey": {"$lt": 7}}}], "as": "ns"}}, keep("r_name", n={"$size": "$ns"})], "SELECT r_name, (SELECT count(*) FROM nation WHERE n_nationkey < 7) AS n FROM region")
add("l_null_keys", "nation", [{"$set": {"k": {"$cond": [{"$gt": ["$n_regionkey", 2]}, "$n_regionkey", None]}}}, {"$lookup": {"from": "region", "localField": "k", "foreignField": "r_regionkey", "as": "rs"}}, keep("n_nationkey", n={"$size": "$rs"})], "SELECT n_nationkey, CAST(CASE WHEN n_regionkey > 2 THEN 1 ELSE 0 END AS BIGINT) AS n FROM nation")

# ------------------------------------------------------------------ expressions


def _expr(name: str, table: str, key: str, spec: Any, sql: str) -> None:
    add("e_" + name, table, [keep(key, x=spec)], f"SELECT {key}, {sql} AS x FROM {table}")


def _o(name: str, spec: Any, sql: str) -> None:
    _expr(name, "orders", "o_orderkey", spec, sql)


def _n(name: str, spec: Any, sql: str) -> None:
    _expr(name, "nation", "n_nationkey", spec, sql)


def _d(name: str, spec: Any, sql: str) -> None:
    _expr(name, "documents", "doc_id", spec, sql)


_NULLED, _NULLED_SQL = {"$cond": [{"$gt": ["$n_regionkey", 2]}, "$n_regionkey", None]}, "CASE WHEN n_regionkey > 2 THEN n_regionkey END"
_o("path", "$o_totalprice", "o_totalprice")
add("e_constant", "orders", [{"$set": {"x": 5}}, keep("o_orderkey", "x")], "SELECT o_orderkey, 5 AS x FROM orders")
_o("object", {"$getField": {"field": "b", "input": {"a": 1, "b": "$o_custkey"}}}, "o_custkey")
_o("array", {"$arrayElemAt": [["$o_orderkey", "$o_custkey"], 1]}, "o_custkey")
_o("literal", {"$literal": "$not_a_path"}, "'$not_a_path'")
_n("ifnull", {"$ifNull": [_NULLED, -1]}, f"coalesce({_NULLED_SQL}, -1)")
_o("add", {"$add": ["$o_orderkey", "$o_custkey", 3]}, "o_orderkey + o_custkey + 3")
_o("subtract", {"$subtract": ["$o_totalprice", "$o_custkey"]}, "o_totalprice - o_custkey")
_o("multiply", {"$multiply": ["$o_orderkey", 2.5]}, "o_orderkey * CAST(2.5 AS DOUBLE)")
_n("divide", {"$divide": ["$n_nationkey", "$n_regionkey"]}, "CASE WHEN n_regionkey <> 0 THEN CAST(n_nationkey AS DOUBLE) / n_regionkey END")
_o("mod", {"$mod": [{"$subtract": ["$o_custkey", 700]}, 7]}, "CAST(o_custkey - 700 AS DOUBLE) % 7")
_o("abs", {"$abs": {"$subtract": ["$o_custkey", 700]}}, "CAST(abs(o_custkey - 700) AS DOUBLE)")
_o("ceil", {"$ceil": "$o_totalprice"}, "ceil(o_totalprice)")
_o("floor", {"$floor": ["$o_totalprice"]}, "floor(o_totalprice)")
_o("trunc", {"$trunc": {"$subtract": ["$o_totalprice", 250000]}}, "trunc(o_totalprice - 250000)")
_o("round", {"$round": [{"$divide": ["$o_totalprice", 7]}, 1]}, "round(o_totalprice / 7 * 10) / 10")
_n("log_base_one", {"$log": [{"$add": ["$n_regionkey", 0.5]}, 1]}, "CASE WHEN n_regionkey = 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END")
_n("floor_large", {"$floor": {"$multiply": ["$n_nationkey", 1e20]}}, "n_nationkey * 1e20")
_n("ceil_infinite", {"$ceil": {"$exp": {"$multiply": ["$n_nationkey", 1000]}}}, "CASE WHEN n_nationkey = 0 THEN 1.0 ELSE CAST('inf' AS DOUBLE) END")
_n("strlen_wide", {"$strLenBytes": {"$concat": ["é€", "$n_name"]}}, "CAST(strlen('é€' || n_name) AS BIGINT)")
_n("substr_wide", {"$substr": [{"$concat": ["é€", "$n_name"]}, 2, 3]}, "'€'")
_n("arraytoobject_dynamic", {"$getField": {"field": "k", "input": {"$arrayToObject": [{"$concatArrays": [[["k", "$n_name"]], [["k", "last"]]]}]}}}, "'last'")
_n("pow", {"$pow": ["$n_nationkey", 2]}, "pow(CAST(n_nationkey AS DOUBLE), 2)")
_o("sqrt", {"$round": [{"$sqrt": "$o_totalprice"}, 6]}, "round(sqrt(o_totalprice) * 1e6) / 1e6")
_n("exp", {"$round": [{"$exp": "$n_regionkey"}, 6]}, "round(exp(n_regionkey) * 1e6) / 1e6")
_o("ln", {"$round": [{"$ln": "$o_totalprice"}, 6]}, "round(ln(o_totalprice) * 1e6) / 1e6")
_o("log10", {"$round": [{"$log10": "$o_totalprice"}, 6]}, "round(log10(o_totalprice) * 1e6) / 1e6")
_o("log", {"$round": [{"$log": ["$o_totalprice", 2]}, 6]}, "round(ln(o_totalprice) / ln(2) * 1e6) / 1e6")
_o("eq", {"$eq": ["$o_orderstatus", "F"]}, "o_orderstatus = 'F'")
_o("ne", {"$ne": ["$o_orderstatus", "F"]}, "o_orderstatus <> 'F'")
_o("gt", {"$gt": ["$o_totalprice", "$o_custkey"]}, "o_totalprice > o_custkey")
_o("gte", {"$gte": ["$o_custkey", 500]}, "o_custkey >= 500")
_n("lt", {"$lt": [_NULLED, 4]}, f"coalesce({_NULLED_SQL} < 4, false)")
_o("lte", {"$lte": ["$o_orderstatus", "O"]}, "o_orderstatus <= 'O'")
_o("cond", {"$cond": {"if": {"$gt": ["$o_totalprice", 100000]}, "then": "big", "else": "small"}}, "CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END")
_o("switch", {"$switch": {"branches": [{"case": {"$eq": ["$o_orderstatus", "F"]}, "then": 1}, {"case": {"$eq": ["$o_orderstatus", "O"]}, "then": 2}], "default": 0}}, "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END")
_n("and", {"$and": ["$n_regionkey", {"$lt": ["$n_nationkey", 20]}]}, "n_regionkey <> 0 AND n_nationkey < 20")
_n("or", {"$or": ["$n_regionkey", {"$lt": ["$n_nationkey", 3]}]}, "n_regionkey <> 0 OR n_nationkey < 3")
_n("not", {"$not": ["$n_regionkey"]}, "n_regionkey = 0")
_o("concat", {"$concat": ["$o_orderstatus", "/", "$o_orderpriority"]}, "o_orderstatus || '/' || o_orderpriority")
_o("tostring", {"$toString": "$o_orderkey"}, "CAST(o_orderkey AS VARCHAR)")
_o("tostring_double", {"$toString": "$o_totalprice"}, "printf('%.6f', o_totalprice)")
_d("tolower", {"$toLower": {"$substr": ["$lang", 0, 5]}}, "lower(lang)")
_o("toupper", {"$toUpper": "$o_orderpriority"}, "upper(o_orderpriority)")
_n("trim", {"$trim": {"input": {"$concat": ["  ", "$n_name", "\t"]}}}, "n_name")
_n("trim_chars", {"$trim": {"input": {"$concat": ["xyx", {"$toString": "$n_nationkey"}, "y"]}, "chars": "xy"}}, "CAST(n_nationkey AS VARCHAR)")
_o("substr", {"$substr": ["$o_orderpriority", 2, 3]}, "substring(o_orderpriority, 3, 3)")
_o("substrbytes", {"$substrBytes": ["$o_orderpriority", 1, -1]}, "substring(o_orderpriority, 2)")
_o("substrcp", {"$substrCP": ["$o_orderpriority", 100, 1]}, "''")
_d("split", {"$size": {"$split": ["$text", "."]}}, "CAST(len(string_split(text, '.')) AS BIGINT)")
_d("strlenbytes", {"$strLenBytes": "$text"}, "CAST(strlen(text) AS BIGINT)")
_d("strlencp", {"$strLenCP": "$text"}, "CAST(strlen(text) AS BIGINT)")
_o("toint", {"$toInt": "$o_orderpriority"}, "CAST(regexp_extract(o_orderpriority, '^([0-9]+)', 1) AS BIGINT)")
_o("tolong", {"$toLong": "$o_totalprice"}, "CAST(trunc(o_totalprice) AS BIGINT)")
_o("todouble", {"$toDouble": {"$concat": [{"$toString": "$o_custkey"}, ".5kg"]}}, "o_custkey + CAST(0.5 AS DOUBLE)")
_n("tobool", {"$toBool": "$n_regionkey"}, "n_regionkey <> 0")
_n("type", {"$type": _NULLED}, "CASE WHEN n_regionkey > 2 THEN 'int' ELSE 'null' END")
_n("type_missing", {"$type": "$nothing_here"}, "'missing'")
_n("isnumber", {"$isNumber": _NULLED}, "n_regionkey > 2")
_expr("size", "embeddings", "vec_id", {"$size": "$embedding"}, "CAST(len(embedding) AS BIGINT)")
_expr("arrayelemat", "embeddings", "vec_id", {"$arrayElemAt": ["$embedding", -2]}, "embedding[-2]")
_expr("concatarrays", "embeddings", "vec_id", {"$size": {"$concatArrays": ["$embedding", "$embedding", [1.5]]}}, "CAST(len(embedding) * 2 + 1 AS BIGINT)")
_expr("slice", "embeddings", "vec_id", {"$first": {"$slice": ["$embedding", -3]}}, "embedding[-3]")
_expr("slice_position", "embeddings", "vec_id", {"$size": {"$slice": ["$embedding", 60, 10]}}, "CAST(4 AS BIGINT)")
_n("range", {"$size": {"$range": ["$n_regionkey", 20, 3]}}, "CAST(len(range(CAST(n_regionkey AS BIGINT), 20, 3)) AS BIGINT)")
_n("in", {"$in": ["$n_regionkey", [1, 3]]}, "n_regionkey IN (1, 3)")
_expr("isarray", "embeddings", "vec_id", {"$isArray": "$embedding"}, "true")
_expr("first", "embeddings", "vec_id", {"$first": "$embedding"}, "embedding[1]")
_expr("last", "embeddings", "vec_id", {"$last": "$embedding"}, "embedding[-1]")
_expr("reversearray", "embeddings", "vec_id", {"$arrayElemAt": [{"$reverseArray": "$embedding"}, 0]}, "embedding[-1]")
_n("sum", {"$sum": {"$range": [0, "$n_nationkey"]}}, "CAST(n_nationkey * (n_nationkey - 1) // 2 AS BIGINT)")
_n("avg", {"$avg": [["$n_nationkey", 3, None]]}, "(n_nationkey + 3) / CAST(2 AS DOUBLE)")
_expr("min", "embeddings", "vec_id", {"$min": "$embedding"}, "list_min(embedding)")
_expr("max", "embeddings", "vec_id", {"$max": "$embedding"}, "list_max(embedding)")
_n("mergeobjects", {"$getField": {"field": "a", "input": {"$mergeObjects": [{"a": 1}, {"a": "$n_regionkey"}]}}}, "n_regionkey")
_n("objecttoarray", {"$getField": {"field": "k", "input": {"$arrayElemAt": [{"$objectToArray": {"p": 1, "q": "$n_nationkey"}}, 1]}}}, "'q'")
_n("arraytoobject", {"$getField": {"field": "q", "input": {"$arrayToObject": [[["p", 1], ["q", "$n_nationkey"]]]}}}, "n_nationkey")
_n("getfield", {"$getField": "n_name"}, "n_name")
_n("root", {"$getField": {"field": "n_name", "input": "$$ROOT"}}, "n_name")

# ------------------------------------------------------------------ updates


def _change(name: str, table: str, change: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: change(Tables(spark, sf_dir)(table))
    ORACLES[name] = sql


def _updates() -> None:
    from foliant.operators import updates as u

    _change("u_set", "supplier", lambda df: u.update(df, {"s_nationkey": {"$lt": 5}}, {"$set": {"s_name": "near", "flag": True}}), "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'near' ELSE s_name END AS s_name, s_nationkey, s_acctbal, CASE WHEN s_nationkey < 5 THEN true END AS flag FROM supplier")
    _change("u_unset", "supplier", lambda df: u.update(df, {"s_nationkey": {"$lt": 5}}, {"$unset": {"s_acctbal": ""}}), "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey >= 5 THEN s_acctbal END AS s_acctbal FROM supplier")
    _change("u_inc", "supplier", lambda df: u.update(df, {"s_suppkey": {"$gt": 10}}, {"$inc": {"s_suppkey": 1000, "s_acctbal": 0.5}}), "SELECT CASE WHEN s_suppkey > 10 THEN s_suppkey + 1000 ELSE s_suppkey END AS s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey > 10 THEN s_acctbal + 0.5 ELSE s_acctbal END AS s_acctbal FROM supplier")
    _change("u_replace", "region", lambda df: u.update(df, {"r_name": {"$regex": "^A"}}, {"r_name": "gone"}), "SELECT CASE WHEN r_name NOT LIKE 'A%' THEN r_regionkey END AS r_regionkey, CASE WHEN r_name LIKE 'A%' THEN 'gone' ELSE r_name END AS r_name FROM region")
    _change("u_upsert", "region", lambda df: u.upserted(df, {"r_regionkey": 99}, {"$set": {"r_name": "NEW"}}), "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NEW'")
    _change("u_update_one", "region", lambda df: u.update(df.withColumn("_o", F.col("r_regionkey")), {"r_regionkey": {"$gte": 2}}, {"$set": {"r_name": "one"}}, many=False, order="_o").drop("_o"), "SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'one' ELSE r_name END AS r_name FROM region")
    _change("u_delete", "customer", lambda df: u.delete(df, {"c_acctbal": {"$lt": 0}}), "SELECT * FROM customer WHERE NOT c_acctbal < 0")
    _change("u_delete_one", "region", lambda df: u.delete(df.withColumn("_o", F.col("r_regionkey")), {"r_regionkey": {"$gt": 1}}, many=False, order="_o").drop("_o"), "SELECT * FROM region WHERE r_regionkey <> 2")


_updates()

# ------------------------------------------------------------------ reads of a stored collection


def _find(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.sources.collection import Cursor

    return Cursor(Tables(spark, sf_dir)("orders"), {"o_orderstatus": "O"}, False).sort({"o_totalprice": -1, "o_orderkey": 1}).skip(10).limit(40).project({"_id": 0, "o_orderkey": 1, "o_totalprice": 1}).to_df()


QUERIES["c_find"] = _find
ORACLES["c_find"] = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 10"

# every one makes a database of its own below the shared folder, in memory for c_memory

_FOLDERS: list[tuple[SparkSession, str]] = []


def _database(spark: SparkSession, memory: bool = False) -> Any:
    from foliant.sources import Database

    if memory:
        return Database(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
    path = f"{root.rstrip('/')}/foliant-collections-{uuid.uuid4().hex}"
    _FOLDERS.append((spark, path))
    return Database(spark, path)


@atexit.register
def _clean() -> None:
    for spark, path in _FOLDERS:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass


def _stored(name: str, table: str, work: Callable[[Any, Any, SparkSession], DataFrame], sql: str, memory: bool = False) -> None:
    """work gets the collection that holds the table, its database and the session."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = _database(spark, memory)
        db.collection(table).insert_df(Tables(spark, sf_dir)(table))
        return work(db.collection(table), db, spark)

    QUERIES[name] = run
    ORACLES[name] = sql


def _figures(spark: SparkSession, **figures: int) -> DataFrame:
    return spark.createDataFrame(sorted(figures.items()), "what string, n long")


def _figures_sql(**figures: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS what, CAST(({v}) AS BIGINT) AS n" for k, v in figures.items())


def _documents_of(c: Any, spark: SparkSession, **more: int) -> DataFrame:
    return _figures(spark, rows=c.to_df().count(), **more)


def _collections() -> None:
    def insert(c: Any, db: Any, spark: SparkSession) -> DataFrame:
        c.insert_many([{"n_nationkey": 100, "n_name": "ATLANTIS", "n_regionkey": 9}, {"n_nationkey": 101, "n_name": "LEMURIA", "n_regionkey": 9}])
        c.insert_one({"n_nationkey": 102, "n_name": "MU", "n_regionkey": 2})
        return c.to_df()

    _stored("c_insert", "nation", insert, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM (SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL VALUES (100, 'ATLANTIS', 9), (101, 'LEMURIA', 9), (102, 'MU', 2))")
    _stored("c_scan", "orders", lambda c, db, spark: c.find({}).to_df(), "SELECT * FROM orders")
    _stored("c_find_one", "nation", lambda c, db, spark: spark.createDataFrame([c.find_one({"n_regionkey": {"$eq": 2}})], "n_nationkey int, n_name string, n_regionkey int"), "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2 ORDER BY n_nationkey LIMIT 1")
    _stored("c_aggregate", "orders", lambda c, db, spark: c.aggregate_df([{"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}}}]), "SELECT o_orderstatus AS _id, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1")
    _stored("c_memory", "customer", lambda c, db, spark: (c.update_many({"c_nationkey": {"$lt": 3}}, {"$set": {"c_mktsegment": "near"}}), c.to_df())[1], "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_nationkey < 3 THEN 'near' ELSE c_mktsegment END AS c_mktsegment FROM customer", memory=True)

    def update(c: Any, db: Any, spark: SparkSession) -> DataFrame:
        many = c.update_many({"s_nationkey": {"$lt": 5}}, {"$set": {"s_name": "near"}, "$inc": {"s_acctbal": 1}})
        same = c.update_many({"s_name": "near"}, {"$set": {"s_name": "near"}})
        return _figures(spark, matched=many["matched"], modified=many["modified"], again_matched=same["matched"], again_modified=same["modified"], total=round(c.to_df().agg(F.sum("s_acctbal")).first()[0]))

    near = "SELECT count(*) FROM supplier WHERE s_nationkey < 5"
    _stored("c_update_many", "supplier", update, _figures_sql(matched=near, modified=near, again_matched=near, again_modified="0", total="SELECT round(sum(s_acctbal + CASE WHEN s_nationkey < 5 THEN 1 ELSE 0 END)) FROM supplier"))
    _stored("c_update_one", "nation", lambda c, db, spark: (c.update_one({"n_regionkey": 1}, {"$set": {"n_name": "first"}}), c.to_df())[1], "SELECT n_nationkey, CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 1) THEN 'first' ELSE n_name END AS n_name, n_regionkey FROM nation")
    _stored("c_upsert", "region", lambda c, db, spark: (c.update_one({"r_regionkey": 77}, {"$set": {"r_name": "NOWHERE", "_id": "x"}}, upsert=True), c.find({}).project({"_id": 0}).to_df())[1], "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region UNION ALL SELECT 77, 'NOWHERE'")
    _stored("c_delete", "customer", lambda c, db, spark: (lambda many, one: _documents_of(c, spark, many=many, one=one))(c.delete_many({"c_acctbal": {"$lt": 0}}), c.delete_one({"c_nationkey": 3})), _figures_sql(rows="SELECT count(*) - 1 FROM customer WHERE NOT c_acctbal < 0", many="SELECT count(*) FROM customer WHERE c_acctbal < 0", one="1"))

    def indexes(c: Any, db: Any, spark: SparkSession) -> DataFrame:
        from foliant.errors import DocumentError

        made = [c.create_index("by_key", "n_nationkey", unique=True), c.create_index("by_region", ["n_regionkey", "n_name"], cluster=True), c.create_index("by_key", "n_name")]
        try:
            c.insert_one({"n_nationkey": 3, "n_name": "again", "n_regionkey": 0})
            refused = 0
        except DocumentError:
            refused = 1
        entries = {f"entries_{i['name']}": i["entries"] for i in c.list_indexes()}
        dropped = [c.drop_index("by_key"), c.drop_index("by_key")]
        return _figures(spark, made=sum(made), refused=refused, dropped=sum(dropped), left=len(c.list_indexes()), **entries)

    n = "SELECT count(*) FROM nation"
    _stored("c_indexes", "nation", indexes, _figures_sql(made="2", refused="1", dropped="1", left="2", entries__id_=n, entries_by_key=n, entries_by_region=n))
    _stored("c_index_lookup", "orders", lambda c, db, spark: (c.create_index("by_customer", "o_custkey", cluster=True), c.find({"o_custkey": 42}).project({"_id": 0, "o_orderkey": 1, "o_custkey": 1}).to_df())[1], "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 42")

    def cursor(c: Any, db: Any, spark: SparkSession) -> DataFrame:
        key, batch = db.open_cursor("nation", c.find({}).batch_size(10))
        rows, at = [(0, d["n_nationkey"]) for d in batch], 0
        other, _ = db.open_cursor("nation", c.find({}).batch_size(1))
        while key:
            key, batch = db.get_more("nation", key)
            at += 1
            rows += [(at, d["n_nationkey"]) for d in batch]
        rows += [(-1, k) for k in range(len(db.kill_cursors([other, 999])))]
        return spark.createDataFrame(rows, "batch long, n_nationkey long")

    _stored("c_cursor", "nation", cursor, "SELECT CAST((row_number() OVER (ORDER BY n_nationkey) - 1) // 10 AS BIGINT) AS batch, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation UNION ALL SELECT -1, 0")


_collections()

# ------------------------------------------------------------------ composites

_NET = {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}


def flagship() -> list[dict[str, Any]]:
    return [
        {"$match": {"o_orderstatus": "F", "o_totalprice": {"$gt": 1000}}},
        {"$group": {"_id": "$o_orderpriority", "n": {"$sum": 1}, "total": {"$sum": "$o_totalprice"}, "avg": {"$avg": "$o_totalprice"}}},
        {"$set": {"total": {"$round": ["$total", 2]}, "avg": {"$round": ["$avg", 2]}}},
        {"$sort": {"_id": 1}},
    ]


add("q_priorities", "orders", flagship(), "SELECT o_orderpriority AS _id, CAST(count(*) AS DOUBLE) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS avg FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 GROUP BY 1")
add(
    "q_pricing_summary", "lineitem",
    [
        {"$group": {"_id": {"f": "$l_returnflag", "s": "$l_linestatus"}, "qty": {"$sum": "$l_quantity"}, "net": {"$sum": _NET}, "disc": {"$avg": "$l_discount"}, "n": {"$sum": 1}}},
        keep("qty", "n", f="$_id.f", s="$_id.s", net={"$round": ["$net", 0]}, disc={"$round": ["$disc", 6]}),
    ],
    "SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount))) AS net, round(avg(l_discount) * 1e6) / 1e6 AS disc, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2",
)
add(
    "q_shipping_priority", "lineitem",
    [
        {"$lookup": {"from": "orders", "localField": "l_orderkey", "foreignField": "o_orderkey", "as": "o"}}, {"$unwind": "$o"},
        {"$lookup": {"from": "customer", "localField": "o.o_custkey", "foreignField": "c_custkey", "as": "c"}}, {"$unwind": "$c"},
        {"$match": {"c.c_mktsegment": "BUILDING"}},
        {"$group": {"_id": "$l_orderkey", "net": {"$sum": _NET}}}, {"$set": {"net": {"$round": ["$net", 2]}}}, {"$sort": {"net": -1, "_id": 1}}, {"$limit": 10},
    ],
    "SELECT l_orderkey AS _id, round(sum(l_extendedprice * (1 - l_discount)) * 100) / 100 AS net FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY net DESC, _id LIMIT 10",
)
add(
    "q_nation_revenue", "lineitem",
    [
        {"$lookup": {"from": "supplier", "localField": "l_suppkey", "foreignField": "s_suppkey", "as": "s"}}, {"$unwind": "$s"},
        {"$lookup": {"from": "nation", "localField": "s.s_nationkey", "foreignField": "n_nationkey", "as": "n"}}, {"$unwind": "$n"},
        {"$group": {"_id": "$n.n_name", "net": {"$sum": _NET}}}, {"$set": {"net": {"$round": ["$net", 0]}}},
    ],
    "SELECT n_name AS _id, round(sum(l_extendedprice * (1 - l_discount))) AS net FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
)
add(
    "q_forecast", "lineitem",
    [{"$match": {"l_discount": {"$gte": 0.05, "$lte": 0.07}, "l_quantity": {"$lt": 24}}}, {"$group": {"_id": None, "x": {"$sum": {"$multiply": ["$l_extendedprice", "$l_discount"]}}}}, keep(x={"$round": ["$x", 0]})],
    "SELECT round(sum(l_extendedprice * l_discount)) AS x FROM lineitem WHERE l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24",
)
add(
    "q_event_types", "events", [{"$group": {"_id": "$event_type", "n": {"$sum": 1}, "first": {"$min": "$ts"}, "value": {"$max": "$value"}}}],
    "SELECT event_type AS _id, CAST(count(*) AS DOUBLE) AS n, min(ts) AS first, max(value) AS value FROM events GROUP BY 1",
)
add(
    "q_user_funnel", "events",
    [
        {"$group": {"_id": "$user_id", "views": {"$sum": {"$cond": [{"$eq": ["$event_type", "view"]}, 1, 0]}}, "buys": {"$sum": {"$cond": [{"$eq": ["$event_type", "purchase"]}, 1, 0]}}}},
        {"$match": {"buys": {"$gt": 0}}},
        {"$project": {"views": 1, "buys": 1, "rate": {"$round": [{"$divide": ["$views", "$buys"]}, 4]}}},
    ],
    "SELECT *, round(views / buys * 10000) / 10000 AS rate FROM (SELECT user_id AS _id, CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS views, CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS buys FROM events GROUP BY 1) WHERE buys > 0",
)
