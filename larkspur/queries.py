"""A query for each operator over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.collection import Collection
from .operators.database import Database
from .plans.filters import compile_filter
from .plans.update import apply_update

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
#: Keys that give a table's rows their natural order.
NATURAL = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"]}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def database(spark: SparkSession, sf_dir: str, *tables: str) -> Database:
    return Database.from_parquet(spark, sf_dir, list(tables) or TABLES, NATURAL)


def query(name: str, sql: str, *tables: str):
    def register(f: Callable[[Database], DataFrame]) -> None:
        QUERIES[name] = lambda spark, sf_dir: f(database(spark, sf_dir, *tables))
        SQL[name] = " ".join(sql.split())

    return register


def pipeline(name: str, sql: str, table: str, stages: list[dict], *more: str, after: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def run(db: Database) -> DataFrame:
        out = db.collection(table).aggregate(stages)
        return after(out) if after else out

    query(name, sql, table, *more)(run)


def matching(name: str, table: str, filter_: dict, where: str, columns: str) -> None:
    pipeline(name, f"SELECT {columns} FROM {table} WHERE {where}", table, [{"$match": filter_}, {"$project": {"_id": 0, **dict.fromkeys(columns.split(", "), 1)}}])


def joined(c: str, by: str = ",") -> F.Column:
    return F.array_join(F.transform(F.col(c), lambda x: F.coalesce(x.cast("string"), F.lit("null"))), by)


# filters

matching("match_eq", "orders", {"o_orderstatus": "F"}, "o_orderstatus = 'F'", "o_orderkey, o_totalprice")
matching("match_eq_operator", "orders", {"o_orderstatus": {"$eq": "O"}, "o_custkey": 7}, "o_orderstatus = 'O' AND o_custkey = 7", "o_orderkey, o_custkey")
matching("match_ne", "orders", {"o_orderpriority": {"$ne": "1-URGENT"}}, "o_orderpriority <> '1-URGENT'", "o_orderkey, o_orderpriority")
matching("match_nin", "orders", {"o_orderpriority": {"$nin": ["1-URGENT", "2-HIGH", None, 5]}}, "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", "o_orderkey, o_orderpriority")
matching("match_nin_not_a_list", "nation", {"n_name": {"$nin": "x"}}, "true", "n_nationkey, n_name")
matching("match_gt", "lineitem", {"l_extendedprice": {"$gt": 50000}}, "l_extendedprice > 50000", "l_orderkey, l_extendedprice")
matching("match_gte_lt", "lineitem", {"l_quantity": {"$gte": 10, "$lt": 20}}, "l_quantity >= 10 AND l_quantity < 20", "l_orderkey, l_quantity")
matching("match_lte", "lineitem", {"l_discount": {"$lte": 0.02}}, "l_discount <= 0.02", "l_orderkey, l_discount")
matching("match_int_against_double", "orders", {"o_orderkey": {"$gt": 99.5, "$lte": 200.5}}, "o_orderkey >= 100 AND o_orderkey <= 200", "o_orderkey, o_custkey")
matching("match_date", "orders", {"o_orderdate": {"$gte": {"$date": "1995-01-01T00:00:00Z"}, "$lt": {"$date": "1996-01-01T00:00:00Z"}}}, "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'", "o_orderkey, o_custkey")
matching("match_in", "customer", {"c_mktsegment": {"$in": ["BUILDING", "MACHINERY", 3, None]}}, "c_mktsegment IN ('BUILDING', 'MACHINERY')", "c_custkey, c_mktsegment")
matching("match_in_not_a_list", "nation", {"n_name": {"$in": "x"}}, "false", "n_nationkey, n_name")
matching("match_and_or", "part", {"$and": [{"p_size": {"$gt": 10}}, {"$or": [{"p_size": {"$lt": 20}}, {"p_retailprice": {"$gt": 1500}}]}]}, "p_size > 10 AND (p_size < 20 OR p_retailprice > 1500)", "p_partkey, p_size")
matching("match_nor", "part", {"$nor": [{"p_size": {"$gt": 10}}, {"p_brand": "Brand#11"}]}, "NOT (p_size > 10 OR p_brand = 'Brand#11')", "p_partkey, p_size")
matching("match_not", "part", {"$not": {"p_size": {"$gte": 10}}}, "NOT (p_size >= 10)", "p_partkey, p_size")
matching("match_not_of_a_field", "part", {"p_size": {"$not": {"$gte": 10}}}, "false", "p_partkey, p_size")
matching("match_empty_and_or", "region", {"$and": [], "$nor": [{"$or": []}]}, "true", "r_regionkey, r_name")
matching("match_exists", "nation", {"n_name": {"$exists": True}, "n_comment": {"$exists": False}, "n_regionkey": {"$exists": 0}}, "true", "n_nationkey, n_name")
matching("match_type", "nation", {"n_name": {"$type": "string"}, "n_nationkey": {"$type": 16}}, "true", "n_nationkey, n_name")
matching("match_type_other", "nation", {"n_name": {"$type": "number"}}, "false", "n_nationkey, n_name")
matching("match_regex", "part", {"p_name": {"$regex": "^(cold|blue)", "$options": "i"}}, "false", "p_partkey, p_name")
matching("match_regex_anchored", "part", {"p_name": {"$regex": "^cold"}}, "regexp_matches(p_name, '^cold')", "p_partkey, p_name")
matching("match_regex_bad", "part", {"p_name": {"$regex": "("}}, "false", "p_partkey, p_name")
matching("match_mod", "orders", {"o_orderkey": {"$mod": [7, 3]}}, "o_orderkey % 7 = 3", "o_orderkey, o_custkey")
matching("match_mod_double", "lineitem", {"l_extendedprice": {"$mod": [10.9, 4]}}, "CAST(trunc(l_extendedprice) AS BIGINT) % 10 = 4", "l_orderkey, l_extendedprice")
matching("match_string_above_number", "customer", {"c_name": {"$gt": 5}}, "true", "c_custkey, c_name")
matching("match_number_below_string", "customer", {"c_acctbal": {"$lt": "a", "$gt": None}}, "true", "c_custkey, c_acctbal")
matching("match_unknown_operator", "region", {"r_name": {"$near": 1}}, "false", "r_regionkey, r_name")
matching("match_empty_operators", "region", {"r_name": {}}, "true", "r_regionkey, r_name")
matching("match_plain_document", "region", {"r_name": {"k": 1}}, "false", "r_regionkey, r_name")
matching("match_missing_field", "region", {"r_comment": None}, "false", "r_regionkey, r_name")
matching("match_missing_field_ne", "region", {"r_comment": {"$ne": 3}}, "true", "r_regionkey, r_name")

#: documents with the label that some of them have: the rest get a null.
LABELLED = [{"$lookup": {"from": "labels", "localField": "doc_id", "foreignField": "doc_id", "as": "label"}}, {"$unwind": {"path": "$label", "preserveNullAndEmptyArrays": True}}, {"$addFields": {"quality": "$label.quality"}}, {"$project": {"doc_id": 1, "quality": 1, "_id": 0}}]
_LABELLED = "(SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))"
pipeline("match_null", f"SELECT doc_id, quality FROM {_LABELLED} WHERE quality IS NULL", "documents", [*LABELLED, {"$match": {"quality": None}}], "labels")
pipeline("match_null_is_below_numbers", f"SELECT doc_id, quality FROM {_LABELLED} WHERE quality < 1 OR quality IS NULL", "documents", [*LABELLED, {"$match": {"quality": {"$lt": 1}}}], "labels")
pipeline("match_null_ne", f"SELECT doc_id, quality FROM {_LABELLED} WHERE quality IS DISTINCT FROM 1", "documents", [*LABELLED, {"$match": {"quality": {"$ne": 1}}}], "labels")
pipeline("group_with_nulls", f"SELECT CAST(doc_id % 2 AS BIGINT) AS k, coalesce(sum(quality), 0)::DOUBLE AS total, coalesce(sum(quality), 0)::DOUBLE / count(*) AS mean, CASE WHEN count(quality) = count(*) THEN min(quality) END AS low, max(quality) AS high FROM {_LABELLED} GROUP BY 1", "documents", LABELLED, "labels", after=lambda df: _grouped(df.withColumn("k", F.col("doc_id") % 2), [{"$group": {"_id": "$k", "total": {"$sum": "$quality"}, "mean": {"$avg": "$quality"}, "low": {"$min": "$quality"}, "high": {"$max": "$quality"}}}]).withColumnRenamed("_id", "k"))


def _grouped(df: DataFrame, stages: list[dict], natural: list[str] | None = None) -> DataFrame:
    return Collection(df.sparkSession, "derived", df, natural).aggregate(stages)


PUSHED = [{"$group": {"_id": "$o_custkey", "keys": {"$push": "$o_orderkey"}, "status": {"$push": "$o_orderstatus"}}}]
pipeline("match_size", "SELECT o_custkey AS _id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) = 10", "orders", [*PUSHED, {"$match": {"keys": {"$size": 10}}}], after=lambda df: df.select("_id", F.size("keys").cast("long").alias("n")))
pipeline("match_all", "SELECT o_custkey AS _id FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') > 0 AND count(*) FILTER (o_orderstatus = 'P') > 0", "orders", [*PUSHED, {"$match": {"status": {"$all": ["F", "P"]}}}, {"$project": {"_id": 1}}])
pipeline("match_whole_array", "SELECT o_custkey AS _id FROM orders GROUP BY 1 HAVING string_agg(o_orderstatus, '' ORDER BY o_orderkey) = 'F'", "orders", [*PUSHED, {"$match": {"status": ["F"]}}, {"$project": {"_id": 1}}])
pipeline("match_array_index", "SELECT o_custkey AS _id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 2 AND o_orderstatus = 'F'", "orders", [*PUSHED, {"$match": {"status.1": "F"}}, {"$project": {"_id": 1}}])


@query("match_elem", "SELECT o_custkey AS _id FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 150000) > 0", "orders")
def _(db: Database) -> DataFrame:
    items = db.collection("orders").df.groupBy(F.col("o_custkey").alias("_id")).agg(F.collect_list(F.struct(F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))).alias("items"))
    return Collection(db.spark, "c", items).find({"items": {"$elemMatch": {"s": "F", "p": {"$gt": 150000}}}}, {"_id": 1})


@query("match_elem_scalar", "SELECT o_custkey AS _id FROM orders WHERE false", "orders")
def _(db: Database) -> DataFrame:
    return db.collection("orders").aggregate([*PUSHED, {"$match": {"keys": {"$elemMatch": {"$gt": 1}}}}, {"$project": {"_id": 1}}])


# projections

pipeline("project_include", "SELECT s_name, s_suppkey FROM supplier", "supplier", [{"$project": {"s_name": 1, "s_suppkey": 1, "_id": 0, "s_acctbal": True}}])
pipeline("project_exclude", "SELECT s_suppkey, s_name, s_nationkey FROM supplier", "supplier", [{"$project": {"s_acctbal": 0, "s_name.x": 0}}])
pipeline("add_fields", "SELECT o_orderkey, o_custkey AS who, 7 AS seven, 'lit' AS word, o_totalprice AS o_custkey FROM orders", "orders", [{"$addFields": {"who": "$o_custkey", "seven": 7, "word": "lit", "o_custkey": "$o_totalprice"}}, {"$project": {"_id": 0, "o_orderkey": 1, "who": 1, "seven": 1, "word": 1, "o_custkey": 1}}])
pipeline("add_fields_nested", "SELECT o_orderkey, o_custkey AS id, 1 AS one, o_totalprice AS price FROM orders", "orders", [{"$set": {"customer.id": "$o_custkey", "customer.more.one": 1, "customer.price": "$o_totalprice"}}, {"$project": {"_id": 0, "o_orderkey": 1, "customer.id": 1, "customer.more.one": 1, "customer.price": 1}}], after=lambda df: df.select("o_orderkey", "customer.id", "customer.more.one", "customer.price"))
pipeline("unset_stage", "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part", "part", [{"$unset": ["p_type", "p_size"]}])
pipeline("unset_nested", "SELECT n_nationkey, n_name AS name FROM nation", "nation", [{"$set": {"d.name": "$n_name", "d.key": "$n_regionkey"}}, {"$unset": "d.key"}], after=lambda df: df.select("n_nationkey", F.col("d.name").alias("name")))
pipeline("replace_root", "SELECT n_name AS name, n_regionkey AS region, 1 AS one FROM nation", "nation", [{"$replaceRoot": {"newRoot": {"name": "$n_name", "region": "$n_regionkey", "one": 1}}}])
pipeline("replace_root_path", "SELECT r.r_regionkey, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "nation", [{"$lookup": {"from": "region", "localField": "n_regionkey", "foreignField": "r_regionkey", "as": "r"}}, {"$unwind": "$r"}, {"$replaceRoot": {"newRoot": "$r"}}], "region")

# unnesting, limits, counts

pipeline("unwind", "SELECT vec_id, CAST(unnest(embedding) AS FLOAT) AS embedding FROM embeddings", "embeddings", [{"$unwind": "$embedding"}, {"$project": {"_id": 0, "vec_id": 1, "embedding": 1}}])
pipeline("unwind_preserve", f"SELECT doc_id, quality FROM {_LABELLED}", "documents", [{"$lookup": {"from": "labels", "localField": "doc_id", "foreignField": "doc_id", "as": "label"}}, {"$set": {"found": "$label"}}, {"$unwind": {"path": "$found", "preserveNullAndEmptyArrays": True}}], "labels", after=lambda df: df.select("doc_id", F.col("found.quality").alias("quality")))
pipeline("unwind_scalar", "SELECT n_nationkey FROM nation WHERE false", "nation", [{"$unwind": "$n_name"}, {"$project": {"_id": 0, "n_nationkey": 1}}])
pipeline("unwind_scalar_preserve", "SELECT n_nationkey FROM nation", "nation", [{"$unwind": {"path": "$n_name", "preserveNullAndEmptyArrays": True}}, {"$project": {"_id": 0, "n_nationkey": 1}}])
pipeline("count_stage", "SELECT count(*) AS n FROM events WHERE event_type = 'click'", "events", [{"$match": {"event_type": "click"}}, {"$count": "n"}])
pipeline("count_empty", "SELECT 0::BIGINT AS n", "events", [{"$match": {"event_type": 3}}, {"$count": "n"}])
pipeline("sort_skip_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$skip": 5}, {"$limit": 20}, {"$project": {"_id": 0, "o_orderkey": 1, "o_totalprice": 1}}])
pipeline("sort_by_strings", "SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_custkey DESC LIMIT 30", "customer", [{"$sort": {"c_mktsegment": -1, "c_custkey": -1}}, {"$limit": 30}, {"$project": {"_id": 0, "c_mktsegment": 1, "c_custkey": 1}}])
pipeline("limit_in_scan_order", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7", "orders", [{"$limit": 7}, {"$project": {"_id": 0, "o_orderkey": 1}}])
pipeline("limit_nonpositive", "SELECT r_regionkey, r_name FROM region", "region", [{"$limit": 0}, {"$skip": -1}])
pipeline("skip_all", "SELECT r_regionkey, r_name FROM region WHERE false", "region", [{"$skip": 100}])
pipeline("sort_nulls_first", f"SELECT doc_id, quality FROM {_LABELLED} ORDER BY quality ASC NULLS FIRST, doc_id LIMIT 900", "documents", [*LABELLED, {"$sort": {"quality": 1, "doc_id": 1}}, {"$limit": 900}], "labels")


@query("find_options", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 15 OFFSET 3", "customer")
def _(db: Database) -> DataFrame:
    return db.collection("customer").find({"c_acctbal": {"$gt": 0}}, {"_id": 0, "c_custkey": 1, "c_name": 1}, {"c_acctbal": -1, "c_custkey": 1}, 3, 15)


@query("find_by_id", "SELECT o_orderkey AS _id, o_custkey FROM orders WHERE o_orderkey = 42", "orders")
def _(db: Database) -> DataFrame:
    return Collection(db.spark, "o", db.collection("orders").df.withColumnRenamed("o_orderkey", "_id")).find({"_id": 42}, {"o_custkey": 1})


@query("find_one", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1", "orders")
def _(db: Database) -> DataFrame:
    return db.collection("orders").find({"o_orderstatus": "P"}, {"_id": 0, "o_orderkey": 1, "o_custkey": 1}, limit=1)


# groups

pipeline("group_sum_avg_count", "SELECT l_returnflag AS _id, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice) / count(*), 4) AS price, count(*) AS n, sum(l_linenumber)::DOUBLE AS lines FROM lineitem GROUP BY 1", "lineitem", [{"$group": {"_id": "$l_returnflag", "qty": {"$sum": "$l_quantity"}, "price": {"$avg": "$l_extendedprice"}, "n": {"$count": {}}, "lines": {"$sum": "$l_linenumber"}}}], after=lambda df: df.withColumns({"qty": F.round("qty", 2), "price": F.round("price", 4)}))
pipeline("group_sum_of_strings", "SELECT c_mktsegment AS _id, 0::DOUBLE AS total, count(*)::DOUBLE AS ones FROM customer GROUP BY 1", "customer", [{"$group": {"_id": "$c_mktsegment", "total": {"$sum": "$c_name"}, "ones": {"$sum": 1}}}])
pipeline("group_min_max", "SELECT o_orderstatus AS _id, min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderpriority) AS first_priority FROM orders GROUP BY 1", "orders", [{"$group": {"_id": "$o_orderstatus", "low": {"$min": "$o_totalprice"}, "high": {"$max": "$o_totalprice"}, "first_priority": {"$min": "$o_orderpriority"}}}])
pipeline("group_first_last", "SELECT o_custkey AS _id, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS dear, last(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS cheap FROM orders GROUP BY 1", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "dear": {"$first": "$o_orderkey"}, "cheap": {"$last": "$o_orderkey"}}}])
pipeline("group_push", "SELECT n_regionkey AS _id, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY 1", "nation", [{"$sort": {"n_name": -1}}, {"$group": {"_id": "$n_regionkey", "names": {"$push": "$n_name"}}}], after=lambda df: df.withColumn("names", joined("names")))
pipeline("group_push_scan_order", "SELECT o_custkey AS _id, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1", "orders", [{"$group": {"_id": "$o_custkey", "keys": {"$push": "$o_orderkey"}}}], after=lambda df: df.withColumn("keys", joined("keys")))
pipeline("group_push_nulls", f"SELECT CAST(0 AS INT) AS _id, string_agg(coalesce(CAST(quality AS VARCHAR), 'null'), ',' ORDER BY doc_id) AS all_of_them FROM {_LABELLED}", "documents", [*LABELLED, {"$sort": {"doc_id": 1}}, {"$group": {"_id": 0, "all_of_them": {"$push": "$quality"}}}], "labels", after=lambda df: df.withColumn("all_of_them", joined("all_of_them")))
pipeline("group_add_to_set", "SELECT user_id AS _id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1", "events", [{"$sort": {"event_type": 1}}, {"$group": {"_id": "$user_id", "kinds": {"$addToSet": "$event_type"}}}], after=lambda df: df.withColumn("kinds", joined("kinds")))
pipeline("group_compound", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2", "lineitem", [{"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "n": {"$count": {}}}}], after=lambda df: df.select("_id.flag", "_id.status", "n"))
pipeline("group_null_id", "SELECT count(*) AS n, round(sum(l_tax), 4) AS tax FROM lineitem", "lineitem", [{"$group": {"_id": None, "n": {"$count": {}}, "tax": {"$sum": "$l_tax"}}}], after=lambda df: df.select("n", F.round("tax", 4).alias("tax")))
pipeline("group_empty", "SELECT 1::BIGINT AS n WHERE false", "lineitem", [{"$match": {"l_quantity": {"$gt": 1e9}}}, {"$group": {"_id": None, "n": {"$count": {}}}}, {"$project": {"_id": 0, "n": 1}}])

# lookups

pipeline("lookup_array", "SELECT r_regionkey, r_name, count(n_nationkey) AS nations, coalesce(string_agg(n_name, ',' ORDER BY n_nationkey), '') AS names FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2", "region", [{"$lookup": {"from": "nation", "localField": "r_regionkey", "foreignField": "n_regionkey", "as": "n"}}], "nation", after=lambda df: df.select("r_regionkey", "r_name", F.size("n").cast("long").alias("nations"), F.array_join("n.n_name", ",").alias("names")))
pipeline("lookup_unwind", "SELECT n_name, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey", "nation", [{"$lookup": {"from": "supplier", "localField": "n_nationkey", "foreignField": "s_nationkey", "as": "s"}}, {"$unwind": "$s"}, {"$project": {"_id": 0, "n_name": 1, "s.s_suppkey": 1}}], "supplier", after=lambda df: df.select("n_name", "s.s_suppkey"))
pipeline("lookup_unwind_preserve", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)", "documents", [{"$lookup": {"from": "labels", "localField": "doc_id", "foreignField": "doc_id", "as": "l"}}, {"$unwind": {"path": "$l", "preserveNullAndEmptyArrays": True}}], "labels", after=lambda df: df.select("doc_id", "l.toxic"))
pipeline("lookup_anti", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)", "documents", [{"$lookup": {"from": "labels", "localField": "doc_id", "foreignField": "doc_id", "as": "l"}}, {"$match": {"l": {"$size": 0}}}, {"$project": {"_id": 0, "doc_id": 1}}], "labels")
pipeline("lookup_semi", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)", "documents", [{"$lookup": {"from": "labels", "localField": "doc_id", "foreignField": "doc_id", "as": "l"}}, {"$match": {"l": {"$ne": []}}}, {"$project": {"_id": 0, "doc_id": 1}}], "labels")
pipeline("lookup_null_keys", "SELECT d.doc_id, count(*) AS n FROM (SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)) d LEFT JOIN (SELECT NULL::INT AS k UNION ALL SELECT 1) r ON d.quality IS NOT DISTINCT FROM r.k GROUP BY 1", "documents", LABELLED, "labels", after=lambda df: _null_keys(df))
pipeline("lookup_other_kind", "SELECT n_nationkey, 0 AS n FROM nation", "nation", [{"$lookup": {"from": "region", "localField": "n_name", "foreignField": "r_regionkey", "as": "r"}}], "region", after=lambda df: df.select("n_nationkey", F.size("r").alias("n")))
pipeline("lookup_no_collection", "SELECT r_regionkey, 0 AS n FROM region", "region", [{"$lookup": {"from": "nowhere", "localField": "r_regionkey", "foreignField": "x", "as": "m"}}], after=lambda df: df.select("r_regionkey", F.size("m").alias("n")))
pipeline("lookup_without_fields", "SELECT r_regionkey, (SELECT count(*) FROM nation) AS n FROM region", "region", [{"$lookup": {"from": "nation", "as": "m"}}], "nation", after=lambda df: df.select("r_regionkey", F.size("m").cast("long").alias("n")))


def _null_keys(df: DataFrame) -> DataFrame:
    db = Database(df.sparkSession)
    db.register("l", df)
    db.register("r", df.sparkSession.createDataFrame([(None,), (1,)], "k int"))
    out = db.collection("l").aggregate([{"$lookup": {"from": "r", "localField": "quality", "foreignField": "k", "as": "m"}}])
    return out.select("doc_id", F.greatest(F.size("m"), F.lit(1)).cast("long").alias("n"))


# distinct and count


@query("distinct_field", "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_acctbal > 0", "customer")
def _(db: Database) -> DataFrame:
    return db.collection("customer").distinct("c_mktsegment", {"c_acctbal": {"$gt": 0}})


@query("count_command", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'", "customer")
def _(db: Database) -> DataFrame:
    return db.collection("customer").count_frame({"c_mktsegment": "BUILDING"})


# updates: the next version as a plan


def updated(name: str, sql: str, table: str, filter_: dict, update: dict, after: Callable[[DataFrame], DataFrame] | None = None, before: Callable[[Database], DataFrame] | None = None) -> None:
    def run(db: Database) -> DataFrame:
        df = before(db) if before else db.collection(table).df
        out = apply_update(df, compile_filter(filter_, df.schema), update)
        return after(out) if after else out

    query(name, sql, table)(run)


updated("update_set_inc_mul", "SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN 'renamed' ELSE s_name END AS s_name, CASE WHEN s_nationkey < 10 THEN s_nationkey + 100 ELSE s_nationkey END::INT AS s_nationkey, CASE WHEN s_nationkey < 10 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal, CASE WHEN s_nationkey < 10 THEN 5 END AS fresh FROM supplier", "supplier", {"s_nationkey": {"$lt": 10}}, {"$set": {"s_name": "renamed"}, "$inc": {"s_nationkey": 100, "fresh": 5}, "$mul": {"s_acctbal": 2}})
updated("update_inc_by_a_double", "SELECT p_partkey, CASE WHEN p_size > 25 THEN trunc(p_size + 1.7)::INT ELSE p_size END AS p_size FROM part", "part", {"p_size": {"$gt": 25}}, {"$inc": {"p_size": 1.7}}, lambda df: df.select("p_partkey", "p_size"))
updated("update_min_max", "SELECT p_partkey, least(p_size, 20) AS p_size, greatest(p_retailprice, 1200) AS p_retailprice FROM part", "part", {}, {"$min": {"p_size": 20}, "$max": {"p_retailprice": 1200.0}}, lambda df: df.select("p_partkey", "p_size", "p_retailprice"))
updated("update_rename_unset", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_name END AS title, CASE WHEN n_regionkey <> 1 THEN n_name END AS n_name, CASE WHEN n_regionkey <> 1 THEN n_regionkey END AS n_regionkey FROM nation", "nation", {"n_regionkey": 1}, {"$rename": {"n_name": "title"}, "$unset": {"n_regionkey": ""}})
updated("update_plain_keys", "SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'two' ELSE r_name END AS r_name FROM region", "region", {"r_regionkey": 2}, {"r_name": "two"})
updated("update_nested_set", "SELECT n_nationkey, n_name AS a, 5 AS b FROM nation", "nation", {}, {"$set": {"x.y.z.b": 5}}, lambda df: df.select("n_nationkey", F.col("n_name").alias("a"), F.col("x.y.z.b").alias("b")))


def _keys_by_customer(db: Database) -> DataFrame:
    return db.collection("orders").aggregate(PUSHED)


_LISTS = "(SELECT o_custkey AS _id, list(o_orderkey ORDER BY o_orderkey) AS k, list(o_orderstatus ORDER BY o_orderkey) AS s FROM orders GROUP BY 1)"
updated("update_push", f"SELECT _id, array_to_string(k || [1, 2], ',') AS keys FROM {_LISTS}", "orders", {}, {"$push": {"keys": {"$each": [1, 2]}}}, lambda df: df.select("_id", joined("keys").alias("keys")), _keys_by_customer)
updated("update_pop", f"SELECT _id, array_to_string(k[:-2], ',') AS keys, array_to_string(s[2:], ',') AS status FROM {_LISTS}", "orders", {}, {"$pop": {"keys": 1, "status": -1}}, lambda df: df.select("_id", joined("keys").alias("keys"), joined("status").alias("status")), _keys_by_customer)
updated("update_pull", f"SELECT _id, array_to_string(list_filter(s, lambda x: x <> 'F'), ',') AS status FROM {_LISTS}", "orders", {}, {"$pull": {"status": "F", "keys": {"$gt": 5}}}, lambda df: df.select("_id", joined("status").alias("status")), _keys_by_customer)
updated("update_pull_all", f"SELECT _id, array_to_string(list_filter(s, lambda x: x NOT IN ('F', 'P')), ',') AS status FROM {_LISTS}", "orders", {}, {"$pullAll": {"status": ["F", "P"]}}, lambda df: df.select("_id", joined("status").alias("status")), _keys_by_customer)
updated("update_add_to_set", f"SELECT _id, array_to_string(CASE WHEN list_contains(s, 'P') THEN s ELSE s || ['P'] END || ['new'], ',') AS status FROM {_LISTS}", "orders", {}, {"$addToSet": {"status": {"$each": ["P", "new", "P"]}}}, lambda df: df.select("_id", joined("status").alias("status")), _keys_by_customer)


@query("update_one", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 3) THEN 33 ELSE n_regionkey END AS n_regionkey FROM nation", "nation")
def _(db: Database) -> DataFrame:
    db.collection("nation").update_one({"n_regionkey": 3}, {"$set": {"n_regionkey": 33}})
    return db.collection("nation").df


@query("update_counts", "SELECT 5::BIGINT AS matched, 4::BIGINT AS modified", "region")
def _(db: Database) -> DataFrame:
    r = db.collection("region").update_many({}, {"$set": {"r_regionkey": 2}})
    return db.spark.createDataFrame([(r.matched_count, r.modified_count)], "matched long, modified long")


@query("update_command", "SELECT n_nationkey, CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 1) THEN 'first' ELSE n_name END AS n_name, n_regionkey FROM nation", "nation")
def _(db: Database) -> DataFrame:
    db.run_command({"update": "nation", "updates": [{"q": {"n_regionkey": 1}, "u": {"$set": {"n_name": "first"}}, "multi": True}]})
    return db.collection("nation").df


@query("upsert", "SELECT r_regionkey, r_name, NULL::VARCHAR AS note FROM region UNION ALL SELECT 77, 'seventy', 'new'", "region")
def _(db: Database) -> DataFrame:
    db.collection("region").update_one({"r_regionkey": 77}, {"$set": {"r_name": "seventy"}, "$setOnInsert": {"note": "new"}}, upsert=True)
    return db.collection("region").df.select("r_regionkey", "r_name", "note")


@query("replace_one", "SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'other' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 22, 'other'", "region")
def _(db: Database) -> DataFrame:
    db.collection("region").replace_one({"r_regionkey": 2}, {"r_regionkey": 22, "r_name": "other"})
    return db.collection("region").df


@query("insert", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (90, 'ninety'), (91, NULL))", "region")
def _(db: Database) -> DataFrame:
    db.collection("region").insert([{"r_regionkey": 90, "r_name": "ninety"}, {"r_regionkey": 91}])
    return db.collection("region").df.select("r_regionkey", "r_name")


@query("delete_many", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 2", "nation")
def _(db: Database) -> DataFrame:
    db.collection("nation").delete_many({"n_regionkey": 2})
    return db.collection("nation").df


@query("delete_one", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey <> (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2)", "nation")
def _(db: Database) -> DataFrame:
    db.collection("nation").delete_one({"n_regionkey": 2})
    return db.collection("nation").df


@query("find_and_modify", "SELECT n_nationkey, CASE WHEN n_name = (SELECT max(n_name) FROM nation WHERE n_regionkey = 2) THEN 'changed' ELSE n_name END AS n_name, n_regionkey FROM nation", "nation")
def _(db: Database) -> DataFrame:
    db.run_command({"findAndModify": "nation", "query": {"n_regionkey": 2}, "sort": {"n_name": -1}, "update": {"$set": {"n_name": "changed"}}})
    return db.collection("nation").df


@query("find_and_remove", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey <> (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = 4)", "nation")
def _(db: Database) -> DataFrame:
    db.collection("nation").find_and_modify({"n_regionkey": 4}, sort={"n_nationkey": -1}, remove=True)
    return db.collection("nation").df


@query("transaction", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 50, 'kept'", "region")
def _(db: Database) -> DataFrame:
    for number, name, end in ((1, "lost", "abortTransaction"), (2, "kept", "commitTransaction")):
        about = {"lsid": {"id": "s"}, "txnNumber": number, "autocommit": False}
        db.run_command({"insert": "region", "documents": [{"r_regionkey": 50, "r_name": name}], **about})
        db.run_command({end: 1, **about})
    return db.collection("region").df.select("r_regionkey", "r_name")


# more of joins, arrays, writes and commands

pipeline("lookup_array_key", "SELECT a.o_custkey AS _id, count(b.o_custkey) AS n FROM (SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS s FROM orders GROUP BY 1) a JOIN (SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS s FROM orders GROUP BY 1) b ON a.s = b.s GROUP BY 1", "orders", [{"$group": {"_id": "$o_custkey", "status": {"$push": "$o_orderstatus"}}}], after=lambda df: _self_lookup(df))
pipeline("lookup_overwrites", "SELECT n_nationkey, 1 AS n FROM nation", "nation", [{"$lookup": {"from": "region", "localField": "n_regionkey", "foreignField": "r_regionkey", "as": "n_name"}}], "region", after=lambda df: df.select("n_nationkey", F.size("n_name").alias("n")))
pipeline("lookup_nested_key", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "nation", [{"$set": {"at.region": "$n_regionkey"}}, {"$lookup": {"from": "region", "localField": "at.region", "foreignField": "r_regionkey", "as": "r"}}, {"$unwind": "$r"}], "region", after=lambda df: df.select("n_nationkey", "r.r_name"))
pipeline("lookup_twice", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "supplier", [{"$lookup": {"from": "nation", "localField": "s_nationkey", "foreignField": "n_nationkey", "as": "n"}}, {"$unwind": "$n"}, {"$lookup": {"from": "region", "localField": "n.n_regionkey", "foreignField": "r_regionkey", "as": "r"}}, {"$unwind": "$r"}], "nation", "region", after=lambda df: df.select("s_suppkey", "n.n_name", "r.r_name"))
pipeline("sort_then_group", "SELECT o_orderstatus AS _id, count(*) AS n FROM orders GROUP BY 1", "orders", [{"$sort": {"o_totalprice": -1}}, {"$group": {"_id": "$o_orderstatus", "n": {"$count": {}}}}])
pipeline("sort_limit_group", "SELECT o_orderstatus AS _id, count(*) AS n FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500) GROUP BY 1", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 500}, {"$group": {"_id": "$o_orderstatus", "n": {"$count": {}}}}])
pipeline("group_in_first_seen_order", "SELECT o_custkey AS _id FROM orders GROUP BY 1 ORDER BY min(o_orderkey) LIMIT 12", "orders", [{"$group": {"_id": "$o_custkey"}}, {"$limit": 12}])
pipeline("group_first_of_strings", "SELECT c_nationkey AS _id, first(c_name ORDER BY c_mktsegment DESC, c_custkey) AS name FROM customer GROUP BY 1", "customer", [{"$sort": {"c_mktsegment": -1, "c_custkey": 1}}, {"$group": {"_id": "$c_nationkey", "name": {"$first": "$c_name"}}}])
pipeline("group_literals", "SELECT r_regionkey AS _id, 2.5::DOUBLE AS total, 'x' AS word FROM region", "region", [{"$group": {"_id": "$r_regionkey", "total": {"$sum": 2.5}, "word": {"$first": "x"}}}])
pipeline("unwind_group", "SELECT vec_id AS _id, count(*) AS n, round(sum(e)::DOUBLE, 3) AS total FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e FROM embeddings) GROUP BY 1", "embeddings", [{"$unwind": "$embedding"}, {"$group": {"_id": "$vec_id", "n": {"$count": {}}, "total": {"$sum": "$embedding"}}}], after=lambda df: df.withColumn("total", F.round("total", 3)))
pipeline("unwind_in_order", "SELECT vec_id, embedding[1]::FLOAT AS first FROM embeddings", "embeddings", [{"$unwind": "$embedding"}, {"$group": {"_id": "$vec_id", "first": {"$first": "$embedding"}}}], after=lambda df: df.withColumnRenamed("_id", "vec_id"))
updated("update_pull_documents", "SELECT o_custkey AS _id, count(*) FILTER (o_totalprice <= 100000) AS n FROM orders GROUP BY 1", "orders", {}, {"$pull": {"items": {"p": {"$gt": 100000}}}}, lambda df: df.select("_id", F.size("items").cast("long").alias("n")), lambda db: db.collection("orders").df.groupBy(F.col("o_custkey").alias("_id")).agg(F.collect_list(F.struct(F.col("o_totalprice").alias("p"))).alias("items")))
updated("update_current_date", "SELECT r_regionkey, true AS dated FROM region", "region", {}, {"$currentDate": {"at": True}}, lambda df: df.select("r_regionkey", F.col("at").isNotNull().alias("dated")))
updated("update_in_order", "SELECT r_regionkey, (r_regionkey + 1) * 10 AS k FROM region", "region", {}, {"$set": {"k": 0}, "$inc": {"k": 10}, "$rename": {"k": "j"}}, lambda df: df.select("r_regionkey", ((F.col("r_regionkey") + 1) * F.col("j")).alias("k")))
updated("update_unknown_operator", "SELECT r_regionkey, r_name FROM region", "region", {}, {"$bit": {"r_regionkey": 1}})


def _self_lookup(df: DataFrame) -> DataFrame:
    db = Database(df.sparkSession)
    db.register("a", df)
    db.register("b", df)
    out = db.collection("a").aggregate([{"$lookup": {"from": "b", "localField": "status", "foreignField": "status", "as": "m"}}])
    return out.select("_id", F.size("m").cast("long").alias("n"))


@query("distinct_nested", "SELECT DISTINCT n_regionkey AS value FROM nation", "nation")
def _(db: Database) -> DataFrame:
    nested = db.collection("nation").aggregate([{"$replaceRoot": {"newRoot": {"key": "$n_regionkey"}}}]).select(F.struct("key").alias("d"))
    return Collection(db.spark, "n", nested).distinct("d.key")


@query("command_find", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 20", "customer")
def _(db: Database) -> DataFrame:
    got = db.run_command({"find": "customer", "filter": {"c_nationkey": 3}, "sort": {"c_custkey": 1}, "limit": 20, "projection": {"_id": 0, "c_custkey": 1, "c_name": 1}, "batchSize": 7})["cursor"]
    docs = got["firstBatch"]
    while got["id"]:
        got = db.run_command({"getMore": got["id"], "collection": "customer", "batchSize": 7})["cursor"]
        docs += got["nextBatch"]
    return db.spark.createDataFrame([(d["c_custkey"], d["c_name"]) for d in docs], "c_custkey long, c_name string")


@query("command_distinct_and_count", "SELECT (SELECT count(DISTINCT c_mktsegment) FROM customer) AS segments, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS negative", "customer")
def _(db: Database) -> DataFrame:
    values = db.run_command({"distinct": "customer", "key": "c_mktsegment"})["values"]
    n = db.run_command({"count": "customer", "query": {"c_acctbal": {"$lt": 0}}})["n"]
    return db.spark.createDataFrame([(len(values), n)], "segments long, negative long")


@query("command_delete", "SELECT s_suppkey FROM supplier WHERE s_nationkey <> 5 AND s_suppkey <> (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = 6)", "supplier")
def _(db: Database) -> DataFrame:
    db.run_command({"delete": "supplier", "deletes": [{"q": {"s_nationkey": 5}, "limit": 0}, {"q": {"s_nationkey": 6}, "limit": 1}]})
    return db.collection("supplier").df.select("s_suppkey")


@query("unique_index", "SELECT true AS by_key, false AS by_region, count(*) AS left_over FROM nation", "nation")
def _(db: Database) -> DataFrame:
    reply = [db.run_command({"createIndexes": "nation", "indexes": [{"key": {k: 1}, "unique": True}]})["ok"] == 1.0 for k in ("n_nationkey", "n_regionkey")]
    db.run_command({"insert": "nation", "documents": [{"n_nationkey": 3, "n_name": "again"}]})
    return db.spark.createDataFrame([(*reply, db.collection("nation").count())], "by_key boolean, by_region boolean, left_over long")


@query("catalog", "SELECT 'nation' AS name, 25::BIGINT AS n UNION ALL SELECT 'region', 5", "region", "nation")
def _(db: Database) -> DataFrame:
    db.run_command({"drop": "nowhere"})
    names = [c["name"] for c in db.run_command({"listCollections": 1})["cursor"]["firstBatch"]]
    return db.spark.createDataFrame([(n, db.run_command({"collStats": n})["count"]) for n in names], "name string, n long")


# commands, sessions, errors and scans


def _row(db: Database, schema: str, *values) -> DataFrame:
    return db.spark.createDataFrame([values], schema)


matching("match_extended_literals", "orders", {"o_custkey": {"$lte": {"$numberLong": "400"}}, "o_totalprice": {"$gt": {"$numberDouble": "1e5"}}, "o_orderkey": {"$ne": {"$numberDecimal": "7.0"}}}, "o_custkey <= 400 AND o_totalprice > 100000 AND o_orderkey <> 7", "o_orderkey, o_custkey")
pipeline("project_without_id", "SELECT 0::BIGINT AS fields, count(*) AS n FROM nation", "nation", [{"$project": {"_id": 0}}], after=lambda df: df.select(F.lit(len(df.columns)).cast("long").alias("fields")).groupBy("fields").agg(F.count(F.lit(1)).alias("n")))
pipeline("group_malformed_accumulator", "SELECT n_regionkey AS _id, count(*) AS n FROM nation GROUP BY 1", "nation", [{"$group": {"_id": "$n_regionkey", "left_out": 5, "two": {"$sum": 1, "$max": "$n_name"}, "n": {"$count": {}}}}])


@query("lookup_int_against_double", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "nation", "region")
def _(db: Database) -> DataFrame:
    db.register("doubles", db.collection("nation").df.withColumn("k", F.col("n_regionkey").cast("double")))
    out = db.collection("doubles").aggregate([{"$lookup": {"from": "region", "localField": "k", "foreignField": "r_regionkey", "as": "r"}}, {"$unwind": "$r"}])
    return out.select("n_nationkey", "r.r_name")


@query("group_numbers_of_two_kinds", "SELECT n_regionkey::DOUBLE AS _id, 2 * count(*) AS n FROM nation GROUP BY 1", "nation")
def _(db: Database) -> DataFrame:
    df = db.collection("nation").df
    return _grouped(df.select(F.col("n_regionkey").cast("double").alias("k")).unionAll(df.select("n_regionkey")), [{"$group": {"_id": "$k", "n": {"$count": {}}}}])


@query("index_range_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900 ORDER BY o_orderkey DESC", "orders")
def _(db: Database) -> DataFrame:
    orders = db.collection("orders")
    orders.create_index({"o_orderkey": 1})
    return orders.find({"o_orderkey": {"$gte": 100, "$lt": 900}}, {"_id": 0, "o_orderkey": 1, "o_custkey": 1}, {"o_orderkey": -1})


@query("limit_from_the_end", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10 OFFSET 5", "orders")
def _(db: Database) -> DataFrame:
    return db.collection("orders").find({}, {"_id": 0, "o_orderkey": 1}, {"o_orderkey": -1}, 5, 10)


@query("skip_limit_in_scan_order", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 30 OFFSET 40", "customer")
def _(db: Database) -> DataFrame:
    return db.collection("customer").find({}, {"_id": 0, "c_custkey": 1}, None, 40, 30)


@query("bad_lines_left_out", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE event_id % 10 <> 0", "events")
def _(db: Database) -> DataFrame:
    from .sources.tables import parsed_lines

    cut = F.when(F.col("event_id") % 10 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    return parsed_lines(db.collection("events").df.select("event_id", cut.alias("value"))).select("event_id", F.expr("variant_get(doc, '$.k', 'bigint')").alias("k"))


@query("insert_one", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 70, 'new'", "region")
def _(db: Database) -> DataFrame:
    db.collection("region").insert_one({"r_regionkey": 70, "r_name": "new"})
    return db.collection("region").df.select("r_regionkey", "r_name")


@query("update_many_customers", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'x' ELSE c_name END AS c_name FROM customer", "customer")
def _(db: Database) -> DataFrame:
    customer = db.collection("customer")
    customer.update_many({"c_mktsegment": "BUILDING"}, {"$inc": {"c_acctbal": 10}, "$set": {"c_name": "x"}})
    return customer.df.select("c_custkey", "c_acctbal", "c_name")


@query("matches_helper", "SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey >= 5", "nation")
def _(db: Database) -> DataFrame:
    nation = db.collection("nation")
    rows = [r.asDict() for r in nation.find().collect()]  # the table of 25 nations
    return db.spark.createDataFrame([(r["n_nationkey"],) for r in rows if nation.matches(r, {"n_regionkey": {"$in": [1, 3]}, "n_nationkey": {"$gte": 5}})], "n_nationkey long")


@query("command_handshake", "SELECT 1.0::DOUBLE AS ping, true AS writable, true AS old_name, 16777216::BIGINT AS size, true AS has_version, 59::BIGINT AS unknown")
def _(db: Database) -> DataFrame:
    hello, old = db.run_command({"hello": 1}), db.run_command({"isMaster": 1})
    return _row(db, "ping double, writable boolean, old_name boolean, size long, has_version boolean, unknown long", db.run_command({"ping": 1})["ok"], hello["isWritablePrimary"], old["ismaster"], hello["maxBsonObjectSize"], bool(db.run_command({"buildInfo": 1})["version"]), db.run_command({"nope": 1})["code"])


@query("command_aggregate", "SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1", "nation")
def _(db: Database) -> DataFrame:
    got = db.run_command({"aggregate": "nation", "pipeline": [{"$group": {"_id": "$n_regionkey", "n": {"$count": {}}}}]})["cursor"]["firstBatch"]
    return db.spark.createDataFrame([(r["_id"], r["n"]) for r in got], "region long, n long")


@query("command_kill_cursors", "SELECT 5::BIGINT AS fetched, 1::BIGINT AS killed, 1::BIGINT AS unknown, 43::BIGINT AS code", "nation")
def _(db: Database) -> DataFrame:
    got = db.run_command({"find": "nation", "batchSize": 5})["cursor"]
    reply = db.run_command({"killCursors": "nation", "cursors": [got["id"], -1]})
    return _row(db, "fetched long, killed long, unknown long, code long", len(got["firstBatch"]), len(reply["cursorsKilled"]), len(reply["cursorsNotFound"]), db.run_command({"getMore": got["id"], "collection": "nation"})["code"])


@query("command_explain", "SELECT true AS pushed, true AS one_column, 'EOF' AS nothing", "nation")
def _(db: Database) -> DataFrame:
    plan = db.run_command({"explain": {"find": "nation", "filter": {"n_nationkey": {"$gt": 5}}, "projection": {"_id": 0, "n_nationkey": 1}}})["queryPlanner"]["winningPlan"]["plan"]
    return _row(db, "pushed boolean, one_column boolean, nothing string", "GreaterThan(n_nationkey,5)" in plan, bool(re.search(r"ReadSchema: struct<n_nationkey:\w+>", plan)), db.run_command({"explain": {"find": "nowhere"}})["queryPlanner"]["winningPlan"]["stage"])


@query("command_validate", "SELECT true AS valid, count(*) AS n, true AS all_valid, 26::BIGINT AS missing FROM customer", "customer")
def _(db: Database) -> DataFrame:
    db.collection("customer").create_index({"c_custkey": 1}, True)
    reply = db.run_command({"validate": "customer"})
    return _row(db, "valid boolean, n long, all_valid boolean, missing long", reply["valid"], reply["nrecords"], db.validate()["valid"], db.run_command({"validate": "nowhere"})["code"])


@query("command_drop", "SELECT 'nation' AS name", "region", "nation")
def _(db: Database) -> DataFrame:
    db.run_command({"drop": "region"})
    return db.spark.createDataFrame([(n,) for n in db.list_collections()], "name string")


@query("session_scope", "SELECT 5::BIGINT AS outside, 6::BIGINT AS after, 225::BIGINT AS old, 251::BIGINT AS ended, 0::BIGINT AS sessions", "region")
def _(db: Database) -> DataFrame:
    lsid = {"id": db.start_session()}
    about = {"lsid": lsid, "txnNumber": 4, "autocommit": False}
    insert = {"insert": "region", "documents": [{"r_regionkey": 60, "r_name": "later"}]}
    db.run_command({**insert, **about})
    outside = db.collection("region").count()
    db.run_command({"commitTransaction": 1, **about})
    old, ended = (db.run_command({**insert, **about, "txnNumber": n})["code"] for n in (3, 4))
    db.run_command({"refreshSessions": [lsid]})
    after = db.collection("region").count()
    db.run_command({"endSessions": [lsid]})
    return _row(db, "outside long, after long, old long, ended long, sessions long", outside, after, old, ended, len(db.sessions))


@query("write_conflict", "SELECT 112::BIGINT AS code, count(*) + 1 AS n FROM region", "region")
def _(db: Database) -> DataFrame:
    about = {"lsid": {"id": "one"}, "txnNumber": 1, "autocommit": False}
    db.run_command({"insert": "region", "documents": [{"r_regionkey": 61, "r_name": "staged"}], **about})
    db.run_command({"insert": "region", "documents": [{"r_regionkey": 62, "r_name": "between"}]})
    return _row(db, "code long, n long", db.run_command({"commitTransaction": 1, **about})["code"], db.collection("region").count())


@query("writers_at_once", "SELECT count(*) + 4 AS n, 4::BIGINT AS added FROM region", "region")
def _(db: Database) -> DataFrame:
    from concurrent.futures import ThreadPoolExecutor

    region = db.collection("region")
    with ThreadPoolExecutor(4) as pool:
        added = list(pool.map(lambda i: region.insert_one({"r_regionkey": 80 + i, "r_name": "one of four"}), range(4)))
    return _row(db, "n long, added long", region.count(), len(set(added)))


#: Commands that must fail as bad values, by what is wrong with them.
BAD_COMMANDS = {
    "unknown stage": {"aggregate": "region", "pipeline": [{"$nope": 1}]},
    "two fields in a stage": {"aggregate": "region", "pipeline": [{"$limit": 1, "$skip": 1}]},
    "lookup without as": {"aggregate": "region", "pipeline": [{"$lookup": {"from": "region", "localField": "a", "foreignField": "b"}}]},
    "lookup without from": {"aggregate": "region", "pipeline": [{"$lookup": {"localField": "a", "foreignField": "b", "as": "c"}}]},
    "unwind without a path": {"aggregate": "region", "pipeline": [{"$unwind": {}}]},
    "count without a name": {"aggregate": "region", "pipeline": [{"$count": ""}]},
    "unknown accumulator": {"aggregate": "region", "pipeline": [{"$group": {"_id": None, "x": {"$median": "$r_regionkey"}}}]},
    "name of a field": {"insert": "region", "documents": [{"$r_name": 1}]},
    "empty name of a field": {"insert": "region", "documents": [{"": 1}]},
    "null id": {"insert": "region", "documents": [{"_id": None}]},
    "array as id": {"insert": "region", "documents": [{"_id": [1]}]},
    "name of a collection": {"insert": "system.x", "documents": [{"a": 1}]},
}


@query("bad_commands", "SELECT unnest([" + ", ".join(f"'{x}'" for x in BAD_COMMANDS) + "]) AS what, 2::BIGINT AS code, 5::BIGINT AS n", "region")
def _(db: Database) -> DataFrame:
    codes = {what: db.run_command(c).get("code") for what, c in BAD_COMMANDS.items()}
    n = db.collection("region").count()
    return db.spark.createDataFrame([(what, code, n) for what, code in codes.items()], "what string, code long, n long")


# dynamic documents


@query("dynamic_filter", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE (props->>'k')::BIGINT >= 50", "events")
def _(db: Database) -> DataFrame:
    from .operators.dynamic import DynamicCollection

    events = db.collection("events").df.select("event_id", F.expr("parse_json(props)").alias("doc"))
    return DynamicCollection(events).find({"k": {"$gte": 50}}).select("event_id", F.expr("variant_get(doc, '$.k', 'bigint')").alias("k"))


@query("dynamic_sort", "SELECT event_id FROM events ORDER BY (props->>'k')::BIGINT DESC, event_id LIMIT 40", "events")
def _(db: Database) -> DataFrame:
    from .operators.dynamic import DynamicCollection

    events = db.collection("events").df.select("event_id", F.expr("parse_json(props)").alias("doc"))
    return DynamicCollection(events).find({}, sort={"k": -1}, then=["event_id"], limit=40).select("event_id")


#: The pipeline of the flagship query: the customers of a segment by the revenue of their orders before a date.
FLAGSHIP = [
    {"$match": {"c_mktsegment": "BUILDING"}},
    {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}},
    {"$unwind": "$o"},
    {"$match": {"o.o_orderdate": {"$lt": {"$date": "1997-01-01T00:00:00Z"}}}},
    {"$lookup": {"from": "lineitem", "localField": "o.o_orderkey", "foreignField": "l_orderkey", "as": "l"}},
    {"$unwind": "$l"},
    {"$group": {"_id": "$c_custkey", "revenue": {"$sum": "$l.l_extendedprice"}, "lines": {"$count": {}}, "dearest": {"$max": "$o.o_totalprice"}}},
    {"$sort": {"lines": -1, "_id": 1}},
    {"$limit": 25},
]
pipeline("flagship", "SELECT c_custkey AS _id, round(sum(l_extendedprice), 2) AS revenue, count(*) AS lines, max(o_totalprice) AS dearest FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1 ORDER BY lines DESC, _id LIMIT 25", "customer", FLAGSHIP, "orders", "lineitem", after=lambda df: df.withColumn("revenue", F.round("revenue", 2)))
