"""The engine's tables, derived from the driver's, in Spark and as SQL common table expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE, OVERLAP = 200, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a policy: owned by the source, shared with the language's group, every third public."""
    acl = F.struct(F.col("source").alias("owner"), F.array("lang").alias("visible_to_groups"), F.array().cast("array<string>").alias("visible_to_users"), (F.col("doc_id") % 3 == 0).alias("public"))
    return table(spark, sf_dir, "documents").withColumn("acl", acl)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("name"),
        F.col("event_type").alias("type"),
        F.col("event_type").alias("description"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100)).alias("confidence"),
        F.col("event_id").cast("string").alias("chunk_id"),
        F.col("event_id").alias("seq"),
    )


MENTIONS = """mentions AS (SELECT CAST(user_id AS VARCHAR) AS name, event_type AS type, event_type AS description,
 greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 100)) AS confidence, CAST(event_id AS VARCHAR) AS chunk_id, event_id AS seq FROM events)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    make = lambda t, k, name, kind, letter: t.select(F.concat(F.lit(letter), F.col(k).cast("string")).alias("name"), F.lit(kind).alias("type"), F.col(name).alias("description"))
    return make(s, "s_suppkey", "s_name", "supplier", "S").unionByName(make(p, "p_partkey", "p_name", "part", "P"))


ENTITIES = """entities AS (SELECT 'S' || s_suppkey AS name, 'supplier' AS type, s_name AS description FROM supplier
 UNION ALL SELECT 'P' || p_partkey, 'part', p_name FROM part)"""


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation a line item, unmerged; line numbers of an order may repeat, a part and supplier on one counts once."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").agg(*(F.max(c).alias(c) for c in ("l_linestatus", "l_returnflag", "l_discount")))
    return li.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("src_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("tgt_id"),
        F.col("l_linestatus").alias("keywords"),
        F.col("l_returnflag").alias("description"),
        (F.col("l_discount") * 10).alias("confidence"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.lit(None).cast("timestamp_ntz").alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct supplier-part edges, told apart by their numbers before names are made of them."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return li.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("src_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("tgt_id"))


RELATIONS = """relations AS (SELECT DISTINCT 'S' || l_suppkey AS src_id, 'P' || l_partkey AS tgt_id FROM lineitem)"""


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers to their nations, nations to regions, customers to their orders: a sparse graph with hubs, long paths and nodes beside it."""
    edges = lambda name, src, a, tgt, b: table(spark, sf_dir, name).select(F.concat(F.lit(src), F.col(a).cast("string")).alias("src_id"), F.concat(F.lit(tgt), F.col(b).cast("string")).alias("tgt_id"))
    parts = [edges("supplier", "S", "s_suppkey", "N", "s_nationkey"), edges("customer", "C", "c_custkey", "N", "c_nationkey"), edges("nation", "N", "n_nationkey", "R", "n_regionkey"), edges("orders", "C", "o_custkey", "O", "o_orderkey")]
    return reduce(DataFrame.unionByName, parts).distinct()


TRADE = """relations AS (SELECT 'S' || s_suppkey AS src_id, 'N' || s_nationkey AS tgt_id FROM supplier UNION SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
 UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders)"""
BOTH_WAYS = "edges AS (SELECT src_id AS src, tgt_id AS dst FROM relations UNION SELECT tgt_id, src_id FROM relations)"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal relations: customer to order, from the order's date to its last shipment; open while status is O."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    rows = table(spark, sf_dir, "orders").join(last, "o_orderkey", "left")
    return rows.select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("src_id"),
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("tgt_id"),
        F.col("o_orderpriority").alias("description"),
        F.col("o_orderdate").alias("valid_from"),
        F.when(F.col("o_orderstatus") == "O", F.lit(None)).otherwise(F.col("shipped")).alias("valid_to"),
    )


ORDERS = """relations AS (SELECT 'C' || o_custkey AS src_id, 'O' || o_orderkey AS tgt_id, o_orderpriority AS description, o_orderdate AS valid_from,
 CASE WHEN o_orderstatus = 'O' THEN NULL ELSE shipped END AS valid_to
 FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


# SQL of text functions: the classes of functions/text.py, which RE2 reads alike.
SQL_TOKENS = "list_filter(regexp_split_to_array(coalesce({0}, ''), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"
SQL_LEXICAL = "list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', '', 'g'), '[\\s\\p{{Z}}]+'), lambda x: x <> '')"
SQL_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+'))"
SQL_STRIP = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
