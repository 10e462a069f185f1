"""Reading the tables that registered queries run over, and stand-ins derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chats(spark: SparkSession, d: str) -> DataFrame:
    """Orders as chats: urgent ones are starred, those of filled orders have no user."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("title"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate")).alias("starred_at"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("user_id"),
    )


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Line items as messages of their order; users and assistants by turns."""
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("chat_id"),
        F.col("l_shipdate").alias("created_at"),
        F.when(F.col("l_linenumber") % 2 == 1, "user").otherwise("assistant").alias("role"),
        F.col("l_quantity").cast("long").alias("output_tokens"),
        F.round(F.col("l_extendedprice")).cast("long").alias("input_tokens"),
        F.round(F.col("l_tax") * 100).cast("long").alias("tps"),
        F.round(F.col("l_discount") * 100).cast("long").alias("ttft"),
    )


#: The same stand-ins for the oracles.
CHATS_SQL = """chats AS (SELECT o_orderkey AS id, o_orderpriority || ' ' || o_orderstatus AS title, o_orderdate AS created_at,
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END AS starred_at, CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS user_id FROM orders)"""
MESSAGES_SQL = """messages AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS chat_id, l_shipdate AS created_at,
  CASE WHEN l_linenumber % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, l_quantity::BIGINT AS output_tokens, round(l_extendedprice)::BIGINT AS input_tokens,
  round(l_tax * 100)::BIGINT AS tps, round(l_discount * 100)::BIGINT AS ttft FROM lineitem)"""


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, event_id, src, dst): the event type that follows each event of a user."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
    return e.where("dst is not null")


TRANSITIONS_SQL = """transitions AS (SELECT * FROM (SELECT user_id, event_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as program blocks: (pos, name, type)."""
    kind = F.when(F.col("p_size") <= 4, "OB").when(F.col("p_type") == "ECONOMY", "DB").when(F.col("p_type") == "SMALL", "UDT").otherwise("FC")
    return table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("B"), "p_partkey").alias("name"), kind.alias("type"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Calls between blocks (src, dst): the part that follows a part on its first order that goes on."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b"), "l_orderkey", "l_linenumber")
    e = e.where("b is not null").groupBy("a").agg(F.min_by("b", F.struct("l_orderkey", "l_linenumber", "b")).alias("b"))
    return e.select(F.concat(F.lit("B"), "a").alias("src"), F.concat(F.lit("B"), "b").alias("dst"))


NODES_SQL = """nodes AS (SELECT p_partkey AS pos, 'B' || p_partkey AS name, CASE WHEN p_size <= 4 THEN 'OB' WHEN p_type = 'ECONOMY' THEN 'DB' WHEN p_type = 'SMALL' THEN 'UDT' ELSE 'FC' END AS type FROM part)"""
EDGES_SQL = """edges AS (SELECT 'B' || a AS src, 'B' || arg_min(b, (l_orderkey::HUGEINT * 100 + l_linenumber) * 1000000000 + b) AS dst FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b, l_orderkey, l_linenumber FROM lineitem) WHERE b IS NOT NULL GROUP BY a)"""
