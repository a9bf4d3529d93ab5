"""The base relations over the star-schema tables, as lazily built DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iid, seq, journal, year, work, page, section, line, doctype, conf, flag, status, ord.

    The fact table is joined with its orders and parts on their keys; suppliers and nations are small
    enough for Spark to broadcast on its own.
    """
    t = lambda name: table(spark, sf_dir, name)
    joined = (
        t("lineitem")
        .join(t("orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return joined.select(
        F.col("l_orderkey").alias("iid"),
        F.col("l_linenumber").alias("seq"),
        F.col("n_name").alias("journal"),
        F.year("o_orderdate").cast("string").alias("year"),
        F.col("p_brand").alias("work"),
        (100 + F.col("l_partkey") % 60).cast("int").alias("page"),
        F.char(97 + F.col("l_linenumber") % 5).alias("section"),
        F.col("l_quantity").cast("int").alias("line"),
        F.col("p_type").alias("doctype"),
        F.round(1 - 6 * F.col("l_discount"), 3).alias("conf"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("ord"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, is_part_of, published_date, content_subtype, title: one row an order."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("item_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("c_mktsegment")).alias("is_part_of"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_date"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.lower(F.substring("o_orderpriority", 3, 20))).alias("content_subtype"),
        F.concat(F.lit("On "), F.col("c_name")).alias("title"),
    )


CATALOGUE = """
catalogue AS (
  SELECT o_orderkey AS item_id, CASE WHEN o_orderstatus <> 'P' THEN c_mktsegment END AS is_part_of, strftime(o_orderdate, '%Y-%m-%d') AS published_date,
    CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE lower(substring(o_orderpriority, 3, 20)) END AS content_subtype, 'On ' || c_name AS title
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
)"""
