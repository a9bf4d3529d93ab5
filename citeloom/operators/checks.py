"""Invariants over results, as DataFrames of what violates them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def out_of_range(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows whose page is outside their work's span, or has none."""
    found = rows.join(spans, "work", "left")
    return found.where(F.coalesce(~F.col("page").between(F.col("start"), F.col("end")), F.lit(True)))


def coverage(requested: DataFrame, delivered: DataFrame) -> DataFrame:
    """One row: requested, delivered, missing and extra distinct ids."""
    both = requested.select("iid").distinct().withColumn("r", F.lit(1)).join(delivered.select("iid").distinct().withColumn("d", F.lit(1)), "iid", "full")
    return both.agg(F.count("r").alias("requested"), F.count("d").alias("delivered"), F.count_if(F.col("d").isNull()).alias("missing"), F.count_if(F.col("r").isNull()).alias("extra"))


def assignment_rate(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy("work").agg((F.count_if(F.coalesce(F.col(column), F.lit("")) != "") / F.count("*")).alias("rate"))


def unclean_partitions(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of a type that a delivery should not hold, by type."""
    return rows.where(~F.col("doctype").isin(*keep)).groupBy("doctype").agg(F.count("*").alias("n"))


def group_coverage(rows: DataFrame, members: DataFrame) -> DataFrame:
    """journal, missing_in_rows, in_no_group: where the rows' journals and the groups' members differ."""
    here = rows.select("journal").distinct().withColumn("__row", F.lit(True))
    there = members.select("journal").distinct().withColumn("__member", F.lit(True))
    both = here.join(there, "journal", "full")
    return both.where("__row IS NULL OR __member IS NULL").select("journal", F.col("__row").isNull().alias("missing_in_rows"), F.col("__member").isNull().alias("in_no_group"))
