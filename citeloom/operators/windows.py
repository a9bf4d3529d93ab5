"""Ordered operators: sequences, ranks, smoothing, crossings, first-wins, medians, step-up q-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import let

def sequence(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return rows.withColumn("seq_in_article", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def average_rank(value: str, *keys: str) -> Column:
    """Rank with ties sharing their mean."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0


def smooth(series: DataFrame, keys: list[str], value: str, width: int) -> DataFrame:
    """Centred mean over calendar years of the years present; below 2 nothing changes."""
    if width < 2:
        return series.withColumn("smoothed", F.col(value).cast("double"))
    half = width // 2
    span = Window.partitionBy(*keys).orderBy("year").rangeBetween(-half, half)
    return series.withColumn("smoothed", F.avg(value).over(span))


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def half_crossing(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """For each key the row at which the running sum reaches half of the total."""
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(Window.partitionBy(*keys))
    reached = F.sum(value).over(run)
    marked = rows.withColumns({"__run": reached, "__half": total / 2.0})
    return marked.where((F.col("__run") >= F.col("__half")) & (F.col("__run") - F.col(value) < F.col("__half"))).drop("__run", "__half")


def cumulative_percent(rows: DataFrame, value: str, *order) -> DataFrame:
    total = F.sum(value).over(Window.partitionBy())
    run = F.sum(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("cumulative", F.round(100.0 * run / total, 4))


def q_values(tests: DataFrame, keys: list[str], p: str, ident: str) -> DataFrame:
    """Benjamini-Hochberg step-up q, monotone from the largest p."""
    ordered = Window.partitionBy(*keys).orderBy(p, ident)
    ranked = tests.withColumns({"__rank": F.row_number().over(ordered), "__m": F.count("*").over(Window.partitionBy(*keys))})
    tail = ordered.rowsBetween(0, Window.unboundedFollowing)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__rank")).over(tail))).drop("__rank", "__m")


def top(rows: DataFrame, n: int, keys: list[str], *order) -> DataFrame:
    """The first n rows of each key in a total order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


FOLD_BLOCK = 128


def fold(rows: Column, start: Column, step, none: Column) -> Column:
    """What ``step(state, row)`` yields over all rows in order: it returns (state, out), out an array of the
    type of ``none``. Results are gathered in blocks of rows, so that none is copied once for each later row."""
    blocks = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(rows) - 1, F.lit(FOLD_BLOCK)).cast("int")), lambda b: F.slice(rows, b * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)))

    def one(at: Column, row: Column) -> Column:
        return let(step(at["state"], row), lambda r: F.struct(r["state"].alias("state"), F.concat(at["out"], r["out"]).alias("out")))

    def block(at: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(at["state"].alias("state"), none.alias("out")), one)
        return let(done, lambda r: F.struct(r["state"].alias("state"), F.concat(at["out"], F.array(r["out"])).alias("out")))

    whole = F.aggregate(blocks, F.struct(start.alias("state"), F.slice(F.array(none), 1, 0).alias("out")), block)["out"]
    return F.when(F.size(rows) > 0, F.flatten(whole)).otherwise(none)


def running(sizes: Column) -> Column:
    """For each element the sum of those before it."""
    total = F.lit(0).cast("long")
    return fold(sizes, total, lambda at, n: F.struct((at + n).alias("state"), F.array(at).alias("out")), F.array().cast("array<bigint>"))


def longest_wins(matches: Column) -> Column:
    """Greedy sweep over matches (start, end, ...): earliest start, longest of equal starts, no overlaps."""
    ordered = F.array_sort(
        matches,
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int"),
    )

    def step(last: Column, m: Column) -> Column:
        free = m["start"] >= last
        return F.struct(F.when(free, m["end"]).otherwise(last).cast("long").alias("state"), F.filter(F.array(m), lambda _: free).alias("out"))

    return let(ordered, lambda rows: fold(rows, F.lit(-1).cast("long"), step, F.slice(rows, 1, 0)))
