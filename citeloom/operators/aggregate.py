"""Aggregations over citation rows: volumes, cells, cubes, queue profiles, missingness, allocation.

Distinct counts are exact. Every function takes DataFrames and returns one; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import dated


def volume(rows: DataFrame, *keys: str) -> DataFrame:
    """Citations and distinct articles for each key, in one pass."""
    return rows.groupBy(*keys).agg(F.count("*").alias("citations"), F.countDistinct("iid").alias("articles"))


def cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, distinct articles and a journal map for each cell.

    Journals are summed before they are gathered, so a cell's map has a row a journal, not a citation.
    Articles are counted over the cell: an article that cites it in two journals counts once.
    """
    by_journal = rows.groupBy(*keys, "journal").agg(F.count("*").alias("n"))
    maps = by_journal.groupBy(*keys).agg(F.sum("n").alias("count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("journal", "n")))).alias("by_journal"))
    return maps.join(rows.groupBy(*keys).agg(F.countDistinct("iid").alias("articles")), keys)


def cube(dots: DataFrame) -> DataFrame:
    """Work x journal x year: citations and distinct articles of dated rows."""
    return volume(dots.where(dated(F.col("year"))).withColumn("year", F.col("year").cast("int")), "work", "journal", "year")


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def mode_of(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value for each key; ties go to the smallest."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", F.lit(0))).alias("any"), F.max("n").alias("n")).join(
        counts, [key, "n"]
    ).groupBy(key).agg(F.min(value).alias(value), F.max("n").alias("n"))


def filed_and_candidates(queue: DataFrame, least: float = 0.4) -> DataFrame:
    """For each work: rows filed under it (once each) and rows that name it as a candidate (many)."""
    filed = queue.where("work is not null").groupBy("work").agg(F.count("*").alias("filed"))
    named = queue.select("conf", F.explode("candidates").alias("work"))
    held = named.groupBy("work").agg(F.count("*").alias("candidate_rows"), F.count_if(F.col("conf") >= least).alias("candidate_confident"))
    return filed.join(held, "work", "full").select("work", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("filed", "candidate_rows", "candidate_confident")))


def co_candidates(queue: DataFrame) -> DataFrame:
    """Work x partner: how many queued rows have both as candidates (pairs within a row's short list)."""
    pairs = queue.select(F.explode("candidates").alias("work"), "candidates").select("work", F.explode("candidates").alias("partner"))
    return pairs.where("work <> partner").groupBy("work", "partner").agg(F.count("*").alias("rows"))


def resolution(rows: DataFrame) -> DataFrame:
    """Rows (work, resolved boolean) to floor, queued and rate; a work without rows of either kind has rate 1."""
    sums = rows.groupBy("work").agg(F.count_if("resolved").alias("floor"), F.count_if(~F.col("resolved")).alias("queued"))
    total = F.col("floor") + F.col("queued")
    return sums.withColumn("rate", F.when(total == 0, 1.0).otherwise(F.round(F.col("floor") / total, 4)))


def tier(rate: Column, threshold: float = 0.80) -> Column:
    return F.when(rate >= threshold, "trustworthy").otherwise("uncertain")


def small_n(floor: Column, threshold: int = 100) -> Column:
    """Whether a rate rests on so few resolved rows that it is noise."""
    return floor < threshold


def page_bands(rows: DataFrame, size: int = 10, least_rows: int = 30, least_gap: float = 0.15) -> DataFrame:
    """Bands of pages whose resolved share falls short of their work's, and what they miss."""
    start = (F.floor(F.col("page") / size) * size).cast("int")
    bands = rows.groupBy("work", start.alias("band_start")).agg(F.count("*").alias("volume"), F.count_if("resolved").alias("resolved"))
    work = Window.partitionBy("work")
    bands = bands.withColumn("rate", F.sum("resolved").over(work) / F.sum("volume").over(work)).withColumn("resolved_share", F.col("resolved") / F.col("volume"))
    gap = F.col("rate") - F.col("resolved_share")
    return bands.where((F.col("volume") >= least_rows) & (gap >= least_gap)).select(
        "work",
        "band_start",
        (F.col("band_start") + size - 1).alias("band_end"),
        F.round("resolved_share", 4).alias("resolved_share"),
        F.round(gap, 4).alias("gap"),
        "volume",
        F.round(F.col("rate") * F.col("volume") - F.col("resolved"), 2).alias("est_missing"),
    )


def allocate(queue: DataFrame, floors: DataFrame) -> DataFrame:
    """Each queued row is shared out over its candidates in proportion to their floors, evenly if all are 0."""
    rows = queue.select("ord", F.explode("candidates").alias("work")).join(floors, "work", "left").fillna(0, ["floor"])
    row = Window.partitionBy("ord")
    weight = F.when(F.sum("floor").over(row) == 0, 1.0 / F.count("*").over(row)).otherwise(F.col("floor") / F.sum("floor").over(row))
    return rows.withColumn("weight", weight).groupBy("work").agg(F.sum("weight").alias("allocated"))


def upper_median(values: Column) -> Column:
    """Of an array: the element at n div 2 of the sorted values."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def nearest_rank(values: Column, share_: float) -> Column:
    ordered = F.sort_array(values)
    return F.get(ordered, F.greatest(F.ceil(F.size(values) * share_) - 1, F.lit(0)).cast("int"))


def occupancy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells, mean rows a cell and the share of cells with one row."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("cells"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.count_if(F.col("n") == 1) / F.count("*"), 6).alias("singletons"))
