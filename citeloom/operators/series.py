"""Interactive queries over the work x journal x year cube: filters, series, shares, comparisons, drills.

The cube is small (works x journals x years) and is the only thing these read; a missing year stays
missing. Each function takes parameters and returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def selected(rows: DataFrame, journals: Sequence[str] | None = None, y0: int | None = None, y1: int | None = None) -> DataFrame:
    """Journal in the set and year in the window; an undated row passes the window."""
    if journals is not None:
        rows = rows.where(F.col("journal").isin(*journals))
    year = F.col("year")
    if y0 is not None:
        rows = rows.where(year.isNull() | (year == 0) | (year >= y0))
    if y1 is not None:
        rows = rows.where(year.isNull() | (year == 0) | (year <= y1))
    return rows


def series(cube: DataFrame, works: Sequence[str], metric: str = "citations", journals: Sequence[str] | None = None, y0: int | None = None, y1: int | None = None) -> DataFrame:
    """year, n of a set of works."""
    rows = selected(cube.where(F.col("work").isin(*works)), journals, y0, y1)
    return rows.groupBy("year").agg(F.sum(metric).alias("n"))


def corpus(cube: DataFrame, metric: str = "citations", journals: Sequence[str] | None = None) -> DataFrame:
    """year, total of all works; the year window never applies here."""
    return selected(cube, journals).groupBy("year").agg(F.sum(metric).alias("total"))


def shares(cube: DataFrame, works: Sequence[str], metric: str = "citations", journals: Sequence[str] | None = None, y0: int | None = None, y1: int | None = None) -> DataFrame:
    """year, n, total, share of each year that the works have rows in."""
    both = series(cube, works, metric, journals, y0, y1).join(corpus(cube, metric, journals), "year")
    return both.withColumn("share", F.when(F.col("total") > 0, F.col("n") / F.col("total")))


def compare(cube: DataFrame, sets: dict[str, Sequence[str]], metric: str = "citations") -> DataFrame:
    """label, year, n of several sets of works, in one pass over the cube."""
    members = [F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, works)).alias("works")) for label, works in sets.items()]
    rows = cube.withColumn("set", F.explode(F.array(*members))).where(F.array_contains(F.col("set.works"), F.col("work")))
    return rows.groupBy(F.col("set.label").alias("label"), "year").agg(F.sum(metric).alias("n"))


def compare_fields(cube: DataFrame, works: Sequence[str], fields: DataFrame, metric: str = "citations") -> DataFrame:
    """One set of works split by journal field (fields: journal, field)."""
    rows = cube.where(F.col("work").isin(*works)).join(fields, "journal", "left")
    return rows.groupBy(F.coalesce("field", F.lit("other")).alias("label"), "year").agg(F.sum(metric).alias("n"))


def drill(dots: DataFrame, work: str, page: int, section: str, journals: Sequence[str] | None = None, y0: int | None = None, y1: int | None = None) -> DataFrame:
    """Distinct articles that cite a passage."""
    rows = selected(dots.where((F.col("work") == work) & (F.col("page") == page) & (F.col("section") == section)), journals, y0, y1)
    return rows.select("iid", "journal", "year").distinct()


def journal_contrast(dots: DataFrame, a: Sequence[str], b: Sequence[str]) -> DataFrame:
    """work, page, diff: share of a passage among one set's rows less its share among the other's."""
    n = dots.groupBy("work", "page").agg(F.count_if(F.col("journal").isin(*a)).alias("a"), F.count_if(F.col("journal").isin(*b)).alias("b"))
    from pyspark.sql import Window

    whole = Window.partitionBy("work")
    return n.select("work", "page", (F.col("a") / F.greatest(F.sum("a").over(whole), F.lit(1)) - F.col("b") / F.greatest(F.sum("b").over(whole), F.lit(1))).alias("diff"))


def summary(chosen: Sequence[str], groups: dict[str, Sequence[str]]) -> str:
    """A filter in words: whole groups by name, what is left by count."""
    left, names = set(chosen), []
    for name, members in groups.items():
        if members and set(members) <= left:
            names.append(name)
            left -= set(members)
    if not chosen:
        return "no journals"
    return " + ".join([*names, *([f"{len(left)} more"] if left else [])])
