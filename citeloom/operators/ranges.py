"""Page spans: ranges become pages, so a range join is an equi-join with a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pages(spans: DataFrame) -> DataFrame:
    """One row for each page of each span. Spans are closed; a reversed one has no page."""
    return spans.where("start <= end").withColumn("page", F.explode(F.sequence("start", "end")))


def page_works(spans: DataFrame) -> DataFrame:
    """page, works (sorted): as many rows as the systems have pages."""
    return pages(spans).groupBy("page").agg(F.sort_array(F.collect_set("work")).alias("works"))


def page_spans(spans: DataFrame) -> DataFrame:
    """page, spans (work, lo, hi): for refinement by precise boundaries."""
    return pages(spans).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("work", "lo", "hi"))).alias("spans"))


def refine(spans: Column, at: Column) -> Column:
    """Spans whose precise bounds hold the position; those without stay; if none is left, all are."""
    kept = F.filter(spans, lambda s: s["lo"].isNull() | ((s["lo"] <= at) & (at <= s["hi"])))
    return F.when(F.size(kept) == 0, spans).otherwise(kept)


def boundaries(spans: DataFrame) -> DataFrame:
    """Pages on which one span ends and another starts."""
    a = spans.select(F.col("start").alias("page"), F.col("start").alias("own"))
    b = spans.select(F.col("end").alias("page"), F.col("start").alias("other"))
    return a.join(b, "page").where("own <> other").select("page").distinct()


def ngrams(words: Column, most: int) -> Column:
    """All runs of 1 to ``most`` words, joined by blanks."""
    n, none = F.size(words), F.array().cast("array<string>")

    def runs(k: int) -> Column:
        joined = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
        return F.when(n >= k, joined).otherwise(none)

    return F.array_distinct(F.concat(*map(runs, range(1, most + 1))))
