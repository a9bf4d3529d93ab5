"""Distilled shapes: decade arrays, shape codes, shared bar scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import decade_slot, roman

SLOTS = 14


def decade_rows(units: DataFrame) -> DataFrame:
    """work, unit, slots (distinct articles by decade), total: a unit's row of a heat map."""
    n = units.withColumn("slot", decade_slot(F.col("year"))).groupBy("work", "unit", "slot").agg(F.countDistinct("iid").alias("n"))
    slot = lambda k: F.coalesce(F.sum(F.when(F.col("slot") == k, F.col("n"))), F.lit(0)).cast("long")
    return n.groupBy("work", "unit").agg(F.array(*map(slot, range(SLOTS))).alias("slots"), F.sum("n").alias("total"))


def column_shares(rows: DataFrame) -> DataFrame:
    """Each unit's share of its work's articles in every decade, 0 where there are none."""
    whole = Window.partitionBy("work")
    totals = F.array(*(F.sum(F.get("slots", F.lit(k))).over(whole) for k in range(SLOTS)))
    parts = rows.withColumn("__t", totals)
    return parts.withColumn("shares", F.zip_with("slots", "__t", lambda n, t: F.when(t > 0, n / t).otherwise(0.0))).drop("__t")


def shape_code(verdict: Column, flat_only: Column, understates: Column, powered: Column, solid: Column, survivors: Column) -> Column:
    """(shape, hedged) of a work's analysis. t: too thin to tell; s: stable; 1: one direction, r: a rise and
    a fall, each with p for named passages or w for the whole.

    ``solid``: passages that move and are well founded; ``survivors``: passages of the structure over
    several periods. A null verdict is a work without an analysis."""
    code = lambda shape, hedged=False: F.struct(F.lit(shape).alias("shape"), F.lit(hedged).alias("hedged"))
    named, reversing = solid >= 1, survivors >= 1
    return (
        F.when((verdict == "stable") & flat_only & reversing, code("rp"))
        .when((verdict == "stable") & flat_only, code("rw"))
        .when((verdict == "stable") & powered, code("s"))
        .when((verdict == "REAL") & named, code("1p"))
        .when(verdict == "REAL", code("1w"))
        .when((verdict == "marginal") & understates & reversing, code("rp", True))
        .when((verdict == "marginal") & understates, code("rw", True))
        .when((verdict == "marginal") & named, code("1p", True))
        .when(verdict == "marginal", code("1w", True))
        .otherwise(code("t"))
    )


#: Authors whose works are read by book alone.
BY_BOOK = ("Pindar", "Homer", "Paul")


def grains(author: Column, faceted: Column) -> Column:
    """The grains of a work, the first its default: book alone, book before passage where books are known,
    else passage."""
    return F.when(author.isin(*BY_BOOK), F.array(F.lit("book"))).when(faceted, F.array(F.lit("book"), F.lit("passage"))).otherwise(F.array(F.lit("passage")))


def default_grain(works: DataFrame, variants: DataFrame, whole: str = "all") -> DataFrame:
    """work, grains, default_grain, never_testable of works (work, author, faceted), from the shapes of their
    variants (work, grain, jset, shape): the first grain whose variant over all journals can be tested, or
    the first one."""
    testable = variants.where("shape <> 't'")
    found = testable.groupBy("work").agg(F.collect_set(F.when(F.col("jset") == whole, F.col("grain"))).alias("__can"))
    rows = works.select("work", grains(F.col("author"), F.col("faceted")).alias("grains")).join(found, "work", "left")
    can = F.filter("grains", lambda g: F.array_contains(F.coalesce("__can", F.array().cast("array<string>")), g))
    return rows.select("work", "grains", F.coalesce(F.get(can, F.lit(0)), F.get("grains", F.lit(0))).alias("default_grain"), F.col("__can").isNull().alias("never_testable"))


def bar_scale(floor: Column, unplaceable: Column) -> Column:
    """The longest bar of the view: floor and unplaceable together."""
    return F.max(floor + unplaceable).over(Window.partitionBy())


#: Books that are named by letters, in the order of the alphabet; a small alpha is the second book.
LETTERS = "ΑαΒΓΔΕΖΗΘΙΚΛΜΝ"


def text_order(label: Column, pooled: Column | None = None) -> Column:
    """The sort key of a unit label in the order of the text: (work or 0, book, page, section and line).

    Labels are ``Il.1.5``-like (book and line), a Roman or Greek book letter, or a page with a section;
    a pooled label is ``work:unit`` and sorts by its work first.
    """
    unit = F.when(label.contains(":"), F.element_at(F.split(label, ":"), -1)).otherwise(label)
    shelf = F.when(label.contains(":"), F.get(F.split(label, ":"), F.lit(0))).otherwise("") if pooled is None else pooled
    plain = F.rtrim(unit, F.lit("*"))
    greek = F.instr(F.lit(LETTERS), plain)
    numbers = F.transform(F.regexp_extract_all(unit, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    book = F.when((F.char_length(plain) == 1) & (greek > 0), F.array(greek)).when(roman(plain).isNotNull(), F.array(roman(plain))).otherwise(numbers)
    return F.struct(shelf.alias("shelf"), book.alias("numbers"), F.regexp_extract(unit, r"\d([a-e])", 1).alias("section"))
