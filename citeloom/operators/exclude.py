"""Rows that have a citation's shape but are none: ordered reasons, first hit wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import page_of

#: Content types in scope, the last page plus one, markers of other authors.
KEPT_TYPES = ("research-article", "book-review", "book-reviews", "discussion")
FIRST_YEAR = 1463
FOREIGN = (
    "Aj Od Il Ar Nub Ran Soph Eur Hom Aesch Pind Sall Iug his Tac Verg Aen Ov Hor Cic Liv Plut Sext adv math schol fr frg POxy PMG Gen Ex Lev Matt Luc Joh"
).split()
GREEK = ("bekker", "stephanus", "ambiguous")


def numeric_density(context: Column) -> Column:
    """Share of blank-, comma- or semicolon-separated tokens that look like numbers or loci."""
    tokens = F.filter(F.split(context, r"[\s,;]+"), lambda t: t != "")
    numbers = F.filter(tokens, lambda t: t.rlike(r"^\(?\d+[a-eA-E]?\d*[.,;:)]*$"))
    return F.when(F.size(tokens) == 0, 0.0).otherwise(F.size(numbers) / F.size(tokens))


def locus_count(context: Column) -> Column:
    return F.regexp_count(context, F.lit(r"\b\d+[a-eA-E]\d*\b"))


#: Where the bands of numeric density begin.
DENSITY_BANDS = (0.0, 0.3, 0.5, 0.7, 0.9)


def density_band(density: Column) -> Column:
    """The beginning of the band that a density is in."""
    return F.element_at(F.filter(F.array(*map(F.lit, DENSITY_BANDS)), lambda b: b <= density), -1)


def density_profile(rows: DataFrame, by: str = "doctype", thresholds: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """by, band, n, over_50 and so on: contexts by band of their numeric density, and how many reach each threshold."""
    density = rows.select(by, numeric_density(F.col("context")).alias("d"))
    over = [F.count_if(F.col("d") >= t).alias(f"over_{round(100 * t)}") for t in thresholds]
    return density.groupBy(by, density_band(F.col("d")).alias("band")).agg(F.count("*").alias("n"), *over)


def index_like(context: Column, cites: int = 5) -> Column:
    """Whether a window looks like an index or a concordance: many citations, or a number, colon, number."""
    return (locus_count(context) >= cites) | context.rlike(r"\d+[a-eA-E]?\s*:\s*\d")


def neighbours(match: Column, context: Column, offset: Column | None = None) -> tuple[Column, Column]:
    """The 12 characters before and 8 after the match's first occurrence, or after ``offset`` (from 1)."""
    at = F.instr(context, match) if offset is None else offset
    before = F.when(at > 0, F.substr(context, F.greatest(at - 12, F.lit(1)), F.least(at - 1, F.lit(12)))).otherwise("")
    after = F.when(at > 0, F.substr(context, at + F.char_length(match), F.lit(8))).otherwise("")
    return before, after


def reason(match: Column, context: Column, corpus: Column, doctype: Column) -> Column:
    """book_section_ref, dk_fragment, modern_year, foreign_text, excluded_doctype, or null. Content
    reasons apply to page-reference systems only, the scope of doctypes to all; an empty doctype is in
    scope, ``?`` is not."""
    before, after = neighbours(match, context)
    greek = corpus.isin(*GREEK)
    return (
        F.when(greek & before.rlike(r"\d+\.$"), "book_section_ref")
        .when(greek & after.rlike(r"(?i)^\s*[-–—]?\s*(?:=\s*)?(?:d[\s.\-]?k|diels)"), "dk_fragment")
        .when(greek & (page_of(match) >= FIRST_YEAR), "modern_year")
        .when(greek & before.rlike(rf"(?i)\b(?:{'|'.join(FOREIGN)})\.?\s*$"), "foreign_text")
        .when((doctype != "") & ~doctype.isin(*KEPT_TYPES), "excluded_doctype")
    )
