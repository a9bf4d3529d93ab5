"""Scalar column functions: normalising, parsing loci, numerals, formatting. All built-in expressions.

The patterns of loci, endpoints, cues and DOIs are fixed values: they define what is a citation.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "[-–—]"
#: Letters of the citation alphabet with an accent, and what is left of each without it.
_ACCENTED = [c for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFKD", c)) > 1]
_PLAIN = [unicodedata.normalize("NFKD", c)[0] for c in _ACCENTED]


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as wanted (a transform over one element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """A regex group, null where it is empty or nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))


def number(c: Column, pattern: str, n: int = 1) -> Column:
    return group(c, pattern, n).try_cast("int")


def flatten(c: Column) -> Column:
    """White space of any kind to single blanks, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_accents(c: Column) -> Column:
    """Letters of the token alphabet without their accents; combining marks are dropped."""
    return F.regexp_replace(F.translate(c, "".join(_ACCENTED), "".join(_PLAIN)), r"\p{M}+", "")


def normal(c: Column) -> Column:
    """Without accents, lower case, trimmed, without closing full stops."""
    return F.trim(F.regexp_replace(F.trim(F.lower(strip_accents(c))), r"\.+$", ""))


def or_unknown(c: Column) -> Column:
    """``?`` for missing or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("?"))


def first_present(*cs: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))


def year_token(c: Column) -> Column:
    """The first four-digit token, hyphens read as blanks; else the text itself; else ``?``."""
    tokens = F.filter(F.split(F.replace(c, F.lit("-"), F.lit(" ")), r"\s+"), lambda t: t.rlike(r"^\d{4}$"))
    return F.coalesce(F.get(tokens, F.lit(0)), F.nullif(c, F.lit("")), F.lit("?"))


def dated(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9]{4}$"), F.lit(False))


# -- loci ----------------------------------------------------------------------------------------


def page_of(c: Column) -> Column:
    return number(c, r"^(\d+)")


def letter_of(c: Column) -> Column:
    return F.lower(group(c, r"^\d+([a-eA-E])"))


def column_line(c: Column) -> Column:
    """(col, line) of a page-column-line cell; col null where the letter is no column, then line 0."""
    pattern = r"^\d+([abAB])(\d*)$"
    col = F.lower(group(c, pattern))
    return F.struct(col.alias("col"), F.when(col.isNull(), 0).otherwise(F.coalesce(number(c, pattern, 2), F.lit(0))).alias("line"))


def locus(c: Column) -> Column:
    """(page, section, line) of a cell."""
    pattern = r"^\s*(\d{2,4})\s*([a-eA-E])?\s*(\d+)?"
    return F.struct(number(c, pattern, 1).alias("page"), F.lower(group(c, pattern, 2)).alias("section"), number(c, pattern, 3).alias("line"))


def locus_key(page: Column, section: Column, line: Column) -> Column:
    """The sort key of a locus: a missing section counts as a, a missing line as 0."""
    return F.struct(page.alias("page"), F.coalesce(section, F.lit("a")).alias("section"), F.coalesce(line, F.lit(0)).alias("line"))


def section_endpoint(c: Column) -> Column:
    pattern = r"^\s*(\d{2,4})?\s*([a-eA-E])?"
    return F.struct(number(c, pattern, 1).alias("page"), F.lower(group(c, pattern, 2)).alias("section"))


def column_endpoint(c: Column) -> Column:
    pattern = r"^\s*(\d{3,4})?\s*([abAB])?\s*(\d+)?"
    return F.struct(
        number(c, pattern, 1).alias("page"), F.lower(group(c, pattern, 2)).alias("col"), F.coalesce(number(c, pattern, 3), F.lit(0)).alias("line")
    )


def roman(c: Column) -> Column:
    """A Roman numeral's value, a smaller digit before a larger one subtracting; null for other text."""
    digits = F.split(F.reverse(F.lower(c)), "")
    worth = lambda d: sum((F.when(d == x, v).otherwise(0) for x, v in zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000), strict=True)), F.lit(0))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))

    def add(at: Column, d: Column) -> Column:
        v = worth(d)
        return F.struct(F.when(v < at["last"], at["total"] - v).otherwise(at["total"] + v).alias("total"), v.alias("last"))

    return F.when(F.lower(c).rlike("^[ivxlcdm]+$"), F.aggregate(digits, start, add, lambda at: at["total"]))


def book_number(c: Column) -> Column:
    return F.coalesce(number(c, r"^(\d+)$"), roman(c))


def line_end(start: Column, end: Column) -> Column:
    """An abbreviated end takes the leading digits of its start: 484-93 ends at 493."""
    value, scale = end.try_cast("int"), F.pow(F.lit(10), F.length(end)).cast("int")
    return F.when(value < start, start - start % scale + value).otherwise(value)


def span_length(c: Column) -> Column:
    """Lines that a cell's trailing range covers, 1 for a single line."""
    pattern = r"(\d{1,3})\s*[-–—]\s*(\d{1,3})\s*$"
    start = number(c, pattern, 1)
    return F.when(start.isNull(), 1).otherwise(line_end(start, group(c, pattern, 2)) - start + 1)


def line_band(line: Column, size: int = 15) -> Column:
    return F.floor(F.coalesce(line, F.lit(0)) / size).cast("int")


def year_bin(year: Column, size: int) -> Column:
    return (F.floor(year / size) * size).cast("int")


def decade_slot(year: Column, first: int = 1890, slots: int = 14) -> Column:
    return F.least(F.greatest(F.floor((year - first) / 10), F.lit(0)), F.lit(slots - 1)).cast("int")


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_")


def cued_tail(c: Column) -> Column:
    """(book, line) of a cued cell: the numbers around its last dot or colon."""
    pattern = r"(\d+)[.:](\d+)$"
    return F.struct(number(c, pattern, 1).alias("book"), number(c, pattern, 2).alias("line"))


def unit_book(unit: Column, corpus: Column) -> Column:
    """The book of a fanned-out unit: what stands before the line or verse; empty elsewhere."""
    by = F.when(corpus.isin("homer", "pindar"), F.regexp_extract(unit, r"(\d+)\.\d+$", 1)).when(corpus == "nt", F.regexp_extract(unit, r"(\d+):\d+$", 1))
    return F.coalesce(by, F.lit(""))


def cue_key(cell: Column, corpus: Column) -> Column:
    """The normalised cue of a cell: il, od, ol, pyth, nem, isth, or a letter such as ``1 cor``."""
    epic = F.lower(group(cell, r"(?i)^\s*(Iliad|Odyssey|Il|Od)\.?\s*(?:\d{1,2}|[ivxlcdm]{1,7})[.,\s]\s*\d{1,3}"))
    ode = F.lower(group(cell, r"(?i)^\s*(Olympian|Pythian|Nemean|Isthmian|Ol|Pyth|Nem|Isth)\.?\s*\d{1,2}\.\d{1,3}"))
    letter = r"^\s*([12]|II?)?\s*([A-Za-z]+)\.?\s*\d{1,3}:\d"
    n = F.when(group(cell, letter, 1).isin("1", "I"), "1 ").when(group(cell, letter, 1).isNotNull(), "2 ").otherwise("")
    return (
        F.when(corpus == "homer", F.substring(epic, 1, 2))
        .when(corpus == "pindar", F.when(ode.startswith("ol"), "ol").when(ode.startswith("nem"), "nem").otherwise(F.substring(ode, 1, 4)))
        .when(corpus == "nt", F.concat(n, F.lower(group(cell, letter, 2))))
    )


def passage_label(page: Column, section: Column, line: Column, system: Column) -> Column:
    return (
        F.when(system == "stephanus", F.concat(page.cast("string"), section))
        .when(system == "bekker", F.concat(page.cast("string"), section, F.coalesce(line.cast("string"), F.lit(""))))
        .otherwise(F.concat_ws(".", section, page.cast("string")))
    )


def shelf_system(has_bekker: Column, has_stephanus: Column, cued: Column) -> Column:
    """A work's system from the tags its rows carry: bekker only without any stephanus row."""
    return F.when(cued.isNotNull(), cued).when(has_bekker & ~has_stephanus, "bekker").otherwise("stephanus")


def confidence_band(c: Column) -> Column:
    """The band of a confidence, which may be text; ``n/a`` where it is no number."""
    x = c.try_cast("double")
    bands = F.when(x >= 0.9, "0.90-1.00").when(x >= 0.7, "0.70-0.89").when(x >= 0.5, "0.50-0.69").when(x >= 0.3, "0.30-0.49").otherwise("0.00-0.29")
    return F.when(x.isNull(), "n/a").otherwise(bands)


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    return F.round(F.when(whole == 0, 0.0).otherwise(100.0 * part / whole), places)


def doi_bucket(c: Column) -> Column:
    """What a DOI field holds; blanks around it don't count, blanks alone are malformed."""
    doi = F.trim(c)
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "missing")
        .when(doi.rlike(r"(?i)^10\.2307/community\."), "community")
        .when(doi.rlike(r"(?i)^10\.2307/\d+$"), "jstor_stable")
        .when(doi.rlike(r"^10\.\d{4,9}/[-._;()/:A-Za-z0-9]"), "publisher")
        .otherwise("malformed")
    )


#: Parts of labels that are no article's.
NO_ARTICLE = ("front", "back", "cover", "matter", "toc", "contents", "editorial-board", "index", "advertisement", "misc", "announcement", "volume-information")


def content_class(*labels: Column) -> Column:
    """article if a label says so, else other for back matter and the like, else unknown."""
    text = F.lower(F.concat_ws(" ", *labels))
    return F.when(text.contains("article"), "article").when(text.rlike("|".join(NO_ARTICLE)), "other").otherwise("unknown")


def candidate_names(reason: Column) -> Column:
    """The names in the candidate list of a queue reason, in either kind of quotes; empty without a list."""
    listed = F.regexp_extract(reason, r"candidates\s*\[([^\]]*)\]", 1)
    return F.transform(F.regexp_extract_all(listed, F.lit("'[^']+'|\"[^\"]+\""), F.lit(0)), lambda x: F.substr(x, F.lit(2), F.length(x) - 2))


def cue_of(cell: Column) -> Column:
    """The cue of a cell: its first word, after a book number of the letters 1 or 2; null without one."""
    pattern = r"^\s*([12]\s?)?([A-Za-z]+)"
    prefix, word = F.trim(F.regexp_extract(cell, pattern, 1)), group(cell, pattern, 2)
    return F.when(prefix == "", word).otherwise(F.concat(prefix, F.lit(" "), word))


def separator(cell: Column) -> Column:
    """What stands between the book and the line of an epic cell: dot, comma or space; null in other cells."""
    mark = F.regexp_extract(cell, r"^\s*[A-Za-z]+\.?[\s\x{a0}]{0,4}(?:\d{1,2}|[IVXivx]+)(\.|,\s?|\s)\d{1,3}", 1)
    return F.when(mark == ".", "dot").when(mark.startswith(","), "comma").when(mark != "", "space")


def tick_step(most: Column, count: int = 5) -> Column:
    """Axis step: 1, 2 or 5 times a power of ten, the largest that is not above ``most / count``; null without a range."""
    rough = F.when(most > 0, most / count)
    power = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    return F.when(rough / power >= 5, 5.0).when(rough / power >= 2, 2.0).when(rough.isNotNull(), 1.0) * power


def nice_ticks(most: Column, count: int = 5) -> Column:
    """Ticks from 0 by that step; the last is at ``most`` or above."""
    return let(
        F.struct(most.cast("double").alias("most"), tick_step(most, count).alias("step")),
        lambda x: let(
            F.floor(x["most"] * 1.0001 / x["step"]).cast("int"),
            lambda n: F.transform(F.sequence(F.lit(0), n + F.when(n * x["step"] < x["most"], 1).otherwise(0)), lambda k: k * x["step"]),
        ),
    )
