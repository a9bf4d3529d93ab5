"""Citation extraction: find-all with offsets in six shapes, longest wins, context windows, running order.

Each pattern marks its matches in one pass over a page; the start of a match is the summed length of all
that the marks cut off before it. Pages are matched whole, at any length; one too long for a row comes in
pieces and is cut only where no match can reach over. The shapes, their tails and their cue words are
fixed values: they define what is a citation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import flatten, let
from citeloom.operators.windows import longest_wins, running

#: The cue words of each cued system.
CUES = {
    "homer": ("Iliad", "Odyssey", "Il", "Od"),
    "pindar": ("Olympian", "Pythian", "Nemean", "Isthmian", "Ol", "Pyth", "Nem", "Isth"),
    "nt": ("Rom", "(?:[12]|II?) ?Cor", "Gal", "Eph", "Phil", "Col", "(?:[12]|II?) ?Thess", "(?:[12]|II?) ?Tim", "Tit", "Phlm"),
}
ROMAN_BOOKS = ["".join(t) for t in ((("", "X", "XX")[n // 10], ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")[n % 10]) for n in range(1, 25))]
CONTEXT = 120


def _cued(system: str, shape: str) -> str:
    return rf"(?i)\b(?:{'|'.join(CUES[system])})\.?[\s\x{{a0}}]{{0,4}}(?:{shape})"


def patterns() -> dict[str, str]:
    """System to pattern, in order of precedence for equal spans."""
    books = "|".join(sorted(ROMAN_BOOKS, key=len, reverse=True))
    section_tail, column_tail, more = r"(?:[-–—](?:\d{2,3})?[a-eA-E]\d{0,2})?", r"(?:[-–—](?:\d{4})?[abAB]\d{0,2})?", r"\d{1,3}(?:[-–]\d{1,3})?"
    return {
        "bekker": rf"\b\d{{4}}[abAB]\d{{0,2}}{column_tail}\b",
        "stephanus": rf"\b\d{{2,3}}[c-eC-E]\d{{0,2}}{section_tail}\b",
        "ambiguous": rf"\b\d{{2,3}}[abAB]\d{{0,2}}{section_tail}\b",
        "homer": _cued("homer", rf"(?:\d{{1,2}}|{books})(?:\.|,\s?|\s){more}"),
        "pindar": _cued("pindar", rf"\d{{1,2}}\.{more}"),
        "nt": _cued("nt", rf"\d{{1,3}}:{more}"),
    }


#: Marks around matches; a page's own ones (control characters, no white space) become a third.
OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"


def found(page: Column, system: str, pattern: str) -> Column:
    """All matches of one pattern: (start, end, corpus, match). The pattern runs over the page once: its
    matches are marked, and what the marks cut off are gap, match, gap and so on."""
    flags = "(?U)(?i)" if "(?i)" in pattern else "(?U)"
    marked = F.regexp_replace(page, flags + pattern.replace("(?i)", ""), f"{OPEN}$0{CLOSE}")
    none = F.array().cast("array<struct<start:bigint,end:bigint,corpus:string,match:string>>")

    def placed(parts: Column, begin: Column) -> Column:
        row = lambda k: F.struct(F.get(begin, k).alias("start"), F.get(begin, k + 1).alias("end"), F.lit(system).alias("corpus"), F.get(parts, k).alias("match"))
        return F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), row)

    def rows(parts: Column) -> Column:
        return F.when(F.size(parts) > 1, let(running(F.transform(parts, F.char_length)), lambda begin: placed(parts, begin))).otherwise(none)

    return let(F.split(marked, f"[{OPEN}{CLOSE}]"), rows)


def matches(page: Column) -> Column:
    """Matches of all six shapes in reading order, overlaps resolved."""
    plain = F.translate(page, OPEN + CLOSE, OTHER * 2)
    return let(plain, lambda text: longest_wins(F.concat(*(found(text, k, p) for k, p in patterns().items()))))


def extract(delivery: DataFrame) -> DataFrame:
    """delivery (iid, full_text array) to citations: iid, page_index, char_offset, seq, corpus, match, context.

    ``seq`` runs through an article in (page, offset) order; null pages are skipped.
    """
    pages = delivery.select("iid", F.posexplode("full_text").alias("page_index", "page")).where("page IS NOT NULL")
    hits = pages.select("iid", "page_index", "page", F.explode(matches(F.col("page"))).alias("m"))
    lo = F.greatest(F.col("m.start") - CONTEXT, F.lit(0))
    rows = hits.select(
        "iid",
        "page_index",
        F.col("m.start").cast("int").alias("char_offset"),
        F.col("m.corpus").alias("corpus"),
        F.col("m.match").alias("match"),
        flatten(F.substr("page", (lo + 1).cast("int"), (F.col("m.end") + CONTEXT - lo).cast("int"))).alias("context"),
    )
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("iid").orderBy("page_index", "char_offset")) - 1)


#: Characters of a long page that are brought together at once; more than a context, at least.
BLOCK = 1 << 12


def safe_cut() -> str:
    """White space that no match holds: the character before it is a letter, and neither a cue nor a numeral
    ends there. No shape goes on from anything else to white space."""
    cues = "|".join(c.replace("(?:[12]|II?) ?", "") for k in sorted(CUES) for c in CUES[k])
    return rf"(?U)(?i)(?<=\p{{L}})(?<![ivx]|{cues})\s"


def extract_pieces(pieces: DataFrame, block: int = BLOCK) -> DataFrame:
    """What ``extract`` finds on whole pages, from pieces (iid, page_index, piece, text) that follow each other
    by ``piece``: no row or task holds a page. ``char_offset`` is long.

    The text is dealt to blocks of equal length. A block's part up to its first safe cut belongs to the
    segment before it, and a segment is matched by itself; text without a safe cut stays in one segment.
    """
    page = ["iid", "page_index"]
    text = pieces.where("text IS NOT NULL AND text <> ''").withColumn("size", F.char_length("text").cast("long"))
    before = Window.partitionBy(*page).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = text.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")))
    whole = lambda x: F.call_function("div", x, F.lit(block))
    spread = placed.withColumn("b", F.explode(F.sequence(whole(F.col("at")), whole(F.col("at") + F.col("size") - 1))))
    lo = F.greatest(F.col("b") * block - F.col("at"), F.lit(0))
    own = F.substr("text", (lo + 1).cast("int"), ((F.col("b") + 1) * block - F.col("at") - lo).cast("int"))
    rows = spread.groupBy(*page, "b").agg(F.sort_array(F.collect_list(F.struct("at", own.alias("text")))).alias("t"))
    rows = rows.select(*page, "b", F.array_join(F.col("t.text"), "").alias("text"))

    order = Window.partitionBy(*page).orderBy("b")
    longest = max(len(x) for k in CUES for x in CUES[k])  # so far the cut looks back, and must see
    head = F.regexp_extract("text", f"(?s)^.{{{longest},}}?{safe_cut()}", 0)
    cut = F.when(F.col("b") == 0, 0).when(head != "", F.char_length(head))
    edges = {"left": F.coalesce(F.lag(F.right("text", F.lit(CONTEXT))).over(order), F.lit("")), "right": F.coalesce(F.lead(F.left("text", F.lit(CONTEXT))).over(order), F.lit(""))}
    rows = rows.withColumns({**edges, "cut": cut})
    rows = rows.withColumn("last", F.last(F.when(F.col("cut").isNotNull(), F.col("b")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    to = F.coalesce("cut", F.char_length("text"))
    start, rest = F.left("text", to), F.substr("text", to + 1)
    closing = F.struct(F.col("last").alias("segment"), "b", start.alias("text"), F.lit("").alias("left"), F.left(F.concat(rest, "right"), F.lit(CONTEXT)).alias("right"), (F.col("b") * block).alias("at"))
    opening = F.struct(F.col("b").alias("segment"), "b", rest.alias("text"), F.right(F.concat("left", start), F.lit(CONTEXT)).alias("left"), "right", (F.col("b") * block + to).alias("at"))
    halves = F.array_compact(F.array(F.when(F.col("last").isNotNull(), closing), F.when(F.col("cut").isNotNull(), opening)))
    parts = rows.select(*page, F.explode(halves).alias("p"))
    joined = parts.groupBy(*page, "p.segment").agg(F.sort_array(F.collect_list("p")).alias("p"))
    first, last = F.get("p", F.lit(0)), F.get("p", F.size("p") - 1)
    joined = joined.select(*page, first["at"].alias("at"), first["left"].alias("left"), F.array_join(F.col("p.text"), "").alias("text"), last["right"].alias("right"))

    hits = joined.select(*page, "at", "left", F.concat("left", "text", "right").alias("around"), F.explode(matches(F.col("text"))).alias("m"))
    begin = F.char_length("left") + F.col("m.start")
    lo = F.greatest(begin - CONTEXT, F.lit(0))
    found = hits.select(
        *page,
        (F.col("at") + F.col("m.start")).alias("char_offset"),
        F.col("m.corpus").alias("corpus"),
        F.col("m.match").alias("match"),
        flatten(F.substr("around", (lo + 1).cast("int"), (begin + F.col("m.end") - F.col("m.start") + CONTEXT - lo).cast("int"))).alias("context"),
    )
    return found.withColumn("seq", F.row_number().over(Window.partitionBy("iid").orderBy("page_index", "char_offset")) - 1)
