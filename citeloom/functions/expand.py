"""Range cells to arrays of unit cells; null diverts the row (incoherent, out of range or too long)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.text import DASH, book_number, group, let, line_end, number

CAPS = {"stephanus": 40, "bekker": 20, "homer": 30, "pindar": 20, "nt": 30}
SECTIONS = "abcde"


#: A page and a section, then after a dash a section or both; a page, column and line, likewise.
_SECTIONS = r"^\s*(\d{2,4})\s*([a-eA-E])[^-–—]*?\s*[-–—]\s*(\d{2,4})?\s*([a-eA-E])?.*$"
_COLUMNS = r"^\s*(\d{3,4})\s*([abAB])\s*(\d+)?[^-–—]*?\s*[-–—]\s*(\d{3,4})?\s*([abAB])?\s*(\d+)?.*$"


def _groups(cell: Column, pattern: str, n: int, body) -> Column:
    """``body`` of the pattern's groups ('' where one is empty), matched once; null where it doesn't match."""
    parts = F.split(F.regexp_replace(cell, "(?s)" + pattern, ",".join(f"${k + 1}" for k in range(n))), ",")
    return F.when(cell.rlike("(?s)" + pattern), let(parts, body))


def _listed(lo: Column, hi: Column, cap: int, unit) -> Column:
    """Units lo..hi, null if there are none or more than ``cap``."""
    return F.when((hi >= lo) & (hi - lo < cap), F.transform(F.sequence(lo, hi), unit))


def _letter(c: Column) -> Column:
    return F.ascii(F.lower(c)) - 97


def _or(c: Column, other: Column) -> Column:
    """A group as a number, ``other`` where it is empty."""
    return F.coalesce(c.try_cast("int"), other)


def stephanus(cell: Column, cap: int = CAPS["stephanus"]) -> Column:
    """620a-622c to its thirteen sections: a page and section are one number, five to a page."""
    div = lambda k: F.call_function("div", k, F.lit(5)).cast("string")
    unit = lambda k: F.concat(div(k), F.substr(F.lit(SECTIONS), k % 5 + 1, F.lit(1)))

    def body(g: Column) -> Column:
        first = g[0].cast("int") * 5 + _letter(g[1])
        last = _or(g[2], g[0].cast("int")) * 5 + F.when(g[3] != "", _letter(g[3])).otherwise(_letter(g[1]))
        return let(F.struct(first.alias("lo"), last.alias("hi")), lambda k: _listed(k["lo"], k["hi"], cap, unit))

    return F.when(~cell.rlike(DASH), F.array(cell)).otherwise(_groups(cell, _SECTIONS, 4, body))


def bekker(cell: Column, cap: int = CAPS["bekker"]) -> Column:
    """A range to its 15-line bands, three to a column; a single cell keeps its line."""
    label = lambda p, c, band: F.concat(p.cast("string"), c, F.when(band == 0, "").otherwise((band * 15).cast("string")))
    unit = lambda k: label(F.call_function("div", k, F.lit(6)), F.when(k % 6 < 3, "a").otherwise("b"), k % 3)
    place = lambda at: at["page"] * 6 + (F.ascii(at["col"]) - 97) * 3 + F.least(at["band"], F.lit(2))
    at = lambda page, col, line: F.struct(page.alias("page"), col.alias("col"), F.call_function("div", line, F.lit(15)).cast("int").alias("band"))

    def body(g: Column) -> Column:
        page, col = g[0].cast("int"), F.lower(g[1])
        spot = F.struct(
            at(page, col, _or(g[2], F.lit(0))).alias("a"),
            at(_or(g[3], page), F.when(g[4] != "", F.lower(g[4])).otherwise(col), _or(g[5], F.lit(0))).alias("b"),
        )
        return let(spot, units)

    def units(x: Column) -> Column:
        a, b = x["a"], x["b"]
        # A line beyond the third band opens its column's last unit under its own band.
        own = lambda rows: F.concat(F.array(label(a["page"], a["col"], a["band"])), F.slice(rows, F.lit(2), F.size(rows)))
        ends = F.struct(place(a).alias("lo"), place(b).alias("hi"))
        listed = let(ends, lambda k: _listed(k["lo"], k["hi"], cap, unit))
        return F.when(a <= b, F.when(a["band"] > 2, let(listed, own)).otherwise(listed))

    return F.when(~cell.rlike(DASH), F.array(cell)).otherwise(_groups(cell, _COLUMNS, 6, body))


_EPIC = r"(?i)^\s*(Iliad|Odyssey|Il|Od)\.?\s*(\d{1,2}|[ivxlcdm]{1,7})[.,\s]\s*(\d{1,3})(?:\s*[-–—]\s*(\d{1,3}))?"
_ODE = r"(?i)^\s*(Olympian|Pythian|Nemean|Isthmian|Ol|Pyth|Nem|Isth)\.?\s*(\d{1,2})\.(\d{1,3})(?:\s*[-–—]\s*(\d{1,3}))?"


def _lines(cell: Column, pattern: str, cue: Column, most_book: int, cap: int, lengths: Column | None) -> Column:
    start = number(cell, pattern, 3)
    ref = F.struct(cue.alias("cue"), book_number(group(cell, pattern, 2)).alias("book"), start.alias("start"), group(cell, pattern, 4).alias("tail"))

    def body(r: Column) -> Column:
        unit = lambda n: F.concat(r["cue"], F.lit(". "), r["book"].cast("string"), F.lit("."), n.cast("string"))

        def lines(end: Column) -> Column:
            ok = r["book"].between(1, most_book) & (r["start"] >= 1)
            if lengths is not None:
                longest = F.get(lengths, r["book"] - 1)
                ok = ok & (longest.isNull() | ((r["start"] <= longest) & (end <= longest)))
            return F.when(ok, _listed(r["start"], end, cap, unit))

        return F.when(r["book"].isNull(), F.array(cell)).otherwise(let(F.coalesce(line_end(r["start"], r["tail"]), r["start"]), lines))

    return F.when(cell.rlike(pattern), let(ref, body)).otherwise(F.array(cell))


def homer(cell: Column, lengths: Column | None = None, cap: int = CAPS["homer"]) -> Column:
    return _lines(cell, _EPIC, F.initcap(F.substring(F.lower(group(cell, _EPIC)), 1, 2)), 24, cap, lengths)


def pindar(cell: Column, cap: int = CAPS["pindar"]) -> Column:
    name = F.lower(group(cell, _ODE))
    cue = F.when(name.startswith("ol"), "Ol").when(name.startswith("pyth"), "Pyth").when(name.startswith("nem"), "Nem").otherwise("Isth")
    return _lines(cell, _ODE, cue, 14, cap, None)


_VERSE = r"(\d{1,3}):(\d{1,3})(?:\s*[-–—]\s*(?:(\d{1,3}):)?(\d{1,3}))?"


def nt(cell: Column, lengths: Column | None = None, cap: int = CAPS["nt"]) -> Column:
    """Chapter:verse cells; ``lengths`` has the verses of each chapter of the cell's book."""
    part = lambda n: number(cell, _VERSE, n)
    cue = F.trim(F.regexp_extract(cell, r"^(.*?)\d{1,3}:\d{1,3}", 1))
    ref = F.struct(cue.alias("cue"), part(1).alias("ch"), part(2).alias("v"), part(3).alias("to"), group(cell, _VERSE, 4).alias("tail"))
    lengths = F.lit(None).cast("array<int>") if lengths is None else lengths
    known = lengths.isNotNull()
    size = lambda c: F.when(c >= 1, F.get(lengths, c - 1))

    def body(r: Column) -> Column:
        ch, v, to = r["ch"], r["v"], r["to"]
        unit = lambda c, n: F.trim(F.concat(r["cue"], F.lit(" "), c.cast("string"), F.lit(":"), n.cast("string")))

        def same(end: Column) -> Column:
            inside = ~known | (F.coalesce(v <= size(ch), F.lit(False)) & F.coalesce(end <= size(ch), F.lit(False)))
            return F.when(inside, _listed(v, end, cap, lambda n: unit(ch, n)))

        last = r["tail"].try_cast("int")
        good = known & (ch >= 1) & (to <= F.size(lengths)) & (to > ch) & (v <= size(ch)) & (last <= size(to))

        def chapter(c: Column) -> Column:
            lo, hi = F.when(c == ch, v).otherwise(1), F.when(c == to, last).otherwise(size(c))
            return F.when(hi >= lo, F.transform(F.sequence(lo, hi), lambda n: unit(c, n))).otherwise(F.array().cast("array<string>"))

        across = let(F.when(good, F.flatten(F.transform(F.sequence(ch, to), chapter))), lambda rows: F.when(F.size(rows) <= cap, rows))
        return F.when(to.isNull() | (to == ch), let(F.coalesce(line_end(v, r["tail"]), v), same)).otherwise(across)

    return F.when(cell.rlike(_VERSE), let(ref, body)).otherwise(F.array(cell))


def expand(cell: Column, system: Column, lengths: Column | None = None) -> Column:
    """By reference system; ``ambiguous`` is read as stephanus, an unknown system keeps the cell."""
    return (
        F.when(system.isin("stephanus", "ambiguous"), stephanus(cell))
        .when(system == "bekker", bekker(cell))
        .when(system == "homer", homer(cell, lengths))
        .when(system == "pindar", pindar(cell))
        .when(system == "nt", nt(cell, lengths))
        .otherwise(F.array(cell))
    )
