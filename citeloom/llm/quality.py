"""Quality rules: a threshold table compiled into one projection over text measures.

DataFrame functions only: no user functions, no shuffle. Every measure is taken on the whole text
inside its row, so nothing is grouped and no key can be hot.

Defined results: null text reads as empty and measures 0 everywhere; ratios with a zero denominator
are 0; repeated rows are judged one by one; an empty table gives no rows; columns of the input are
kept as they are and no column is added to them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import SPACES, WORD_BREAK, let, text_of

SYMBOLS = "#*$%&|<>"

#: Common words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as with was be by on are this from at or an "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als "
    "le la les de des et un une du en que qui dans par pour sur au avec "
    "el los las y del se por con para una su lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure, an optional lower and an optional upper bound (both inclusive)."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Measures: see ``measured``. A document is kept if it meets every rule.
RULES = (
    Rule("n_words", least=50),
    Rule("mean_word_chars", least=2.0, most=12.0),
    Rule("symbol_ratio", most=0.2),
    Rule("stop_ratio", least=0.02),
    Rule("dup_line_ratio", most=0.5),
    Rule("repeat_ratio", most=0.5),
)


def _repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in ``words``.

    Windows are hashed, the position is packed into the low bits and the longs are sorted, which
    leaves equal windows side by side. What agrees in the hash is then compared word by word, so
    the count is exact.
    """
    n = F.size(words)
    bits = F.length(F.bin(n)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - F.lit(1).cast("long")

    def packed(i: Column) -> Column:
        h = F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1))
        return F.call_function("shiftleft", F.call_function("shiftright", h, bits), bits).bitwiseOR(i.cast("long"))

    def near(rows: Column, key) -> Column:
        """The elements whose key equals a neighbour's."""
        return F.filter(rows, lambda x, k: (key(x) == key(F.get(rows, k - 1))) | (key(x) == key(F.get(rows, k + 1))))

    def exact(positions: Column) -> Column:
        gram = lambda p: F.struct(F.concat_ws(" ", F.get(words, p - 1), F.get(words, p), F.get(words, p + 1)).alias("g"), p.alias("p"))
        return let(
            F.sort_array(F.transform(positions, lambda p: gram(p.cast("int")))),
            lambda rows: F.sort_array(F.transform(near(rows, lambda x: x["g"]), lambda x: x["p"])),
        )

    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b
        )

    found = let(
        F.sort_array(F.transform(F.sequence(F.lit(1), n - 2), packed)),
        lambda s: F.transform(near(s, lambda x: F.call_function("shiftright", x, bits)), lambda x: x.bitwiseAND(mask)),
    )
    return F.when(n < 3, F.lit(0)).otherwise(let(found, lambda at: F.when(F.size(at) == 0, F.lit(0)).otherwise(let(exact(at), covered))))


def _without(text: Column, drop: str) -> Column:
    return F.translate(text, drop, "")


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "mean_word_chars", "symbol_ratio", "stop_ratio", "dup_line_ratio", "repeat_ratio",
)


def measured(text: Column) -> Column:
    """All measures of a text as one struct. Words and counts are bound, so a filter on the result
    evaluates nothing twice."""
    lines = let(
        F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, SPACES)) > 0),
        lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")),
    )

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n"),
            F.char_length(_without(text, SPACES)).cast("long").alias("chars"),
            (F.char_length(text) - F.char_length(_without(text, SYMBOLS))).cast("long").alias("symbols"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("stops"),
            lines.alias("lines"),
            _repeated_words(words).cast("long").alias("repeat"),
        )

    def named(c: Column) -> Column:
        ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
        values = (
            c["n"], c["chars"], c["symbols"], c["lines"]["dup"], c["repeat"],
            ratio(c["chars"], c["n"]), ratio(c["symbols"], c["n"]), ratio(c["stops"], c["n"]), ratio(c["lines"]["dup"], c["lines"]["all"]), ratio(c["repeat"], c["n"]),
        )
        return F.struct(*(v.alias(k) for k, v in zip(MEASURES, values, strict=True)))

    return let(let(F.filter(F.split(text, WORD_BREAK), lambda w: w != ""), counts), named)


def verdict(m: Column, rules=RULES) -> Column:
    """The table as one boolean expression over the measures."""
    tests = [m[r.measure] >= r.least for r in rules if r.least is not None]
    tests += [m[r.measure] <= r.most for r in rules if r.most is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id with counts, base_failed and kept."""
    m = F.col("m")
    rows = docs.select("doc_id", measured(text_of(docs)).alias("m"))
    return rows.select("doc_id", *(m[k].alias(k) for k in MEASURES[:5]), base_failed(m).alias("base_failed"), (~base_failed(m) & verdict(m, rules)).alias("kept"))


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the same columns."""
    return docs.where(let(measured(text_of(docs)), lambda m: ~base_failed(m) & verdict(m, rules)))
