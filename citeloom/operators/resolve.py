"""Citations to works: candidates by page, names in context, inherited scope, title prior.

Everything but the scope is a projection over a row's candidate and name arrays. The scope is a fold
over an article's rows in reading order, so an article's rows meet in one group; articles are records
of bounded size and the group key spreads them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.expand import expand
from citeloom.functions.text import column_line, cue_key, let, normal, page_of, unit_book
from citeloom.operators import ranges
from citeloom.operators.windows import fold

CUED = ("homer", "pindar", "nt")


@dataclass(frozen=True)
class Policy:
    accept: float = 0.90
    scope_accept: float = 0.83
    scope_chars: int = 4000
    scope_pages: int = 1


@dataclass
class Tables:
    """Dimension tables: spans (work, system, start, end, lo, hi), forms (form, work, ambiguous), cues
    (corpus, cue, work), lengths (work, lengths). No join with them is forced: Spark broadcasts a table that
    it knows to be small and deals out one that is not."""

    spans: DataFrame
    forms: DataFrame
    cues: DataFrame
    lengths: DataFrame


def _words(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-zÀ-ÿ.]+)"), F.lit(1)), normal), lambda w: w != "")


def named(rows: DataFrame, text: str, forms: DataFrame, out: str) -> DataFrame:
    """iid, seq, ``out``: the works whose forms (runs of up to three words) a text has."""
    grams = rows.select("iid", "seq", F.explode(ranges.ngrams(_words(F.col(text)), 3)).alias("form"))
    return grams.join(forms.select("form", "work"), "form").groupBy("iid", "seq").agg(F.sort_array(F.collect_set("work")).alias(out))


def _pages(spans: DataFrame) -> DataFrame:
    """page, bekker and stephanus (work, lo, hi), boundary: one small table for both systems."""
    own = lambda system: F.sort_array(F.collect_list(F.when(F.col("system") == system, F.struct("work", "lo", "hi"))))
    pages = ranges.pages(spans).groupBy("page").agg(own("bekker").alias("bekker"), own("stephanus").alias("stephanus"))
    edge = ranges.boundaries(spans.where("system = 'bekker'")).withColumn("boundary", F.lit(True))
    return pages.join(edge, "page", "left").select("page", "bekker", "stephanus", F.coalesce("boundary", F.lit(False)).alias("boundary"))


def candidates(rows: DataFrame, tables: Tables) -> DataFrame:
    """Adds page, candidates (sorted), cross (both systems), edge (a boundary page with several works)."""
    place = column_line(F.col("match"))
    rows = rows.withColumns({"page": page_of(F.col("match")), "__at": place}).join(_pages(tables.spans), "page", "left")
    none = F.array().cast(rows.schema["bekker"].dataType)
    at = F.struct(F.col("page").alias("page"), F.col("__at.col").alias("col"), F.col("__at.line").alias("line"))
    bekker = F.coalesce("bekker", none)
    bekker = F.when((F.size(bekker) > 1) & F.col("__at.col").isNotNull(), ranges.refine(bekker, at)).otherwise(bekker)
    works = lambda spans: F.transform(spans, lambda s: s["work"])
    b, s = works(bekker), works(F.coalesce("stephanus", none))
    both = F.when(F.col("corpus") == "bekker", b).when(F.col("corpus") == "stephanus", s).otherwise(F.array_union(b, s))
    cross = ~F.col("corpus").isin("bekker", "stephanus") & (F.size(b) > 0) & (F.size(s) > 0)
    return rows.withColumns({"candidates": F.array_sort(F.array_distinct(both)), "cross": cross, "edge": F.coalesce("boundary", F.lit(False)) & (F.size(b) > 1)}).drop(
        "bekker", "stephanus", "boundary", "__at"
    )


def decide(corpus: Column, page: Column, cands: Column, names: Column, cross: Column, edge: Column, cued: Column) -> Column:
    """(work, confidence, method, queued) of every rule that needs no other row; null if none decides."""
    agreed = F.array_intersect(cands, names)
    first = lambda a: F.get(a, F.lit(0))
    rule = lambda work, conf, method, queued=False: F.struct(
        work.alias("work"), F.lit(conf).cast("double").alias("confidence"), (method if isinstance(method, Column) else F.lit(method)).alias("method"), F.lit(queued).alias("queued")
    )
    nothing = F.lit(None).cast("string")
    several = F.when(cross, "cross_system_resolved_by_name").when(edge, "boundary_resolved_by_name").otherwise("range+name")
    unique = (F.size(cands) == 1) & ~cross
    return (
        F.when(corpus.isin(*CUED), F.when(cued.isNotNull(), rule(cued, 0.95, "cue_work")).otherwise(rule(nothing, 0.0, "cue_unresolved", True)))
        .when(page.isNull(), rule(nothing, 0.0, "no_page", True))
        .when(unique & F.array_contains(names, first(cands)), rule(first(cands), 0.97, "range_unique+name"))
        .when(unique & (F.size(names) > 0), rule(first(cands), 0.90, "range_unique_name_mentioned"))
        .when(unique, rule(first(cands), 0.93, "range_unique"))
        .when((F.size(cands) > 0) & (F.size(agreed) == 1), rule(first(agreed), 0.90, several))
        .when((F.size(cands) > 0) & (F.size(agreed) > 1), rule(first(F.array_sort(agreed)), 0.5, "name_multi_candidate", True))
        .when((F.size(cands) > 0) & (F.size(names) > 0), rule(first(cands), 0.45, "name_range_conflict", True))
    )


ANCHORS = ("range_unique+name", "range_unique_name_mentioned", "range_unique", "cross_system_resolved_by_name", "boundary_resolved_by_name", "range+name")
#: Base confidence of an inherited scope, what a page and a full distance take off it; fixed values.
SCOPE_BASE, SCOPE_PAGE, SCOPE_DISTANCE = 0.88, 0.15, 0.10
_OUT = "array<struct<work:string,confidence:double,method:string,queued:boolean,scope:string>>"


def scope_distance(pages: Column, offset: Column, since: Column) -> Column:
    """Characters between a row and the scope ``pages`` before it: exact on one page, coarse across pages."""
    return F.when(pages == 0, offset - since).otherwise(pages * 100000 + offset)


def scope_reaches(pages: Column, chars: Column, policy: Policy = Policy()) -> Column:
    return (pages >= 0) & (chars >= 0) & (chars <= policy.scope_chars * (policy.scope_pages + pages))


def scope_confidence(pages: Column, chars: Column, policy: Policy = Policy()) -> Column:
    decayed = SCOPE_BASE - SCOPE_PAGE * pages - SCOPE_DISTANCE * F.least(chars / float(max(policy.scope_chars, 1)), F.lit(1.0))
    return F.round(F.greatest(decayed, F.lit(0.0)), 3)


def accepted(queued: Column, confidence: Column, policy: Policy = Policy()) -> Column:
    return ~queued & (confidence >= min(policy.accept, policy.scope_accept))


def _fold(rows: Column, policy: Policy) -> Column:
    """Decide the rows that no rule of their own decides, carrying the last named work along: a decision a
    row, with the work in force after it."""

    def step(scope: Column, r: Column) -> Column:
        pages = r["page_index"] - scope["page_index"]
        chars = scope_distance(pages, r["char_offset"], scope["char_offset"])
        near = scope["work"].isNotNull() & scope_reaches(pages, chars, policy)
        conf = scope_confidence(pages, chars, policy)
        # A scope's span is asked for by page: the row has the works of both systems on its page.
        inside = F.array_contains(r["on_page"], scope["work"])
        titled = F.array_intersect(r["candidates"], r["titles"])
        own = r["own"]
        row = lambda work, conf, method, queued: F.struct(
            work.alias("work"), conf.cast("double").alias("confidence"), F.lit(method).alias("method"), queued.alias("queued")
        )
        yes, no = F.lit(True), F.lit(False)
        left = F.get(r["candidates"], F.lit(0))
        out = (
            F.when(own.isNotNull(), own)
            .when(near & inside, row(scope["work"], conf, "scope_inherited", conf < policy.scope_accept))
            .when(near, row(scope["work"], F.lit(0.4), "scope_range_mismatch", yes))
            .when(F.size(titled) == 1, row(F.get(titled, F.lit(0)), F.lit(0.85), "title_prior", no))
            .when(r["cross"], row(left, F.lit(0.3), "cross_system_unresolved", yes))
            .otherwise(row(left, F.lit(0.3), "unresolved", yes))
        )

        def decided(d: Column) -> Column:
            anchors = d["method"].isin(*ANCHORS, "title_prior")
            now = F.struct(d["work"].alias("work"), r["page_index"].alias("page_index"), r["char_offset"].alias("char_offset"))
            after = F.when(anchors, now).otherwise(scope)
            full = F.struct(*(d[k].alias(k) for k in ("work", "confidence", "method", "queued")), after["work"].alias("scope"))
            return F.struct(after.alias("state"), F.array(full).alias("out"))

        return let(out, decided)

    nowhere = F.struct(F.lit(None).cast("string").alias("work"), F.lit(0).alias("page_index"), F.lit(0).alias("char_offset"))
    return fold(rows, nowhere, step, F.array().cast(_OUT))


def resolve(citations: DataFrame, tables: Tables, policy: Policy = Policy()) -> DataFrame:
    """citations (iid, seq, page_index, char_offset, corpus, match, context, title) with candidates, work,
    confidence, method, scope (the work in force after the row) and accepted. Excluded rows must have
    been taken out: they never set a scope."""
    rows = candidates(citations, tables)
    keys = cue_key(F.col("match"), F.col("corpus"))
    cues = tables.cues.select("corpus", F.col("cue").alias("__cue"), F.col("work").alias("cued"))
    rows = rows.withColumn("__cue", keys).join(cues, ["corpus", "__cue"], "left").drop("__cue")
    everywhere = ranges.page_works(tables.spans).withColumnRenamed("works", "on_page")
    rows = rows.join(everywhere, "page", "left")
    rows = rows.join(named(citations, "context", tables.forms, "names"), ["iid", "seq"], "left")
    rows = rows.join(named(citations, "title", tables.forms.where("NOT ambiguous"), "titles"), ["iid", "seq"], "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({k: F.coalesce(k, none) for k in ("names", "titles", "on_page")})
    own = decide(*(F.col(k) for k in ("corpus", "page", "candidates", "names", "cross", "edge", "cued"))).alias("own")
    kept = [c for c in rows.columns if c not in ("iid", "seq", "own", "cued", "titles", "on_page")]
    # An article's rows travel whole through the fold, so nothing is built twice and nothing joined back.
    carried = F.struct("seq", *kept, "titles", "on_page", own)
    articles = rows.groupBy("iid").agg(F.sort_array(F.collect_list(carried)).alias("rows"))
    decided = articles.select("iid", F.explode(F.arrays_zip("rows", _fold(F.col("rows"), policy).alias("d"))).alias("z"))
    out = decided.select("iid", "z.rows.seq", *(F.col(f"z.rows.{c}").alias(c) for c in kept), "z.d.*")
    return out.withColumn("accepted", accepted(F.col("queued"), F.col("confidence"), policy))


def fan_out(resolved: DataFrame, tables: Tables) -> DataFrame:
    """Accepted rows as unit rows (match, span_src, book), the others queued with a reason: one table with
    ``disposition`` resolved or queue. A range that can't be expanded is queued as span_diverted."""
    system = tables.spans.select("work", "system").distinct()
    rows = resolved.join(system, "work", "left").join(tables.lengths, "work", "left")
    own = F.when(F.col("corpus") == "ambiguous", F.coalesce("system", F.lit("stephanus"))).otherwise(F.col("corpus"))
    rows = rows.withColumn("units", F.when(F.col("accepted"), expand(F.col("match"), own, F.col("lengths"))))
    reason = F.when(~F.col("accepted"), F.col("method")).when(F.col("units").isNull(), "span_diverted")
    rows = rows.withColumns({"reason": reason, "disposition": F.when(reason.isNull(), "resolved").otherwise("queue")})
    unit = F.explode(F.when(reason.isNull(), F.col("units")).otherwise(F.array("match")))
    out = rows.withColumn("unit", unit)
    span = F.when((F.col("disposition") == "resolved") & (F.size("units") > 1), F.col("match")).otherwise("")
    book = F.when(F.col("disposition") == "resolved", unit_book(F.col("unit"), F.col("corpus"))).otherwise("")
    return out.withColumns({"span_src": span, "book": book}).drop("match", "units", "system", "lengths").withColumnRenamed("unit", "match")


def promotable(queue: DataFrame, strict: bool = False) -> DataFrame:
    """Scope rows whose only candidate is the inherited work; ``strict`` asks for one over both systems."""
    own = (F.size("candidates") == 1) & (F.get("candidates", F.lit(0)) == F.col("work"))
    return queue.where((F.col("method") == "scope_inherited") & own & (~F.col("cross") if strict else F.lit(True)))
