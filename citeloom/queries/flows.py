"""G01-G16, D01-D12, Q01-Q10, S10-S26 without files, V03-V09, and the flagship query from raw text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import expand
from citeloom.functions.text import locus
from citeloom.operators import aggregate, checks, extract, facet, ranges, resolve, series
from citeloom.plans.relations import CATALOGUE, catalogue, citations, table
from citeloom.queries.registry import query
from citeloom.sources import readers, writers

c = F.col


def delivery(s, d):
    """iid, full_text: a page for each citation row, with its locus in running text."""
    text = F.concat(F.lit("see "), c("page").cast("string"), c("section"), c("line").cast("string"), F.lit("; so "), c("work"))
    pages = citations(s, d).groupBy("iid").agg(F.sort_array(F.collect_list(F.struct("ord", text.alias("text")))).alias("rows"))
    return pages.select("iid", F.transform("rows", lambda r: r["text"]).alias("full_text"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """work, year, n, total, share: from raw page text through extraction to the share-of-year series."""
    found = extract.extract(delivery(s, d))
    at = locus(c("match"))
    work = F.regexp_extract("context", r"so (\S+)", 1)
    placed = found.select("iid", work.alias("work"), at["page"].alias("page"), at["section"].alias("section"))
    years = citations(s, d).groupBy("iid").agg(F.min("year").cast("int").alias("year"))
    n = placed.join(years, "iid").groupBy("work", "year").agg(F.count("*").alias("n"))
    total = n.groupBy("year").agg(F.sum("n").alias("total"))
    return n.join(total, "year").select("work", "year", "n", "total", F.round(c("n") / c("total"), 6).alias("share"))


query("flagship_share_by_year", "WITH y AS (SELECT iid, min(CAST(year AS INT)) AS year FROM cit GROUP BY iid), n AS (SELECT work, y.year, count(*) AS n FROM cit JOIN y USING (iid) GROUP BY ALL) SELECT work, year, n, CAST(sum(n) OVER (PARTITION BY year) AS BIGINT) AS total, round(n / sum(n) OVER (PARTITION BY year), 6) AS share FROM n")(flagship)


# -- G: table-generating -------------------------------------------------------------------------


@query("g01_find_all", "SELECT iid, row_number() OVER (PARTITION BY iid ORDER BY ord, page || section || line || '; so ' || work) - 1 AS page_index, 4 AS char_offset, page || section || line AS match FROM cit")
def g01(s, d):
    return extract.extract(delivery(s, d)).select("iid", c("page_index").cast("long").alias("page_index"), "char_offset", "match")


@query("g02_overlaps", "SELECT iid, count(*) AS n, CAST(sum(length('620a-622c ') + length('see ' || page || section || line || '; so ' || work)) AS BIGINT) AS chars FROM (SELECT * FROM cit UNION ALL SELECT * FROM cit) GROUP BY iid")
def g02(s, d):
    """Each page with a range before it, whose end two shapes match: the range alone is left of the two."""
    longer = delivery(s, d).select("iid", F.transform("full_text", lambda t: F.concat(F.lit("620a-622c "), t)).alias("full_text"))
    found = extract.extract(longer)
    whole = longer.select("iid", F.aggregate("full_text", F.lit(0), lambda n, t: n + F.char_length(t)).cast("long").alias("chars"))
    return found.groupBy("iid").agg(F.count("*").alias("n")).join(whole.withColumn("chars", 2 * c("chars")), "iid")


@query("g03_long_pages", "SELECT work, count(*) AS n, CAST(sum(length(page || 'a1 ') + 100) AS BIGINT) AS chars FROM cit GROUP BY work")
def g03(s, d):
    """Pages of any length are matched whole: all rows of a work on one long page, which comes in pieces."""
    text = F.concat(c("page").cast("string"), F.lit("a1 "), F.repeat(F.lit("word "), 20))
    long = citations(s, d).select(c("work").alias("iid"), F.lit(0).alias("page_index"), F.struct("ord", "page").alias("piece"), text.alias("text"))
    found = extract.extract_pieces(long).groupBy("iid").agg(F.count("*").alias("n"), F.max("char_offset").alias("last"))
    size = long.groupBy("iid").agg(F.sum(F.char_length("text")).alias("chars"))
    return found.join(size, "iid").where("last < chars").select(c("iid").alias("work"), "n", "chars")


@query("g04_pages", "SELECT iid, CAST(row_number() OVER (PARTITION BY iid ORDER BY ord, page || section || line || '; so ' || work) - 1 AS INT) AS page_index, 'see ' || page || section || line || '; so ' || work AS page FROM cit")
def g04(s, d):
    return delivery(s, d).select("iid", F.posexplode("full_text").alias("page_index", "page"))


@query("g05_context", "SELECT iid, 'see ' || page || section || line || '; so ' || work AS context FROM cit")
def g05(s, d):
    return extract.extract(delivery(s, d)).select("iid", "context")


def _expansion(s, d, cell, system, lengths=None):
    units = expand.expand(cell, F.lit(system), lengths)
    return citations(s, d).select("ord", F.coalesce(F.array_join(units, " "), F.lit("diverted")).alias("units"))


@query(
    "g06_expand_sections",
    """SELECT ord, CASE WHEN n > 40 THEN 'diverted' ELSE array_to_string(list_transform(range(a, a + n), lambda k: CAST(k // 5 AS VARCHAR) || chr(97 + CAST(k % 5 AS INT))), ' ') END AS units
    FROM (SELECT ord, page * 5 + (ascii(section) - 97) AS a, line % 45 + 1 AS n FROM cit)""",
)
def g06(s, d):
    start = c("page") * 5 + F.ascii("section") - 97
    end = start + c("line") % 45
    name = lambda k: F.concat(F.floor(k / 5).cast("string"), F.char(97 + k % 5))
    return _expansion(s, d, F.concat(name(start), F.lit("-"), name(end)), "stephanus")


@query(
    "g07_expand_columns",
    """SELECT ord, CASE WHEN n > 20 THEN 'diverted' ELSE array_to_string(list_transform(range(a, a + n), lambda k: CAST(k // 6 AS VARCHAR) || CASE WHEN k % 6 < 3 THEN 'a' ELSE 'b' END || CASE WHEN k % 3 = 0 THEN '' ELSE CAST(15 * (k % 3) AS VARCHAR) END), ' ') END AS units
    FROM (SELECT ord, (900 + page) * 6 + line % 6 AS a, seq * 4 AS n FROM cit)""",
)
def g07(s, d):
    start = (900 + c("page")) * 6 + c("line") % 6
    end = start + c("seq") * 4 - 1
    name = lambda k: F.concat(F.floor(k / 6).cast("string"), F.when(k % 6 < 3, "a").otherwise("b"), (k % 3 * 15 + 1).cast("string"))
    return _expansion(s, d, F.concat(name(start), F.lit("-"), name(end)), "bekker")


@query("g08_expand_lines", "SELECT ord, CASE WHEN line % 35 + 1 > 30 OR 100 + line % 35 > 120 THEN 'diverted' ELSE array_to_string(list_transform(range(100, 101 + line % 35), lambda k: 'Il. ' || seq || '.' || k), ' ') END AS units FROM cit")
def g08(s, d):
    cell = F.concat(F.lit("Iliad "), c("seq").cast("string"), F.lit(".100-"), (100 + c("line") % 35).cast("string"))
    return _expansion(s, d, cell, "homer", F.array_repeat(F.lit(120), 24))


@query("g09_expand_odes", "SELECT ord, CASE WHEN line % 35 + 1 > 20 THEN 'diverted' ELSE array_to_string(list_transform(range(100, 101 + line % 35), lambda k: 'Ol. ' || seq || '.' || k), ' ') END AS units FROM cit")
def g09(s, d):
    return _expansion(s, d, F.concat(F.lit("Olympian "), c("seq").cast("string"), F.lit(".100-"), (100 + c("line") % 35).cast("string")), "pindar")


@query(
    "g10_expand_verses",
    """SELECT ord, CASE WHEN n > 30 THEN 'diverted' ELSE array_to_string(list_transform(range(1, n + 1), lambda k: CASE WHEN k <= 3 THEN 'Rom ' || seq || ':' || (k + 17) ELSE 'Rom ' || (seq + 1) || ':' || (k - 3) END), ' ') END AS units FROM (SELECT ord, seq, 3 + 1 + line % 20 AS n FROM cit)""",
)
def g10(s, d):
    cell = F.concat(F.lit("Rom "), c("seq").cast("string"), F.lit(":18-"), (c("seq") + 1).cast("string"), F.lit(":"), (1 + c("line") % 20).cast("string"))
    return _expansion(s, d, cell, "nt", F.array_repeat(F.lit(20), 16))


@query("g11_dispatch", "SELECT ord, CASE doctype WHEN 'PROMO' THEN page || 'a' WHEN 'ECONOMY' THEN 'Ol. 3.' || (1 + line) ELSE 'x-y' END AS units FROM cit")
def g11(s, d):
    kind = c("doctype")
    cell = F.when(kind == "PROMO", F.concat(c("page").cast("string"), F.lit("a"))).when(kind == "ECONOMY", F.concat(F.lit("Ol. 3."), (1 + c("line")).cast("string"))).otherwise("x-y")
    system = F.when(kind == "PROMO", "ambiguous").when(kind == "ECONOMY", "pindar").otherwise("unknown")
    return citations(s, d).select("ord", F.array_join(expand.expand(cell, system), " ").alias("units"))


@query("g12_fan_out", "SELECT CASE WHEN n > 5 THEN 'queue' ELSE 'resolved' END AS disposition, CAST(sum(CASE WHEN n > 5 THEN 1 ELSE n END) AS BIGINT) AS rows FROM (SELECT 1 + line % 7 AS n FROM cit) GROUP BY 1")
def g12(s, d):
    start = c("page") * 5 + F.ascii("section") - 97
    name = lambda k: F.concat(F.floor(k / 5).cast("string"), F.char(97 + k % 5))
    cell = F.when(c("line") % 7 == 0, name(start)).otherwise(F.concat(name(start), F.lit("-"), name(start + c("line") % 7)))
    rows = citations(s, d).select(cell.alias("cell"), expand.stephanus(cell, 5).alias("units"))
    out = rows.select(F.when(c("units").isNull(), "queue").otherwise("resolved").alias("disposition"), F.explode(F.coalesce("units", F.array("cell"))).alias("unit"))
    return out.groupBy("disposition").agg(F.count("*").alias("rows"))


@query("g13_range_pages", "SELECT p_brand AS work, unnest(range(100 + n, 103 + n)) AS page FROM (SELECT DISTINCT p_brand, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS n FROM part)")
def g13(s, d):
    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    spans = table(s, d, "part").select(c("p_brand").alias("work"), (100 + n).alias("start"), (102 + n).alias("end")).distinct()
    return ranges.pages(spans).select("work", c("page").cast("long").alias("page"))


@query("g14_ngrams", "WITH t AS (SELECT o_orderkey AS k, string_split(lower(o_orderpriority || ' of ' || o_orderstatus), ' ') AS w FROM orders), g AS (SELECT k, unnest(w) AS form FROM t UNION SELECT k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t UNION SELECT k, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM t) SELECT form, count(*) AS n FROM g GROUP BY form")
def g14(s, d):
    words = F.split(F.lower(F.concat(c("o_orderpriority"), F.lit(" of "), c("o_orderstatus"))), " ")
    return table(s, d, "orders").select(F.explode(ranges.ngrams(words, 3)).alias("form")).groupBy("form").agg(F.count("*").alias("n"))


@query("g15_ngram_containers", "SELECT event_id AS iid, 'k' AS gram, json_extract_string(props, '$.k')::INT AS n FROM events")
def g15(s, d):
    return readers.ngram_levels(table(s, d, "events").select(c("event_id").alias("iid"), "props"), "props").select("iid", "gram", "n")


@query("g16_key_walk", "SELECT 'k' AS path, json_extract_string(props, '$.k') AS value FROM events")
def g16(s, d):
    return readers.key_walk(table(s, d, "events"), "props")


# -- D: decisions --------------------------------------------------------------------------------


def decided(s, d):
    """A row's own decision, from candidate and name arrays derived from its columns."""
    n = F.regexp_extract("work", r"(\d+)", 1).cast("int")
    brand = lambda k: F.concat(F.lit("Brand#"), (1 + (n + k) % 25).cast("string"))
    cands = F.array_sort(F.array_distinct(F.slice(F.array(c("work"), brand(3), brand(9)), F.lit(1), c("seq") % 4)))
    names = F.when(c("line") % 5 == 0, F.array(c("work"))).when(c("line") % 5 == 1, F.array(F.lit("Brand#99"))).when(c("line") % 5 == 2, F.array(c("work"), brand(3))).otherwise(F.array().cast("array<string>"))
    corpus = F.when(c("doctype") == "PROMO", "homer").otherwise("bekker")
    cued = F.when(c("section") != "a", "Iliad")
    page = F.when(c("page") < 159, c("page"))
    given = F.struct(corpus.alias("corpus"), page.alias("page"), cands.alias("cands"), names.alias("names"), (c("flag") == "R").alias("cross"), (c("status") == "F").alias("edge"), cued.alias("cued"))
    rows = citations(s, d).select("ord", F.explode(F.array(given)).alias("x"))  # what is generated is computed once, whatever reads or filters it
    return rows.select("ord", F.explode(F.array(resolve.decide(*(c(f"x.{k}") for k in ("corpus", "page", "cands", "names", "cross", "edge", "cued"))))).alias("d"))


DECIDED = """r AS (SELECT *, CAST(regexp_extract(work, '(\\d+)', 1) AS INT) AS n FROM cit),
k AS (SELECT *, list_sort(list_distinct([work, 'Brand#' || (1 + (n + 3) % 25), 'Brand#' || (1 + (n + 9) % 25)][1 : seq % 4])) AS cand,
  CASE line % 5 WHEN 0 THEN [work] WHEN 1 THEN ['Brand#99'] WHEN 2 THEN [work, 'Brand#' || (1 + (n + 3) % 25)] ELSE [] END AS names FROM r),
i AS (SELECT *, list_filter(cand, lambda x: list_contains(names, x)) AS agreed, len(cand) = 1 AND flag <> 'R' AS uniq FROM k),
m AS (SELECT ord, agreed, cand, CASE WHEN doctype = 'PROMO' THEN CASE WHEN section <> 'a' THEN 'cue_work' ELSE 'cue_unresolved' END WHEN page >= 159 THEN 'no_page'
  WHEN uniq AND list_contains(names, cand[1]) THEN 'range_unique+name' WHEN uniq AND len(names) > 0 THEN 'range_unique_name_mentioned' WHEN uniq THEN 'range_unique'
  WHEN len(cand) > 0 AND len(agreed) = 1 THEN CASE WHEN flag = 'R' THEN 'cross_system_resolved_by_name' WHEN status = 'F' THEN 'boundary_resolved_by_name' ELSE 'range+name' END
  WHEN len(cand) > 0 AND len(agreed) > 1 THEN 'name_multi_candidate' WHEN len(cand) > 0 AND len(names) > 0 THEN 'name_range_conflict' END AS method FROM i)"""


def _decision(name, methods):
    listed = ", ".join(f"'{m}'" for m in methods)
    sql = f"WITH {DECIDED} SELECT ord, method, CASE WHEN method = 'cue_work' THEN 'Iliad' WHEN method IN ('cue_unresolved', 'no_page') THEN NULL WHEN method LIKE '%by_name' OR method IN ('range+name', 'name_multi_candidate') THEN agreed[1] ELSE cand[1] END AS work FROM m WHERE method IN ({listed})"

    @query(name, sql)
    def run(s, d):
        return decided(s, d).where(c("d.method").isin(*methods)).select("ord", c("d.method").alias("method"), c("d.work").alias("work"))

    return run


_decision("d01_cued", ["cue_work", "cue_unresolved"])
_decision("d02_no_page", ["no_page"])
_decision("d04_unique", ["range_unique+name", "range_unique_name_mentioned", "range_unique"])
_decision("d05_by_name", ["cross_system_resolved_by_name", "boundary_resolved_by_name", "range+name"])
_decision("d06_several_named", ["name_multi_candidate"])
_decision("d07_conflict", ["name_range_conflict"])


@query("d03_candidates", "SELECT ord, CASE WHEN page % 2 = 0 THEN 2 ELSE 1 END AS n, page % 2 = 0 AS is_cross FROM cit")
def d03(s, d):
    pos = "struct<page:int,col:string,line:int>"
    spans = s.createDataFrame([("All", "stephanus", 100, 160, None, None), *[(f"P{p}", "bekker", p, p, None, None) for p in range(100, 160, 2)]], f"work string, system string, start int, end int, lo {pos}, hi {pos}")
    rows = citations(s, d).select("ord", F.lit("ambiguous").alias("corpus"), F.concat(c("page").cast("string"), F.lit("a")).alias("match"))
    out = resolve.candidates(rows, resolve.Tables(spans, None, None, None))
    return out.select("ord", F.size("candidates").alias("n"), c("cross").alias("is_cross"))


def articles(s, d):
    """Citation rows in the resolver's schema, with spans, names and titles derived from the tables."""
    pos = "struct<page:int,col:string,line:int>"
    spans = s.createDataFrame(
        [("Alpha", "stephanus", 100, 125, None, None), ("Beta", "stephanus", 115, 150, None, None), ("Gamma", "bekker", 140, 159, None, None)],
        f"work string, system string, start int, end int, lo {pos}, hi {pos}",
    )
    forms = s.createDataFrame([("alpha", "Alpha", False), ("beta", "Beta", False)], "form string, work string, ambiguous boolean")
    cues = s.createDataFrame([("homer", "il", "Iliad")], "corpus string, cue string, work string")
    lengths = s.createDataFrame([("Iliad", [700] * 24)], "work string, lengths array<int>")
    rows = citations(s, d)
    name = F.when(c("line") % 6 == 0, "so Alpha").when(c("line") % 6 == 1, "so Beta").otherwise("plain")
    from citeloom.operators.windows import sequence

    placed = sequence(rows, "iid", "ord", "line").select(
        "iid", c("seq_in_article").alias("seq"), F.floor(c("seq_in_article") / 6).cast("int").alias("page_index"), (c("seq_in_article") % 6 * 800).alias("char_offset"), F.lit("stephanus").alias("corpus"),
        F.concat(c("page").cast("string"), F.lit("c")).alias("match"), name.alias("context"), F.when(c("iid") % 3 == 0, "On Beta").otherwise("").alias("title"),
    )
    return placed, resolve.Tables(spans, forms, cues, lengths)


def _resolved(s, d):
    return resolve.resolve(*articles(s, d))


SCOPED = """
r AS (SELECT iid, row_number() OVER (PARTITION BY iid ORDER BY ord, line) - 1 AS seq, page, line FROM cit),
p AS (SELECT *, seq // 6 AS pi, seq % 6 * 800 AS co, CASE WHEN page < 115 THEN ['Alpha'] WHEN page <= 125 THEN ['Alpha', 'Beta'] WHEN page <= 150 THEN ['Beta'] ELSE [] END AS cand,
  CASE line % 6 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Beta' END AS name, iid % 3 = 0 AS titled FROM r),
q AS (SELECT *, CASE WHEN len(cand) = 1 THEN cand[1] WHEN len(cand) = 2 THEN name END AS own,
  CASE WHEN len(cand) = 1 THEN CASE WHEN name = cand[1] THEN 'range_unique+name' WHEN name IS NOT NULL THEN 'range_unique_name_mentioned' ELSE 'range_unique' END ELSE 'range+name' END AS how FROM p),
st AS (
  SELECT iid, CAST(-1 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS work, CAST(NULL AS VARCHAR) AS method, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS sw, CAST(0 AS BIGINT) AS spi, CAST(0 AS BIGINT) AS sco FROM (SELECT DISTINCT iid FROM cit)
  UNION ALL
  SELECT iid, seq, CASE m WHEN 'own' THEN own WHEN 'scope_inherited' THEN sw WHEN 'scope_range_mismatch' THEN sw WHEN 'title_prior' THEN 'Beta' ELSE cand[1] END, CASE m WHEN 'own' THEN how ELSE m END,
    CASE m WHEN 'own' THEN CASE how WHEN 'range_unique+name' THEN 0.97 WHEN 'range_unique' THEN 0.93 ELSE 0.90 END WHEN 'scope_inherited' THEN round(0.88::DOUBLE - 0.10::DOUBLE * least(dist / 4000.0::DOUBLE, 1), 3) WHEN 'scope_range_mismatch' THEN 0.4 WHEN 'title_prior' THEN 0.85 ELSE 0.3 END,
    CASE m WHEN 'own' THEN own WHEN 'title_prior' THEN 'Beta' ELSE sw END, CASE WHEN m IN ('own', 'title_prior') THEN pi ELSE spi END, CASE WHEN m IN ('own', 'title_prior') THEN co ELSE sco END
  FROM (SELECT *, CASE WHEN own IS NOT NULL THEN 'own' WHEN near AND (sw = 'Alpha' AND page BETWEEN 100 AND 125 OR sw = 'Beta' AND page BETWEEN 115 AND 150) THEN 'scope_inherited' WHEN near THEN 'scope_range_mismatch'
      WHEN titled AND list_contains(cand, 'Beta') THEN 'title_prior' ELSE 'unresolved' END AS m
    FROM (SELECT *, coalesce(dist >= 0 AND dist <= 4000 * (1 + pi - spi), false) AS near
      FROM (SELECT q.*, st.sw, st.spi, st.sco, CASE WHEN sw IS NULL OR pi < spi THEN NULL WHEN pi = spi THEN co - sco ELSE (pi - spi) * 100000 + co END AS dist FROM st JOIN q ON q.iid = st.iid AND q.seq = st.seq + 1)))
)"""


def _placed_rows(s, d):
    return _resolved(s, d).withColumn("seq", c("seq").cast("long"))


@query("d08_scope", f"WITH RECURSIVE {SCOPED.strip()} SELECT iid, seq, work, confidence, method FROM st WHERE method IN ('scope_inherited', 'scope_range_mismatch')")
def d08(s, d):
    return _placed_rows(s, d).where(c("method").isin("scope_inherited", "scope_range_mismatch")).select("iid", "seq", "work", "confidence", "method")


@query("d09_title_prior", f"WITH RECURSIVE {SCOPED.strip()} SELECT iid, seq, work FROM st WHERE method = 'title_prior'")
def d09(s, d):
    return _placed_rows(s, d).where("method = 'title_prior'").select("iid", "seq", "work")


@query("d10_unresolved", f"WITH RECURSIVE {SCOPED.strip()} SELECT iid, seq, work, method FROM st WHERE method = 'unresolved'")
def d10(s, d):
    return _placed_rows(s, d).where("method LIKE '%unresolved'").select("iid", "seq", "work", "method")


@query("j13_as_of", f"WITH RECURSIVE {SCOPED.strip()} SELECT iid, seq, work, confidence, method FROM st WHERE seq >= 0")
def j13(s, d):
    """Every row resolved: its own rules, else the latest work named in the article within reach."""
    return _placed_rows(s, d).select("iid", "seq", "work", "confidence", "method")


@query("w09_scope_state", f"WITH RECURSIVE {SCOPED.strip()} SELECT iid, seq, sw AS scope FROM st WHERE seq >= 0")
def w09(s, d):
    return _placed_rows(s, d).select("iid", "seq", "scope")


@query("d11_acceptance", f"WITH RECURSIVE {SCOPED.strip()} SELECT method, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS queued FROM (SELECT method, method IN ('range_unique+name', 'range_unique', 'range_unique_name_mentioned', 'range+name', 'title_prior') OR method = 'scope_inherited' AND confidence >= 0.83 AS ok FROM st WHERE seq >= 0) GROUP BY method")
def d11(s, d):
    return _resolved(s, d).groupBy("method").agg(F.count_if("accepted").alias("accepted"), F.count_if(~c("accepted")).alias("queued"))


@query("d12_promotion", "SELECT count(*) AS n FROM cit WHERE seq % 4 = 1 AND doctype = 'PROMO'")
def d12(s, d):
    rows = citations(s, d).select(
        c("work"), F.when(c("seq") % 4 == 1, F.array("work")).otherwise(F.array(c("work"), F.lit("other"))).alias("candidates"),
        F.when(c("doctype") == "PROMO", "scope_inherited").otherwise("unresolved").alias("method"), (c("flag") == "R").alias("cross"),
    )
    return resolve.promotable(rows).agg(F.count("*").alias("n"))


@query("j12_book_of", "SELECT ord, CASE WHEN page >= 140 THEN 'III' WHEN page > 120 OR (page = 120 AND section >= 'b') THEN 'II' WHEN page > 100 OR section >= 'b' OR line >= 5 THEN 'I' END AS book FROM cit")
def j12(s, d):
    make = lambda rows, cols: s.createDataFrame(rows, cols)
    openings = make([("W", "I", 100, "a", 5), ("W", "II", 120, "b", 0), ("W", "III", 140, "a", 0)], "work string, label string, page int, section string, line int")
    ends = make([("W", 159, "e", 9999)], "work string, page int, section string, line int")
    caps = make([], "work string, label string, page int, section string, line int")
    rows = citations(s, d).select("ord", F.concat(F.lit("W"), F.substring("work", 1, 0)).alias("work"), F.concat(c("page").cast("string"), "section", c("line").cast("string")).alias("match"))
    return facet.facet(rows.withColumn("book", F.lit(None).cast("string")), facet.intervals(openings, ends, caps)).select("ord", "book")


# -- Q: interactive ------------------------------------------------------------------------------

WORKS = ["Brand#2", "Brand#5", "Brand#8"]
CUBE = "cube AS (SELECT work, journal, CAST(year AS INT) AS year, count(*) AS citations, count(DISTINCT iid) AS articles FROM cit GROUP BY ALL)"
IN_WORKS = "work IN ('Brand#2', 'Brand#5', 'Brand#8')"


def cube(s, d):
    return aggregate.cube(citations(s, d))


@query("q01_series", f"WITH {CUBE} SELECT year, CAST(sum(articles) AS BIGINT) AS n FROM cube WHERE {IN_WORKS} AND journal IN ('NATION_1', 'NATION_2') AND year BETWEEN 1996 AND 2000 GROUP BY year")
def q01(s, d):
    return series.series(cube(s, d), WORKS, "articles", ["NATION_1", "NATION_2"], 1996, 2000)


@query("q02_corpus", f"WITH {CUBE} SELECT year, CAST(sum(citations) AS BIGINT) AS total FROM cube WHERE journal IN ('NATION_1', 'NATION_2') GROUP BY year")
def q02(s, d):
    return series.corpus(cube(s, d), "citations", ["NATION_1", "NATION_2"])


@query("q03_share", f"WITH {CUBE}, a AS (SELECT year, sum(citations) FILTER ({IN_WORKS}) AS n, sum(citations) AS total FROM cube GROUP BY year) SELECT year, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total, round(n / total, 8) AS share FROM a WHERE n IS NOT NULL")
def q03(s, d):
    return series.shares(cube(s, d), WORKS).withColumn("share", F.round("share", 8))


@query("q04_compare", f"WITH {CUBE} SELECT 'x' AS label, year, CAST(sum(citations) AS BIGINT) AS n FROM cube WHERE {IN_WORKS} GROUP BY year UNION ALL SELECT 'y', year, CAST(sum(citations) AS BIGINT) FROM cube WHERE work IN ('Brand#5', 'Brand#6') GROUP BY year")
def q04(s, d):
    return series.compare(cube(s, d), {"x": WORKS, "y": ["Brand#5", "Brand#6"]})


@query("q05_gaps", f"WITH {CUBE} SELECT year, CAST(sum(citations) AS BIGINT) AS n FROM cube WHERE {IN_WORKS} AND year % 3 <> 0 GROUP BY year")
def q05(s, d):
    return series.series(cube(s, d).where("year % 3 <> 0"), WORKS)


@query("q06_ranking", "SELECT work, count(*) FILTER (flag = 'A') AS floor, count(*) FILTER (flag = 'N') AS band_extra, count(*) FILTER (flag = 'R') AS unplaceable, count(*) AS total FROM cit GROUP BY work")
def q06(s, d):
    n = citations(s, d).groupBy("work").agg(*(F.count_if(c("flag") == f).alias(k) for f, k in (("A", "floor"), ("N", "band_extra"), ("R", "unplaceable"))))
    return n.withColumn("total", c("floor") + c("band_extra") + c("unplaceable")).orderBy(F.desc("floor"), "work")


@query("q07_custom_set", "SELECT page, CAST(sum(n) AS BIGINT) AS n FROM (SELECT page, journal, count(DISTINCT iid) AS n FROM cit WHERE work = 'Brand#5' AND journal IN ('NATION_3', 'NATION_4') GROUP BY ALL) GROUP BY page")
def q07(s, d):
    rows = series.selected(citations(s, d).where("work = 'Brand#5'"), ["NATION_3", "NATION_4"])
    return rows.groupBy("page", "journal").agg(F.countDistinct("iid").alias("n")).groupBy("page").agg(F.sum("n").alias("n"))


@query("q08_drill", "SELECT DISTINCT iid, journal, CAST(year AS INT) AS year FROM cit WHERE work = 'Brand#5' AND page = 120 AND section = 'b' AND CAST(year AS INT) <= 2000")
def q08(s, d):
    return series.drill(citations(s, d).withColumn("year", c("year").cast("int")), "Brand#5", 120, "b", None, None, 2000)


@query("q10_contrast", "WITH n AS (SELECT work, page, count(*) FILTER (journal IN ('NATION_1', 'NATION_2')) AS a, count(*) FILTER (journal IN ('NATION_3')) AS b FROM cit GROUP BY ALL) SELECT work, page, round(a / greatest(sum(a) OVER w, 1) - b / greatest(sum(b) OVER w, 1), 8) AS diff FROM n WINDOW w AS (PARTITION BY work)")
def q10(s, d):
    return series.journal_contrast(citations(s, d), ["NATION_1", "NATION_2"], ["NATION_3"]).withColumn("diff", F.round("diff", 8))


# -- S: sources and sinks (those that write are in files.py) and checks ----------------------------


@query("s10_id_list", "SELECT DISTINCT trim(' ' || o_orderpriority || ' ') AS iid FROM orders")
def s10(s, d):
    padded = table(s, d, "orders").select(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("value"))
    return readers.id_list(padded.union(s.createDataFrame([("   ",), ("",)], "value string")))


@query("s11_scan_ids", "SELECT DISTINCT c_mktsegment AS iid FROM customer")
def s11(s, d):
    return readers.scan_ids(table(s, d, "customer").select(F.to_json(F.struct(c("c_mktsegment").alias("iid"), "c_name")).alias("value")))


@query("s13_work_scan", "SELECT page, section, line FROM cit WHERE work = 'Brand#7'")
def s13(s, d):
    return citations(s, d).where("work = 'Brand#7'").select("page", "section", "line")


@query("s20_resume", "SELECT DISTINCT iid FROM cit WHERE iid NOT IN (SELECT iid FROM cit WHERE page < 110)")
def s20(s, d):
    rows = citations(s, d)
    return writers.not_done(rows.select("iid").distinct(), rows.where("page < 110"))


@query("s26_peek", "SELECT 'k' AS key, least(100, count(*)) AS n FROM events")
def s26(s, d):
    return readers.peek(table(s, d, "events").select(c("props").alias("value")), 100)


@query("v03_assignment", "SELECT work, round(count(*) FILTER (page >= 102) / count(*), 6) AS rate FROM cit GROUP BY work")
def v03(s, d):
    rows = citations(s, d).withColumn("book", F.when(c("page") >= 102, "I").otherwise(""))
    return checks.assignment_rate(rows, "book").withColumn("rate", F.round("rate", 6))


@query("v04_coverage", f"WITH {CATALOGUE.strip()}, r AS (SELECT DISTINCT item_id AS iid FROM catalogue), e AS (SELECT DISTINCT iid FROM cit WHERE doctype = 'PROMO') SELECT (SELECT count(*) FROM r) AS requested, (SELECT count(*) FROM e) AS delivered, (SELECT count(*) FROM r WHERE iid NOT IN (SELECT iid FROM e)) AS missing, (SELECT count(*) FROM e WHERE iid NOT IN (SELECT iid FROM r)) AS extra")
def v04(s, d):
    return checks.coverage(catalogue(s, d).select(c("item_id").alias("iid")), citations(s, d).where("doctype = 'PROMO'"))


@query("v06_clean_partition", "SELECT doctype, count(*) AS n FROM cit WHERE doctype NOT IN ('PROMO', 'ECONOMY') GROUP BY doctype")
def v06(s, d):
    return checks.unclean_partitions(citations(s, d), ["PROMO", "ECONOMY"])


@query("v08_out_of_range", "SELECT count(*) AS n FROM cit WHERE page NOT BETWEEN 105 AND 154")
def v08(s, d):
    spans = citations(s, d).select("work", F.lit(105).alias("start"), F.lit(154).alias("end")).distinct()
    return checks.out_of_range(citations(s, d), spans).agg(F.count("*").alias("n"))


@query("v09_thin_trusted", "WITH n AS (SELECT work, count(*) FILTER (flag <> 'R') AS floor, round(count(*) FILTER (flag <> 'R') / count(*), 4) AS rate FROM cit GROUP BY work) SELECT work, floor FROM n WHERE rate >= 0.66 AND floor < 1610")
def v09(s, d):
    rows = citations(s, d).withColumn("resolved", c("flag") != "R")
    return aggregate.resolution(rows).where("rate >= 0.66 AND floor < 1610").select("work", "floor")


@query("a38_gram_levels", "SELECT event_type AS level, count(*) AS records, count(*) FILTER (json_extract_string(props, '$.k')::INT >= 50) AS bearing FROM events GROUP BY event_type")
def a38(s, d):
    events = table(s, d, "events").select(c("event_id").alias("iid"), c("event_type").alias("level"), "props")
    grams = readers.ngram_levels(events, "props").groupBy("iid").agg(F.bool_or(c("n") >= 50).alias("bearing"))
    return events.join(grams, "iid", "left").groupBy("level").agg(F.count("*").alias("records"), F.count_if("bearing").alias("bearing"))


@query("p21_doi_paths", "SELECT 'ids.main_doi' AS path, count(*) AS n FROM customer UNION ALL SELECT 'ref', count(*) FILTER (c_custkey % 3 = 0) FROM customer")
def p21(s, d):
    ref = F.when(c("c_custkey") % 3 == 0, F.concat(F.lit("10.1234/"), "c_name")).otherwise(c("c_name"))
    rows = table(s, d, "customer").select(F.to_json(F.struct(F.struct(c("c_name").alias("main_doi")).alias("ids"), ref.alias("ref"), "c_mktsegment")).alias("j"))
    return readers.doi_like(readers.key_walk(rows, "j"))


@query("v05_group_coverage", "WITH u AS (SELECT DISTINCT journal FROM cit WHERE page < 105 AND flag = 'A'), g AS (SELECT n_name AS journal FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'NATION_77') SELECT coalesce(u.journal, g.journal) AS journal, u.journal IS NULL AS missing_in_rows, g.journal IS NULL AS in_no_group FROM u FULL JOIN g ON u.journal = g.journal WHERE u.journal IS NULL OR g.journal IS NULL")
def v05(s, d):
    """Groups against rows, both ways: a member that no row has, a journal that is in no group."""
    members = table(s, d, "nation").where("n_regionkey <> 1").select(c("n_name").alias("journal")).union(s.createDataFrame([("NATION_77",)], "journal string"))
    return checks.group_coverage(citations(s, d).where("page < 105 AND flag = 'A'"), members)
