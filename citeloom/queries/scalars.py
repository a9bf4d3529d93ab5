"""Projections, predicates and scalar functions over the relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import exclude, shapes
from citeloom.operators.temporal import correlation
from citeloom.plans.relations import CATALOGUE, catalogue, citations, table
from citeloom.queries.registry import query

c = F.col
CELL = "(page || section || line)"


def cell():
    return F.concat(c("page").cast("string"), "section", c("line").cast("string"))


@query("p01_projection", f"WITH {CATALOGUE.strip()} SELECT item_id, coalesce(nullif(is_part_of, ''), '?') AS journal, coalesce(nullif(content_subtype, ''), '?') AS doctype, coalesce(nullif(title, ''), '?') AS title FROM catalogue")
def p01(s, d):
    return catalogue(s, d).select("item_id", T.or_unknown(c("is_part_of")).alias("journal"), T.or_unknown(c("content_subtype")).alias("doctype"), T.or_unknown(c("title")).alias("title"))


@query("p02_year_token", "WITH x AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'c-' || year(o_orderdate) WHEN 1 THEN 'n.d.' WHEN 2 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders) SELECT k, coalesce(list_filter(string_split(replace(d, '-', ' '), ' '), lambda t: regexp_full_match(t, '\\d{4}'))[1], nullif(d, ''), '?') AS year FROM x")
def p02(s, d):
    k, date = c("o_orderkey"), c("o_orderdate")
    raw = F.when(k % 4 == 0, F.concat(F.lit("c-"), F.year(date).cast("string"))).when(k % 4 == 1, "n.d.").when(k % 4 == 2, "").otherwise(F.date_format(date, "yyyy-MM-dd"))
    return table(s, d, "orders").select(k.alias("k"), T.year_token(raw).alias("year"))


@query("p03_year_prefix", f"WITH {CATALOGUE.strip()} SELECT substring(published_date, 1, 4) AS year, count(*) AS n FROM catalogue GROUP BY 1")
def p03(s, d):
    return catalogue(s, d).groupBy(F.substring("published_date", 1, 4).alias("year")).agg(F.count("*").alias("n"))


@query("p04_year_pattern", f"WITH {CATALOGUE.strip()} SELECT item_id, regexp_extract(title || ' ' || published_date, '(1[6-9]\\d\\d|20[0-2]\\d)', 1) AS year FROM catalogue")
def p04(s, d):
    return catalogue(s, d).select("item_id", F.regexp_extract(F.concat_ws(" ", "title", "published_date"), r"(1[6-9]\d\d|20[0-2]\d)", 1).alias("year"))


@query("p05_dated", "SELECT count(*) FILTER (regexp_full_match(y, '[0-9]{4}')) AS dated, count(*) AS rows FROM (SELECT CASE WHEN seq = 1 THEN '?' WHEN seq = 2 THEN '199' ELSE year END AS y FROM cit)")
def p05(s, d):
    y = F.when(c("seq") == 1, "?").when(c("seq") == 2, "199").otherwise(c("year"))
    return citations(s, d).agg(F.count_if(T.dated(y)).alias("dated"), F.count("*").alias("rows"))


@query("p06_filter_undated_kept", "SELECT journal, count(*) AS n FROM cit WHERE journal IN ('NATION_1', 'NATION_2', 'NATION_3') AND (seq = 1 OR CAST(year AS INT) BETWEEN 1996 AND 1999) GROUP BY journal")
def p06(s, d):
    from citeloom.operators.series import selected

    rows = citations(s, d).withColumn("year", F.when(c("seq") != 1, c("year").cast("int")))
    return selected(rows, ["NATION_1", "NATION_2", "NATION_3"], 1996, 1999).groupBy("journal").agg(F.count("*").alias("n"))


@query("p07_keep_set", f"WITH {CATALOGUE.strip()} SELECT content_subtype AS doctype, count(*) AS n FROM catalogue WHERE content_subtype = '' OR content_subtype IN ('high', 'urgent') GROUP BY 1")
def p07(s, d):
    return catalogue(s, d).where((c("content_subtype") == "") | c("content_subtype").isin("high", "urgent")).groupBy(c("content_subtype").alias("doctype")).agg(F.count("*").alias("n"))


EXCLUSION = """x AS (SELECT ord, page || section AS m, CASE seq WHEN 1 THEN 'in 12.' || page || section WHEN 2 THEN 'see ' || page || section || ' DK 3' WHEN 3 THEN 'Soph. ' || page || section WHEN 4 THEN 'at ' || page * 10 || section ELSE 'plain ' || page || section END AS ctx,
  CASE seq WHEN 4 THEN page * 10 || section ELSE page || section END AS mm, CASE WHEN seq = 6 THEN 'misc' WHEN seq = 7 THEN '?' ELSE '' END AS dt FROM cit)"""


@query(
    "p08_exclusion_cascade",
    f"WITH {EXCLUSION} SELECT ord, CASE WHEN regexp_matches(ctx, '\\d+\\.\\d+[a-e]$') AND ctx LIKE 'in %' THEN 'book_section_ref' WHEN ctx LIKE '% DK 3' THEN 'dk_fragment' WHEN CAST(regexp_extract(mm, '^(\\d+)', 1) AS INT) >= 1463 THEN 'modern_year' WHEN ctx LIKE 'Soph.%' THEN 'foreign_text' WHEN dt <> '' THEN 'excluded_doctype' END AS reason FROM x",
)
def p08(s, d):
    p = F.concat(c("page").cast("string"), "section")
    big = F.concat((c("page") * 10).cast("string"), "section")
    seq = c("seq")
    context = F.when(seq == 1, F.concat(F.lit("in 12."), p)).when(seq == 2, F.concat(F.lit("see "), p, F.lit(" DK 3"))).when(seq == 3, F.concat(F.lit("Soph. "), p)).when(seq == 4, F.concat(F.lit("at "), big)).otherwise(F.concat(F.lit("plain "), p))
    doctype = F.when(seq == 6, "misc").when(seq == 7, "?").otherwise("")
    return citations(s, d).select("ord", exclude.reason(F.when(seq == 4, big).otherwise(p), context, F.lit("bekker"), doctype).alias("reason"))


GATED = """g AS (SELECT ord, doctype IN ('PROMO', 'ECONOMY') AS greek, CASE seq % 4 WHEN 0 THEN 'book_section_ref' WHEN 1 THEN 'dk_fragment' WHEN 2 THEN 'foreign_text' END AS content, CASE line % 3 WHEN 0 THEN 'misc' WHEN 1 THEN 'discussion' ELSE '' END AS dt FROM cit)"""


@query("p09_gating", f"WITH {GATED} SELECT ord, CASE WHEN greek AND content IS NOT NULL THEN content WHEN dt = 'misc' THEN 'excluded_doctype' END AS reason FROM g")
def p09(s, d):
    """Content reasons hold for page references alone, the scope of doctypes for all."""
    m, k = F.concat(c("page").cast("string"), F.lit("c")), c("seq") % 4
    context = F.when(k == 0, F.concat(F.lit("in 12."), m)).when(k == 1, F.concat(m, F.lit(" DK 3"))).when(k == 2, F.concat(F.lit("Soph. "), m)).otherwise(F.concat(F.lit("plain "), m))
    corpus = F.when(c("doctype").isin("PROMO", "ECONOMY"), "stephanus").otherwise("homer")
    doctype = F.when(c("line") % 3 == 0, "misc").when(c("line") % 3 == 1, "discussion").otherwise("")
    return citations(s, d).select("ord", exclude.reason(m, context, corpus, doctype).alias("reason"))


@query("p10_modern_year", "SELECT count(*) FILTER (page * 10 >= 1463) AS modern, count(*) FILTER (page * 10 < 1463) AS kept FROM cit")
def p10(s, d):
    modern = T.page_of(F.concat((c("page") * 10).cast("string"), F.lit("a"))) >= exclude.FIRST_YEAR
    return citations(s, d).agg(F.count_if(modern).alias("modern"), F.count_if(~modern).alias("kept"))


@query("p11_neighbours", "SELECT ord, right('passages near ' || work || ' ', 12) AS before, substring(' and then more', 1, 8) AS after FROM cit")
def p11(s, d):
    m = cell()
    before, after = exclude.neighbours(m, F.concat(F.lit("passages near "), "work", F.lit(" "), m, F.lit(" and then more")))
    return citations(s, d).select("ord", before.alias("before"), after.alias("after"))


@query("p12_density", f"SELECT ord, CASE WHEN seq % 2 = 0 THEN 2 / 4.0::DOUBLE ELSE 1 / 3.0::DOUBLE END AS density FROM cit WHERE {CELL} <> ''")
def p12(s, d):
    context = F.when(c("seq") % 2 == 0, F.concat(F.lit("see "), cell(), F.lit(", "), c("page").cast("string"), F.lit(" x"))).otherwise(F.concat(F.lit("see "), cell(), F.lit(" x")))
    return citations(s, d).select("ord", exclude.numeric_density(context).alias("density"))


@query("p13_locus_count", "SELECT ord, CAST(CASE WHEN seq % 2 = 0 THEN 2 ELSE 1 END AS INT) AS n FROM cit")
def p13(s, d):
    context = F.when(c("seq") % 2 == 0, F.concat_ws(" ", F.lit("see"), cell(), F.lit("12c"))).otherwise(F.concat_ws(" ", F.lit("see"), cell()))
    return citations(s, d).select("ord", exclude.locus_count(context).alias("n"))


@query("p14_index_page", "SELECT ord, seq >= 5 OR line % 4 = 0 AS is_index FROM cit")
def p14(s, d):
    """Windows with one citation for each number of a line, some with a page after a colon."""
    cites = F.repeat(F.concat(F.lit("at "), c("page").cast("string"), F.lit("c, ")), c("seq"))
    window = F.concat(cites, F.when(c("line") % 4 == 0, F.concat(F.lit("12 : "), c("line").cast("string"))).otherwise("and so: on"))
    return citations(s, d).select("ord", exclude.index_like(window).alias("is_index"))


@query("p15_review_like", "SELECT doctype, count(*) AS n FROM cit WHERE regexp_matches(lower(doctype), 'promo|econ') GROUP BY doctype")
def p15(s, d):
    return citations(s, d).where(F.lower("doctype").rlike("promo|econ")).groupBy("doctype").agg(F.count("*").alias("n"))


@query("p16_folded_match", "SELECT doc_id FROM documents WHERE regexp_matches(lower(strip_accents(text)), 'ecole|ee|uber|nin')")
def p16(s, d):
    folded = F.lower(T.strip_accents(c("text")))
    return table(s, d, "documents").where(folded.contains("ecole") | folded.contains("ee") | folded.contains("uber") | folded.contains("nin")).select("doc_id")


@query("p17_roster", "SELECT journal, tier, count(*) AS n FROM cit JOIN (VALUES ('NATION_1', 'core'), ('NATION_5', 'core'), ('NATION_7', 'wide')) r(j, tier) ON journal = j GROUP BY ALL")
def p17(s, d):
    roster = s.createDataFrame([("NATION_1", "core"), ("NATION_5", "core"), ("NATION_7", "wide")], "journal string, tier string")
    return citations(s, d).join(roster, "journal").groupBy("journal", "tier").agg(F.count("*").alias("n"))


@query("p18_canonical", "SELECT CASE WHEN regexp_matches(journal, '^NATION_1') THEN 'first' WHEN regexp_matches(journal, '2$') THEN 'second' END AS canonical, count(*) AS n FROM cit GROUP BY 1")
def p18(s, d):
    first = F.when(c("journal").rlike("^NATION_1"), "first").when(c("journal").rlike("2$"), "second")
    return citations(s, d).groupBy(first.alias("canonical")).agg(F.count("*").alias("n"))


LABEL = "CASE item_id % 6 WHEN 0 THEN 'Research-Article' WHEN 1 THEN 'front-matter' WHEN 2 THEN 'book-review' WHEN 3 THEN NULL WHEN 4 THEN 'misc' ELSE content_subtype END"


@query(
    "p19_content_class",
    f"""WITH {CATALOGUE.strip()}, i AS (SELECT lower(concat_ws(' ', {LABEL}, CASE WHEN item_id % 4 = 0 THEN 'article index' ELSE '' END)) AS l FROM catalogue)
    SELECT CASE WHEN trim(l) = '' THEN 'unknown' WHEN regexp_matches(l, 'front|back|cover|matter|toc|contents|editorial-board|index|advertisement|misc|announcement|volume-information') AND NOT contains(l, 'article') THEN 'other'
      WHEN contains(l, 'article') THEN 'article' ELSE 'unknown' END AS class, count(*) AS n FROM i GROUP BY 1""",
)
def p19(s, d):
    k = c("item_id") % 6
    label = F.when(k == 0, "Research-Article").when(k == 1, "front-matter").when(k == 2, "book-review").when(k == 4, "misc").when(k == 5, c("content_subtype"))
    return catalogue(s, d).groupBy(T.content_class(label, F.when(c("item_id") % 4 == 0, "article index").otherwise("")).alias("class")).agg(F.count("*").alias("n"))


DOI = "CASE item_id % 8 WHEN 0 THEN NULL WHEN 1 THEN ' 10.2307/' || item_id || ' ' WHEN 2 THEN '10.1093/x' || item_id WHEN 3 THEN 'https://community.x/' || item_id WHEN 4 THEN '10.2307/Community.' || item_id WHEN 5 THEN '10.2307/x' || item_id WHEN 6 THEN '  ' ELSE '10.12/abc' END"


@query("p20_doi_bucket", f"""WITH {CATALOGUE.strip()}, i AS (SELECT {DOI} AS doi FROM catalogue) SELECT CASE WHEN coalesce(doi, '') = '' THEN 'missing' WHEN regexp_matches(trim(doi), '(?i)^10\\.2307/community\\.') THEN 'community' WHEN regexp_matches(trim(doi), '(?i)^10\\.2307/\\d+$') THEN 'jstor_stable'
WHEN regexp_matches(trim(doi), '^10\\.\\d{{4,9}}/[-._;()/:A-Za-z0-9]+') THEN 'publisher' ELSE 'malformed' END AS bucket, count(*) AS n FROM i GROUP BY 1""")
def p20(s, d):
    k, t = c("item_id") % 8, c("item_id").cast("string")
    doi = (
        F.when(k == 1, F.concat(F.lit(" 10.2307/"), t, F.lit(" "))).when(k == 2, F.concat(F.lit("10.1093/x"), t)).when(k == 3, F.concat(F.lit("https://community.x/"), t))
        .when(k == 4, F.concat(F.lit("10.2307/Community."), t)).when(k == 5, F.concat(F.lit("10.2307/x"), t)).when(k == 6, "  ").when(k == 7, "10.12/abc")
    )
    return catalogue(s, d).groupBy(T.doi_bucket(doi).alias("bucket")).agg(F.count("*").alias("n"))


@query("p22_first_present", f"WITH {CATALOGUE.strip()} SELECT item_id, coalesce(nullif(content_subtype, ''), nullif(is_part_of, ''), nullif(title, '')) AS label FROM catalogue")
def p22(s, d):
    return catalogue(s, d).select("item_id", T.first_present(c("content_subtype"), c("is_part_of"), c("title")).alias("label"))


@query("p23_out_of_canon", "SELECT work, count(*) FILTER (line NOT BETWEEN 1 AND m) AS stray FROM cit JOIN (SELECT p_brand, CAST(20 + max(p_size) % 20 AS INT) AS m FROM part GROUP BY p_brand) ON work = p_brand GROUP BY work")
def p23(s, d):
    canon = table(s, d, "part").groupBy("p_brand").agg((20 + F.max("p_size") % 20).cast("int").alias("m"))
    return citations(s, d).join(canon, c("work") == c("p_brand")).groupBy("work").agg(F.count_if(~c("line").between(1, c("m"))).alias("stray"))


@query("p24_out_of_range", "SELECT ord FROM cit JOIN (SELECT DISTINCT p_brand, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS n FROM part) ON work = p_brand WHERE page NOT BETWEEN 100 + n AND 150")
def p24(s, d):
    from citeloom.operators.checks import out_of_range

    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    spans = table(s, d, "part").select(c("p_brand").alias("work"), (100 + n).alias("start"), F.lit(150).alias("end")).distinct()
    return out_of_range(citations(s, d), spans).select("ord")


@query("p25_truthy", "SELECT event_type, count(*) FILTER (json_extract_string(props, '$.k')::INT % 2 = 1) AS flagged FROM events GROUP BY event_type")
def p25(s, d):
    flag = F.when(F.get_json_object("props", "$.k").cast("int") % 2 == 1, "True").otherwise("0")
    return table(s, d, "events").groupBy("event_type").agg(F.count_if(F.lower(flag).isin("true", "1")).alias("flagged"))


@query("p26_published_columns", "SELECT iid, work, page, section, line, journal, year FROM cit")
def p26(s, d):
    from citeloom.plans.published import published

    return published(citations(s, d).withColumn("context", F.lit("licensed text"))).select("iid", "work", "page", "section", "line", "journal", "year")


# -- scalar functions ----------------------------------------------------------------------------


@query("f01_flatten", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents")
def f01(s, d):
    return table(s, d, "documents").select("doc_id", T.flatten(c("text")).alias("flat"))


@query("f02_strip_accents", "SELECT doc_id, strip_accents(text) AS plain FROM documents")
def f02(s, d):
    return table(s, d, "documents").select("doc_id", T.strip_accents(c("text")).alias("plain"))


@query("f03_normal", "SELECT doc_id, trim(rtrim(trim(lower(strip_accents(text))), '.')) AS norm FROM documents")
def f03(s, d):
    return table(s, d, "documents").select("doc_id", T.normal(c("text")).alias("norm"))


@query("f04_parts", f"SELECT ord, page, section AS letter, CASE WHEN section IN ('a', 'b') THEN section END AS col, CASE WHEN section IN ('a', 'b') THEN line ELSE 0 END AS line FROM cit WHERE {CELL} <> ''")
def f04(s, d):
    at = T.column_line(cell())
    return citations(s, d).select("ord", T.page_of(cell()).alias("page"), T.letter_of(cell()).alias("letter"), at["col"].alias("col"), at["line"].alias("line"))


@query("f05_locus", "SELECT ord, page, section, CASE WHEN seq = 1 THEN NULL ELSE line END AS line FROM cit")
def f05(s, d):
    at = T.locus(F.when(c("seq") == 1, F.concat(c("page").cast("string"), F.upper("section"))).otherwise(cell()))
    return citations(s, d).select("ord", at["page"].alias("page"), at["section"].alias("section"), at["line"].alias("line"))


@query("f06_section_endpoint", "SELECT ord, CASE WHEN seq = 1 THEN NULL ELSE page END AS page, CASE WHEN seq = 2 THEN NULL ELSE section END AS section FROM cit")
def f06(s, d):
    p = c("page").cast("string")
    at = T.section_endpoint(F.when(c("seq") == 1, c("section")).when(c("seq") == 2, p).otherwise(F.concat(p, "section")))
    return citations(s, d).select("ord", at["page"].alias("page"), at["section"].alias("section"))


@query("f07_column_endpoint", "SELECT ord, page, CASE WHEN section IN ('a', 'b') THEN section END AS col, CASE WHEN section IN ('a', 'b') THEN line ELSE 0 END AS line FROM cit")
def f07(s, d):
    at = T.column_endpoint(cell())
    return citations(s, d).select("ord", at["page"].alias("page"), at["col"].alias("col"), at["line"].alias("line"))


@query("f08_roman", "SELECT ord, 1 + line % 10 AS n FROM cit WHERE line >= 0")
def f08(s, d):
    numeral = F.element_at(F.array(*map(F.lit, "I II iii IV V VI vii VIII IX X".split())), 1 + c("line") % 10)
    return citations(s, d).select("ord", T.roman(numeral).alias("n"))


@query("f09_line_end", "SELECT ord, CASE WHEN line % 100 < page % 10 THEN page - page % 10 + page % 10 ELSE 0 END AS x, page - page % 100 + line AS short_end FROM cit WHERE line >= 10 AND page - page % 100 + line >= page")
def f09(s, d):
    rows = citations(s, d).where("line >= 10 AND page - page % 100 + line >= page")
    x = F.when(c("line") % 100 < c("page") % 10, c("page")).otherwise(0)
    return rows.select("ord", x.alias("x"), T.line_end(c("page"), c("line").cast("string")).alias("short_end"))


@query("f10_span_length", "SELECT ord, 1 + line % 9 AS n FROM cit")
def f10(s, d):
    span = F.concat(F.lit("Il. 1."), (100 + c("line")).cast("string"), F.when(c("line") % 9 > 0, F.concat(F.lit("-"), (100 + c("line") + c("line") % 9).cast("string"))).otherwise(""))
    return citations(s, d).select("ord", T.span_length(span).alias("n"))


@query("f11_band", "SELECT ord, CAST(line // 15 AS INT) AS band FROM cit")
def f11(s, d):
    return citations(s, d).select("ord", T.line_band(c("line")).alias("band"))


@query("f12_bins", "SELECT ord, CAST(CAST(year AS INT) // 5 * 5 AS INT) AS bin, CAST(greatest(0, least(13, floor((CAST(year AS INT) - 1890) / 10))) AS INT) AS slot FROM cit")
def f12(s, d):
    y = c("year").cast("int")
    return citations(s, d).select("ord", T.year_bin(y, 5).alias("bin"), T.decade_slot(y).alias("slot"))


@query("f13_safe_name", "SELECT DISTINCT regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9_.-]+', '_', 'g') AS name FROM part")
def f13(s, d):
    return table(s, d, "part").select(T.safe_name(F.concat_ws("/", "p_name", "p_brand")).alias("name")).distinct()


@query("f14_cued_tail", "SELECT ord, seq AS book, line FROM cit")
def f14(s, d):
    at = T.cued_tail(F.concat(F.lit("Il. "), c("seq").cast("string"), F.lit("."), c("line").cast("string")))
    return citations(s, d).select("ord", at["book"].alias("book"), at["line"].alias("line"))


@query("f15_unit_book", "SELECT ord, CASE WHEN doctype IN ('PROMO', 'ECONOMY') THEN CAST(seq AS VARCHAR) ELSE '' END AS book FROM cit")
def f15(s, d):
    system = F.when(c("doctype") == "PROMO", "homer").when(c("doctype") == "ECONOMY", "nt").otherwise("bekker")
    unit = F.concat(F.lit("X "), c("seq").cast("string"), F.when(c("doctype") == "PROMO", ".").otherwise(":"), c("line").cast("string"))
    return citations(s, d).select("ord", T.unit_book(unit, system).alias("book"))


@query("f16_cue_key", "SELECT ord, CASE seq % 3 WHEN 0 THEN 'il' WHEN 1 THEN 'pyth' ELSE '2 cor' END AS cue FROM cit")
def f16(s, d):
    k = c("seq") % 3
    n = c("line").cast("string")
    match = F.when(k == 0, F.concat(F.lit("Iliad IX, "), n)).when(k == 1, F.concat(F.lit("Pythian 4."), n)).otherwise(F.concat(F.lit("II Cor 3:"), n))
    return citations(s, d).select("ord", T.cue_key(match, F.when(k == 0, "homer").when(k == 1, "pindar").otherwise("nt")).alias("cue"))


@query("f18_system", "SELECT ord, CASE WHEN doctype = 'PROMO' THEN CASE WHEN page < 130 THEN 'stephanus' ELSE 'bekker' END ELSE lower(doctype) END AS system FROM cit")
def f18(s, d):
    of_work = F.when(c("page") < 130, "stephanus").otherwise("bekker")
    return citations(s, d).select("ord", F.when(c("doctype") == "PROMO", of_work).otherwise(F.lower("doctype")).alias("system"))


@query("f19_shelf_system", "SELECT work, CASE WHEN bool_or(doctype = 'PROMO' AND page > 158) THEN 'homer' WHEN bool_or(page > 157) AND NOT bool_or(page < 103) THEN 'bekker' ELSE 'stephanus' END AS system FROM cit GROUP BY work")
def f19(s, d):
    flags = citations(s, d).groupBy("work").agg(F.bool_or((c("doctype") == "PROMO") & (c("page") > 158)).alias("h"), F.bool_or(c("page") > 157).alias("b"), F.bool_or(c("page") < 103).alias("s"))
    return flags.select("work", T.shelf_system(c("b"), c("s"), F.when(c("h"), "homer")).alias("system"))


@query("f20_candidate_list", "SELECT ord, CASE seq % 4 WHEN 0 THEN work || '|' || doctype || chr(39) || 's' WHEN 1 THEN '' ELSE work || '|' || doctype END AS works FROM cit")
def f20(s, d):
    """Names in both kinds of quotes; what is quoted outside the list is no candidate."""
    single = F.concat(F.lit("'not this' named; candidates ['"), "work", F.lit("', '"), "doctype", F.lit("'] or 'that'"))
    double = F.concat(F.lit("no decisive name; candidates ['"), "work", F.lit("', \""), "doctype", F.lit("'s\"]"))
    prose = F.when(c("seq") % 4 == 0, double).when(c("seq") % 4 == 1, F.concat(F.lit("inherited '"), "work", F.lit("' but not in range"))).otherwise(single)
    return citations(s, d).select("ord", F.array_join(T.candidate_names(prose), "|").alias("works"))


@query("f21_confidence_band", "SELECT CASE WHEN seq = 7 THEN 'n/a' WHEN x >= 0.9 THEN '0.90-1.00' WHEN x >= 0.7 THEN '0.70-0.89' WHEN x >= 0.5 THEN '0.50-0.69' WHEN x >= 0.3 THEN '0.30-0.49' ELSE '0.00-0.29' END AS band, count(*) AS n FROM (SELECT seq, line * 2 / 100.0::DOUBLE AS x FROM cit) GROUP BY 1")
def f21(s, d):
    conf = F.when(c("seq") == 7, "none").otherwise((c("line") * 2 / 100.0).cast("string"))
    return citations(s, d).groupBy(T.confidence_band(conf).alias("band")).agg(F.count("*").alias("n"))


@query("f22_cue_parts", "SELECT ord, CASE WHEN seq = 1 THEN '1 Cor' WHEN seq = 2 THEN NULL ELSE 'Il' END AS cue, CASE WHEN seq = 1 THEN NULL WHEN seq = 2 THEN NULL WHEN seq % 3 = 0 THEN 'dot' WHEN seq % 3 = 1 THEN 'comma' ELSE 'space' END AS sep FROM cit")
def f22(s, d):
    book, mark = F.when(c("line") % 2 == 0, "3").otherwise("IV"), F.when(c("seq") % 3 == 0, ".").when(c("seq") % 3 == 1, ", ").otherwise(" ")
    match = F.when(c("seq") == 1, F.concat(F.lit("1 Cor 3:"), c("line").cast("string"))).when(c("seq") == 2, F.lit("327a")).otherwise(F.concat(F.lit("Il. "), book, mark, c("line").cast("string")))
    return citations(s, d).select("ord", T.cue_of(match).alias("cue"), T.separator(match).alias("sep"))


@query("f23_scope_decay", "SELECT ord, CASE WHEN pages > 0 THEN pages * 100000 + chars ELSE chars END AS distance, round(greatest(0.88::DOUBLE - 0.15::DOUBLE * pages - 0.10::DOUBLE * least((CASE WHEN pages > 0 THEN pages * 100000 + chars ELSE chars END) / 4000.0::DOUBLE, 1), 0), 3) AS conf FROM (SELECT ord, CAST(seq % 3 AS BIGINT) AS pages, CAST(line * 160 AS BIGINT) AS chars FROM cit)")
def f23(s, d):
    from citeloom.operators import resolve

    pages = (c("seq") % 3).cast("long")
    rows = citations(s, d).select("ord", pages.alias("pages"), resolve.scope_distance(pages, (c("line") * 160).cast("long") + 7, F.when(pages == 0, 7).otherwise(0)).alias("far"))
    distance = c("far") - F.when(c("pages") == 0, 0).otherwise(7)
    return rows.select("ord", distance.alias("distance"), resolve.scope_confidence(c("pages"), distance).alias("conf"))


@query("f24_formats", "SELECT work, format('{:,}', count(*)) AS thousands FROM cit GROUP BY work")
def f24(s, d):
    return citations(s, d).groupBy("work").agg(F.format_number(F.count("*"), 0).alias("thousands"))


@query("f26_correlation", "WITH n AS (SELECT page, count(*) FILTER (flag = 'A') AS a, count(*) FILTER (flag = 'R') AS r FROM cit GROUP BY page) SELECT round(corr(a, r), 6) AS pearson FROM n")
def f26(s, d):
    n = citations(s, d).groupBy("page").agg(F.count_if(c("flag") == "A").alias("a"), F.count_if(c("flag") == "R").alias("r"))
    return n.agg(F.round(correlation("a", "r"), 6).alias("pearson"))


@query("f27_moments", "SELECT work, round(avg(line), 6) AS mean, round(stddev_pop(line), 6) AS sd FROM cit GROUP BY work")
def f27(s, d):
    return citations(s, d).groupBy("work").agg(F.round(F.avg("line"), 6).alias("mean"), F.round(F.stddev_pop("line"), 6).alias("sd"))


@query("f28_share", "SELECT work, journal, round(n / greatest(sum(n) OVER (PARTITION BY work), 1), 8) AS share FROM (SELECT work, journal, count(*) AS n FROM cit GROUP BY ALL)")
def f28(s, d):
    n = citations(s, d).groupBy("work", "journal").agg(F.count("*").alias("n"))
    return n.select("work", "journal", F.round(c("n") / F.greatest(F.sum("n").over(Window.partitionBy("work")), F.lit(1)), 8).alias("share"))


@query("f29_column_share", "WITH u AS (SELECT work, page, count(DISTINCT iid) AS n FROM cit WHERE CAST(year AS INT) BETWEEN 1990 AND 1999 GROUP BY ALL) SELECT work, page, round(n / sum(n) OVER (PARTITION BY work), 8) AS share FROM u")
def f29(s, d):
    units = citations(s, d).select("work", c("page").cast("string").alias("unit"), "iid", c("year").cast("int").alias("year"))
    rows = shapes.column_shares(shapes.decade_rows(units))
    share = F.get("shares", F.lit(10))
    return rows.where(F.get("slots", F.lit(10)) > 0).select("work", c("unit").cast("int").alias("page"), F.round(share, 8).alias("share"))


@query("f30_nested_title", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def f30(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(
    "f31_nice_ticks",
    """WITH n AS (SELECT work, max(line) * count(*) AS most FROM cit WHERE line > 0 GROUP BY work), r AS (SELECT work, most, most / 5.0::DOUBLE AS raw FROM n), m AS (SELECT *, pow(10, floor(log10(raw))) AS mag FROM r),
    st AS (SELECT work, most, CASE WHEN raw / mag >= 5 THEN 5 WHEN raw / mag >= 2 THEN 2 ELSE 1 END * mag AS step FROM m),
    k AS (SELECT *, CAST(floor(most * 1.0001::DOUBLE / step) AS BIGINT) AS n FROM st)
    SELECT work, step, n + 1 + CASE WHEN n * step < most THEN 1 ELSE 0 END AS ticks, (n + CASE WHEN n * step < most THEN 1 ELSE 0 END) * step AS last FROM k""",
)
def f31(s, d):
    n = citations(s, d).where("line > 0").groupBy("work").agg((F.max("line") * F.count("*")).alias("most"))
    ticks = n.select("work", T.tick_step(c("most")).alias("step"), T.nice_ticks(c("most")).alias("t"))
    return ticks.select("work", "step", F.size("t").cast("long").alias("ticks"), F.element_at("t", -1).alias("last"))


@query("f32_bar_scale", "WITH n AS (SELECT work, count(*) FILTER (flag <> 'R') AS floor, count(*) FILTER (flag = 'R') AS u FROM cit GROUP BY work) SELECT work, round(floor / max(floor + u) OVER (), 8) AS bar FROM n")
def f32(s, d):
    n = citations(s, d).groupBy("work").agg(F.count_if(c("flag") != "R").alias("floor"), F.count_if(c("flag") == "R").alias("u"))
    return n.select("work", F.round(c("floor") / shapes.bar_scale(c("floor"), c("u")), 8).alias("bar"))


@query("f33_spark_heights", "WITH n AS (SELECT CAST(year AS INT) AS year, count(*) AS n FROM cit GROUP BY 1) SELECT year, round(sqrt(n) / sqrt(max(n) OVER ()) * 96, 6) AS height FROM n")
def f33(s, d):
    n = citations(s, d).groupBy(c("year").cast("int").alias("year")).agg(F.count("*").alias("n"))
    return n.select("year", F.round(F.sqrt("n") / F.sqrt(F.max("n").over(Window.partitionBy())) * 96, 6).alias("height"))
