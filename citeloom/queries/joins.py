"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.functions.text import or_unknown, passage_label
from citeloom.operators import ranges
from citeloom.plans.relations import CATALOGUE, catalogue, citations, table
from citeloom.queries.registry import query

c = F.col


def built(s, d):
    """Ids of articles built before, a part of what is delivered now."""
    return table(s, d, "lineitem").where("l_orderkey % 3 = 0").select(c("l_orderkey").alias("iid"))


BUILT = "built AS (SELECT l_orderkey AS iid FROM lineitem WHERE l_orderkey % 3 = 0)"


def spans(s, d):
    """work, system, start, end: a page span for each brand; spans overlap."""
    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    brands = table(s, d, "part").select("p_brand").distinct().select(c("p_brand").alias("work"), n.alias("n"))
    return brands.select("work", F.when(c("n") % 2 == 0, "bekker").otherwise("stephanus").alias("system"), (100 + 2 * c("n")).cast("int").alias("start"), (104 + 2 * c("n") + c("n") % 7).cast("int").alias("end"))


SPANS = """spans AS (SELECT work, CASE WHEN n % 2 = 0 THEN 'bekker' ELSE 'stephanus' END AS system, 100 + 2 * n AS start, 104 + 2 * n + n % 7 AS "end"
  FROM (SELECT DISTINCT p_brand AS work, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS n FROM part))"""


@query(
    "j01_metadata",
    f"WITH {CATALOGUE.strip()} SELECT ord, coalesce(nullif(is_part_of, ''), '?') AS journal, coalesce(nullif(content_subtype, ''), '?') AS doctype, coalesce(title, '') AS title FROM cit LEFT JOIN catalogue ON iid = item_id AND item_id % 5 <> 0",
)
def j01(s, d):
    meta = catalogue(s, d).where("item_id % 5 <> 0")
    rows = citations(s, d).select("iid", "ord").join(meta, c("iid") == c("item_id"), "left")
    return rows.select("ord", or_unknown(c("is_part_of")).alias("journal"), or_unknown(c("content_subtype")).alias("doctype"), F.coalesce("title", F.lit("")).alias("title"))


@query("j02_keep_requested", f"WITH {CATALOGUE.strip()} SELECT item_id, published_date FROM catalogue WHERE item_id IN (SELECT iid FROM cit WHERE doctype = 'PROMO')")
def j02(s, d):
    ids = citations(s, d).where("doctype = 'PROMO'").select(c("iid").alias("item_id"))
    return catalogue(s, d).join(ids, "item_id", "left_semi").select("item_id", "published_date")


@query("j03_not_yet_done", f"WITH {BUILT} SELECT DISTINCT iid FROM cit WHERE iid NOT IN (SELECT iid FROM built)")
def j03(s, d):
    return citations(s, d).select("iid").distinct().join(built(s, d), "iid", "left_anti")


#: The rows one by one: two may share an ``ord``.
ROWS = "(SELECT *, row_number() OVER () AS rn FROM cit) cit"


@query("j04_range_candidates", f'WITH {SPANS} SELECT ord, array_to_string(list(s.work ORDER BY s.work), \',\') AS candidates FROM {ROWS} JOIN spans s ON page BETWEEN s.start AND s."end" GROUP BY rn, ord')
def j04(s, d):
    pages = ranges.page_works(spans(s, d))
    return citations(s, d).select("ord", "page").join(pages, "page").select("ord", F.array_join("works", ",").alias("candidates"))


@query(
    "j05_page_works_by_letter",
    f"WITH {SPANS} SELECT ord, count(*) AS n FROM cit JOIN spans s ON page BETWEEN s.start AND s.\"end\" AND NOT (section IN ('c', 'd', 'e') AND system = 'bekker') GROUP BY ord",
)
def j05(s, d):
    rows = citations(s, d).select("ord", "page", "section").join(ranges.pages(spans(s, d)), "page")
    return rows.where(~(c("section").isin("c", "d", "e") & (c("system") == "bekker"))).groupBy("ord").agg(F.count("*").alias("n"))


@query(
    "j06_precise",
    f"""WITH {SPANS}, k AS (
      SELECT ord, s.work, (page, section, line) BETWEEN (s.start, 'b', 10) AND (s."end", 'b', 20) AS inside, CAST(regexp_extract(s.work, '(\\d+)', 1) AS INT) % 3 = 0 AS vague
      FROM cit JOIN spans s ON page BETWEEN s.start AND s."end" WHERE section IN ('a', 'b')),
    g AS (SELECT ord, list(work ORDER BY work) AS everyone, list(work ORDER BY work) FILTER (inside OR vague) AS few FROM k GROUP BY ord)
    SELECT ord, array_to_string(coalesce(few, everyone), ',') AS works FROM g""",
)
def j06(s, d):
    key = lambda p, sec, line: F.struct(p.alias("page"), F.lit(sec).alias("col"), F.lit(line).alias("line"))
    vague = F.regexp_extract("work", r"(\d+)", 1).cast("int") % 3 == 0
    precise = spans(s, d).withColumns({"lo": F.when(~vague, key(c("start"), "b", 10)), "hi": F.when(~vague, key(c("end"), "b", 20))})
    rows = citations(s, d).where(c("section").isin("a", "b")).join(ranges.page_spans(precise), "page")
    at = F.struct(c("page").alias("page"), c("section").alias("col"), c("line").alias("line"))
    return rows.select("ord", F.array_join(F.transform(ranges.refine(c("spans"), at), lambda x: x["work"]), ",").alias("works"))


@query("j07_boundary_pages", f'WITH {SPANS} SELECT DISTINCT a.start AS page FROM spans a JOIN spans b ON a.start = b."end" AND a.start <> b.start')
def j07(s, d):
    return ranges.boundaries(spans(s, d))


@query(
    "j08_name_forms",
    """WITH t AS (SELECT o_orderkey AS k, string_split(lower(o_orderpriority), ' ') AS w FROM orders),
    g AS (SELECT k, unnest(w) AS form FROM t UNION ALL SELECT k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t)
    SELECT DISTINCT k, work FROM g JOIN (VALUES ('not specified', 'W1'), ('5-low', 'W2'), ('specified', 'W3'), ('1-urgent', 'W2')) f(form, work) USING (form)""",
)
def j08(s, d):
    forms = s.createDataFrame([("not specified", "W1"), ("5-low", "W2"), ("specified", "W3"), ("1-urgent", "W2")], "form string, work string")
    words = F.split(F.lower("o_orderpriority"), " ")
    grams = table(s, d, "orders").select(c("o_orderkey").alias("k"), F.explode(ranges.ngrams(words, 3)).alias("form"))
    return grams.join(forms, "form").select("k", "work").distinct()


@query("j10_named_candidates", f'WITH {SPANS}, k AS (SELECT ord, list(s.work) AS cand, any_value(cit.work) AS named FROM {ROWS} JOIN spans s ON page BETWEEN s.start AND s."end" GROUP BY rn, ord) SELECT ord, len(list_filter(cand, lambda x: x = named)) AS hits FROM k')
def j10(s, d):
    rows = citations(s, d).select("ord", "page", "work").join(ranges.page_works(spans(s, d)), "page")
    return rows.select("ord", F.size(F.array_intersect("works", F.array("work"))).cast("long").alias("hits"))


@query("j11_cue_work", "SELECT ord, w AS cued FROM cit JOIN (VALUES ('ECONOMY', 'a', 'Iliad'), ('ECONOMY', 'b', 'Odyssey'), ('PROMO', 'c', 'Romans')) v(corpus, cue, w) ON doctype = corpus AND section = cue")
def j11(s, d):
    cues = s.createDataFrame([("ECONOMY", "a", "Iliad"), ("ECONOMY", "b", "Odyssey"), ("PROMO", "c", "Romans")], "doctype string, section string, cued string")
    return citations(s, d).join(cues, ["doctype", "section"]).select("ord", "cued")


@query("j14_reconcile", f"WITH {BUILT}, a AS (SELECT DISTINCT iid FROM built), b AS (SELECT DISTINCT iid FROM cit WHERE doctype = 'PROMO') SELECT coalesce(a.iid, b.iid) AS iid, a.iid IS NOT NULL AS requested, b.iid IS NOT NULL AS delivered FROM a FULL JOIN b ON a.iid = b.iid")
def j14(s, d):
    a = built(s, d).distinct().withColumn("requested", F.lit(True))
    b = citations(s, d).where("doctype = 'PROMO'").select("iid").distinct().withColumn("delivered", F.lit(True))
    return a.join(b, "iid", "full").select("iid", F.coalesce("requested", F.lit(False)).alias("requested"), F.coalesce("delivered", F.lit(False)).alias("delivered"))


@query("j15_in_corpus", f"WITH {BUILT} SELECT iid, ord FROM cit WHERE iid IN (SELECT iid FROM built)")
def j15(s, d):
    return citations(s, d).join(built(s, d), "iid", "left_semi").select("iid", "ord")


@query("j16_overlap", f"WITH {BUILT}, a AS (SELECT DISTINCT iid FROM cit) SELECT count(*) AS delivered, count(*) FILTER (iid IN (SELECT iid FROM built)) AS overlap, count(*) FILTER (iid NOT IN (SELECT iid FROM built)) AS net_new FROM a")
def j16(s, d):
    ids = citations(s, d).select("iid").distinct().join(built(s, d).distinct().withColumn("old", F.lit(1)), "iid", "left")
    return ids.agg(F.count("*").alias("delivered"), F.count("old").alias("overlap"), F.count_if(c("old").isNull()).alias("net_new"))


@query("j17_collision_profile", f"WITH {CATALOGUE.strip()}, {BUILT} SELECT is_part_of, content_subtype, count(*) AS n FROM (SELECT DISTINCT iid FROM built) b JOIN catalogue ON iid = item_id GROUP BY ALL")
def j17(s, d):
    return catalogue(s, d).join(built(s, d).distinct(), c("item_id") == c("iid")).groupBy("is_part_of", "content_subtype").agg(F.count("*").alias("n"))


@query(
    "j18_co_candidates",
    """WITH q AS (SELECT ord, list_sort(list_distinct([work, 'Brand#' || (1 + n % 25), 'Brand#' || (1 + (n + 6) % 25)][1 : 1 + seq % 3])) AS k FROM (SELECT *, CAST(regexp_extract(work, '(\\d+)', 1) AS INT) AS n FROM cit WHERE flag = 'R'))
    SELECT work, partner, count(*) AS rows FROM (SELECT a.w AS work, unnest(k) AS partner FROM (SELECT unnest(k) AS w, k FROM q) a) WHERE work <> partner GROUP BY ALL""",
)
def j18(s, d):
    from citeloom.operators.aggregate import co_candidates
    from citeloom.queries.aggregates import queue

    return co_candidates(queue(s, d))


@query(
    "j19_bands_nested",
    f"""WITH {SPANS}, b AS (SELECT work, CAST(page // 10 * 10 AS INT) AS band, count(*) AS n FROM cit WHERE flag = 'R' AND page < 130 GROUP BY ALL)
    SELECT s.work, coalesce(array_to_string(list(band || ':' || n ORDER BY band) FILTER (band IS NOT NULL), ','), '') AS bands FROM spans s LEFT JOIN b USING (work) GROUP BY s.work""",
)
def j19(s, d):
    b = citations(s, d).where("flag = 'R' AND page < 130").groupBy("work", (F.floor(c("page") / 10) * 10).cast("int").alias("band")).agg(F.count("*").alias("n"))
    nested = b.groupBy("work").agg(F.array_sort(F.collect_list(F.struct("band", "n"))).alias("bands"))
    text = F.array_join(F.transform("bands", lambda x: F.concat(x["band"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",")
    return spans(s, d).join(nested, "work", "left").select("work", F.coalesce(text, F.lit("")).alias("bands"))


@query(
    "j20_snapshot_diff",
    """WITH r AS (SELECT work, count(*) FILTER (flag = 'A') / count(*) AS x, count(*) FILTER (flag = 'N') / count(*) AS y FROM cit GROUP BY work)
    SELECT work, x >= 0.333::DOUBLE AS was, y >= 0.333::DOUBLE AS now FROM r WHERE (x >= 0.333::DOUBLE) <> (y >= 0.333::DOUBLE)""",
)
def j20(s, d):
    rows = citations(s, d)
    snap = lambda flag, name: rows.groupBy("work").agg((F.count_if(c("flag") == flag) / F.count("*") >= 0.333).alias(name))
    return snap("A", "was").join(snap("N", "now"), "work").where("was <> now")


@query("j21_dots_metadata", f"WITH {CATALOGUE.strip()} SELECT ord, coalesce(title, '') AS title, coalesce(published_date, '') AS published FROM cit LEFT JOIN catalogue ON iid = item_id AND item_id % 7 <> 0")
def j21(s, d):
    meta = catalogue(s, d).where("item_id % 7 <> 0")
    return citations(s, d).select("iid", "ord").join(meta, c("iid") == c("item_id"), "left").select("ord", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("published_date", F.lit("")).alias("published"))


@query("j22_journal_field", "SELECT coalesce(r_name, 'other') AS field, count(*) AS n FROM cit LEFT JOIN (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0) ON journal = n_name GROUP BY 1")
def j22(s, d):
    groups = table(s, d, "nation").where("n_nationkey % 4 <> 0").join(table(s, d, "region"), c("n_regionkey") == c("r_regionkey")).select("n_name", "r_name")
    return citations(s, d).join(groups, c("journal") == c("n_name"), "left").groupBy(F.coalesce("r_name", F.lit("other")).alias("field")).agg(F.count("*").alias("n"))


@query("j23_work_author", "SELECT work, CASE WHEN bool_or(doctype = 'PROMO' AND page < 101) THEN 'cued' WHEN CAST(regexp_extract(work, '(\\d+)', 1) AS INT) < 9 THEN 'second' ELSE 'first' END AS author FROM cit GROUP BY work")
def j23(s, d):
    tagged = citations(s, d).groupBy("work").agg(F.bool_or((c("doctype") == "PROMO") & (c("page") < 101)).alias("cued"))
    number = F.regexp_extract("work", r"(\d+)", 1).cast("int")
    return tagged.select("work", F.when(c("cued"), "cued").when(number < 9, "second").otherwise("first").alias("author"))


@query(
    "j24_pooled_within",
    """WITH p AS (SELECT work || ':' || page AS unit, count(*) AS n FROM cit GROUP BY ALL), w AS (SELECT work, page, count(*) AS own FROM cit WHERE flag = 'A' GROUP BY ALL HAVING count(*) > 14)
    SELECT unit, n, own FROM p LEFT JOIN (SELECT work || ':' || page AS unit, own FROM w) USING (unit)""",
)
def j24(s, d):
    rows = citations(s, d).withColumn("unit", F.concat_ws(":", "work", c("page").cast("string")))
    within = rows.where("flag = 'A'").groupBy("unit").agg(F.count("*").alias("own")).where("own > 14")
    return rows.groupBy("unit").agg(F.count("*").alias("n")).join(within, "unit", "left")


@query("j25_text_heads", f"WITH {CATALOGUE.strip()}, s AS (SELECT item_id, title FROM catalogue ORDER BY item_id DESC LIMIT 60), x AS (SELECT DISTINCT item_id, title FROM s) SELECT doc_id, substring(text, 1, 120) AS head, title FROM documents JOIN x ON doc_id = item_id % 200")
def j25(s, d):
    """The heads (the first 120 characters are the feature) of the texts of a sample of 60 titles."""
    sample = catalogue(s, d).select("item_id", "title").orderBy(F.desc("item_id")).limit(60).distinct()
    return table(s, d, "documents").join(sample, c("doc_id") == c("item_id") % 200).select("doc_id", F.substring("text", 1, 120).alias("head"), "title")


@query("j26_work_set", "SELECT work, year, count(*) AS n FROM cit WHERE work IN ('Brand#3', 'Brand#7', 'Brand#11') GROUP BY ALL")
def j26(s, d):
    members = s.createDataFrame([("Brand#3",), ("Brand#7",), ("Brand#11",)], "work string")
    return citations(s, d).join(members, "work", "left_semi").groupBy("work", "year").agg(F.count("*").alias("n"))


@query("j09_title_forms", "SELECT c_custkey AS k, work FROM customer JOIN (VALUES ('building', 'W1', false), ('household', 'W2', true), ('machinery', 'W3', false)) f(form, work, vague) ON lower(c_mktsegment) = form WHERE NOT vague")
def j09(s, d):
    forms = s.createDataFrame([("building", "W1", False), ("household", "W2", True), ("machinery", "W3", False)], "form string, work string, vague boolean")
    grams = table(s, d, "customer").select(c("c_custkey").alias("k"), F.explode(ranges.ngrams(F.split(F.lower("c_mktsegment"), " "), 3)).alias("form"))
    return grams.join(forms.where("NOT vague"), "form").select("k", "work").distinct()


# -- sets ----------------------------------------------------------------------------------------


@query(
    "u01_differences",
    f"WITH {BUILT}, a AS (SELECT DISTINCT iid FROM cit WHERE doctype = 'PROMO'), b AS (SELECT DISTINCT iid FROM built) SELECT 'missing' AS side, iid FROM (SELECT iid FROM b EXCEPT SELECT iid FROM a) UNION ALL SELECT 'extra', iid FROM (SELECT iid FROM a EXCEPT SELECT iid FROM b) UNION ALL SELECT 'both', iid FROM (SELECT iid FROM a INTERSECT SELECT iid FROM b)",
)
def u01(s, d):
    a, b = citations(s, d).where("doctype = 'PROMO'").select("iid"), built(s, d)
    side = lambda name, rows: rows.select(F.lit(name).alias("side"), "iid")
    return side("missing", b.distinct().subtract(a)).union(side("extra", a.distinct().subtract(b))).union(side("both", a.intersect(b)))


@query("u02_union_keys", "SELECT work FROM cit WHERE flag = 'A' AND page < 103 UNION SELECT work FROM cit WHERE flag = 'R' AND page > 156")
def u02(s, d):
    rows = citations(s, d)
    return rows.where("flag = 'A' AND page < 103").select("work").union(rows.where("flag = 'R' AND page > 156").select("work")).distinct()


@query("u03_pool", "SELECT 'shelf:' || work AS label, count(*) AS n FROM cit WHERE work IN ('Brand#1', 'Brand#2') GROUP BY 1")
def u03(s, d):
    rows = citations(s, d)
    pooled = rows.where("work = 'Brand#1'").unionByName(rows.where("work = 'Brand#2'")).withColumn("label", F.concat(F.lit("shelf:"), "work"))
    return pooled.groupBy("label").agg(F.count("*").alias("n"))


@query("u04_candidate_union", f'WITH {SPANS} SELECT ord, count(DISTINCT s.work) AS n FROM {ROWS} JOIN spans s ON page BETWEEN s.start AND s."end" GROUP BY rn, ord')
def u04(s, d):
    sp = spans(s, d)
    of = lambda system: ranges.page_works(sp.where(c("system") == system)).withColumnRenamed("works", system)
    rows = citations(s, d).select("ord", "page").join(of("bekker"), "page", "left").join(of("stephanus"), "page", "left")
    none = F.array().cast("array<string>")
    both = F.array_union(F.coalesce("bekker", none), F.coalesce("stephanus", none))
    return rows.select("ord", F.size(both).cast("long").alias("n")).where("n > 0")


@query("u05_coverage", "SELECT 'missing' AS side, n_name AS journal FROM nation WHERE n_name NOT IN (SELECT journal FROM cit WHERE page < 102 AND flag = 'R') UNION ALL SELECT 'stray', journal FROM (SELECT DISTINCT journal FROM cit) WHERE journal NOT IN (SELECT n_name FROM nation WHERE n_nationkey < 20)")
def u05(s, d):
    rows, nations = citations(s, d), table(s, d, "nation")
    missing = nations.join(rows.where("page < 102 AND flag = 'R'"), c("n_name") == c("journal"), "left_anti").select(F.lit("missing").alias("side"), c("n_name").alias("journal"))
    stray = rows.select("journal").distinct().join(nations.where("n_nationkey < 20"), c("n_name") == c("journal"), "left_anti").select(F.lit("stray").alias("side"), "journal")
    return missing.union(stray)


@query("u06_distinct_union", "SELECT work, count(DISTINCT iid) AS articles FROM cit WHERE flag IN ('A', 'N') GROUP BY work")
def u06(s, d):
    rows = citations(s, d)
    return rows.where("flag = 'A'").unionByName(rows.where("flag = 'N'")).groupBy("work").agg(F.countDistinct("iid").alias("articles"))


@query("f17_passage_label", "SELECT ord, CASE WHEN doctype = 'PROMO' THEN page || section ELSE page || section || line END AS label FROM cit WHERE doctype IN ('PROMO', 'ECONOMY')")
def f17(s, d):
    system = F.when(c("doctype") == "PROMO", "stephanus").otherwise("bekker")
    return citations(s, d).where(c("doctype").isin("PROMO", "ECONOMY")).select("ord", passage_label(c("page"), c("section"), c("line"), system).alias("label"))
