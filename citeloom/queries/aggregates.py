"""Aggregations over the citation relation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.functions.text import confidence_band, decade_slot, line_band, percent, span_length
from citeloom.operators import aggregate as agg
from citeloom.operators import exclude
from citeloom.operators import windows as win
from citeloom.plans.relations import catalogue, citations
from citeloom.queries.registry import query

c = F.col


def resolved(s, d):
    """Rows with flag R are taken as queued, the others as resolved."""
    return citations(s, d).withColumn("resolved", c("flag") != "R")


def queue(s, d):
    """Queued rows with one to three candidate works derived from the brand number."""
    n = F.regexp_extract("work", r"(\d+)", 1).cast("int")
    names = [F.concat(F.lit("Brand#"), (1 + (n + k) % 25).cast("string")) for k in (0, 6)]
    own = F.array(c("work"), *names)
    return citations(s, d).where("flag = 'R'").select("ord", "iid", "page", "conf", "journal", "status", "work", F.array_sort(F.array_distinct(F.slice(own, F.lit(1), 1 + c("seq") % 3))).alias("candidates"))


QUEUE = """
queue AS (
  SELECT ord, iid, page, conf, journal, status, work, list_sort(list_distinct([work, 'Brand#' || (1 + n % 25), 'Brand#' || (1 + (n + 6) % 25)][1 : 1 + seq % 3])) AS candidates
  FROM (SELECT *, CAST(regexp_extract(work, '(\\d+)', 1) AS INT) AS n FROM cit WHERE flag = 'R')
)"""


@query("a01_count", "SELECT journal, year, doctype AS corpus, count(*) AS citations FROM cit GROUP BY ALL")
def a01(s, d):
    return citations(s, d).groupBy("journal", "year", c("doctype").alias("corpus")).agg(F.count("*").alias("citations"))


@query("a02_count_articles", "SELECT journal, year, doctype AS corpus, count(*) AS citations, count(DISTINCT iid) AS articles FROM cit GROUP BY ALL")
def a02(s, d):
    return agg.volume(citations(s, d).withColumnRenamed("doctype", "corpus"), "journal", "year", "corpus")


@query("a03_rollup", "SELECT doctype AS corpus, year, count(*) AS citations FROM cit GROUP BY ROLLUP (doctype, year)")
def a03(s, d):
    return citations(s, d).withColumnRenamed("doctype", "corpus").rollup("corpus", "year").agg(F.count("*").alias("citations"))


@query("a04_tallies", "SELECT flag, status, doctype, count(*) AS n FROM cit GROUP BY GROUPING SETS ((flag), (status), (doctype))")
def a04(s, d):
    rows = citations(s, d)
    one = lambda k: rows.groupBy(k).agg(F.count("*").alias("n")).select(*[c(k) if x == k else F.lit(None).cast("string").alias(x) for x in ("flag", "status", "doctype")], "n")
    return one("flag").unionByName(one("status")).unionByName(one("doctype"))


@query("a05_percent", "SELECT flag, count(*) AS n, round(100.0::DOUBLE * count(*) / nullif(sum(count(*)) OVER (), 0), 4) AS pct FROM cit GROUP BY flag")
def a05(s, d):
    n = citations(s, d).groupBy("flag").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * c("n") / F.nullif(F.sum("n").over(Window.partitionBy()), F.lit(0)), 4))


@query("a06_works", "SELECT work, count(*) AS citations, count(DISTINCT iid) AS articles FROM cit GROUP BY work")
def a06(s, d):
    return agg.volume(citations(s, d), "work")


@query(
    "a07_cells",
    """WITH j AS (SELECT work, page, section, line // 15 AS band, journal, count(*) AS n FROM cit GROUP BY ALL)
    SELECT j.work, j.page, j.section, CAST(j.band AS INT) AS band, CAST(sum(n) AS BIGINT) AS count, min(x.articles) AS articles,
      array_to_string(list(journal || '=' || n ORDER BY journal), ',') AS by_journal
    FROM j JOIN (SELECT work, page, section, line // 15 AS band, count(DISTINCT iid) AS articles FROM cit GROUP BY ALL) x
      USING (work, page, section, band) GROUP BY ALL HAVING true""".replace(" GROUP BY ALL HAVING true", " GROUP BY j.work, j.page, j.section, j.band"),
)
def a07(s, d):
    rows = citations(s, d).withColumn("band", line_band(c("line")))
    out = agg.cells(rows, ["work", "page", "section", "band"])
    text = F.array_join(F.transform(F.map_entries("by_journal"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("by_journal", text)


@query("a08_histograms", "SELECT journal, count(*) AS n, min(CAST(year AS INT)) AS first_year, max(CAST(year AS INT)) AS last_year FROM cit GROUP BY journal")
def a08(s, d):
    y = c("year").cast("int")
    return citations(s, d).groupBy("journal").agg(F.count("*").alias("n"), F.min(y).alias("first_year"), F.max(y).alias("last_year"))


@query(
    "a09_queue_profile",
    f"""WITH {QUEUE.strip()},
    f AS (SELECT work, count(*) AS filed FROM queue GROUP BY work),
    k AS (SELECT work, count(*) AS candidate_rows, count(*) FILTER (conf >= 0.8) AS candidate_confident FROM (SELECT conf, unnest(candidates) AS work FROM queue) GROUP BY work)
    SELECT work, coalesce(filed, 0) AS filed, coalesce(candidate_rows, 0) AS candidate_rows, coalesce(candidate_confident, 0) AS candidate_confident FROM f FULL JOIN k USING (work)""",
)
def a09(s, d):
    return agg.filed_and_candidates(queue(s, d), 0.8)


@query(
    "a10_queue_accounting",
    f"WITH {QUEUE.strip()} SELECT count(*) AS queued, CAST(sum(len(candidates)) AS BIGINT) AS attributions, round(avg(len(candidates)), 6) AS mean_works FROM queue",
)
def a10(s, d):
    return queue(s, d).agg(F.count("*").alias("queued"), F.sum(F.size("candidates")).cast("long").alias("attributions"), F.round(F.avg(F.size("candidates")), 6).alias("mean_works"))


RATES = "SELECT work, count(*) FILTER (flag <> 'R') AS floor, count(*) FILTER (flag = 'R') AS queued, round(count(*) FILTER (flag <> 'R') / count(*), 4) AS rate FROM cit GROUP BY work"


@query("a11_resolution", f"SELECT *, CASE WHEN rate >= 0.66::DOUBLE THEN 'trustworthy' ELSE 'uncertain' END AS tier, floor < 1600 AS small_n FROM ({RATES})")
def a11(s, d):
    """With thresholds near the tables' own rates, so that both sides are met."""
    return agg.resolution(resolved(s, d)).withColumn("tier", agg.tier(c("rate"), 0.66)).withColumn("small_n", agg.small_n(c("floor"), 1600))


@query("a12_rate_histogram", f"SELECT CAST(least(floor(rate * 10) * 10, 90) AS INT) AS bucket, count(*) AS works FROM ({RATES}) GROUP BY 1")
def a12(s, d):
    return agg.resolution(resolved(s, d)).groupBy(F.least(F.floor(c("rate") * 10) * 10, F.lit(90)).cast("int").alias("bucket")).agg(F.count("*").alias("works"))


@query(
    "a13_match_coverage",
    "SELECT count(DISTINCT iid) AS needed, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN iid END) AS matched, round(count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN iid END) / count(DISTINCT iid), 4) AS rate FROM cit LEFT JOIN orders ON iid = o_orderkey",
)
def a13(s, d):
    ids = citations(s, d).select("iid").distinct()
    has = s.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'F'").select(c("o_orderkey").alias("iid"), F.lit(1).alias("hit")).distinct()
    return ids.join(has, "iid", "left").agg(F.count("*").alias("needed"), F.count("hit").alias("matched"), F.round(F.count("hit") / F.count("*"), 4).alias("rate"))


@query("a14_cube", "SELECT work, journal, CAST(year AS INT) AS year, count(*) AS citations, count(DISTINCT iid) AS articles FROM cit WHERE regexp_matches(year, '^[0-9]{4}$') GROUP BY ALL")
def a14(s, d):
    return agg.cube(citations(s, d))


@query(
    "a15_titles",
    "SELECT journal, count(*) AS n, count(*) FILTER (lower(doctype) LIKE '%promo%') AS reviews, min(CAST(year AS INT)) AS first_year, max(CAST(year AS INT)) AS last_year FROM cit GROUP BY journal",
)
def a15(s, d):
    y = c("year").cast("int")
    return citations(s, d).groupBy("journal").agg(F.count("*").alias("n"), F.count_if(F.lower("doctype").contains("promo")).alias("reviews"), F.min(y).alias("first_year"), F.max(y).alias("last_year"))


@query(
    "a16_delivery_survey",
    """SELECT journal, count(*) AS rows, count(DISTINCT iid) AS ids, count(*) - count(DISTINCT iid) AS repeats,
      count(*) FILTER (doctype = 'ECONOMY') AS economy, count(*) FILTER (doctype = 'STANDARD') AS standard FROM cit GROUP BY journal""",
)
def a16(s, d):
    rows = citations(s, d)
    kinds = rows.groupBy("journal").pivot("doctype", ["ECONOMY", "STANDARD"]).agg(F.count(F.lit(1))).select("journal", *(F.coalesce(c(k), F.lit(0)).alias(k.lower()) for k in ("ECONOMY", "STANDARD")))
    return rows.groupBy("journal").agg(F.count("*").alias("rows"), F.countDistinct("iid").alias("ids")).withColumn("repeats", c("rows") - c("ids")).join(kinds, "journal")


@query("a17_review_share", "SELECT journal, round(count(*) FILTER (doctype = 'PROMO') / count(*), 6) AS review_share FROM cit GROUP BY journal")
def a17(s, d):
    return citations(s, d).groupBy("journal").agg(F.round(F.count_if(c("doctype") == "PROMO") / F.count("*"), 6).alias("review_share"))


@query("a18_journal_year_doctype", "SELECT journal, year, doctype, count(*) AS n FROM cit GROUP BY ALL ORDER BY ALL")
def a18(s, d):
    return citations(s, d).groupBy("journal", "year", "doctype").agg(F.count("*").alias("n")).orderBy("journal", "year", "doctype")


@query(
    "a19_work_rates",
    f"""WITH r AS ({RATES}), m AS (SELECT work, status, count(*) AS n FROM cit WHERE flag = 'R' GROUP BY ALL),
    t AS (SELECT work, status AS top_reason, n AS reason_rows FROM m QUALIFY row_number() OVER (PARTITION BY work ORDER BY n DESC, status) = 1)
    SELECT work, floor, queued, rate, top_reason, reason_rows FROM r LEFT JOIN t USING (work) WHERE floor + queued >= 100""",
)
def a19(s, d):
    rows = resolved(s, d)
    reasons = agg.mode_of(rows.where("flag = 'R'"), "work", "status").select("work", c("status").alias("top_reason"), c("n").alias("reason_rows"))
    return agg.resolution(rows).join(reasons, "work", "left").where("floor + queued >= 100").select("work", "floor", "queued", "rate", "top_reason", "reason_rows")


@query("a20_estimated_total", "SELECT work, round(floor / (floor / (floor + queued)), 2) AS est_total FROM (SELECT work, count(*) FILTER (flag <> 'R') AS floor, count(*) FILTER (flag = 'R') AS queued FROM cit GROUP BY work)")
def a20(s, d):
    return agg.resolution(resolved(s, d)).select("work", F.round(c("floor") / (c("floor") / (c("floor") + c("queued"))), 2).alias("est_total"))


@query(
    "a21_missingness",
    """WITH b AS (SELECT work, CAST(page // 10 * 10 AS INT) AS band_start, count(*) AS volume, count(*) FILTER (flag <> 'R') AS resolved FROM cit GROUP BY ALL),
    r AS (SELECT *, sum(resolved) OVER (PARTITION BY work) / sum(volume) OVER (PARTITION BY work) AS rate FROM b)
    SELECT work, band_start, band_start + 9 AS band_end, round(resolved / volume, 4) AS resolved_share, round(rate - resolved / volume, 4) AS gap, volume, round(rate * volume - resolved, 2) AS est_missing
    FROM r WHERE volume >= 30 AND rate - resolved / volume >= 0.02""",
)
def a21(s, d):
    return agg.page_bands(resolved(s, d), 10, 30, 0.02)


@query(
    "a22_allocation",
    f"""WITH {QUEUE.strip()}, fl AS (SELECT work, count(*) FILTER (flag <> 'R') AS floor FROM cit GROUP BY work),
    e AS (SELECT ord, unnest(candidates) AS work FROM queue), j AS (SELECT e.ord, e.work, coalesce(floor, 0) AS floor FROM e LEFT JOIN fl USING (work))
    SELECT work, round(sum(CASE WHEN t = 0 THEN 1.0::DOUBLE / n ELSE floor / t END), 4) AS allocated
    FROM (SELECT *, sum(floor) OVER (PARTITION BY ord) AS t, count(*) OVER (PARTITION BY ord) AS n FROM j) GROUP BY work""",
)
def a22(s, d):
    floors = agg.resolution(resolved(s, d)).select("work", "floor")
    return agg.allocate(queue(s, d), floors).select("work", F.round("allocated", 4).alias("allocated"))


@query(
    "a23_estimate_ratio",
    f"""WITH {QUEUE.strip()}, fl AS (SELECT work, count(*) FILTER (flag <> 'R') AS floor FROM cit GROUP BY work),
    e AS (SELECT ord, unnest(candidates) AS work FROM queue), j AS (SELECT e.ord, e.work, coalesce(floor, 0) AS floor FROM e LEFT JOIN fl USING (work)),
    al AS (SELECT work, sum(CASE WHEN t = 0 THEN 1.0::DOUBLE / n ELSE floor / t END) AS a FROM (SELECT *, sum(floor) OVER (PARTITION BY ord) AS t, count(*) OVER (PARTITION BY ord) AS n FROM j) GROUP BY work)
    SELECT work, floor, round((floor + coalesce(a, 0)) / nullif(floor, 0), 4) AS ratio, coalesce((floor + coalesce(a, 0)) >= 1.5::DOUBLE * floor, true) AS raised FROM fl LEFT JOIN al USING (work)""",
)
def a23(s, d):
    floors = agg.resolution(resolved(s, d)).select("work", "floor")
    got = floors.join(agg.allocate(queue(s, d), floors), "work", "left")
    est = c("floor") + F.coalesce("allocated", F.lit(0.0))
    return got.select("work", "floor", F.round(est / F.nullif("floor", F.lit(0)), 4).alias("ratio"), (est >= 1.5 * c("floor")).alias("raised"))


DENSE = """x AS (SELECT doctype, seq % 8 AS numbers, line % 5 AS words FROM cit),
dn AS (SELECT doctype, CASE WHEN numbers + words = 0 THEN 0 ELSE numbers / (numbers + words) END AS d FROM x)"""


@query(
    "a24_density_bands",
    f"""WITH {DENSE} SELECT doctype, CASE WHEN d >= 0.9::DOUBLE THEN 0.9::DOUBLE WHEN d >= 0.7::DOUBLE THEN 0.7::DOUBLE WHEN d >= 0.5::DOUBLE THEN 0.5::DOUBLE WHEN d >= 0.3::DOUBLE THEN 0.3::DOUBLE ELSE 0::DOUBLE END AS band, count(*) AS n,
    count(*) FILTER (d >= 0.5::DOUBLE) AS over_50, count(*) FILTER (d >= 0.6::DOUBLE) AS over_60, count(*) FILTER (d >= 0.7::DOUBLE) AS over_70, count(*) FILTER (d >= 0.8::DOUBLE) AS over_80, count(*) FILTER (d >= 0.9::DOUBLE) AS over_90 FROM dn GROUP BY 1, 2""",
)
def a24(s, d):
    """Contexts with 0 to 7 numbers among 0 to 4 words."""
    number = F.concat(c("page").cast("string"), "section", F.lit(", "))
    context = F.concat(F.repeat(number, c("seq") % 8), F.repeat(F.lit("word "), c("line") % 5))
    return exclude.density_profile(citations(s, d).select("doctype", context.alias("context")))


@query(
    "a25_decades",
    "SELECT CAST(CAST(year AS INT) // 10 * 10 AS INT) AS decade, journal, count(*) AS n, round(count(*) FILTER (line >= 25) / count(*), 6) AS index_share FROM cit WHERE doctype = 'PROMO' GROUP BY 1, 2",
)
def a25(s, d):
    decade = (F.floor(c("year").cast("int") / 10) * 10).cast("int").alias("decade")
    return citations(s, d).where("doctype = 'PROMO'").groupBy(decade, "journal").agg(F.count("*").alias("n"), F.round(F.count_if(c("line") >= 25) / F.count("*"), 6).alias("index_share"))


BAND = "CASE WHEN conf >= 0.9 THEN '0.90-1.00' WHEN conf >= 0.7 THEN '0.70-0.89' WHEN conf >= 0.5 THEN '0.50-0.69' WHEN conf >= 0.3 THEN '0.30-0.49' ELSE '0.00-0.29' END"


@query(
    "a26_queue_crosstab",
    f"""SELECT status AS reason, count(*) FILTER (b = '0.90-1.00') AS b90, count(*) FILTER (b = '0.70-0.89') AS b70, count(*) FILTER (b = '0.50-0.69') AS b50, count(*) FILTER (b = '0.30-0.49') AS b30, count(*) FILTER (b = '0.00-0.29') AS b00
    FROM (SELECT status, {BAND} AS b FROM cit WHERE flag = 'R') GROUP BY status""",
)
def a26(s, d):
    names = {"0.90-1.00": "b90", "0.70-0.89": "b70", "0.50-0.69": "b50", "0.30-0.49": "b30", "0.00-0.29": "b00"}
    rows = citations(s, d).where("flag = 'R'").select(c("status").alias("reason"), confidence_band(c("conf")).alias("band"))
    wide = rows.groupBy("reason").pivot("band", list(names)).agg(F.count(F.lit(1)))
    return wide.select("reason", *(F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(v) for k, v in names.items()))


@query(
    "a27_book_coverage",
    "SELECT work, count(*) AS rows, count(*) FILTER (book <> '') AS with_book, array_to_string(list_sort(list_distinct(list(book) FILTER (book <> ''))), ',') AS books FROM (SELECT work, CASE WHEN page < 150 THEN section ELSE '' END AS book FROM cit) GROUP BY work",
)
def a27(s, d):
    rows = citations(s, d).select("work", F.when(c("page") < 150, c("section")).otherwise("").alias("book"))
    return rows.groupBy("work").agg(F.count("*").alias("rows"), F.count_if(c("book") != "").alias("with_book"), F.array_join(F.sort_array(F.collect_set(F.nullif("book", F.lit("")))), ",").alias("books"))


@query("a28_doctypes", "SELECT doctype, flag, count(*) AS n FROM cit GROUP BY GROUPING SETS ((doctype), (doctype, flag))")
def a28(s, d):
    rows = citations(s, d)
    both = rows.groupBy("doctype", "flag").agg(F.count("*").alias("n"))
    return both.unionByName(both.groupBy("doctype").agg(F.sum("n").alias("n")).withColumn("flag", F.lit(None).cast("string")))


@query(
    "a29_cumulative_profile",
    "SELECT journal, n, round(100.0::DOUBLE * sum(n) OVER (ORDER BY n DESC, journal ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 4) AS cumulative FROM (SELECT journal, count(*) AS n FROM cit GROUP BY journal)",
)
def a29(s, d):
    n = citations(s, d).groupBy("journal").agg(F.count("*").alias("n"))
    return win.cumulative_percent(n, "n", F.desc("n"), "journal")


def _occupancy_sql(keys):
    return f"SELECT '{'-'.join(k.split(' AS ')[-1] for k in keys)}' AS grain, count(*) AS cells, round(avg(n), 6) AS mean, round(count(*) FILTER (n = 1) / count(*), 6) AS singletons FROM (SELECT {', '.join(keys)}, count(*) AS n FROM cit GROUP BY ALL)"


@query("a30_occupancy", " UNION ALL ".join(map(_occupancy_sql, (["work", "page"], ["work", "page", "section"], ["work", "page", "section", "line // 10 AS ten"]))))
def a30(s, d):
    rows = citations(s, d).withColumn("ten", F.floor(c("line") / 10))
    grains = [["work", "page"], ["work", "page", "section"], ["work", "page", "section", "ten"]]
    parts = [agg.occupancy(rows, g).withColumn("grain", F.lit("-".join(g))) for g in grains]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a31_span_density", "SELECT work, round(count(DISTINCT (page, section)) / (max(page) - min(page) + 1), 6) AS density FROM cit GROUP BY work")
def a31(s, d):
    return citations(s, d).groupBy("work").agg(F.round(F.countDistinct("page", "section") / (F.max("page") - F.min("page") + 1), 6).alias("density"))


@query(
    "a32_profiles",
    """SELECT journal, count(*) AS cites, count(DISTINCT iid) AS articles, CAST(floor(median(CAST(year AS INT))) AS INT) AS median_year,
    count(*) FILTER (CAST(year AS INT) < 1997) AS early, count(*) FILTER (CAST(year AS INT) >= 1997) AS late FROM cit GROUP BY journal""",
)
def a32(s, d):
    y = c("year").cast("int")
    return citations(s, d).groupBy("journal").agg(
        F.count("*").alias("cites"), F.countDistinct("iid").alias("articles"), F.floor(F.median(y)).cast("int").alias("median_year"), F.count_if(y < 1997).alias("early"), F.count_if(y >= 1997).alias("late")
    )


@query(
    "a33_proem",
    """SELECT line, count(DISTINCT iid) FILTER (CAST(year AS INT) < 1997) AS early, count(DISTINCT iid) FILTER (CAST(year AS INT) >= 1997) AS late, count(DISTINCT journal) AS journals
    FROM cit WHERE line <= 10 GROUP BY line""",
)
def a33(s, d):
    y = c("year").cast("int")
    return citations(s, d).where("line <= 10").groupBy("line").agg(
        F.countDistinct(F.when(y < 1997, c("iid"))).alias("early"), F.countDistinct(F.when(y >= 1997, c("iid"))).alias("late"), F.countDistinct("journal").alias("journals")
    )


@query("a34_concordance", "SELECT iid, count(DISTINCT (page, section, line)) AS lines, count(*) AS rows FROM cit GROUP BY iid ORDER BY lines DESC, iid LIMIT 20")
def a34(s, d):
    return citations(s, d).groupBy("iid").agg(F.countDistinct("page", "section", "line").alias("lines"), F.count("*").alias("rows")).orderBy(F.desc("lines"), "iid").limit(20)


@query(
    "a35_span_lengths",
    """WITH l AS (SELECT work, 1 + line % 9 AS n FROM cit), a AS (SELECT work, list_sort(list(n)) AS v FROM l GROUP BY work)
    SELECT work, v[1] AS least, v[len(v) // 2 + 1] AS median, v[CAST(ceil(len(v) * 0.9::DOUBLE) AS INT)] AS p90, v[len(v)] AS most,
      round(len(list_filter(v, lambda x: x = 1)) / len(v), 6) AS singles FROM a""",
)
def a35(s, d):
    cell = F.concat(F.lit("Il. 1."), (100 + c("line")).cast("string"), F.lit("-"), (100 + c("line") + c("line") % 9).cast("string"))
    values = citations(s, d).select("work", span_length(cell).alias("n")).groupBy("work").agg(F.collect_list("n").alias("v"))
    return values.select(
        "work", F.array_min("v").alias("least"), agg.upper_median(c("v")).alias("median"), agg.nearest_rank(c("v"), 0.9).alias("p90"), F.array_max("v").alias("most"),
        F.round(F.size(F.filter("v", lambda x: x == 1)) / F.size("v"), 6).alias("singles"),
    )


@query(
    "a36_cue_audit",
    """WITH k AS (SELECT substring(work, 1, 7) AS cue, ord, page FROM cit), n AS (SELECT cue, count(*) AS n FROM k GROUP BY cue),
    f AS (SELECT cue, array_to_string(list(page ORDER BY ord), ',') AS samples FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY cue ORDER BY ord) <= 3) GROUP BY cue)
    SELECT cue, n, round(n / sum(n) OVER (), 6) AS share, samples FROM n JOIN f USING (cue)""",
)
def a36(s, d):
    rows = citations(s, d).select(F.substring("work", 1, 7).alias("cue"), "ord", "page")
    n = rows.groupBy("cue").agg(F.count("*").alias("n"))
    some = win.top(rows, 3, ["cue"], "ord").groupBy("cue").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "page"))), lambda x: x["page"].cast("string")), ",").alias("samples"))
    return n.withColumn("share", F.round(c("n") / F.sum("n").over(Window.partitionBy()), 6)).join(some, "cue")


@query("a37_stray", "SELECT page, count(*) AS cites, count(DISTINCT iid) AS articles, count(DISTINCT journal) AS journals, min(year) AS first_year, max(year) AS last_year FROM cit WHERE page NOT BETWEEN 110 AND 149 GROUP BY page")
def a37(s, d):
    return citations(s, d).where(~c("page").between(110, 149)).groupBy("page").agg(
        F.count("*").alias("cites"), F.countDistinct("iid").alias("articles"), F.countDistinct("journal").alias("journals"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )


@query(
    "a39_decade_arrays",
    """WITH u AS (SELECT work, page, journal, CAST(greatest(0, least(13, floor((CAST(year AS INT) - 1890) / 10))) AS INT) AS slot, count(DISTINCT iid) AS a FROM cit GROUP BY ALL)
    SELECT work, array_to_string([coalesce((SELECT sum(a) FROM u x WHERE x.work = w.work AND x.slot = k), 0)::BIGINT FOR k IN range(14)], ',') AS volume FROM (SELECT DISTINCT work FROM u) w""".replace(
        "[coalesce((SELECT sum(a) FROM u x WHERE x.work = w.work AND x.slot = k), 0)::BIGINT FOR k IN range(14)]",
        "list_transform(range(14), lambda k: coalesce(m[CAST(k AS INT)], 0)::BIGINT)",
    ).replace("FROM (SELECT DISTINCT work FROM u) w", "FROM (SELECT work, map_from_entries(list((slot, t))) AS m FROM (SELECT work, slot, sum(a) AS t FROM u GROUP BY ALL) GROUP BY work) w"),
)
def a39(s, d):
    u = citations(s, d).withColumn("slot", decade_slot(c("year").cast("int"))).groupBy("work", "page", "journal", "slot").agg(F.countDistinct("iid").alias("a"))
    slots = u.groupBy("work").agg(*(F.coalesce(F.sum(F.when(c("slot") == k, c("a"))), F.lit(0)).alias(f"s{k}") for k in range(14)))
    return slots.select("work", F.array_join(F.array(*(c(f"s{k}").cast("string") for k in range(14))), ",").alias("volume"))


@query(
    "a40_sparsity",
    """WITH n AS (SELECT work, page, section, count(DISTINCT iid) AS n FROM cit GROUP BY ALL)
    SELECT work, count(*) FILTER (n = 1) AS one, count(*) FILTER (n = 2) AS two, count(*) FILTER (n IN (3, 4)) AS few, count(*) FILTER (n >= 5) AS more, count(*) FILTER (n >= 10) AS ten, count(*) FILTER (n >= 20) AS twenty FROM n GROUP BY work""",
)
def a40(s, d):
    n = citations(s, d).groupBy("work", "page", "section").agg(F.countDistinct("iid").alias("n"))
    k = c("n")
    tests = {"one": k == 1, "two": k == 2, "few": k.isin(3, 4), "more": k >= 5, "ten": k >= 10, "twenty": k >= 20}
    return n.groupBy("work").agg(*(F.count_if(t).alias(name) for name, t in tests.items()))


@query("a41_bin_totals", "SELECT work, bin, CAST(sum(n) AS BIGINT) AS incidences FROM (SELECT work, page, CAST(CAST(year AS INT) // 5 * 5 AS INT) AS bin, count(DISTINCT iid) AS n FROM cit GROUP BY ALL) GROUP BY ALL")
def a41(s, d):
    b = (F.floor(c("year").cast("int") / 5) * 5).cast("int").alias("bin")
    return citations(s, d).groupBy("work", "page", b).agg(F.countDistinct("iid").alias("n")).groupBy("work", "bin").agg(F.sum("n").alias("incidences"))


@query(
    "a42_group_totals",
    """WITH v AS (SELECT journal, count(*) AS n FROM cit GROUP BY journal), g AS (SELECT n_name AS journal, r_name AS grp FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT grp, CAST(sum(n) AS BIGINT) AS total, array_to_string(list(journal ORDER BY n DESC, journal), ',') AS members FROM v JOIN g USING (journal) GROUP BY grp""",
)
def a42(s, d):
    v = citations(s, d).groupBy("journal").agg(F.count("*").alias("n"))
    g = s.read.parquet(f"{d}/nation.parquet").join(s.read.parquet(f"{d}/region.parquet"), c("n_regionkey") == c("r_regionkey")).select(c("n_name").alias("journal"), c("r_name").alias("grp"))
    members = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-c("n")).alias("k"), "journal"))), lambda x: x["journal"]), ",")
    return v.join(g, "journal").groupBy("grp").agg(F.sum("n").alias("total"), members.alias("members"))


@query(
    "a43_out_of_range",
    """WITH o AS (SELECT work, page || section AS cell FROM cit WHERE page NOT BETWEEN 105 AND 154), n AS (SELECT work, cell, count(*) AS n FROM o GROUP BY ALL)
    SELECT work, cell, n, row_number() OVER (PARTITION BY work ORDER BY n DESC, cell) AS rank FROM n QUALIFY rank <= 8""",
)
def a43(s, d):
    off = citations(s, d).where(~c("page").between(105, 154)).select("work", F.concat(c("page").cast("string"), "section").alias("cell"))
    return win.top(off.groupBy("work", "cell").agg(F.count("*").alias("n")), 8, ["work"], F.desc("n"), "cell").withColumn("rank", c("rank").cast("long"))


@query(
    "a44_fill_rate",
    "SELECT count(*) AS records, count(is_part_of) AS filled, round(count(is_part_of) / count(*), 6) AS rate FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS is_part_of FROM orders WHERE o_orderkey % 2 = 0 ORDER BY o_orderkey LIMIT 5000)",
)
def a44(s, d):
    first = catalogue(s, d).where("item_id % 2 = 0").orderBy("item_id").limit(5000)
    return first.agg(F.count("*").alias("records"), F.count("is_part_of").alias("filled"), F.round(F.count("is_part_of") / F.count("*"), 6).alias("rate"))


@query("v01_filed_accounting", f"WITH {QUEUE.strip()} SELECT count(*) AS rows, count(*) FILTER (len(candidates) = 1) AS single, CAST(sum(len(candidates)) AS BIGINT) >= count(*) AS consistent FROM queue")
def v01(s, d):
    n = F.size("candidates")
    return queue(s, d).agg(F.count("*").alias("rows"), F.count_if(n == 1).alias("single"), (F.sum(n) >= F.count("*")).alias("consistent"))


@query(
    "v02_allocation_sums",
    f"WITH {QUEUE.strip()} SELECT (SELECT count(*) FROM queue) AS queued, (SELECT count(*) FROM queue)::DOUBLE AS allocated, true AS equal",
)
def v02(s, d):
    floors = agg.resolution(resolved(s, d)).select("work", "floor")
    total = agg.allocate(queue(s, d), floors).agg(F.round(F.sum("allocated"), 3).alias("allocated"))
    return queue(s, d).agg(F.count("*").alias("queued")).join(total).select("queued", "allocated", (F.abs(c("queued") - c("allocated")) < 0.01).alias("equal"))


@query("p21b_percent_guard", "SELECT flag, round(CASE WHEN count(*) = 0 THEN 0 ELSE 100.0::DOUBLE * count(*) FILTER (doctype = 'PROMO') / count(*) END, 1) AS pct FROM cit GROUP BY flag")
def percent_guard(s, d):
    return citations(s, d).groupBy("flag").agg(percent(F.count_if(c("doctype") == "PROMO"), F.count("*")).alias("pct"))
