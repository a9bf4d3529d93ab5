"""Ordered operators, sorts, limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.operators import temporal
from citeloom.operators import windows as win
from citeloom.operators.aggregate import upper_median
from citeloom.plans.relations import citations, table
from citeloom.queries.registry import query

c = F.col


def yearly(s, d):
    return citations(s, d).groupBy("work", c("year").cast("int").alias("year")).agg(F.count("*").alias("n"))


YEARLY = "y AS (SELECT work, CAST(year AS INT) AS year, count(*) AS n FROM cit GROUP BY ALL)"


@query("w01_sequence", "SELECT ord, row_number() OVER (PARTITION BY iid ORDER BY page, line, ord) - 1 AS seq_in_article FROM cit")
def w01(s, d):
    return win.sequence(citations(s, d), "iid", "page", "line", "ord").select("ord", c("seq_in_article").cast("long").alias("seq_in_article"))


@query("w02_average_rank", "WITH n AS (SELECT work, page, count(*) AS n FROM cit GROUP BY ALL) SELECT work, page, rank() OVER (PARTITION BY work ORDER BY n) + (count(*) OVER (PARTITION BY work, n) - 1) / 2.0::DOUBLE AS r FROM n")
def w02(s, d):
    n = citations(s, d).groupBy("work", "page").agg(F.count("*").alias("n"))
    return n.select("work", "page", win.average_rank("n", "work").alias("r"))


@query("w03_smooth", f"WITH {YEARLY} SELECT work, year, n, round(avg(n) OVER (PARTITION BY work ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smoothed FROM y WHERE (year + CAST(regexp_extract(work, '(\\d+)', 1) AS INT)) % 4 <> 0")
def w03(s, d):
    gaps = yearly(s, d).where((c("year") + F.regexp_extract("work", r"(\d+)", 1).cast("int")) % 4 != 0)
    return win.smooth(gaps, ["work"], "n", 3).withColumn("smoothed", F.round("smoothed", 6))


@query(
    "w04_half_crossing",
    f"WITH {YEARLY}, r AS (SELECT *, sum(n) OVER (PARTITION BY work ORDER BY year ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY work) / 2.0::DOUBLE AS half FROM y) SELECT work, year, n FROM r WHERE run >= half AND run - n < half",
)
def w04(s, d):
    return win.half_crossing(yearly(s, d), ["work"], "year", "n")


@query("w05_cumulative", "WITH j AS (SELECT journal, count(*) AS n FROM cit GROUP BY journal) SELECT journal, n, round(100.0::DOUBLE * sum(n) OVER (ORDER BY n DESC, journal ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 4) AS cumulative FROM j")
def w05(s, d):
    return win.cumulative_percent(citations(s, d).groupBy("journal").agg(F.count("*").alias("n")), "n", F.desc("n"), "journal")


@query("w06_first_wins", "SELECT iid, page, section, line, work, ord FROM cit QUALIFY row_number() OVER (PARTITION BY iid, page, section, line ORDER BY ord) = 1")
def w06(s, d):
    return win.first_wins(citations(s, d), ["iid", "page", "section", "line"], "ord").select("iid", "page", "section", "line", "work", "ord")


@query("w07_first_seen", "SELECT work, arg_min(journal, ord) AS first_journal FROM cit GROUP BY work")
def w07(s, d):
    return citations(s, d).groupBy("work").agg(F.min_by("journal", "ord").alias("first_journal"))


@query("w10_split_year", "SELECT work, list_sort(list(CAST(year AS INT)))[count(*) // 2 + 1] AS split_year FROM cit GROUP BY work")
def w10(s, d):
    return citations(s, d).groupBy("work").agg(upper_median(F.collect_list(c("year").cast("int"))).alias("split_year"))


@query(
    "w11_period_cuts",
    "WITH v AS (SELECT work, list_sort(list(CAST(year AS INT))) AS ys FROM cit GROUP BY work) SELECT work, ys[least(len(ys), len(ys) // 3 + 1)] AS cut1, ys[least(len(ys), 2 * len(ys) // 3 + 1)] AS cut2 FROM v",
)
def w11(s, d):
    cuts = temporal.period_cuts(citations(s, d).groupBy("work").agg(F.collect_list(c("year").cast("int")).alias("ys")), 3)
    return cuts.select("work", F.get("cuts", F.lit(0)).alias("cut1"), F.get("cuts", F.lit(1)).alias("cut2"))


@query(
    "w12_to_half",
    "WITH u AS (SELECT work, page, count(DISTINCT iid) AS n FROM cit GROUP BY ALL), r AS (SELECT work, sum(n) OVER w AS run, row_number() OVER w AS k, sum(n) OVER (PARTITION BY work) / 2.0::DOUBLE AS half FROM u WINDOW w AS (PARTITION BY work ORDER BY n DESC, page ROWS UNBOUNDED PRECEDING)) SELECT work, min(k) AS units FROM r WHERE run >= half GROUP BY work",
)
def w12(s, d):
    u = citations(s, d).groupBy("work", "page").agg(F.countDistinct("iid").alias("n"))
    return temporal.units_to_half(u, "n", "page").withColumn("units", c("units").cast("long"))


@query(
    "w13_step_up",
    """WITH p AS (SELECT work, page, round((1 + count(*) * 7919 % 997) / 1000.0::DOUBLE, 6) AS p FROM cit GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY p, page) AS k, count(*) OVER (PARTITION BY work) AS m FROM p)
    SELECT work, page, p, round(least(1.0::DOUBLE, min(p * m / k) OVER (PARTITION BY work ORDER BY p, page ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS q FROM r""",
)
def w13(s, d):
    p = F.round((1 + F.count("*") * 7919 % 997) / 1000.0, 6)
    tests = citations(s, d).groupBy("work", "page").agg(p.alias("p"))
    return win.q_values(tests, ["work"], "p", "page").withColumn("q", F.round("q", 8))


@query("w14_peak_slot", f"WITH {YEARLY}, m AS (SELECT work, year, n FROM y QUALIFY row_number() OVER (PARTITION BY work ORDER BY n DESC, year) = 1) SELECT work, year - 1990 AS peak FROM m")
def w14(s, d):
    slots = F.array(*(F.coalesce(F.sum(F.when(c("year") == y, c("n"))), F.lit(0)) for y in range(1990, 2010)))
    a = yearly(s, d).groupBy("work").agg(slots.alias("a"))
    return a.select("work", (F.array_position("a", F.array_max("a")) - 1).cast("int").alias("peak"))


@query("t01_most_common", "WITH n AS (SELECT work, journal, count(*) AS n, min(ord) AS o FROM cit GROUP BY ALL) SELECT work, journal, n, row_number() OVER (PARTITION BY work ORDER BY n DESC, o) AS rank FROM n QUALIFY rank <= 6")
def t01(s, d):
    n = citations(s, d).groupBy("work", "journal").agg(F.count("*").alias("n"), F.min("ord").alias("o"))
    return win.top(n, 6, ["work"], F.desc("n"), "o").select("work", "journal", "n", c("rank").cast("long").alias("rank"))


@query("t02_by_floor", "SELECT work, count(*) AS floor FROM cit GROUP BY work ORDER BY floor DESC, work")
def t02(s, d):
    return citations(s, d).groupBy("work").agg(F.count("*").alias("floor")).orderBy(F.desc("floor"), "work")


@query(
    "t03_movers",
    "WITH u AS (SELECT page, count(*) FILTER (CAST(year AS INT) < 1997) AS e, count(*) FILTER (CAST(year AS INT) >= 1997) AS l FROM cit GROUP BY page) SELECT page, l - e AS delta FROM u ORDER BY abs(l - e) DESC, page LIMIT 25",
)
def t03(s, d):
    y = c("year").cast("int")
    u = citations(s, d).groupBy("page").agg((F.count_if(y >= 1997) - F.count_if(y < 1997)).alias("delta"))
    return u.orderBy(F.abs("delta").desc(), "page").limit(25)


@query("t04_units_by_total", "SELECT page, section, count(*) AS total FROM cit GROUP BY ALL ORDER BY total DESC, page, section LIMIT 50")
def t04(s, d):
    return citations(s, d).groupBy("page", "section").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "page", "section").limit(50)


@query("t05_cell_order", "SELECT work, page, section, CAST(line // 15 AS INT) AS band, count(*) AS n FROM cit GROUP BY ALL ORDER BY work, page, section, band")
def t05(s, d):
    return citations(s, d).groupBy("work", "page", "section", F.floor(c("line") / 15).cast("int").alias("band")).agg(F.count("*").alias("n")).orderBy("work", "page", "section", "band")


@query("t06_text_order", "SELECT work, page, section, row_number() OVER (ORDER BY CAST(regexp_extract(work, '(\\d+)', 1) AS INT), page, section) AS place FROM (SELECT DISTINCT work, page, section FROM cit)")
def t06(s, d):
    units = citations(s, d).select("work", "page", "section").distinct()
    key = F.struct(F.regexp_extract("work", r"(\d+)", 1).cast("int"), "page", "section")
    return units.withColumn("place", F.row_number().over(Window.orderBy(key)).cast("long"))  # a work's few hundred units


@query("t07_numeric_first", "SELECT book, row_number() OVER (ORDER BY n IS NULL, n, book) AS place FROM (SELECT DISTINCT book, TRY_CAST(book AS INT) AS n FROM (SELECT CASE WHEN page % 2 = 0 THEN CAST(page AS VARCHAR) ELSE section END AS book FROM cit))")
def t07(s, d):
    books = citations(s, d).select(F.when(c("page") % 2 == 0, c("page").cast("string")).otherwise(c("section")).alias("book")).distinct()
    n = c("book").try_cast("int")
    return books.withColumn("place", F.row_number().over(Window.orderBy(n.isNull(), n, "book")).cast("long"))


@query("t08_samples", "SELECT doctype, ord FROM cit QUALIFY row_number() OVER (PARTITION BY doctype ORDER BY ord) <= 3")
def t08(s, d):
    """A bounded sample (the feature): the first three rows of each bucket."""
    return win.top(citations(s, d), 3, ["doctype"], "ord").select("doctype", "ord")


@query("t09_record_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def t09(s, d):
    return table(s, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(100)


@query("t10_worst_first", "SELECT work, count(*) AS volume, round(count(*) FILTER (flag <> 'R') / count(*), 4) AS rate FROM cit GROUP BY work ORDER BY rate, volume DESC, work LIMIT 12")
def t10(s, d):
    n = citations(s, d).groupBy("work").agg(F.count("*").alias("volume"), F.round(F.count_if(c("flag") != "R") / F.count("*"), 4).alias("rate"))
    return n.orderBy("rate", F.desc("volume"), "work").limit(12)


@query("t11_most_missing", "WITH b AS (SELECT work, count(*) AS n, count(*) FILTER (flag = 'R') AS missing FROM cit GROUP BY work) SELECT work, missing FROM b ORDER BY missing DESC, work")
def t11(s, d):
    return citations(s, d).groupBy("work").agg(F.count_if(c("flag") == "R").alias("missing")).orderBy(F.desc("missing"), "work")


SPANS = "list_transform(range(1, 6), lambda i: {'s': CAST(line * i * 7 % 60 AS BIGINT), 'e': CAST(line * i * 7 % 60 + 3 + (line + i) % 9 AS BIGINT)})"


@query(
    "w08_longest_wins",
    f"""WITH RECURSIVE m AS (SELECT rid, ord, unnest({SPANS}) AS m FROM (SELECT *, row_number() OVER () AS rid FROM cit)),
    o AS (SELECT rid, ord, m.s AS s, m.e AS e, row_number() OVER (PARTITION BY rid ORDER BY m.s, m.e DESC) AS k FROM m),
    sweep AS (SELECT rid, ord, k, e AS last, s || '-' || e AS kept FROM o WHERE k = 1
      UNION ALL SELECT o.rid, o.ord, o.k, CASE WHEN s >= last THEN e ELSE last END, kept || CASE WHEN s >= last THEN ' ' || s || '-' || e ELSE '' END FROM sweep JOIN o ON o.rid = sweep.rid AND o.k = sweep.k + 1)
    SELECT ord, kept FROM sweep WHERE k = 5""",
)
def w08(s, d):
    """Five spans for each row; overlapping ones resolved."""
    span = lambda i: F.struct((c("line") * i * 7 % 60).alias("start"), (c("line") * i * 7 % 60 + 3 + (c("line") + i) % 9).alias("end"))
    rows = citations(s, d).select("ord", F.array(*(span(i) for i in range(1, 6))).alias("m"))
    text = F.transform(win.longest_wins(c("m")), lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string")))
    return rows.select("ord", F.array_join(text, " ").alias("kept"))
