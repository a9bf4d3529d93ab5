"""Shift analysis. Observed parts are checked against SQL; null-dependent ones by tests, as statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.operators import shapes, temporal
from citeloom.operators import windows as win
from citeloom.plans.relations import citations
from citeloom.queries.registry import query

c = F.col


def units(s, d):
    return citations(s, d).select("work", c("page").cast("string").alias("unit"), "iid", c("year").cast("int").alias("year"))


UNITS = """u AS (SELECT work, CAST(page AS VARCHAR) AS unit, iid, CAST(year AS INT) AS year FROM cit),
sp AS (SELECT work, list_sort(list(year))[count(*) // 2 + 1] AS split_year FROM u GROUP BY work),
el AS (SELECT work, unit, count(DISTINCT iid) FILTER (year < split_year) AS early, count(DISTINCT iid) FILTER (year >= split_year) AS late FROM u JOIN sp USING (work) GROUP BY ALL),
sh AS (SELECT *, early / greatest(sum(early) OVER (PARTITION BY work), 1) AS share_early, late / greatest(sum(late) OVER (PARTITION BY work), 1) AS share_late FROM el)"""


@query("x01_early_late", f"WITH {UNITS} SELECT work, unit, early, late, round(share_early, 8) AS share_early, round(share_late, 8) AS share_late, round(share_late - share_early, 8) AS delta FROM sh")
def x01(s, d):
    return temporal.early_late(units(s, d)).select("work", "unit", "early", "late", *(F.round(k, 8).alias(k) for k in ("share_early", "share_late", "delta")))


SHAPE = f"""WITH {UNITS}, r AS (SELECT *, rank() OVER (PARTITION BY work ORDER BY share_early) + (count(*) OVER (PARTITION BY work, share_early) - 1) / 2.0::DOUBLE AS ra,
rank() OVER (PARTITION BY work ORDER BY share_late) + (count(*) OVER (PARTITION BY work, share_late) - 1) / 2.0::DOUBLE AS rb FROM sh)"""


@query("x02_shape", f"{SHAPE} SELECT work, count(*) AS n_units, CAST(sum(early + late) AS BIGINT) AS incidences, round(corr(ra, rb), 6) AS spearman, round(0.5::DOUBLE * sum(abs(share_late - share_early)), 6) AS tvd FROM r GROUP BY work")
def x02(s, d):
    out = temporal.shape(temporal.early_late(units(s, d)))
    return out.select("work", "n_units", "incidences", F.round("spearman", 6).alias("spearman"), F.round("tvd", 6).alias("tvd"))


@query("x03_gate", f"WITH {UNITS} SELECT work, count(*) AS tested FROM el WHERE early + late >= 38 GROUP BY work")
def x03(s, d):
    return temporal.gated(temporal.early_late(units(s, d)), 38).groupBy("work").agg(F.count("*").alias("tested"))


@query("x04_permutation_null")
def x04(s, d):
    return temporal.permutation_null(units(s, d)).select("work", "unit", F.round("delta", 8).alias("delta"), F.round("p", 8).alias("p"))


@query("x05_q_values")
def x05(s, d):
    return temporal.permutation_q(units(s, d)).select("work", "unit", F.round("q", 8).alias("q"))


@query("x06_z")
def x06(s, d):
    """The observed shape of each work against its null."""
    out = temporal.shape_null(units(s, d))
    return out.select("work", *(F.round(k, 6).alias(k) for k in ("spearman", "tvd", "rho_z", "tvd_z", "tvd_percentile")))


FIXED_P = """t AS (SELECT work, unit, early, late, share_late - share_early AS delta, (1 + (early * 31 + late * 17) % 199) / 200.0::DOUBLE AS p FROM sh),
k AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY p, unit) AS k, count(*) OVER (PARTITION BY work) AS m FROM t),
q AS (SELECT *, least(1.0::DOUBLE, min(p * m / k) OVER (PARTITION BY work ORDER BY p, unit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM k)"""


@query("x07_movers", f"WITH {UNITS}, {FIXED_P} SELECT work, unit, p < 0.05::DOUBLE AS raw, q < 0.10::DOUBLE AS strong, early < 15 AS floor_fail_early FROM q WHERE p < 0.1::DOUBLE")
def x07(s, d):
    p = (1 + (c("early") * 31 + c("late") * 17) % 199) / 200.0
    tests = win.q_values(temporal.early_late(units(s, d)).withColumn("p", p), ["work"], "p", "unit")
    return temporal.movers(tests, 15).where("p < 0.1D").select("work", "unit", "raw", "strong", "floor_fail_early")


DISPERSION = f"""WITH {UNITS}, v AS (SELECT work, list_sort(list(year)) AS ys FROM u GROUP BY work HAVING count(*) >= 15),
ct AS (SELECT work, ys[least(len(ys), len(ys) // 3 + 1)] AS c1, ys[least(len(ys), 2 * len(ys) // 3 + 1)] AS c2 FROM v),
pd AS (SELECT work, unit, count(DISTINCT iid) FILTER (year < c1 AND year < c2) AS n0, count(DISTINCT iid) FILTER ((year >= c1) <> (year >= c2)) AS n1, count(DISTINCT iid) FILTER (year >= c1 AND year >= c2) AS n2 FROM u JOIN ct USING (work) GROUP BY ALL),
ps AS (SELECT work, unit, n0 / greatest(sum(n0) OVER w, 1) AS s0, n1 / greatest(sum(n1) OVER w, 1) AS s1, n2 / greatest(sum(n2) OVER w, 1) AS s2 FROM pd WINDOW w AS (PARTITION BY work)),
dp AS (SELECT work, unit, (abs(s0 - s1) + abs(s0 - s2) + abs(s1 - s2)) * 0.5::DOUBLE / 3 AS dispersion FROM ps)"""


@query("x08_dispersion", f"{DISPERSION} SELECT work, unit, round(dispersion, 8) AS dispersion FROM dp")
def x08(s, d):
    return temporal.dispersion(units(s, d)).withColumn("dispersion", F.round("dispersion", 8))


@query(
    "x09_concentration",
    f"""{DISPERSION}, rk AS (SELECT *, row_number() OVER w AS k, sum(dispersion) OVER (PARTITION BY work) AS total, sum(dispersion) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM dp WINDOW w AS (PARTITION BY work ORDER BY round(dispersion, 8) DESC, unit))
    SELECT work, round(sum(dispersion) FILTER (k <= 1) / any_value(total), 5) AS top1, round(sum(dispersion) FILTER (k <= 10) / any_value(total), 5) AS top10, min(k) FILTER (run >= total / 2) AS units FROM rk GROUP BY work""".replace("OVER (w ROWS UNBOUNDED PRECEDING)", "OVER (PARTITION BY work ORDER BY round(dispersion, 8) DESC, unit ROWS UNBOUNDED PRECEDING)"),
)
def x09(s, d):
    parts = temporal.dispersion(units(s, d)).withColumn("dispersion", F.round("dispersion", 8))
    return temporal.concentration(parts).select("work", F.round("top1", 5).alias("top1"), F.round("top10", 5).alias("top10"), c("units").cast("long").alias("units"))


@query("x08_dispersion_null")
def x08_null(s, d):
    out = temporal.dispersion_null(units(s, d))
    return out.select("work", "unit", *(F.round(k, 8).alias(k) for k in ("dispersion", "p", "z")))


WORKS = "n AS (SELECT work, count(*) AS n, count(DISTINCT iid) AS articles, count(DISTINCT page) AS pages FROM cit GROUP BY work)"
FIXED_Z = f"{WORKS}, z AS (SELECT work, n % 50 / 10.0::DOUBLE AS tvd_z, articles % 40 / 10.0::DOUBLE AS structure_z, articles % 150 AS n_articles, pages % 7 AS n_tested FROM n)"
VERDICT = f"""{FIXED_Z}, v AS (SELECT *, CASE WHEN tvd_z >= 3 THEN 'REAL' WHEN tvd_z >= 1.5::DOUBLE THEN 'marginal' ELSE 'stable' END AS verdict FROM z),
vv AS (SELECT *, verdict = 'stable' AND structure_z >= 3 AS two_bin_flat_only, verdict <> 'REAL' AND structure_z >= 3 AS two_bin_understates,
  verdict = 'stable' AND n_articles >= 100 AND n_tested >= 3 AS stability_powered, abs(tvd_z - 1.5::DOUBLE) <= 1 OR abs(tvd_z - 3) <= 1 AS near_threshold FROM v)"""


def fixed_z(s, d):
    """Scores that depend on the counts of a work's rows, so that every verdict and flag is met."""
    n = citations(s, d).groupBy("work").agg(F.count("*").alias("n"), F.countDistinct("iid").alias("articles"), F.countDistinct("page").alias("pages"))
    return n.select("work", (c("n") % 50 / 10.0).alias("tvd_z"), (c("articles") % 40 / 10.0).alias("structure_z"), (c("articles") % 150).alias("n_articles"), (c("pages") % 7).alias("n_tested"))


FLAGS = ("verdict", "two_bin_flat_only", "two_bin_understates", "stability_powered", "near_threshold")


@query("x10_verdict", f"WITH {VERDICT} SELECT work, {', '.join(FLAGS)} FROM vv")
def x10(s, d):
    return temporal.verdicts(fixed_z(s, d)).select("work", *FLAGS)


@query("x11_focus_page", "SELECT work, CAST(year AS INT) AS year, count(DISTINCT iid) AS articles FROM cit WHERE regexp_matches(page || section, '^10([^0-9]|$)') OR regexp_matches(page || section, '^110([^0-9]|$)') GROUP BY ALL")
def x11(s, d):
    label = F.concat(c("page").cast("string"), "section")
    return citations(s, d).where(label.rlike("^10([^0-9]|$)") | label.rlike("^110([^0-9]|$)")).groupBy("work", c("year").cast("int").alias("year")).agg(F.countDistinct("iid").alias("articles"))


@query(
    "x12_pooled",
    """WITH u0 AS (SELECT CASE WHEN CAST(regexp_extract(work, '(\\d+)', 1) AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END AS work, work || ':' || page AS unit, iid, CAST(year AS INT) AS year FROM cit), """
    + UNITS.replace("u AS (SELECT work, CAST(page AS VARCHAR) AS unit, iid, CAST(year AS INT) AS year FROM cit)", "u AS (SELECT * FROM u0)")
    + " SELECT work, unit, early, late, round(share_late - share_early, 8) AS delta FROM sh",
)
def x12(s, d):
    even = F.regexp_extract("work", r"(\d+)", 1).cast("int") % 2 == 0
    pooled = citations(s, d).select(F.when(even, "even").otherwise("odd").alias("pool"), F.concat_ws(":", "work", c("page").cast("string")).alias("unit"), "iid", c("year").cast("int").alias("year")).withColumnRenamed("pool", "work")
    return temporal.early_late(pooled).select("work", "unit", "early", "late", F.round("delta", 8).alias("delta"))


@query("x13_journal_set", "SELECT work, count(*) AS n FROM cit WHERE journal IN ('NATION_1', 'NATION_4', 'NATION_9') GROUP BY work")
def x13(s, d):
    chosen = s.createDataFrame([("NATION_1",), ("NATION_4",), ("NATION_9",)], "journal string")
    return citations(s, d).join(chosen, "journal", "left_semi").groupBy("work").agg(F.count("*").alias("n"))


@query(
    "x14_shape_code",
    f"""WITH {VERDICT}, k AS (SELECT *, n_articles % 3 AS solid, n_tested % 2 AS survivors FROM vv)
    SELECT work, CASE verdict WHEN 'stable' THEN CASE WHEN two_bin_flat_only THEN CASE WHEN survivors >= 1 THEN 'rp' ELSE 'rw' END WHEN stability_powered THEN 's' ELSE 't' END
      WHEN 'REAL' THEN CASE WHEN solid >= 1 THEN '1p' ELSE '1w' END
      WHEN 'marginal' THEN CASE WHEN two_bin_understates THEN CASE WHEN survivors >= 1 THEN 'rp' ELSE 'rw' END WHEN solid >= 1 THEN '1p' ELSE '1w' END END AS shape,
      verdict = 'marginal' AS hedged FROM k""",
)
def x14(s, d):
    v = temporal.verdicts(fixed_z(s, d)).withColumns({"solid": c("n_articles") % 3, "survivors": c("n_tested") % 2})
    code = shapes.shape_code(*map(c, ("verdict", "two_bin_flat_only", "two_bin_understates", "stability_powered", "solid", "survivors")))
    return v.select("work", code.alias("x")).select("work", "x.shape", "x.hedged")


@query(
    "x15_variant",
    """WITH u AS (SELECT work, page, CAST(greatest(0, least(13, floor((CAST(year AS INT) - 1890) / 10))) AS INT) AS slot, count(DISTINCT iid) AS a FROM cit GROUP BY ALL)
    SELECT work, page, CAST(sum(a) AS BIGINT) AS total, CAST(coalesce(sum(a) FILTER (slot = 10), 0) AS BIGINT) AS s10, CAST(coalesce(sum(a) FILTER (slot = 11), 0) AS BIGINT) AS s11 FROM u GROUP BY ALL""",
)
def x15(s, d):
    rows = shapes.decade_rows(units(s, d))
    return rows.select("work", c("unit").cast("int").alias("page"), "total", F.get("slots", F.lit(10)).alias("s10"), F.get("slots", F.lit(11)).alias("s11"))


AUTHORED = "au AS (SELECT DISTINCT work, CASE n % 5 WHEN 0 THEN 'Pindar' WHEN 1 THEN 'Homer' WHEN 2 THEN 'Paul' ELSE 'Plato' END AS author, n % 2 = 0 AS faceted FROM (SELECT work, CAST(regexp_extract(work, '(\\d+)', 1) AS INT) AS n FROM cit))"
GRAINS = "gr AS (SELECT work, CASE WHEN author IN ('Pindar', 'Homer', 'Paul') THEN ['book'] WHEN faceted THEN ['book', 'passage'] ELSE ['passage'] END AS grains FROM au)"


def authored(s, d):
    n = F.regexp_extract("work", r"(\d+)", 1).cast("int")
    author = F.when(n % 5 == 0, "Pindar").when(n % 5 == 1, "Homer").when(n % 5 == 2, "Paul").otherwise("Plato")
    return citations(s, d).select("work", author.alias("author"), (n % 2 == 0).alias("faceted")).distinct()


@query(
    "x16_default_grain",
    f"""WITH {AUTHORED}, {GRAINS}, sets AS (SELECT *, 'all' AS jset FROM cit UNION ALL SELECT *, 'first' FROM cit WHERE journal < 'NATION_2'),
    va AS (SELECT work, 'book' AS grain, jset, CASE WHEN count(DISTINCT (section, iid)) % 3 = 0 THEN 'rw' ELSE 't' END AS shape FROM sets GROUP BY work, jset
      UNION ALL SELECT work, 'passage', jset, CASE WHEN count(DISTINCT (page, iid)) % 3 <> 0 THEN '1p' ELSE 't' END FROM sets GROUP BY work, jset),
    t AS (SELECT * FROM va WHERE shape <> 't'), k AS (SELECT work, list(grain) FILTER (jset = 'all') AS can FROM t GROUP BY work)
    SELECT gr.work, array_to_string(grains, ',') AS grains, coalesce(list_filter(grains, lambda g: list_contains(coalesce(can, []), g))[1], grains[1]) AS default_grain, k.work IS NULL AS never_testable FROM gr LEFT JOIN k USING (work)""",
)
def x16(s, d):
    rows = citations(s, d)
    sets = rows.withColumn("jset", F.lit("all")).unionByName(rows.where("journal < 'NATION_2'").withColumn("jset", F.lit("first")))
    n = sets.groupBy("work", "jset").agg(F.countDistinct("section", "iid").alias("book"), F.countDistinct("page", "iid").alias("passage"))
    book = n.select("work", F.lit("book").alias("grain"), "jset", F.when(c("book") % 3 == 0, "rw").otherwise("t").alias("shape"))
    passage = n.select("work", F.lit("passage").alias("grain"), "jset", F.when(c("passage") % 3 != 0, "1p").otherwise("t").alias("shape"))
    return shapes.default_grain(authored(s, d), book.unionByName(passage)).withColumn("grains", F.array_join("grains", ","))


@query("x17_grain_policy", f"WITH {AUTHORED}, {GRAINS} SELECT work, unnest(grains) AS grain FROM gr")
def x17(s, d):
    return authored(s, d).select("work", F.explode(shapes.grains(c("author"), c("faceted"))).alias("grain"))


@query(
    "x18_structure",
    f"""WITH {WORKS}, k AS (SELECT work, n % 3 AS n_fdr, articles % 100 / 100.0::DOUBLE AS top5, articles % 20 AS half, pages AS n_tested FROM n)
    SELECT work, CASE WHEN n_fdr >= 1 AND top5 >= 0.40::DOUBLE THEN 'hero' WHEN n_fdr = 0 AND half >= greatest(8, 0.15::DOUBLE * n_tested) THEN 'diffuse' WHEN n_fdr >= 1 THEN 'both' ELSE 'weak' END AS structure FROM k""",
)
def x18(s, d):
    n = citations(s, d).groupBy("work").agg(F.count("*").alias("n"), F.countDistinct("iid").alias("articles"), F.countDistinct("page").alias("pages"))
    return n.select("work", temporal.structure(c("n") % 3, c("articles") % 100 / 100.0, c("articles") % 20, c("pages")).alias("structure"))


@query(
    "x19_collision_pattern",
    r"""WITH x AS (SELECT work, journal, count(*) AS n FROM cit WHERE CAST(regexp_extract(journal, '(\d+)', 1) AS INT) % 9 < CAST(regexp_extract(work, '(\d+)', 1) AS INT) % 7 GROUP BY ALL),
    k AS (SELECT work, count(*) AS nj, max(n) / sum(n) AS top FROM x GROUP BY work)
    SELECT work, CASE WHEN nj <= 3 THEN 'B' WHEN top < 0.35::DOUBLE AND nj >= 5 THEN 'A' ELSE 'mixed' END AS pattern FROM k""",
)
def x19(s, d):
    number = lambda k: F.regexp_extract(k, r"(\d+)", 1).cast("int")
    n = citations(s, d).where(number("journal") % 9 < number("work") % 7).groupBy("work", "journal").agg(F.count("*").alias("n"))
    spread = n.groupBy("work").agg(F.count("*").alias("nj"), (F.max("n") / F.sum("n")).alias("top"))
    return spread.select("work", temporal.collision_pattern(c("nj"), c("top")).alias("pattern"))


@query("v07_parts_sum", f"{DISPERSION}, ws AS (SELECT work, (0.5::DOUBLE * sum(abs(s0 - s1)) + 0.5::DOUBLE * sum(abs(s0 - s2)) + 0.5::DOUBLE * sum(abs(s1 - s2))) / 3 AS whole FROM ps GROUP BY work) SELECT work, round(whole, 6) AS whole FROM ws")
def v07(s, d):
    return temporal.dispersion(units(s, d)).groupBy("work").agg(F.round(F.sum("dispersion"), 6).alias("whole"))


@query("f25_tvd", "WITH n AS (SELECT journal, count(*) FILTER (flag = 'A') AS a, count(*) FILTER (flag = 'R') AS r FROM cit GROUP BY journal) SELECT round(0.5::DOUBLE * sum(abs(a / ta - r / tr)), 8) AS tvd FROM (SELECT *, sum(a) OVER () AS ta, sum(r) OVER () AS tr FROM n)")
def f25(s, d):
    n = citations(s, d).groupBy("journal").agg(F.count_if(c("flag") == "A").alias("a"), F.count_if(c("flag") == "R").alias("r"))
    whole = Window.partitionBy()
    return n.withColumn("x", F.abs(c("a") / F.sum("a").over(whole) - c("r") / F.sum("r").over(whole))).agg(F.round(0.5 * F.sum("x"), 8).alias("tvd"))
