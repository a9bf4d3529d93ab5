"""Queries that write files and read them back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.operators import aggregate, facet, series
from citeloom.plans.published import published
from citeloom.plans.relations import CATALOGUE, catalogue, citations, table
from citeloom.queries.registry import query
from citeloom.sources import readers, writers
from citeloom.sources.files import data_files, scratch

c = F.col


def order_lines(s, d, broken=False):
    """JSON lines of the orders; with ``broken`` blank ones and ones cut short among them."""
    k = c("o_orderkey")
    line = F.to_json(F.struct(k.cast("string").alias("iid"), F.array(c("o_orderpriority")).alias("full_text"), F.array().cast("array<string>").alias("references")))
    if broken:
        line = F.when(k % 7 == 0, F.substring(line, 1, 12)).when(k % 7 == 1, F.lit("  ")).otherwise(line)
    return table(s, d, "orders").select(line.alias("value"))


def written(s, lines, label, **options):
    path = scratch(s, label) + "/t"
    lines.write.options(**options).text(path)
    return path


def spans(s, d):
    return citations(s, d).groupBy("work").agg(F.min("page").alias("start"), F.max("page").alias("end"), F.count("*").alias("n"))


SPAN_SQL = "SELECT work, min(page) AS start, max(page) AS \"end\", count(*) AS n FROM cit GROUP BY work"


@query("s01_text_streams", "SELECT suffix, o_orderpriority AS priority, count(*) AS n FROM orders, (VALUES ('gz'), ('plain')) x(suffix) GROUP BY ALL")
def s01(s, d):
    """The same lines, plain and gzipped; a gzip file is told by its suffix."""
    rows = table(s, d, "orders").select(c("o_orderpriority").alias("value"))
    plain, packed = written(s, rows, "s01"), written(s, rows, "s01", compression="gzip")
    lines = lambda path, suffix: readers.text_lines(s, path).select(F.lit(suffix).alias("suffix"), c("value").alias("priority"))
    return lines(plain, "plain").union(lines(packed, "gz")).groupBy("suffix", "priority").agg(F.count("*").alias("n"))


@query("s02_gzip_magic", "SELECT * FROM (VALUES ('gz', true), ('plain', false)) x(kind, is_gzip)")
def s02(s, d):
    """Told by the first two bytes, whatever the name says."""
    rows = table(s, d, "region").select(c("r_name").alias("value"))
    kinds = [("plain", readers.is_gzip(s, written(s, rows, "s02"))), ("gz", readers.is_gzip(s, written(s, rows, "s02", compression="gzip")))]
    return s.createDataFrame(kinds, "kind string, is_gzip boolean")


@query("s03_array_or_lines", "SELECT kind, CAST(n_nationkey AS VARCHAR) AS iid, n_name AS name FROM nation, (VALUES ('array'), ('lines')) x(kind)")
def s03(s, d):
    one = F.struct(c("n_nationkey").cast("string").alias("iid"), F.array("n_name").alias("full_text"))
    lines = written(s, table(s, d, "nation").select(F.to_json(one).alias("value")), "s03")
    array = written(s, table(s, d, "nation").agg(F.concat(F.lit(" "), F.to_json(F.collect_list(one))).alias("value")), "s03")
    read = lambda path, kind: readers.records(s, path, readers.DELIVERY).select(F.lit(kind).alias("kind"), "iid", F.get("full_text", F.lit(0)).alias("name"))
    return read(lines, "lines").union(read(array, "array"))


@query("s04_tolerant", "SELECT CAST(o_orderkey AS VARCHAR) AS iid, o_orderpriority AS page FROM orders WHERE o_orderkey % 7 > 1")
def s04(s, d):
    path = written(s, order_lines(s, d, broken=True), "s04")
    return readers.records(s, path, readers.DELIVERY).select("iid", F.get("full_text", F.lit(0)).alias("page"))


@query("s05_strict", "SELECT CAST(o_orderkey AS VARCHAR) AS iid FROM orders")
def s05(s, d):
    """Good records alone; tests see it raise on a bad one."""
    return readers.records(s, written(s, order_lines(s, d), "s05"), readers.DELIVERY, strict=True).select("iid")


@query("s06_bad_lines", "SELECT count(*) FILTER (o_orderkey % 7 <> 1) AS records, count(*) FILTER (o_orderkey % 7 = 0) AS bad FROM orders")
def s06(s, d):
    return readers.bad_lines(s, written(s, order_lines(s, d, broken=True), "s06"))


@query("s07_tsv_by_name", SPAN_SQL)
def s07(s, d):
    """A report read by its header, the columns in another order than asked for."""
    path = scratch(s, "s07") + "/t"
    writers.report(spans(s, d).select("n", "end", "work", "start"), path)
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("end", T.IntegerType()), T.StructField("work", T.StringType()), T.StructField("start", T.IntegerType())])
    return readers.tsv(s, path, schema).select("work", "start", "end", "n")


@query("s08_padded", "SELECT CAST(o_orderkey AS VARCHAR) AS iid, o_orderpriority AS journal, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS reason FROM orders")
def s08(s, d):
    """Every other row lacks its last field; the first line of each file is a header."""
    rows = table(s, d, "orders").select("o_orderkey", F.concat_ws("\t", c("o_orderkey").cast("string"), "o_orderpriority", F.when(c("o_orderkey") % 2 == 0, c("o_orderstatus"))).alias("value"))
    head = s.createDataFrame([("iid\tjournal\treason",)], "value string")
    path = scratch(s, "s08") + "/t"
    lines = head.withColumn("k", F.lit(-1).cast("long")).union(rows.select("value", c("o_orderkey").alias("k")))
    lines.coalesce(1).sortWithinPartitions("k").select("value").write.text(path)  # one file, one header: the reader's input as it comes
    return readers.tsv_padded(s, path, ["iid", "journal", "reason"])


@query("s09_long_fields", "SELECT lang, CAST(length(string_agg(text, ' ')) AS BIGINT) AS chars FROM documents GROUP BY lang")
def s09(s, d):
    """All texts of a language as one long field, in rows of some hundred texts that continue it."""
    path = scratch(s, "s09") + "/t"
    writers.long_fields(table(s, d, "documents"), "lang", "text", path)
    return readers.long_fields(s, path, "lang")


@query("s12_dimension", "SELECT n_name AS id, CAST(n_nationkey AS INT) AS start, CAST(n_nationkey + 3 AS INT) AS \"end\" FROM nation")
def s12(s, d):
    one = F.struct(c("n_name").alias("id"), c("n_nationkey").cast("int").alias("start"), (c("n_nationkey") + 3).cast("int").alias("end"))
    whole = table(s, d, "nation").agg(F.to_json(F.struct(F.collect_list(one).alias("works"))).alias("value"))
    return readers.dimension(s, written(s, whole, "s12"), "works", "id string, start int, end int")


@query("s14_raw_tsv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, regexp_replace(text, '[\\t\\r\\n]+', ' ', 'g') AS text FROM documents")
def s14(s, d):
    """Whole texts without quoting: a line is a row, a tab a border, whatever the text holds."""
    path = scratch(s, "s14") + "/t"
    writers.raw_tsv(table(s, d, "documents").select("doc_id", "text"), path)
    parts = F.split("value", "\t", 2)
    return s.read.text(path).select(F.get(parts, F.lit(0)).alias("doc_id"), F.get(parts, F.lit(1)).alias("text"))


ROUTE = "CASE WHEN flag = 'R' THEN 'queue' WHEN status = 'F' THEN 'excluded' ELSE 'resolved' END"


@query("s15_routed", f"SELECT {ROUTE} AS disposition, ord, work FROM cit")
def s15(s, d):
    """One pass over the rows writes three tables; all are read back."""
    route = F.when(c("flag") == "R", "queue").when(c("status") == "F", "excluded").otherwise("resolved")
    path = scratch(s, "s15") + "/t"
    writers.routed(citations(s, d).select("ord", "work", route.alias("disposition")), path)
    return writers.routes(s, path, "ord long, work string")


@query("s16_keyed_json", "SELECT work, page, section, count(*) AS n FROM cit GROUP BY ALL")
def s16(s, d):
    """One nested document a work, read back and opened."""
    cells = citations(s, d).groupBy("work", "page", "section").agg(F.count("*").alias("n"))
    path = scratch(s, "s16") + "/t"
    writers.keyed_json(cells, "work", ["page", "section"], path)
    inner = F.from_json("value", "struct<work:string,rows:array<struct<page:int,section:string,n:bigint>>>")
    return s.read.text(path).select(inner.alias("x")).select("x.work", F.explode("x.rows").alias("r")).select("work", "r.*")


@query("s17_nested_json", "SELECT journal, CAST(year AS VARCHAR) AS year, count(*) AS n FROM cit GROUP BY ALL")
def s17(s, d):
    n = citations(s, d).groupBy("journal", "year").agg(F.count("*").alias("n"))
    path = written(s, writers.nested(n, "journal", "year", value=c("n")).select(c("json").alias("value")), "s17")
    maps = F.from_json("value", "map<string,map<string,bigint>>")
    return s.read.text(path, wholetext=True).select(F.explode(maps).alias("journal", "m")).select("journal", F.explode("m").alias("year", "n"))


@query("s18_report", SPAN_SQL)
def s18(s, d):
    path = scratch(s, "s18") + "/t"
    writers.report(spans(s, d), path, sep=",")
    return s.read.schema("work string, start int, end int, n long").csv(path, header=True, enforceSchema=False)


@query("s19_text_report", "SELECT 'Rows by flag' || chr(10) || string_agg('  flag: ' || flag || '  n: ' || n, chr(10) ORDER BY flag) AS report FROM (SELECT flag, count(*) AS n FROM cit GROUP BY flag)")
def s19(s, d):
    rows = citations(s, d).groupBy("flag").agg(F.count("*").alias("n")).orderBy("flag")
    return s.createDataFrame([(writers.text_report(rows, "Rows by flag"),)], "report string")


BOOKED = "CASE WHEN page >= 140 THEN 'III' WHEN page > 120 OR (page = 120 AND section >= 'b') THEN 'II' WHEN page > 100 OR section >= 'b' OR line >= 5 THEN 'I' END"


def faceted(s, d):
    """Rows of one work and its books; a third of the rows is of a work without any."""
    make = lambda rows, cols: s.createDataFrame(rows, cols)
    openings = make([("W", "I", 100, "a", 5), ("W", "II", 120, "b", 0), ("W", "III", 140, "a", 0)], "work string, label string, page int, section string, line int")
    ends = make([("W", 159, "e", 9999)], "work string, page int, section string, line int")
    caps = make([], "work string, label string, page int, section string, line int")
    cell = F.concat(c("page").cast("string"), "section", c("line").cast("string"))
    rows = citations(s, d).select("ord", F.when(c("seq") % 3 == 0, "bare").otherwise("W").alias("work"), cell.alias("match"), F.lit("").alias("book"))
    return rows, facet.intervals(openings, ends, caps)


@query("s21_faceted_writer", f"SELECT CAST(ord AS VARCHAR) AS ord, CASE WHEN seq % 3 = 0 THEN 'bare' ELSE 'W' END AS work, CASE WHEN seq % 3 = 0 THEN '' ELSE coalesce({BOOKED}, '') END AS book FROM cit")
def s21(s, d):
    """Rows pass through with their book and are written as they come."""
    path = scratch(s, "s21") + "/t"
    writers.raw_tsv(facet.facet(*faceted(s, d)).select("ord", "work", "book"), path)
    parts = F.split("value", "\t", 3)
    return s.read.text(path).select(*(F.get(parts, F.lit(i)).alias(k) for i, k in enumerate(("ord", "work", "book"))))


@query("s21_audit", f"SELECT work, count(*) FILTER (book <> '') AS faceted, count(*) FILTER (book = '') AS bare FROM (SELECT CASE WHEN seq % 3 = 0 THEN 'bare' ELSE 'W' END AS work, CASE WHEN seq % 3 = 0 THEN '' ELSE coalesce({BOOKED}, '') END AS book FROM cit) GROUP BY work")
def s21_audit(s, d):
    return facet.audit(*faceted(s, d))


@query("s22_skip_existing", "SELECT work, journal, count(*) AS n FROM cit WHERE (work, journal) NOT IN (SELECT work, journal FROM cit WHERE page = 104) GROUP BY ALL")
def s22(s, d):
    """Results that an earlier run has written are left out of the next."""
    path, rows = scratch(s, "s22") + "/t", citations(s, d)
    key = F.concat_ws("|", "work", "journal").alias("result")
    aggregate.volume(rows.where("page = 104"), "work", "journal").select(key, "citations").write.parquet(path)
    todo = rows.groupBy("work", "journal").agg(F.count("*").alias("n")).withColumn("result", key)
    return writers.not_done(todo, s.read.schema("result string, citations long").parquet(path), "result").select("work", "journal", "n")


BANDS = [{"start": 100, "end": 109, "note": "kept \u00e9 as it is"}, {"start": 150, "end": 159, "note": None}]


@query("s23_passthrough", "SELECT * FROM (VALUES (100, 109, 'kept é as it is', true, false), (150, 159, NULL, true, false)) x(start, \"end\", note, copied, invented)")
def s23(s, d):
    """A document is copied as it is; where there is none, nothing is written."""
    source = written(s, s.createDataFrame([(json.dumps({"bands": BANDS}),)], "value string"), "s23")
    copied = writers.passthrough(s, source, source + "-copy")
    invented = writers.passthrough(s, source + "-none", source + "-never")
    rows = readers.dimension(s, source + "-copy", "bands", "start int, end int, note string")
    return rows.select("*", F.lit(copied).alias("copied"), F.lit(invented).alias("invented"))


@query("s24_export", "SELECT DISTINCT iid, journal, CAST(year AS INT) AS year FROM cit WHERE work = 'Brand#9' AND page = 130 AND section = 'b'")
def s24(s, d):
    """The distinct articles of a drill selection, without licensed text, as a file of values."""
    path = scratch(s, "s24") + "/t"
    rows = citations(s, d).withColumns({"year": c("year").cast("int"), "context": F.lit("licensed")})
    writers.report(published(series.drill(rows, "Brand#9", 130, "b")), path, sep=",")
    schema = "iid long, journal string, year int"
    return s.read.schema(schema).csv(path, header=True) if data_files(s, path) else s.createDataFrame([], schema)


@query("s25_fill", "SELECT format('{:,}', count(*)) || ' citations of ' || count(DISTINCT work) || ' works' AS text FROM cit")
def s25(s, d):
    totals = citations(s, d).agg(F.count("*").alias("n"), F.countDistinct("work").alias("works")).first().asDict()
    return s.createDataFrame([(writers.fill("{{n}} citations of {{works}} works", totals),)], "text string")


@query("q09_summary", "WITH m AS (SELECT r_name, list_sort(list(n_name)) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name), f AS (SELECT r_name, names, row_number() OVER (ORDER BY r_name) AS k FROM m) SELECT 'group' AS kind, r_name AS text FROM f WHERE k = 1 UNION ALL SELECT 'both', string_agg(r_name, ' + ' ORDER BY r_name) FROM f WHERE k <= 2 UNION ALL SELECT 'part', (SELECT r_name FROM f WHERE k = 1) || ' + 1 more' UNION ALL SELECT 'none', 'no journals'")
def q09(s, d):
    """Selections in words, from the groups of the tables."""
    nations = table(s, d, "nation").join(table(s, d, "region"), c("n_regionkey") == c("r_regionkey")).groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    groups = {r.r_name: list(r.names) for r in nations.orderBy("r_name").collect()}  # journal groups: a handful
    first, second = list(groups.values())[:2]
    chosen = {"group": first, "both": first + second, "part": [*first, second[0]], "none": []}
    return s.createDataFrame([(k, series.summary(v, groups)) for k, v in chosen.items()], "kind string, text string")


@query("s12_catalogue_index", f"WITH {CATALOGUE.strip()} SELECT item_id, coalesce(nullif(is_part_of, ''), '?') AS journal, coalesce(nullif(content_subtype, ''), '?') AS doctype FROM catalogue")
def s12_catalogue(s, d):
    return readers.catalogue_index(catalogue(s, d)).select("item_id", "journal", "doctype")
