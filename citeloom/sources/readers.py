"""Sources: line records by suffix or magic, tolerant and strict JSON, TSV by name or place, id lists."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.text import or_unknown, year_token
from citeloom.sources.files import first_bytes

DELIVERY = T.StructType([T.StructField("iid", T.StringType()), T.StructField("full_text", T.ArrayType(T.StringType())), T.StructField("references", T.ArrayType(T.StringType()))])
CATALOGUE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("item_id", "is_part_of", "published_date", "content_subtype", "content_type", "title", "ithaka_doi", "creators_string")]
)
CORRUPT = "_corrupt_record"
WIDE = {"maxCharsPerColumn": "-1"}


def is_gzip(spark: SparkSession, path: str) -> bool:
    return first_bytes(spark, path) == b"\x1f\x8b"


def text_lines(spark: SparkSession, path: str, spread: int | None = None) -> DataFrame:
    """Lines of a plain or gzip file, by suffix. A gzip file is one task, so ``spread`` deals its lines out."""
    lines = spark.read.text(path)
    return lines.repartition(spread) if spread and path.endswith(".gz") else lines


def is_array(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file is one array (else one record a line), told by its first character that is no blank."""
    return first_bytes(spark, path, 64).lstrip()[:1] == b"["


def records(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """JSON records, an array or one a line. Tolerant reading skips blank and malformed ones; strict raises."""
    reader = spark.read.option("multiLine", is_array(spark, path))
    if strict:
        return reader.schema(schema).option("mode", "FAILFAST").json(path)
    held = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = reader.schema(held).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """records, bad: blank lines count as neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    return lines.agg(F.count("*").alias("records"), F.count_if(parsed.isNull()).alias("bad"))


def tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tab-separated values with a header, fields of any length."""
    return spark.read.schema(schema).options(sep="\t", header=True, enforceSchema=False, **WIDE).csv(path)


def tsv_padded(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated values by place: the header is skipped and short rows are padded with empty fields."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).options(sep="\t", header=True, mode="PERMISSIVE", quote="", **WIDE).csv(path)
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns))


def long_fields(spark: SparkSession, path: str, key: str) -> DataFrame:
    """key, chars: the length of each key's whole field, over all lines that continue it; null if it has no text."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("n", T.LongType()), T.StructField("text", T.StringType())])
    rows = spark.read.schema(schema).options(sep="\t", header=False, quote="", nullValue="\\N", **WIDE).csv(path)
    some = F.when(F.col("n") > 0, F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1)  # with the blank after it
    return rows.groupBy(key).agg((F.sum(some) - 1).alias("chars"))


def id_list(lines: DataFrame) -> DataFrame:
    """iid: trimmed, blanks dropped, distinct. Takes lines in a column ``value``."""
    return lines.select(F.trim("value").alias("iid")).where(F.col("iid") != "").distinct()


def scan_ids(lines: DataFrame, field: str = "iid") -> DataFrame:
    """Distinct ids of JSON lines by pattern, without parsing the texts; sorted."""
    found = F.regexp_extract("value", rf'"{field}"\s*:\s*"([^"]+)"', 1)
    return lines.select(found.alias("iid")).where(F.col("iid") != "").distinct().orderBy("iid")


def dimension(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """A small nested JSON file's list as a table."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame(json.loads(text)[key], schema)


def catalogue_index(rows: DataFrame) -> DataFrame:
    """item_id, journal, year, doctype, title with ``?`` for what is missing or empty."""
    return rows.select(
        "item_id",
        or_unknown(F.col("is_part_of")).alias("journal"),
        year_token(F.col("published_date")).alias("year"),
        or_unknown(F.col("content_subtype")).alias("doctype"),
        F.coalesce("title", F.lit("")).alias("title"),
    )


def peek(lines: DataFrame, n: int = 100) -> DataFrame:
    """key, n: how often each top-level key appears in the first n records (the limit is the feature)."""
    keys = F.explode(F.json_object_keys("value"))
    return lines.limit(n).select(keys.alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def key_walk(rows: DataFrame, column: str) -> DataFrame:
    """(path, value) of every scalar in a JSON text column, at any depth: levels of a variant are opened
    until none is left."""
    level = rows.select(F.lit("").alias("path"), F.try_parse_json(column).alias("v"))
    out = None
    while True:
        kinds = level.withColumn("kind", F.schema_of_variant("v"))
        nested = kinds.where(F.col("kind").rlike("^(OBJECT|ARRAY)"))
        scalars = kinds.where(~F.col("kind").rlike("^(OBJECT|ARRAY)")).select("path", F.col("v").cast("string").alias("value"))
        out = scalars if out is None else out.unionByName(scalars)
        if nested.limit(1).count() == 0:
            return out
        nested.select("path", "v").createOrReplaceTempView("__walk")
        level = rows.sparkSession.sql("SELECT concat_ws('.', nullif(w.path, ''), coalesce(x.key, cast(x.pos as string))) AS path, x.value AS v FROM __walk w, LATERAL variant_explode(w.v) x")


def doi_like(walked: DataFrame) -> DataFrame:
    """Paths of a key walk whose name or value looks like a DOI."""
    return walked.where(F.lower("path").contains("doi") | F.col("value").rlike(r"^10\.\d{4,9}/")).groupBy("path").agg(F.count("*").alias("n"))


def ngram_levels(rows: DataFrame, column: str) -> DataFrame:
    """(iid, gram, n) of a JSON text column that holds a map of counts, a list of texts or a list of objects
    with a ``term``."""
    as_map, as_list = F.from_json(column, "map<string,int>"), F.from_json(column, "array<string>")
    terms = F.from_json(column, "array<struct<term:string,count:int>>")
    head = F.substring(F.trim(column), 1, 1)
    maps = rows.where(head == "{").select("iid", F.explode(as_map).alias("gram", "n"))
    objects = F.trim(column).startswith("[{")
    lists = rows.where((head == "[") & ~objects).select("iid", F.explode(as_list).alias("gram")).withColumn("n", F.lit(1))
    items = rows.where(objects).select("iid", F.explode(terms).alias("t")).select("iid", F.col("t.term").alias("gram"), F.col("t.count").alias("n"))
    return maps.unionByName(lists).unionByName(items)


