"""Sources, sinks, resumable ingest, published columns."""

import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.operators import checks, series
from citeloom.plans.published import check_published, published
from citeloom.sources import readers, writers
from citeloom.streaming.ingest import ingest

GOOD = [{"iid": "a", "full_text": ["see 327a", "x"], "references": []}, {"iid": "b", "full_text": None, "references": ["r"]}]


@pytest.fixture
def files(tmp_path):
    lines = "\n".join([json.dumps(GOOD[0]), "", "{broken", json.dumps(GOOD[1])]) + "\n"
    (tmp_path / "d.jsonl").write_text(lines)
    (tmp_path / "d.json").write_text("  \n" + json.dumps(GOOD))
    with gzip.open(tmp_path / "d.jsonl.gz", "wt") as f:
        f.write(lines)
    (tmp_path / "t.tsv").write_text("iid\tjournal\treason\na\tJ\tr\nb\tK\nc\n")
    (tmp_path / "dim.json").write_text(json.dumps({"dialogues": [{"id": "X", "start": 1, "end": 3}]}))
    return tmp_path


def test_json(spark, files):
    for name in ("d.jsonl", "d.json", "d.jsonl.gz"):
        assert sorted(r.iid for r in readers.records(spark, f"{files}/{name}", readers.DELIVERY).collect()) == ["a", "b"], name
    with pytest.raises(Exception):
        readers.records(spark, f"{files}/d.jsonl", readers.DELIVERY, strict=True).collect()
    assert readers.is_gzip(spark, f"{files}/d.jsonl.gz") and not readers.is_gzip(spark, f"{files}/d.json")
    assert tuple(readers.bad_lines(spark, f"{files}/d.jsonl").first()) == (3, 1)
    assert readers.text_lines(spark, f"{files}/d.jsonl.gz", 3).count() == 4
    assert readers.dimension(spark, f"{files}/dim.json", "dialogues", "id string, start int, end int").first().end == 3


def test_tsv(spark, files):
    rows = readers.tsv_padded(spark, f"{files}/t.tsv", ["iid", "journal", "reason"]).orderBy("iid").collect()
    assert [tuple(r) for r in rows] == [("a", "J", "r"), ("b", "K", ""), ("c", "", "")]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("iid", "journal", "reason")])
    assert readers.tsv(spark, f"{files}/t.tsv", schema).where("reason = 'r'").count() == 1
    writers.raw_tsv(spark.createDataFrame([("a\tb", None), ('"q', "x\ny")], "p string, q string"), f"{files}/out")
    assert sorted(r.value for r in spark.read.text(f"{files}/out").collect()) == ['"q\tx y', "a b\t"]


def test_long_field_takes_many_rows(spark, tmp_path):
    """A key's texts are one field over lines of a few texts each; nulls and empty texts among them."""
    rows = [("en", f"t\t{i}\n") for i in range(1000)] + [("en", None), ("de", ""), ("de", ""), (None, "abc"), ("fr", None)]
    writers.long_fields(spark.createDataFrame(rows, "lang string, text string").repartition(3), "lang", "text", f"{tmp_path}/long", 10)
    got = {r.lang: r.chars for r in readers.long_fields(spark, f"{tmp_path}/long", "lang").collect()}
    assert got == {"en": len(" ".join(t for k, t in rows[:1000])), "de": 1, None: 3, "fr": None}
    assert max(len(r.value) for r in spark.read.text(f"{tmp_path}/long").collect()) < 100


def test_walk(spark):
    df = spark.createDataFrame([("1", '{"a": {"doi": "10.1/x"}, "b": [1, {"c": "10.1234/y"}]}'), ("2", "bad")], "iid string, j string")
    got = sorted((r.path, r.value) for r in readers.key_walk(df, "j").where("path <> ''").collect())
    assert got == [("a.doi", "10.1/x"), ("b.0", "1"), ("b.1.c", "10.1234/y")]
    assert {r.path for r in readers.doi_like(readers.key_walk(df, "j")).collect()} == {"a.doi", "b.1.c"}
    grams = spark.createDataFrame([("1", '{"x": 2}'), ("2", '["y", "z"]'), ("3", '[{"term": "t", "count": 4}]')], "iid string, j string")
    assert sorted((r.iid, r.gram, r.n) for r in readers.ngram_levels(grams, "j").collect()) == [("1", "x", 2), ("2", "y", 1), ("2", "z", 1), ("3", "t", 4)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("W/1", 2, "b"), ("W/1", 1, "a"), ("V", 3, "c")], "work string, page int, section string")
    docs = {r.work: r for r in writers.documents(rows, "work", ["page"]).collect()}
    assert docs["W/1"].file == "W_1.json" and [x["page"] for x in json.loads(docs["W/1"].json)["rows"]] == [1, 2]
    writers.routed(rows.withColumn("disposition", F.when(F.col("page") > 2, "queue").otherwise("resolved")), f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r/disposition=queue").count() == 1
    writers.report(rows, f"{tmp_path}/c")
    assert spark.read.option("header", True).option("sep", "\t").csv(f"{tmp_path}/c").count() == 3
    assert json.loads(writers.nested(rows, "work", "page", value=F.col("section")).first().json)["W/1"] == {"1": "a", "2": "b"}
    assert writers.fill("{{n}} rows", {"n": 1200}) == "1,200 rows"
    with pytest.raises(ValueError):
        writers.fill("{{n}} {{m}}", {"n": 1})
    assert "page: 2" in writers.text_report(rows, "Rows")


def test_context_never_leaves(spark):
    rows = spark.createDataFrame([("a", "licensed")], "iid string, context string")
    assert published(rows).columns == ["iid"]
    check_published(published(rows))
    with pytest.raises(ValueError):
        writers.documents(rows, "iid", [])


def test_ingest_resumes(spark, tmp_path):
    source, sink, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    (tmp_path / "in").mkdir()
    put = lambda name, rows: (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, rows)))
    put("1.json", [GOOD[0], GOOD[0], GOOD[1]])
    ingest(spark, source, readers.DELIVERY, sink, mark)
    assert [(r.iid, r.match) for r in spark.read.parquet(sink).collect()] == [("a", "327a")]
    put("2.json", [GOOD[0], {"iid": "c", "full_text": ["Rom 8:28"], "references": []}])
    ingest(spark, source, readers.DELIVERY, sink, mark)
    assert sorted((r.iid, r.match) for r in spark.read.parquet(sink).collect()) == [("a", "327a"), ("c", "Rom 8:28")]


def test_summary_and_coverage(spark):
    groups = {"Phil": ["a", "b"], "Theo": ["c"]}
    assert [series.summary(x, groups) for x in (["a", "b", "c"], ["a", "c"], [])] == ["Phil + Theo", "Theo + 1 more", "no journals"]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "iid string")
    assert tuple(checks.coverage(ids("a", "b"), ids("b", "c", "d")).first()) == (2, 3, 1, 2)
