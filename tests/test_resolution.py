"""Extraction, exclusion, resolution, fan-out and faceting on hand-written articles."""

import pytest
from pyspark.sql import functions as F

from citeloom.operators import exclude, extract, facet, resolve

PAGES = [
    ("see 620a-622c and 1097b8", [("ambiguous", "620a-622c"), ("bekker", "1097b8")]),
    ("553a-e here", [("ambiguous", "553a-e")]),
    ("at 80d5 and 80D5-E5", [("stephanus", "80d5"), ("stephanus", "80D5-E5")]),
    ("BRUNSCHWIG (1996a), 123-25", [("bekker", "1996a")]),
    ("327a-based", [("ambiguous", "327a")]),
    ("514a — 517c", [("ambiguous", "514a"), ("stephanus", "517c")]),
    ("Il. XXIV.804 and Od. ix.412 and Il 1, 5", [("homer", "Il. XXIV.804"), ("homer", "Od. ix.412"), ("homer", "Il 1, 5")]),
    ("Pyth. 4.162-5, but Pind. 4.162", [("pindar", "Pyth. 4.162-5")]),
    ("II Cor 3:4 and Rom. 8:28-30", [("nt", "II Cor 3:4"), ("nt", "Rom. 8:28-30")]),
    ("Il. 1.1", [("homer", "Il. 1.1")]),
    ("é327a", []),
    ("nothing", []),
]


def test_long_pages_in_pieces(spark):
    """Pieces of a page, cut anywhere, give what the whole page gives; no segment grows with the page."""
    import random

    rng = random.Random(5)
    bits = ["327a ", "620a-622c", "1094b12 ", "Iliad 3.", "12-15 ", "Iliad", " XX", " ", "word ", "so ", "2 Cor", " 3:16, ", "Ol. ", "1.5", "II ", "é ", "𝒳 ", "\n", "food ", "\x01", "980a15"]
    pages, pieces = [], []
    for i in range(40):
        text = "".join(rng.choice(bits) for _ in range(600))
        if i % 4 == 0:
            text = text[:300] + "327a," * 300 + text[300:]  # no safe cut for many blocks
        pages.append((f"a{i % 7}", i // 7, text))
        at = k = 0
        while at < len(text):
            n = rng.choice([1, 7, 60, 900])
            pieces.append((f"a{i % 7}", i // 7, k, text[at : at + n]))
            at, k = at + n, k + 1
    rng.shuffle(pieces)
    whole = [(k, [t for a, _, t in sorted(pages) if a == k]) for k in sorted({p[0] for p in pages})]
    names = ["iid", "page_index", "char_offset", "seq", "corpus", "match", "context"]
    want = extract.extract(spark.createDataFrame(whole, "iid string, full_text array<string>")).select(*names).collect()
    got = extract.extract_pieces(spark.createDataFrame(pieces, "iid string, page_index int, piece int, text string"), 200).select(*names).collect()
    assert len(want) > 2000 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_extraction(spark):
    rows = [(f"a{i:02d}", [None, text]) for i, (text, _) in enumerate(PAGES)]
    got = extract.extract(spark.createDataFrame(rows, "iid string, full_text array<string>")).orderBy("iid", "seq").collect()
    for i, (text, want) in enumerate(PAGES):
        mine = [r for r in got if r.iid == f"a{i:02d}"]
        assert [(r.corpus, r.match) for r in mine] == want, text
        assert all(text[r.char_offset : r.char_offset + len(r.match)] == r.match and r.page_index == 1 for r in mine)
        assert [r.seq for r in mine] == list(range(len(mine)))


EXCLUDED = [
    ("12.25e", "25e", "Polyb. 12.25e", "stephanus", "", "book_section_ref"),
    ("", "80b", "see 80b DK here", "ambiguous", "", "dk_fragment"),
    ("", "1462a", "1462a", "bekker", "", None),
    ("", "1463a", "1463a", "bekker", "", "modern_year"),
    ("", "327a", "Soph. Aj. 327a", "ambiguous", "", "foreign_text"),
    ("", "327a", "in 327a", "ambiguous", "misc", "excluded_doctype"),
    ("", "327a", "in 327a", "ambiguous", "?", "excluded_doctype"),
    ("", "327a", "in 327a", "ambiguous", "", None),
    ("", "327a", "in 327a", "ambiguous", "discussion", None),
    ("", "Il. 1.1", "misc Il. 1.1", "homer", "misc", "excluded_doctype"),
    ("", "Il. 1.1", "in 12.Il. 1.1 DK", "homer", "", None),
]


def test_exclusion(spark):
    df = spark.createDataFrame([(i, m, c, k, d) for i, (_, m, c, k, d, _) in enumerate(EXCLUDED)], "i int, m string, c string, k string, d string")
    got = df.select("i", exclude.reason(*(F.col(x) for x in "mckd")).alias("r"), exclude.numeric_density(F.col("c")).alias("n")).orderBy("i").collect()
    assert [r.r for r in got] == [x[5] for x in EXCLUDED]
    assert got[0].n == 0 and got[3].n == 1.0


@pytest.fixture(scope="module")
def tables(spark):
    pos = "struct<page:int,col:string,line:int>"
    spans = spark.createDataFrame(
        [
            ("Alpha", "stephanus", 300, 320, None, None),
            ("Beta", "stephanus", 310, 340, None, None),
            ("Gamma", "bekker", 315, 325, None, None),
            ("Solo", "bekker", 1000, 1010, None, None),
            ("Left", "bekker", 440, 449, (440, "a", 0), (449, "b", 3)),
            ("Right", "bekker", 449, 460, (449, "b", 3), (460, "b", 99)),
        ],
        f"work string, system string, start int, end int, lo {pos}, hi {pos}",
    )
    forms = spark.createDataFrame(
        [("alpha", "Alpha", False), ("beta", "Beta", False), ("gamma", "Gamma", False), ("solo", "Solo", False), ("the right", "Right", False), ("be", "Beta", True)], "form string, work string, ambiguous boolean"
    )
    cues = spark.createDataFrame([("homer", "il", "Iliad"), ("nt", "rom", "Romans")], "corpus string, cue string, work string")
    lengths = spark.createDataFrame([("Iliad", [100] * 24), ("Romans", [30, 29])], "work string, lengths array<int>")
    return resolve.Tables(spans, forms, cues, lengths)


# (article, page, offset, corpus, match, context, title) -> (work, confidence, method, accepted)
ROWS = [
    ("u", 0, 1, "bekker", "1001a5", "in Solo", "", ("Solo", 0.97, "range_unique+name", True)),
    ("u", 0, 2, "bekker", "1001a5", "as Alpha says", "", ("Solo", 0.90, "range_unique_name_mentioned", True)),
    ("u", 0, 3, "bekker", "1001a5", "plain", "", ("Solo", 0.93, "range_unique", True)),
    ("n", 0, 1, "stephanus", "312c", "Beta.", "", ("Beta", 0.90, "range+name", True)),
    ("n", 0, 2, "stephanus", "312c", "Alpha and Beta", "", ("Alpha", 0.5, "name_multi_candidate", False)),
    ("n", 0, 3, "stephanus", "312c", "Solo", "", ("Alpha", 0.45, "name_range_conflict", False)),
    ("n", 0, 4, "stephanus", "312c", "plain", "", ("Beta", 0.88, "scope_inherited", True)),
    ("n", 0, 2101, "stephanus", "312c", "plain", "", ("Beta", 0.828, "scope_inherited", False)),
    ("n", 0, 2102, "stephanus", "305c", "then", "", ("Alpha", 0.93, "range_unique", True)),
    ("n", 0, 2103, "stephanus", "335c", "then Gamma", "", ("Beta", 0.90, "range_unique_name_mentioned", True)),
    ("n", 1, 5, "stephanus", "312c", "plain", "", ("Alpha", 0.3, "unresolved", False)),
    ("x", 0, 1, "ambiguous", "316a", "Gamma", "", ("Gamma", 0.90, "cross_system_resolved_by_name", True)),
    ("y", 0, 1, "ambiguous", "316a", "plain", "", ("Alpha", 0.3, "cross_system_unresolved", False)),
    ("b", 0, 1, "bekker", "449b3", "The Right", "", ("Right", 0.90, "boundary_resolved_by_name", True)),
    ("p", 0, 1, "bekker", "449b20", "plain", "", ("Right", 0.93, "range_unique", True)),
    ("t", 0, 1, "stephanus", "312c", "plain", "On Beta", ("Beta", 0.85, "title_prior", True)),
    ("t", 0, 50, "stephanus", "312c", "plain", "On Beta", ("Beta", 0.879, "scope_inherited", True)),
    ("t2", 0, 1, "stephanus", "312c", "plain", "On Be", ("Alpha", 0.3, "unresolved", False)),
    ("m", 0, 1, "stephanus", "305c", "plain", "", ("Alpha", 0.93, "range_unique", True)),
    ("m", 0, 9, "stephanus", "900c", "plain", "", ("Alpha", 0.4, "scope_range_mismatch", False)),
    ("c", 0, 1, "homer", "Il. 1.5-7", "", "", ("Iliad", 0.95, "cue_work", True)),
    ("c", 0, 2, "nt", "Gal 1:5", "", "", (None, 0.0, "cue_unresolved", False)),
    ("c", 0, 3, "nt", "Rom 1:5-2", "", "", ("Romans", 0.95, "cue_work", True)),
    ("q", 0, 1, "bekker", "a1001", "", "", (None, 0.0, "no_page", False)),
]


@pytest.fixture(scope="module")
def resolved(spark, tables):
    seq: dict[str, int] = {}
    rows = []
    for iid, page, offset, corpus, match, context, title, _ in ROWS:
        seq[iid] = seq.get(iid, -1) + 1
        rows.append((iid, seq[iid], page, offset, corpus, match, context, title))
    df = spark.createDataFrame(rows, "iid string, seq int, page_index int, char_offset int, corpus string, match string, context string, title string")
    return resolve.resolve(df, tables).cache()


def test_methods(resolved):
    got = {(r.iid, r.page_index, r.char_offset): (r.work, round(r.confidence, 3), r.method, r.accepted) for r in resolved.collect()}
    for iid, page, offset, *_, want in ROWS:
        assert got[iid, page, offset] == (want[0], pytest.approx(want[1], abs=0.0011), want[2], want[3]), (iid, page, offset)


def test_fan_out(resolved, tables):
    out = resolve.fan_out(resolved, tables).collect()
    cued = sorted((r.match, r.book, r.span_src, r.disposition, r.reason) for r in out if r.iid == "c")
    assert ("Il. 1.6", "1", "Il. 1.5-7", "resolved", None) in cued
    assert ("Rom 1:5-2", "", "", "queue", "span_diverted") in cued
    assert sum(r.disposition == "resolved" for r in out if r.iid == "c") == 3
    assert resolve.promotable(resolved).count() == 0


def test_facets(spark):
    openings = spark.createDataFrame(
        [("N", "I", 1094, "a", 1), ("N", "II", 1103, "a", 15), ("E", "IV*", 1129, "a", 1), ("E", "VI*", 1145, "a", 15), ("E", "I", 1214, "a", 1), ("E", "II", 1218, "b", 30)],
        "work string, label string, page int, section string, line int",
    )
    ends = spark.createDataFrame([("N", 1181, "b", 9999), ("E", 1249, "b", 9999)], "work string, page int, section string, line int")
    caps = spark.createDataFrame([("E", "VI*", 1155, "a", 3)], "work string, label string, page int, section string, line int")
    cases = [
        ("N", "1103a14", "I"), ("N", "1103a15", "II"), ("N", "1094a", "I"), ("N", "1300a1", "II"), ("N", "900a1", None),
        ("E", "1155a2", "VI*"), ("E", "1155a3", None), ("E", "1180a", "VI*"), ("E", "1218a", "I"), ("Z", "1a1", None),
    ]
    rows = spark.createDataFrame([(i, w, m) for i, (w, m, _) in enumerate(cases)], "i int, work string, match string")
    got = facet.facet(rows, facet.intervals(openings, ends, caps)).orderBy("i").collect()
    assert [r.book or None for r in got] == [c[2] for c in cases]
