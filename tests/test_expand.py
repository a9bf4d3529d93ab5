"""Range expansion and locus parsing, by table."""

import pytest
from pyspark.sql import functions as F

from citeloom.functions import expand as X
from citeloom.functions import text as T

CASES = [
    ("stephanus", "327a", ["327a"]),
    ("stephanus", "553a-e", ["553a", "553b", "553c", "553d", "553e"]),
    ("stephanus", "553d-554b", ["553d", "553e", "554a", "554b"]),
    ("stephanus", "80D5-E5", ["80d", "80e"]),
    ("stephanus", "620a-622c", 13),
    ("stephanus", "622c-620a", None),
    ("stephanus", "100a-110a", None),
    ("bekker", "1097b8", ["1097b8"]),
    ("bekker", "1097b", ["1097b"]),
    ("bekker", "1097b8-b20", ["1097b", "1097b15"]),
    ("bekker", "1097b8-1098a20", ["1097b", "1097b15", "1097b30", "1098a", "1098a15"]),
    ("bekker", "1097b20-1097b8", None),
    ("bekker", "1097a-1103a", None),
    ("homer", "Il. 16.7-11", ["Il. 16.7", "Il. 16.8", "Il. 16.9", "Il. 16.10", "Il. 16.11"]),
    ("homer", "Odyssey ix.412", ["Od. 9.412"]),
    ("homer", "Il. XXIV, 484-93", 10),
    ("homer", "Il. 1.1-31", None),
    ("homer", "Il. 0.5", None),
    ("homer", "Il. 25.1", None),
    ("homer", "Il. 3.0", None),
    ("homer", "Il. 2.21", None),
    ("pindar", "Olympian 1.3-5", ["Ol. 1.3", "Ol. 1.4", "Ol. 1.5"]),
    ("pindar", "Pyth. 15.1", None),
    ("pindar", "Nem. 4.1-22", None),
    ("nt", "Rom 7:2", ["Rom 7:2"]),
    ("nt", "Rom 7:2-4", ["Rom 7:2", "Rom 7:3", "Rom 7:4"]),
    ("nt", "Rom 2:3-3:2", ["Rom 2:3", "Rom 2:4", "Rom 2:5", "Rom 3:1", "Rom 3:2"]),
    ("nt", "Rom 9:1", None),
    ("nt", "Rom 2:6", None),
    ("other", "12-14", ["12-14"]),
]
LENGTHS = {"homer": [40, 20] + [None] * 0, "nt": [4, 5, 6, 7, 8, 9, 25]}


@pytest.fixture(scope="module")
def expanded(spark):
    homer = [100] * 24
    homer[1] = 20
    homer[8], homer[23], homer[15] = 500, 600, 900
    rows = [(i, s, c, homer if s == "homer" else LENGTHS.get(s)) for i, (s, c, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, system string, cell string, lengths array<int>")
    return {r.i: r.units for r in df.select("i", X.expand(F.col("cell"), F.col("system"), F.col("lengths")).alias("units")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{s} {c}" for s, c, _ in CASES])
def test_units(expanded, i):
    want = CASES[i][2]
    assert (len(expanded[i]) if isinstance(want, int) else expanded[i]) == want


def test_scalars(spark):
    df = spark.createDataFrame([("80D5", "homer", "Iliad XVIII.478"), ("1094a", "nt", "II Cor 3:4"), ("453b11", "pindar", "Isthmian 2.3"), (None, "x", "q")], "c string, k string, m string")
    got = df.select(T.locus(F.col("c")).alias("l"), T.column_line(F.col("c")).alias("b"), T.cue_key(F.col("m"), F.col("k")).alias("q")).collect()
    assert [tuple(r.l) for r in got] == [(80, "d", 5), (1094, "a", None), (453, "b", 11), (None, None, None)]
    assert [tuple(r.b) for r in got] == [(None, 0), ("a", 0), ("b", 11), (None, 0)]
    assert [r.q for r in got] == ["il", "2 cor", "isth", None]
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert [value(T.roman(F.lit(x))) for x in ("XXIV", "ix", "MCMXC", "abc")] == [24, 9, 1990, None]
    assert value(T.line_end(F.lit(111), F.lit("12"))) == 112 and value(T.line_end(F.lit(7), F.lit("11"))) == 11
    assert value(T.normal(F.lit(" Ménon.. "))) == "menon"
    assert value(T.flatten(F.lit("a  b\n c "))) == "a b c"
    assert value(T.year_token(F.lit("c-1998-05"))) == "1998" and value(T.year_token(F.lit("n.d."))) == "n.d." and value(T.year_token(F.lit(""))) == "?"
    assert [value(T.tick_step(F.lit(x))) for x in (10.0, 15.0, 37.0, 400.0, 0.4)] == pytest.approx([2, 2, 5, 50, 0.05]) and value(T.tick_step(F.lit(0.0))) is None
    assert value(T.nice_ticks(F.lit(23.0))) == [0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 22, 24] and value(T.nice_ticks(F.lit(10.0))) == [0, 2, 4, 6, 8, 10]
    assert [value(T.cue_of(F.lit(x))) for x in ("1 Cor 3:4", "Od. IV 1", " Il 1.2", "327a")] == ["1 Cor", "Od", "Il", None]
    assert [value(T.separator(F.lit(x))) for x in ("Od. IV 1", "Il. 1.2", "Il 1, 5", "Rom 3:4")] == ["space", "dot", "comma", None]
    assert value(T.candidate_names(F.lit("named ['x'] not in candidates  ['A b', \"O'C\"] 'y'"))) == ["A b", "O'C"]
