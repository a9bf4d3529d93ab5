"""The pipeline's stages, each against what its operator decides by hand, and the registered queries."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from citeloom.llm import quality
from citeloom.llm.common import stored
from citeloom.llm.queries import ORACLES, QUERIES
from harness import compare, duck

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns, name
        n = docs.count()
        assert 0 < n <= before, name
        before = n
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    ids = [r.doc_id for r in out.orderBy("start").collect()]
    assert ids == sorted(r.doc_id for r in docs.collect())
    assert [r.doc_id for r in corpus_pipeline.run(spark, SF).orderBy("start").collect()] == ids


def good(text):
    """The quality rules by hand."""
    w = (text or "").split()
    n = max(1, len(w))
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {p for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if x.strip()]
    m = {
        "n_words": len(w), "mean_word_chars": sum(map(len, w)) / n, "symbol_ratio": sum(c in quality.SYMBOLS for c in text or "") / n,
        "stop_ratio": sum(x.lower() in quality.STOP_WORDS for x in w) / n, "dup_line_ratio": (len(lines) - len(set(lines))) / max(1, len(lines)), "repeat_ratio": len(hit) / n,
    }
    return all((r.least is None or m[r.measure] >= r.least) and (r.most is None or m[r.measure] <= r.most) for r in quality.RULES)


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_pipeline_by_hand(spark, tmp_path):
    """Nulls, repeated rows and ids, ties, a very long text, copies, benchmark passages, clashing columns."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)] + ["the", "of"] * 300
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randint(60, 200)) for _ in range(40)]
    item = prose(40)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i], "en", "s0") for i in range(5)] + [(3, texts[3], "en", "s0")] * 2 + [(7, texts[8], "en", "s1"), (None, texts[9], "en", None), (None, prose(90), "en", None)]
    near = texts[20].split()
    rows += [(200 + k, " ".join([*near[: 9 + k], "changed", *near[10 + k :]]), "en", "s2") for k in range(4)]
    rows += [(300, f"{prose(60)} {item} {prose(60)}", "en", "s1"), (301, prose(60_000), "en", "s1"), (302, None, "en", "s1"), (303, "", None, "s1"), (304, prose(20), "en", "s1"), (305, "# " * 200 + prose(60), "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in ("n_words", "m", "kept", "node", "key", "label", "slot", "position", "in_mix", "block", "start"):
        docs = docs.withColumn(c, F.lit("clash"))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [r for r in rows if good(r[1])]
    sets = [shingles(r[1]) for r in kept]
    group = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if kept[a][1] == kept[b][1] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    first = {}
    for g, r in zip(group, kept, strict=True):
        first[g] = min(first.get(g, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    mine = shingles(item)
    left = [r for r in first.values() if len(mine & shingles(r[1])) < 0.8 * len(mine)]
    assert len(rows) > len(kept) > len(first) > len(left) > 30

    out = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, (kept, list(first.values()), left, left), strict=False):
        out = stored(stage(spark, out, str(tmp_path)), "test-hand")
        assert out.columns == docs.columns, name
        assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(r[:2] for r in want), name
    from citeloom.llm.queries import byte_encoder

    model, start, want = byte_encoder().model, 0, []
    for i, text, *_ in sorted(left, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        n = len(model.encode(text, add_special_tokens=False).ids) + 1
        want.append((i, start, n))
        start += n
    got = [(r.doc_id, r.start, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()]
    assert got == want


def test_mix_orders_the_shards(spark, tmp_path):
    """The documents stand in the shards in the order of the mix, whether its stage was written or not."""
    from citeloom.llm import mixing, sst
    from citeloom.llm.queries import byte_encoder

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = [r.doc_id for r in mixing.mix(docs).orderBy("position").collect()]
    assert want != sorted(want)
    for mixed in (stored(mixing.mixed(docs), "test-mix"), mixing.mixed(docs)):
        rows = corpus_pipeline.token_shards(spark, mixed, SF).orderBy("mix_start").collect()
        assert [r.doc_id for r in rows] == want and [r.position for r in rows] == list(range(len(want)))
        assert [r.mix_start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
        by_id = sorted(rows, key=lambda r: r.doc_id)
        assert [r.start for r in by_id] == [sum(x.n_tokens for x in by_id[:k]) for k in range(len(by_id))]
    manifest = sst.write_shards(docs, f"file://{tmp_path}/s", byte_encoder, 4, [-F.col("doc_id")])
    assert [r.doc_id for r in sst.read_shards(manifest).orderBy("position").collect()] == sorted(want, reverse=True)
    text = docs.where("doc_id = 7").first().text
    assert [x.tolist() for x in sst.lookup(manifest, 7)] == [byte_encoder().model.encode(text or "", add_special_tokens=False).ids + [2]]
    assert sst.lookup(manifest, 10**9) == []


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test-empty")
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, name):
    ok, text = compare(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF)
    assert ok, text
