"""Edge cases and brute-force comparisons of the training-data operators on small tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeloom.llm import boosting, chat, components, decontaminate, gru, jaccard, lm, mixing, pii, quality, repeats, shingles, sst, toxicity
from citeloom.llm.queries import byte_encoder

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Null, empty, tiny and long texts, exact and near copies, repeated rows, shared passages, null ids and sources."""
    rng = random.Random(4)
    passage, base = prose(rng, 60), [prose(rng, rng.randint(5, 160)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en", "s0") for i in range(6)]
    near = base[7].split()
    for k in range(8):
        changed = list(near)
        changed[k * len(changed) // 9] = f"x{k}"
        rows.append((200 + k, " ".join(changed), "en", "s1"))
    rows += [(300 + i, f"{prose(rng, 20)} {passage} {prose(rng, 30)}", "en", "s2") for i in range(5)]
    rows += [(400, None, "en", None), (401, "", "en", "s1"), (402, " \n ", None, "s1"), (403, "one", "en", "s1"), (404, "one", "en", "s1"), (405, prose(rng, 4000), "en", "s0")]
    rows += [(406, "same row twice " * 10, "en", "s0")] * 2 + [(None, "no id here at all, none", "en", "s0")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ("n_words", "m", "score", "kept", "block", "key", "node", "position", "slot", "label")


@pytest.fixture(scope="module")
def docs(spark, corpus):
    df = spark.createDataFrame(corpus, SCHEMA).repartition(3)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- shingles, components, boosting ----------------------------------------------------------------


def test_shingles_of_short_texts():
    flat, starts = shingles.flat_words([b"a b c d e f", b"", b"a b", b"a"])
    _, begins = shingles.flat_shingles(flat, starts)
    assert np.diff(begins).tolist() == [2, 0, 1, 1]
    h, _ = shingles.flat_shingles(*shingles.flat_words([b"a b", b"a b c"]))
    assert h[0] != h[1]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (4, 5), (5, 6), (20, 20)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 7), 1), 10: 10, 11: 10}


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] > 0.5)).astype(float)
    model = boosting.boost(x, y, rounds=30)
    assert ((model.raw(x) > 0) == y).mean() > 0.98
    f = boosting.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert f(np.array([1.0, 2.5, 4.0])).tolist() == [0.0, 0.5, 1.0]
    assert len(boosting.boost(x, np.zeros(2000)).trees) == 0


# -- 1 chat ----------------------------------------------------------------------------------------


def test_chat(spark):
    rows = [
        (1, 1, "assistant", "b\\e"), (1, 0, "user", "### User: \\t</turn>\n"), (2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, "assistant", "x"),
        (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "wiz: ard\\", "</turn>"), (None, 0, None, "t"), (5, 0, "user", "a"), (5, 0, "user", "a"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_chat(df).withColumn("back", chat.parse_chat(F.col("formatted"))).collect()}
    want: dict = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((turn, role or "", text or ""))
    for conv, turns in want.items():
        assert [(t.role, t.text) for t in out[conv].back] == [t[1:] for t in sorted(turns)]
        assert "".join(s.text for s in out[conv].segments) == out[conv].formatted
    assert {k: r.valid for k, r in out.items()} == {1: True, 2: True, 3: False, 4: False, None: False, 5: False}
    assert out[4].first_bad_turn == 2 and out[3].first_bad_turn == 0 and out[1].first_bad_turn is None
    digest = {r.conv_id: r for r in chat.chat_digest(df).collect()}
    assert digest[1].loss_sha256 == hashlib.sha256(b"b\\e").hexdigest() and digest[1].loss_chars == 3
    assert chat.chat_digest(df.limit(0)).count() == 0


def test_chat_with_clashing_columns_and_long_texts(spark):
    rng = random.Random(2)
    rows = [(1, 0, "user", prose(rng, 50_000)), (1, 1, "assistant", ": ### </turn>" * 1000), (2, 0, "user", "a"), (2, 0, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = df
    for c in ("formatted", "segments", "valid", "loss", "turns", "rows", "state", "n_turns"):
        clash = clash.withColumn(c, F.lit("clash"))
    assert sorted(map(tuple, chat.chat_digest(clash).collect())) == sorted(map(tuple, chat.chat_digest(df).collect()))
    out = {r.conv_id: r for r in chat.format_chat(clash).withColumn("back", chat.parse_chat(F.col("formatted"))).collect()}
    assert [t.text for t in out[1].back] == [rows[0][3], rows[1][3]] and out[1].valid


# -- 2 language model ------------------------------------------------------------------------------


def test_gru_gradients():
    v = gru.Vocabulary([f"h{i}".encode() for i in range(40)], np.arange(40, 0, -1.0), 5, np.full(gru.TAILS, 2.0))
    p = {k: x.astype(np.float64) for k, x in gru.initial(v, 4).items()}
    docs = [np.array([3, 41, 7, 0]), np.array([50, 2, 0])]
    codes, _, fresh = gru.lanes_of(docs, 2)

    def loss(p):
        live = codes >= 0
        states, _, kept = gru.forward(p, np.zeros((2, 4)), np.maximum(codes, 0), fresh, True)
        cls, word = v.split(codes[live])
        return states, kept, live, cls, word, -gru.outputs(p, states[live].astype(np.float64), cls, word, False).sum()

    gru.F32, old = np.float64, gru.F32
    try:
        states, kept, live, cls, word, base = loss(p)
        _, g, dh = gru.outputs(p, states[live], cls, word, True)
        dout = np.zeros_like(states)
        dout[live] = dh
        gru.backward(p, g, states, kept, np.maximum(codes, 0), fresh, dout)
        rng = np.random.default_rng(1)
        for k, x in p.items():
            i = tuple(int(rng.integers(n)) for n in x.shape) if k != "x" else (3, 5)
            keep = x[i]
            x[i] = keep + 1e-5
            up = loss(p)[-1]
            x[i] = keep - 1e-5
            down = loss(p)[-1]
            x[i] = keep
            assert g[k][i] == pytest.approx((up - down) / 2e-5, abs=1e-5), k
    finally:
        gru.F32 = old


def test_gru_is_a_distribution():
    v = gru.Vocabulary([f"h{i}".encode() for i in range(5)], np.arange(5, 0, -1.0), 3, np.full(gru.TAILS, 1.0))
    p = gru.initial(v)
    ones = [np.array([c], np.int32) for c in range(1 + 5 + gru.TAILS)]
    assert np.exp(gru.log_likelihood(p, v, ones)).sum() == pytest.approx(1, abs=1e-4)
    long = [np.array([1, 2, 3, 60 % 6] * 30 + [0]), np.array([0])]
    alone = np.concatenate([gru.log_likelihood(p, v, [d]) for d in long])
    assert gru.log_likelihood(p, v, long) == pytest.approx(alone, rel=1e-5)


def test_lm_scores(docs, corpus, empty):
    got = {(r.doc_id, r.n_tokens): r for r in lm.score_documents(docs).collect()}
    counts: Counter = Counter()
    for i, t, *_ in corpus:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update((t or "").lower().encode().split() + [b""])
    n, v = sum(counts.values()), len(counts)
    assert sum(1 for _ in corpus) == lm.score_documents(docs).count()
    for i, t, *_ in corpus:
        w = (t or "").lower().encode().split() + [b""]
        r = got[i, len(w)]
        assert r.base_score == pytest.approx(sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert r.n_known == sum(counts[x] > 0 for x in w) and r.train_tokens == n and r.score < 0
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 1)
    assert lm.score_documents(empty).count() == 0


def test_lm_trains_on_every_document(docs, corpus):
    blocks = lm.blocked(docs.coalesce(1))
    v, *_ = lm.vocabulary(blocks, lm.lexicon(blocks))
    assert blocks.count() == 1
    ordered = [((r.doc_id, r.text or "")) for r in docs.coalesce(1).collect()]
    texts = [t for i, t in ordered if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    coded = [np.array([*map(v.code, lm.tokens(t.encode())), 0], np.int32) for t in texts]
    want = gru.initial(v)
    gru.learn(want, v, coded, lm.RATE)
    got = lm.train(blocks, v)
    assert sum(map(len, coded)) < 1e5 and all(np.allclose(got[k], want[k], atol=1e-4) for k in want)


def test_lm_score_by_hand(docs, corpus, monkeypatch):
    """Many blocks and buckets: every score from the network's own arithmetic, a document at a time."""
    monkeypatch.setattr(lm.blocked, "__defaults__", (3000,))
    monkeypatch.setattr(lm, "BUCKET_WORDS", 100)
    blocks = lm.blocked(docs)
    sums = lm.lexicon(blocks)
    v, n, distinct = lm.vocabulary(blocks, sums)
    assert blocks.count() > 5 and sums.where("block is null").count() > 3
    counts: Counter = Counter()
    for i, t, *_ in corpus:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update((t or "").lower().encode().split() + [b""])
    assert (n, distinct, v.ends) == (sum(counts.values()), len(counts), counts[b""])
    assert [counts[w] for w in v.head] == sorted((c for w, c in counts.items() if w), reverse=True)[: gru.HEAD]
    p = lm.train(blocks, v)
    assert any(np.abs(p[k] - x).max() > 1e-3 for k, x in gru.initial(v).items())
    got = Counter((r.doc_id, r.n_tokens, round(r.score, 3)) for r in lm.score(blocks, sums, v, n, distinct, p).collect())
    want: Counter = Counter()
    for i, t, *_ in corpus:
        words = (t or "").lower().encode().split()
        codes = np.array([*map(v.code, words), 0], np.int32)
        inside = sum(np.log((counts[w] + 0.5) / v.tail_mass[gru.tail_class(w)]) for w in words if w not in v.ids)
        want[i, len(codes), round((gru.log_likelihood(p, v, [codes])[0] + inside) / np.log(10), 3)] += 1
    assert sum((got - want).values()) <= 2  # a sum in another order may round to the neighbour


def test_lm_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lm.score_documents(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert held[2] > 100 and held[0] > held[1]


def test_lm_edges(spark):
    """A text of 60,000 words, clashing columns, other types; nothing to learn from."""
    rng = random.Random(5)
    rows = [(1, prose(rng, 60_000), 1.5), (2, "A a \x85 É", 2.5), (2, "A a \x85 É", 2.5)]
    got = {r.n_tokens: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id int, text string, score double")).collect()}
    assert set(got) == {60_001, 5} and all(np.isfinite(r.score) for r in got.values())
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    only = lm.score_documents(spark.createDataFrame([(i, "never learned") for i in held], "doc_id long, text string")).collect()
    assert [(r.n_known, r.train_tokens, r.held_out) for r in only] == [(0, 0, True)] * len(held) and all(np.isfinite(r.score) for r in only)


def test_training_keeps_the_state_of_a_long_document(monkeypatch):
    v = gru.Vocabulary([b"a", b"b"], np.array([2.0, 1.0]), 1, np.full(gru.TAILS, 1.0))
    begun, forward = [], gru.forward
    monkeypatch.setattr(gru, "forward", lambda p, h, inputs, fresh, keep: begun.append(int(fresh.sum())) or forward(p, h, inputs, fresh, keep))
    gru.learn(gru.initial(v), v, [np.append(np.tile([1, 2], 1500), 0).astype(np.int32)])
    assert sum(begun) == 1


# -- 3 toxicity ------------------------------------------------------------------------------------


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        w = prose(rng, 40).split()
        if bad:
            w[10:10] = ["you", f"grub{rng.choice(WORDS)}", "grubling"]
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(bad)))
    df = spark.createDataFrame(rows, SCHEMA)
    lab = spark.createDataFrame(labels + [(7, None)], "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [(y, got[i].score) for i, y in labels if got[i].held_out]
    assert min(s for y, s in held if y) > max(s for y, s in held if not y)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert toxicity.score(docs, model).count() == docs.count()
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.train(df, lab.limit(0))
    assert len({r.score for r in toxicity.score(df, nothing).collect()}) == 1
    assert toxicity.normal("!!1d10t.") == ("idiot", True) and toxicity.normal("Clown,") == ("clown", False) and toxicity.normal("2024") == ("", False)


def test_toxicity_of_repeated_rows(spark):
    """An id with two texts and two labels is one training row; repeated rows get equal scores."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        rows.append((i, prose(rng, 30) + (" you scoundrel" if bad else ""), "en", "s"))
        labels += [(i, int(bad)), (i, 0)]
    twice = spark.createDataFrame(rows + rows + [(i, "zz", "en", "s") for i in range(0, 300, 50)], SCHEMA)
    once = spark.createDataFrame(rows, SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    a, b = toxicity.train(twice, lab), toxicity.train(once, lab)
    assert (a.lexicon.toxic, a.lexicon.other) == (b.lexicon.toxic, b.lexicon.other) and a.lexicon.toxic + a.lexicon.other == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(300))
    scores = Counter((r.doc_id, round(r.score, 9)) for r in toxicity.score(twice.where("text <> 'zz'"), a).collect())
    assert len(scores) == 300 and set(scores.values()) == {2}
    small = toxicity.train(once, lab, sample_rows=40)
    assert small.lexicon.toxic + small.lexicon.other == 40 and len(small.lexicon.entries) <= 40


def test_toxicity_on_held_out_rows(spark):
    """Trained on the tables' training rows, judged on their held-out ones; nothing is chosen by the result."""
    sf = "/root/testdata/sf0.1"
    docs, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = toxicity.score(docs, toxicity.train(docs, lab)).where("held_out").join(lab, "doc_id").select("predicted", "toxic").collect()
    hits = sum(r.predicted and r.toxic for r in held)
    assert hits >= 0.8 * sum(r.toxic for r in held) and hits >= 0.8 * sum(r.predicted for r in held)


# -- 4 quality -------------------------------------------------------------------------------------


def test_quality(docs, corpus, empty):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(docs).collect()), key=str)
    want = []
    for i, t, *_ in corpus:
        w = (t or "").split()
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {p for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if x.strip()]
        want.append((i, len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(hit)))
    assert got == sorted(want, key=str)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and quality.keep_good(empty).count() == 0


# -- 5 mixing --------------------------------------------------------------------------------------


def test_schedule_keeps_every_share():
    slots = mixing.quantized({"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05, "e": 0.00001}, 1000)
    order = mixing.schedule(slots)
    assert sum(slots.values()) == len(order) == 1000 and min(slots.values()) >= 1
    done: Counter = Counter()
    for t, (s, j) in enumerate(order, 1):
        assert j == done[s]
        done[s] += 1
        assert all(abs(done[x] - slots[x] * t / 1000) < 1 for x in slots)


def test_mix(spark, docs, empty):
    rows = [(i, "t", "en", "big" if i % 4 else "small") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, {"big": 0.5, "small": 0.5}, block_rows=4, period=10).collect()
    ordered = sorted((r for r in got if r.in_mix), key=lambda r: r.position)
    assert len({r.position for r in got}) == 400 and Counter(r.source for r in ordered)["small"] == 100
    seen: Counter = Counter()
    for n, r in enumerate(ordered, 1):
        seen[r.source] += 1
        assert abs(seen["big"] - n / 2) <= 4
    again = {r.doc_id: r.position for r in mixing.mix(df.repartition(7), {"big": 0.5, "small": 0.5}, block_rows=4, period=10).collect()}
    assert again == {r.doc_id: r.position for r in got}
    assert mixing.mix(docs.drop("slot", "position")).count() == docs.count()
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0
    assert [r.slot for r in mixing.mix(df, {"other": 1.0}).collect()] == [None] * 400


def test_small_source_does_not_end_the_mix(spark):
    rows = [(i, "t", "en", "big" if i % 3 else "other") for i in range(3000)] + [(9000, "t", "en", None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert Counter(r.doc_id for r in mixing.mixed(df, block_rows=4).collect()) == Counter(r[0] for r in rows)
    assert sorted(r.doc_id for r in mixing.mixed(df, {"big": 1.0, "other": 1.0}).collect()) == list(range(3000))
    ordered = [r.source for r in mixing.mix(df, {"": 1.0, "big": 6.0, "other": 3.0}, block_rows=4, period=10).orderBy("position").collect()]
    rest = [s for s in ordered if s is not None]
    seen: Counter = Counter()
    for n, s in enumerate(rest[:2900], 1):  # to near where both run out
        seen[s] += 1
        assert abs(seen["big"] - n * 2 / 3) <= 8


def test_small_weights_are_kept():
    weights = {"a": 0.6, "b": 0.39998, "c": 0.00002}
    slots = mixing.quantized(weights, mixing.long_enough(weights))
    assert slots["c"] / sum(slots.values()) == pytest.approx(0.00002, rel=0.01)
    assert mixing.long_enough({"a": 1e-9, "b": 1.0}) == mixing.MOST_SLOTS and mixing.long_enough({}) == mixing.PERIOD


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    df = spark.createDataFrame([(i, "t", "en", f"s{i % 6}") for i in range(60)], SCHEMA)
    with pytest.raises(ValueError):
        mixing.mix(df)
    with pytest.raises(ValueError):
        mixing.mix(df, {f"s{i}": 1.0 for i in range(4)})
    got = Counter(r.source for r in mixing.mix(df, {"s1": 1.0, "s5": 2.0}, block_rows=2).where("slot is not null").collect())
    assert got == {"s1": 10, "s5": 10}
    monkeypatch.setattr(mixing, "MOST_SOURCES", 100_000)
    slots = mixing.quantized({f"s{i}": 1.0 if i < 3 else 1e-9 for i in range(20_000)}, 20_100)
    assert sum(slots.values()) == 20_100 and min(slots.values()) == 1 and max(slots.values()) - min(slots["s0"], slots["s1"], slots["s2"]) <= 1


@pytest.mark.parametrize("rows_a_bucket", [500, 3])
def test_placement_by_hand(spark, rows_a_bucket, monkeypatch):
    """Null and repeated ids, equal rows, a null source: every source fills its slots in order, none twice."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", rows_a_bucket)
    rows = [(None, f"t{i % 7}", "en", "a") for i in range(40)] + [(5, "t", "en", "b")] * 21 + [(i, "t", "en", None) for i in range(9)] + [(i, "u", "en", "c") for i in range(33)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("extra", F.create_map(F.lit("k"), F.lit(1)))
    weights, block, period = {"a": 0.5, "b": 0.3, "": 0.2}, 4, 10
    got = mixing.mix(df, weights, block, period).collect()
    order = mixing.schedule(mixing.quantized(weights, period))
    want = Counter()
    for source in weights:
        n, slot = sum((r[3] or "") == source for r in rows), -1
        for rank in range(n):
            if rank % block == 0:
                slot = next(t for t in range(slot + 1, 10_000) if order[t % period][0] == source)
            want[source, slot, slot * block + rank % block] += 1
    assert Counter((r.source or "", r.slot, r.position) for r in got if r.source != "c") == want and max(want.values()) == 1
    assert all(r.slot is None and r.position is None and not r.in_mix for r in got if r.source == "c")
    assert len(mixing.mixed(df, weights, block).collect()) == 70


# -- 6 Jaccard join --------------------------------------------------------------------------------


def links_by_hand(rows):
    classes = {}
    for i, t, *_ in rows:
        classes.setdefault(t or "", []).append(i)
    sets = {}
    for t in classes:
        w = t.split()
        k = min(5, len(w))
        sets[t] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    texts = list(classes)
    linked = {t: {u for u in texts if u != t and sets[t] & sets[u] and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u])} for t in texts}
    group = {}
    for t in texts:
        if t not in group:
            todo, seen = [t], {t}
            while todo:
                for u in linked[todo.pop()] - seen:
                    seen.add(u)
                    todo.append(u)
            low = min((i for u in seen for i in classes[u] if i is not None), default=None)
            group.update(dict.fromkeys(seen, low))
    return classes, linked, group


@pytest.mark.parametrize("small", [4096, 2])
def test_join(docs, corpus, small, monkeypatch):
    """Small buckets at first, then buckets of two, so that deeper levels and block pairs do the work."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", 256 if small > 2 else 3)
    classes, linked, group = links_by_hand(corpus)
    got = sorted(((r.doc_id, r.class_id, r.n_copies, r.n_links, r.group_id) for r in jaccard.join(docs).collect()), key=str)
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    want = [(i, low(classes[t or ""]), len(classes[t or ""]), len(linked[t or ""]), group[t or ""]) for i, t, *_ in corpus]
    assert got == sorted(want, key=str)
    assert any(w[3] >= 5 for w in want)


def test_rows_of_small_buckets_are_not_joined(docs, monkeypatch):
    """Without a crowded bucket a row of a path is shuffled once: no step before the components joins it."""
    plans, stored = [], jaccard.stored

    def kept(df, label):
        if label in ("join-crowded", "join-buckets", "join-edges"):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, label)

    monkeypatch.setattr(jaccard, "stored", kept)
    jaccard.join(docs)
    assert plans and not any("Join" in p for p in plans)


def test_groups_over_batches():
    rows = [1, 2, 2, 3, 4, 4, 4, 4, 4, 5, 6, 6, 7]
    for step in (1, 2, 3, 5, 20):
        batches = [pa.record_batch([pa.array(rows[a : a + step], pa.int64())], names=["path"]) for a in range(0, len(rows), step)]
        for least in (1, 2):
            got = [(k, t.num_rows) for (k,), t in jaccard._groups(batches, 1, least)]
            assert got == [(k, rows.count(k)) for k in sorted(set(rows)) if rows.count(k) >= least]


def test_runs_cover_every_level():
    lost = 1 - (1 - np.exp(-1)) * np.prod([1 - np.exp(-c * 0.8) for c in jaccard.DEEP])
    assert lost ** jaccard.runs_for(0.9995, 0.8) <= 0.0005


def test_size_classes(spark):
    sizes = spark.range(1, 3000).select("id", jaccard._size_class(F.col("id"), 0.8).alias("k"), jaccard._size_class(F.col("id"), 0.5).alias("half")).collect()
    k, half = ({r.id: r[n] for r in sizes} for n in (1, 2))
    assert all(abs(k[int(a * 0.8 + 0.999999)] - k[a]) <= 1 and abs(half[-(-a // 2)] - half[a]) <= 1 for a in range(1, 3000))


def test_links_of_all_sizes_in_a_large_component(spark, monkeypatch):
    """A chain from 40 to 300 words: neighbours are linked, the ends are not; blocks of size classes."""
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    rng = random.Random(3)
    words = [f"c{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(n, " ".join(words[:n]), "en", "s") for n in range(40, 301, 4)]
    classes, linked, group = links_by_hand(rows)
    got = {r.doc_id: (r.n_links, r.group_id) for r in jaccard.join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (len(linked[t]), group[t]) for i, t, *_ in rows} and len(set(group.values())) == 1


def test_recall_in_a_hot_bucket(spark):
    """5,000 texts that share a long passage: more than SMALL in its buckets. Planted pairs are all found."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} " + " ".join(f"u{i}x{k}" for k in range(40)), "en", "s") for i in range(5000)]
    pairs = rng.sample(range(5000), 300)
    for n, i in enumerate(pairs):
        words = rows[i][1].split()
        words[rng.randrange(62, 99)] = "changed"
        rows.append((10_000 + n, " ".join(words), "en", "s"))
    got = {r.doc_id: (r.n_links, r.group_id) for r in jaccard.join(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert len(rows) - 300 > jaccard.SMALL
    assert sum(got[10_000 + n] == (1, i) and got[i] == (1, i) for n, i in enumerate(pairs)) == 300
    assert sum(v == (0, k) for k, v in got.items()) == 4700


def test_keep_one(spark, docs, corpus, empty):
    _, _, group = links_by_hand(corpus)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, set(group.values())))
    assert jaccard.keep_one(empty).count() == 0 and jaccard.join(empty).count() == 0


def test_keep_one_where_an_id_has_several_texts(spark):
    rng = random.Random(6)
    base, other = prose(rng, 80).split(), prose(rng, 80)
    near = [" ".join([*base[:k], f"y{k}", *base[k + 1 :]]) for k in (20, 50)]
    rows = [(1, near[0], "b"), (1, near[1], "b"), (2, " ".join(base), "b"), (1, other, "b"), (3, other, "c"), (3, other, "a"), (None, other, "d"), (None, "alone here", "z"), (None, "alone here", "q")]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    assert sorted((str(r.doc_id), r.source) for r in got) == [("1", "b"), ("1", "b"), ("None", "q")]
    assert {r.text for r in got} - set(near) == {other, "alone here"}


# -- 7 personal data -------------------------------------------------------------------------------


def test_feistel_is_a_permutation():
    p = pii.Feistel(b"k")
    for n in (1, 2, 7, 1000):
        out = [p("x", i, n) for i in range(n)]
        assert sorted(out) == list(range(n)) and [p("x", y, n, True) for y in out] == list(range(n))
    assert [p("x", i, 1000) for i in range(9)] != [pii.Feistel(b"q")("x", i, 1000) for i in range(9)]


def test_pseudonyms(spark, docs, empty):
    text = "card 4238958628599792 or 4238-9586-2859-9792, bad 4238958628599793; a.b34@mail7.example.com, +1 (017) 555-7713, 1987-02-29, 1987-02-28, 97.51.17.173, 300.1.1.1, GB82WEST12345698765432"
    rows = [(1, text), (2, "again 4238958628599792 here"), (3, None), (4, "")]
    got = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    out = got[1].text
    for gone in ("4238958628599792", "4238-9586", "a.b34@", "555-7713", "1987-02-28", "97.51.17.173", "12345698765432"):
        assert gone not in out
    for kept in ("4238958628599793", "1987-02-29", "300.1.1.1"):
        assert kept in out
    card = out.split()[1]
    assert card in got[2].text and pii.luhn_digit(card[:-1]) == card[-1] and out.split()[3].replace("-", "")[:16] == card
    assert (got[1].n_card, got[1].n_email, got[1].n_phone, got[1].n_date, got[1].n_ip, got[1].n_iban, got[1].n_replaced) == (2, 1, 1, 1, 1, 1, 7)
    assert got[3].text is None and got[4].text == ""
    assert pii.pseudonymize(docs, b"k").count() == docs.count() and pii.pseudonymize(empty, b"k").count() == 0


def test_other_scripts(spark):
    rows = [(1, "иван.петров@example.com"), (2, "mail 王小明@example.com now"), (3, "γιάννης_7@example.gr"), (4, "иван.петров@example.com"), (5, "a@b.co")]
    got = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    for i, text in rows:
        old = text.split("@")[0].split()[-1]
        assert got[i].n_email == got[i].n_replaced == 1 and old not in got[i].text and got[i].text.split("@")[1] == text.split("@")[1]
        assert pii.restored(got[i].text, b"k") == text
    assert got[1].text == got[4].text and "." in got[1].text


def test_no_value_stays_and_all_come_back(spark):
    """Every count is a replacement, and the key undoes each of them: an exact round trip over the tables."""
    p = pii.Feistel(b"k")
    for n in (2, 3, 26, 1000):
        out = [p.away("x", i, n) for i in range(n)]
        assert sorted(out) == list(range(n)) and all(a != i for i, a in enumerate(out)) and [p.home("x", a, n) for a in out] == list(range(n))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text for r in docs.collect()}
    changed = 0
    for r in pii.pseudonymize(docs, b"k").collect():
        assert (r.text != before[r.doc_id]) == (r.n_replaced > 0)
        assert r.text is None or pii.restored(r.text, b"k") == before[r.doc_id]
        changed += r.n_replaced
    assert changed > 50


# -- 8 decontamination -----------------------------------------------------------------------------


def test_decontamination(spark, docs, corpus, empty):
    passage = corpus[54][1].split()
    items = [(0, " ".join(passage[20:60])), (1, " ".join(passage[20:40] + ["changed"] + passage[41:60])), (2, "one"), (3, None), (4, ""), (5, "never seen anywhere at all today"), (6, "w1 w2 w3")]
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.find_contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for q, t in items:
        w = (t or "").split()
        k = min(5, len(w))
        mine = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        for i, text, *_ in corpus:
            x = (text or "").split()
            share = len(mine & {tuple(x[j : j + k]) for j in range(len(x) - k + 1)}) / len(mine) if mine else 0
            if share >= 0.8:
                want[i, q] = share
    assert got == want and any(q == 0 for _, q in want) and any(q == 2 for _, q in want)
    frame = spark.createDataFrame(items, "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, frame)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r[0] for r in corpus} - {i for i, _ in want}
    assert decontaminate.find_contaminated(empty, frame).count() == 0
    assert decontaminate.find_contaminated(docs, frame.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, frame.limit(0)).count() == docs.count()


# -- 9 shards --------------------------------------------------------------------------------------


def test_shards(spark, docs, corpus, empty, tmp_path):
    from tokenizers import Tokenizer
    import public_tokenizers

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    manifest = sst.write_shards(docs, f"file://{tmp_path}/s", byte_encoder, 4)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in sst.read_shards(manifest).collect()]
    rows = sorted(((i, t or "") for i, t, *_ in corpus), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, start, ids_of = [], 0, {}
    for i, t in rows:
        ids = model.encode(t, add_special_tokens=False).ids + [2]
        ids_of.setdefault(i, []).append(ids)
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    for i in (0, 405, 406, None):
        assert [x.tolist() for x in sst.lookup(manifest, i)] == ids_of[i]
    assert sst.lookup(manifest, 99_999) == [] and sst.lookup(manifest, 50) == []
    assert sst.read_shards(sst.write_shards(empty, f"file://{tmp_path}/e", byte_encoder)).count() == 0


def test_encoder_matches_the_library():
    coder = byte_encoder()
    rng = random.Random(1)
    parts = [" ", "\n", "a", "b'll", "'s", ".", " ", "é", "1", "\t", "  ", "漢", "!", "word,", "\x85", "\x1c", "Ünï"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        want = coder.model.encode(text, add_special_tokens=False).ids + [2]
        assert np.frombuffer(coder.encode(text), coder.kind).tolist() == want, repr(text)


# -- 10 repeats ------------------------------------------------------------------------------------


def test_difference_cover():
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))
    values = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64))
    assert (repeats.unpack(repeats.pack(values)) == values).all()


@pytest.mark.parametrize("block", [1 << 22, 900])
def test_repeats(docs, corpus, empty, block, monkeypatch):
    monkeypatch.setattr(repeats.blocked, "__defaults__", (block,))
    got = Counter(tuple(r) for r in repeats.digest(repeats.find_repeats(docs)).collect())
    order = sorted(corpus, key=lambda r: r[0] if r[0] is not None else 1 << 62)
    first: dict[bytes, float] = {}
    for i, t, *_ in order:
        data = (t or "").encode()
        for k in range(len(data) - 49):
            first.setdefault(data[k : k + 50], i if i is not None else 1 << 62)
    want: Counter = Counter()
    for i, t, *_ in corpus:
        data, mine = (t or "").encode(), i if i is not None else 1 << 62
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < mine:
                gone[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        want[i, len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    assert got == want and sum(k[2] for k in want) > 0
    assert repeats.find_repeats(empty).count() == 0


@pytest.mark.parametrize("block", [1 << 22, 300])
def test_copies_are_rows_not_ids(spark, block, monkeypatch):
    monkeypatch.setattr(repeats.blocked, "__defaults__", (block,))
    rng = random.Random(8)
    old, other, third, fourth = (prose(rng, 30) for _ in range(4))
    rows = [(1, old), (5, old), (5, other), (8, "x " + other), (None, old), (None, third), (None, fourth), (9, third)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, bytes(r.kept).decode()) for r in repeats.find_repeats(df).collect())
    assert got == Counter([(1, old), (5, ""), (5, other), (8, "x "), (None, ""), (None, ""), (None, fourth), (9, third)])


def kept_by_hand(rows):
    """Brute force: (doc_id, kept text) of rows (doc_id, text)."""
    rank = lambda i: 1 << 62 if i is None else i
    first: dict[bytes, int] = {}
    for i, t in sorted(rows, key=lambda r: rank(r[0])):
        data = (t or "").encode()
        for k in range(len(data) - 49):
            first.setdefault(data[k : k + 50], rank(i))
    out: Counter = Counter()
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < rank(i):
                gone[k : k + 50] = True
        out[i, np.frombuffer(data, np.uint8)[~gone].tobytes()] += 1
    return out


@pytest.mark.parametrize("block", [1 << 22, 700])
def test_ids_that_fill_many_blocks(spark, block, monkeypatch):
    """A third of the rows has no id, a third one id; passages go through all of them; one text is long."""
    monkeypatch.setattr(repeats.blocked, "__defaults__", (block,))
    monkeypatch.setattr(repeats, "BUCKET_NAMES", 500)
    rng = random.Random(12)
    passages = [prose(rng, 20) for _ in range(6)]
    text = lambda: f"{prose(rng, 12)} {rng.choice(passages)} {prose(rng, rng.randint(0, 12))}"
    rows = [(i, text()) for i in range(0, 60, 2)] + [(31, text()) for _ in range(30)] + [(None, text()) for _ in range(30)]
    rows += [(31, rows[0][1]), (None, rows[40][1]), (33, prose(rng, 3000) + passages[2]), (90, "é" * 60), (91, "x" + "é" * 60), (92, "")]
    got = Counter((r.doc_id, bytes(r.kept)) for r in repeats.find_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == kept_by_hand(rows)


def test_names_of_different_strings_are_noticed(spark, monkeypatch):
    """Names with four bits: bytes are compared, so nothing is removed for a name's sake."""
    rng = random.Random(13)
    shared = prose(rng, 40)
    rows = [(i, f"{prose(rng, 30)} {shared} {prose(rng, 30)}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    digests = [sorted(map(tuple, repeats.digest(repeats.find_repeats(df, salt)).collect())) for salt in (0, 5)]
    assert digests[0] == digests[1] and sum(r[2] > 0 for r in digests[0]) == 5
    block = repeats.blocked(df).toArrow()
    left = np.concatenate([np.arange(len(t.encode()), 0, -1) for _, t in rows])
    side = lambda *rows: pa.Table.from_batches([repeats._side(list(rows))])
    suspects = (0, repeats.SUSPECT, 0, repeats.pack_bits(left >= 50))
    own = repeats.Prefixes(repeats.Texts(block, side()), np.flatnonzero(left >= 50), 0, 0)
    older = (0, repeats.OLDER, 0, repeats.pack_bits(np.arange(len(own.names)) == 3))
    text = bytes(own_data := repeats.Texts(block, side()).data)[own.lowest[3] : own.lowest[3] + 50]
    shown = lambda text: (0, repeats.SHOWN, 7, (8).to_bytes(4, "little") + (50).to_bytes(8, "little") + np.array([50], np.int64).tobytes() + pa.compress(text, codec="zstd", asbytes=True))
    cut = repeats._cut(0, 0)
    assert own_data is not None and cut(block, side(suspects, older, shown(text))).num_rows == 6
    for bad in (side(suspects, older, shown(text[:-1] + b"\0")), side(suspects, older)):
        with pytest.raises(ValueError, match="different strings have one name"):
            cut(block, bad)
    named = repeats.named
    monkeypatch.setattr(repeats, "named", lambda *a: (named(*a)[0] & np.uint64(15), named(*a)[1]))
    with pytest.raises(ValueError, match="different strings have one name"):
        cut(block, side(suspects, older, shown(text)))
