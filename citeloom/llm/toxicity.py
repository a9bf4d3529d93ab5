"""Toxicity: boosted trees over dense text features, with isotonic calibration.

Features: densities of a lexicon of words and word beginnings, how near a second person such a word
stands, capitals, punctuation, obfuscation. The lexicon is learned from the labelled training rows
alone. Lexicon and trees are fitted on at most ``SAMPLE_ROWS``
labelled documents, picked by a hash of the id, with at most as many lexicon entries; a training row's
own label is left out of the lexicon that its features use. Every text is then scored whole, without
shuffle.

Defined results: null and empty texts have zero features and get the score those have; rows with a
null toxic label, or in the held-out fold, are never learned from; an id with several labels is toxic
if one of them says so, and of several texts with one id the first in order is learned from; without
training rows every score is the same; repeated rows are scored one by one; an empty table gives no
rows; labels, language, source and id are never features; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.boosting import Boosted, Isotonic, boost, isotonic, sigmoid
from citeloom.llm.common import dropped, stored, text_of

SAMPLE_ROWS = 20_000
#: Lengths of the word beginnings that the lexicon may hold beside whole words.
STEMS = (4, 5, 6, 7, 8)  # the best of five choices by cross-validation within the training rows
#: Least log odds and toxic documents of a lexicon entry, picked the same way: the lowest log loss and the
#: highest accuracy of ten pairs.
LEAST, SUPPORT = 2.0, 4
CHUNK = 1 << 20

#: Second-person words of four languages.
SECOND = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
STRIP = re.compile(r"^[\W_]+|[\W_]+$")
INNER = re.compile(r"[\W_]+")

LEX, STEM, PERSON, CAPS, OBF, ALPHA = (1 << i for i in range(6))
FEATURES = (
    "log_tokens", "lexicon_density", "lexicon_hits", "lexicon_most", "stem_density", "stem_hits", "stem_most",
    "person_density", "near_person", "capitals", "marks", "obfuscated", "lexicon_or_stem_most",
)


def normal(token: str) -> tuple[str, bool]:
    """The word in a token, lower case, look-alikes undone, and whether it was obfuscated."""
    bare = STRIP.sub("", token)
    if bare.isalpha():
        return bare.lower(), False
    if not any(c.isalpha() for c in token):
        return "", False
    word = INNER.sub("", STRIP.sub("", token).translate(LEET)).lower()
    return word, word.isalpha() and sum(c.isalpha() for c in bare) * 3 >= len(bare)


def keys_of(word: str) -> list[str]:
    """The lexicon entries a word may match: itself and its beginnings."""
    return ["=" + word, *(f"{n}{word[:n]}" for n in STEMS if len(word) > n)]


@dataclass
class Lexicon:
    """Documents with an entry, toxic and not; an entry counts if its log odds are high enough."""

    toxic: int
    other: int
    entries: dict[str, tuple[int, int]]
    least: float = LEAST
    support: int = SUPPORT

    def weight(self, key: str, without: int | None) -> float:
        """Log odds, without a training row of label ``without``; 0 if the entry doesn't count."""
        if key not in self.entries:
            return 0.0
        a, b = self.entries[key]
        if without is not None:
            a, b = (a - 1, b) if without else (a, max(0, b - 1))
        if a < self.support:
            return 0.0
        odds = float(np.log((a + 0.5) / (self.toxic + 1)) - np.log((b + 0.5) / (self.other + 1)))
        return odds if odds >= self.least else 0.0


class Coder(dict):
    """Token to a packed code: flags and two weights in tenths; forgets everything at a fixed size."""

    most = 200_000

    def __init__(self, lexicon: Lexicon, without: int | None):
        super().__init__()
        self.lexicon, self.without = lexicon, without

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        word, obfuscated = normal(token)
        code = PERSON * (word in SECOND) | OBF * obfuscated
        code |= ALPHA * bool(word) | CAPS * (len(word) > 1 and token.upper() == token)
        if len(word) > 2:
            whole, *stems = (self.lexicon.weight(k, self.without) for k in keys_of(word))
            stem = max(stems, default=0.0)
            code |= LEX * (whole > 0) | STEM * (stem > 0) | min(255, round(whole * 10)) << 8 | min(255, round(stem * 10)) << 16
        self[token] = code
        return code


def features(texts: list[str | None], coder: Coder) -> np.ndarray:
    """A row of FEATURES for each text."""
    parts = [(t or "").split() for t in texts]
    n = np.array([len(p) for p in parts], np.int64)
    starts = np.concatenate([[0], np.cumsum(n)])
    code = np.fromiter((coder[w] for p in parts for w in p), np.int64, int(starts[-1]))
    doc = np.repeat(np.arange(len(parts)), n)
    total = lambda v: np.bincount(doc, v, len(parts)).astype(float)
    flag = lambda b: (code & b > 0).astype(float)

    def most(v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(parts))
        np.maximum.at(out, doc, v)
        return out

    lex, stem = (code >> 8 & 255) / 10.0, (code >> 16 & 255) / 10.0
    person = np.concatenate([[0], np.cumsum(code & PERSON > 0)])
    at = np.arange(len(code))
    around = person[np.minimum(at + 6, starts[1:][doc])] - person[np.maximum(at - 5, starts[:-1][doc])] if len(code) else np.zeros(0)
    hit = code & (LEX | STEM) > 0
    marks = np.array([(t or "").count("!") + (t or "").count("?") for t in texts], float)
    per = 100 / np.maximum(n, 1)
    rows = [
        np.log1p(n), total(flag(LEX)) * per, total(flag(LEX)), most(lex), total(flag(STEM)) * per, total(flag(STEM)), most(stem),
        total(flag(PERSON)) * per, total((hit & (around > 0)).astype(float)) * per, total(flag(CAPS)) / np.maximum(1, total(flag(ALPHA))),
        marks * per, total(flag(OBF)) * per, np.maximum(most(lex), most(stem)),
    ]
    return np.stack(rows, 1)


def text_chunks(texts: list[str | None]):
    run, size, start = [], 0, 0
    for i, t in enumerate(texts):
        run.append(t)
        size += len(t or "")
        if size >= CHUNK:
            yield start, run
            run, size, start = [], 0, i + 1
    if run:
        yield start, run


def fold(doc_id: Column, of: int) -> Column:
    return F.crc32(doc_id.cast("string")) % of


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted
    calibration: Isotonic

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a ten-thousandth of the raw score keeps the order within a step."""
        raw = self.trees.raw(x)
        return np.clip(0.9999 * self.calibration(raw) + 0.0001 * sigmoid(raw), 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
    usable = usable.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("__tox"))
    sample = usable.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", text_of(docs).alias("__text"))
    found = texts.join(F.broadcast(sample), "doc_id")  # at most SAMPLE_ROWS ids
    once = found.groupBy("doc_id").agg(F.min("__text").alias("__text"), F.first("__tox").alias("__tox"))
    rows = stored(once.select("__text", "__tox"), "toxicity-sample")  # at most SAMPLE_ROWS rows

    def count(batches):
        for batch in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            size = {0: 0, 1: 0}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size[y] += 1
                words = {normal(t)[0] for t in text.split()}
                seen[y].update({k for w in words if len(w) > 2 for k in keys_of(w)})
            keys = list(seen[1])  # what no toxic row has never counts
            yield pa.record_batch(
                [pa.array(["", *keys]), pa.array([size[1], *(seen[1][k] for k in keys)], pa.int64()), pa.array([size[0], *(seen[0][k] for k in keys)], pa.int64())],
                names=["key", "toxic", "other"],
            )
            rest = [k for k in seen[0] if k not in seen[1]]
            yield pa.record_batch([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([seen[0][k] for k in rest], pa.int64())], names=["key", "toxic", "other"])

    counts = rows.mapInArrow(count, "key string, toxic long, other long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    useful = counts.where((F.col("key") == "") | (F.col("toxic") >= SUPPORT) & (F.col("toxic") > F.col("other")))
    top = useful.orderBy(F.col("key") != "", F.desc(F.col("toxic") / (F.col("other") + 1)), "key").limit(sample_rows + 1).collect()
    totals = next(((r.toxic, r.other) for r in top if r.key == ""), (0, 0))
    lexicon = Lexicon(*totals, {r.key: (r.toxic, r.other) for r in top if r.key})
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches):
        coders = [Coder(sent.value, 0), Coder(sent.value, 1)]
        for batch in batches:
            texts, ys = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), np.int64)
            for start, part in text_chunks(texts):
                y = ys[start : start + len(part)]
                for v in (0, 1):
                    if len(pick := np.flatnonzero(y == v)):
                        x = features([part[i] for i in pick], coders[v])
                        yield pa.record_batch([pa.array([v] * len(pick), pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    table = rows.mapInArrow(measure, "y int, x array<double>").toPandas()
    dropped(rows)
    if not len(table):
        return Model(lexicon, Boosted(-3.0, 0.0, []), isotonic(np.zeros(1), np.zeros(1)))
    y, x = table["y"].to_numpy(float), np.stack(table["x"])
    order = np.lexsort([*x.T, y])  # the same rows in the same order, whatever the partitions
    y, x = y[order], x[order]
    out = np.zeros(len(y))
    part = np.arange(len(y)) % 3
    for k in range(3):
        out[part == k] = boost(x[part != k], y[part != k]).raw(x[part == k])
    return Model(lexicon, boost(x, y), isotonic(out, y))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), text_of(docs).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = Coder(sent.value.lexicon, None)
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for start, part in text_chunks(batch.column(2).to_pylist()):
                scores[start : start + len(part)] = sent.value.score(features(part, coder))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
