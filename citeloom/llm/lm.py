"""Language-model scoring of whole documents on Spark.

Texts are tokenised once: a block of documents is one row with its distinct words and, for every
token, the number of its word in them. Corpus counts: every training word is counted; buckets of words
sum what the blocks have, and each block gets back the sums of just its own words, so nothing that
grows with the vocabulary is broadcast and a word in every block is one entry a block.
Model: the gated recurrent network of ``gru``, trained on every training document in ``ROUNDS`` rounds.
In a round each task trains a copy of the same network on the whole documents of its blocks of that
round, and the copies are averaged by tokens into the network that the next round starts from. So the
network depends on how the table is split, and within a round more data means more copies, not a longer
training. Scoring carries the state through each document from its first token to its end.

Defined results: null text is empty (its end token only); rows that repeat a doc_id count and are
scored one by one; a null doc_id is a training row (its remainder isn't 1); without training rows
every word is unseen; an empty table gives no rows; further columns are ignored. One text must fit
in a task's memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import gru
from citeloom.llm.common import partitions, stored, text_of

#: A block's text bytes, and the distinct words of a bucket: what a task holds at once.
BLOCK_BYTES = 12 << 20
BUCKET_WORDS = 1 << 20
ROUNDS = 3
RATE = 0.02
_CODEC = "zstd"


def tokens(text: bytes) -> list[bytes]:
    """Words, A-Z in lower case; the end token is not in the list."""
    return text.lower().split()


def _pack(values: np.ndarray | bytes) -> bytes:
    raw = values if isinstance(values, bytes) else values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_CODEC, asbytes=True)


def _raw(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec=_CODEC, asbytes=True)


def _array(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(_raw(blob), kind)


def _words(blob: bytes) -> list[bytes]:
    """Words joined by line breaks, which no word has."""
    raw = _raw(blob)
    return raw.split(b"\n") if raw else []


# -- blocks --------------------------------------------------------------------------------------

BLOCK = "block long, doc_ids binary, no_id binary, held binary, sizes binary, words binary, counts binary, tails binary, tokens binary, n_words long, ends long"
_KINDS = (pa.int64(), *[pa.binary()] * 8, pa.int64(), pa.int64())


class _Numbers(dict):
    """A number for each distinct word, in the order of their coming."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Block:
    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.numbers, self.rows, self.tokens = _Numbers(), [], []

    def add(self, doc_id: int | None, held: bool, text: bytes) -> None:
        words = tokens(text)
        self.tokens.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.rows.append((doc_id, held, len(words)))
        self.size += len(text)

    def packed(self) -> pa.RecordBatch:
        """Words in the order of their hashes, so that those of a bucket are together."""
        words = list(self.numbers)
        order = np.argsort(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)), kind="stable")
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        words = [words[i] for i in order.tolist()]
        ids, held, sizes = zip(*self.rows, strict=True)
        flat = place[np.concatenate(self.tokens)]
        held = np.array(held, bool)
        counts = np.bincount(flat[np.repeat(~held, sizes)], minlength=len(words)).astype(np.int64)
        tails = np.fromiter(map(gru.tail_class, words), np.uint8, len(words))
        row = (
            self.number, np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is None for i in ids]).tobytes(), held.tobytes(),
            np.array(sizes, np.int64).tobytes(), _pack(b"\n".join(words)), _pack(counts), _pack(tails), _pack(flat), len(words), int((~held).sum()),
        )
        return pa.record_batch([pa.array([v], t) for v, t in zip(row, _KINDS, strict=True)], names=[c.split()[0] for c in BLOCK.split(", ")])


def blocked(docs: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """One row a block (BLOCK): its documents with their sizes, words with their counts in training
    documents and tail classes, and the tokens as numbers of words; stored, so that every pass sees the same."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held.alias("held_out"), text_of(docs).cast("binary").alias("text"))

    def pack(batches):
        block = _Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                if block.rows and block.size + len(text) > most:
                    yield block.packed()
                    block = _Block(block.number + 1)
                block.add(doc_id, held, text)
        if block.rows:
            yield block.packed()

    return stored(rows.mapInArrow(pack, BLOCK), "lm-blocks")


# -- corpus counts -------------------------------------------------------------------------------

SUMS = "block long, bucket long, counts binary, top array<struct<word: binary, c: bigint>>, mass array<double>, v long, c long"
_SUMS = pa.schema(
    [
        ("block", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary()), ("top", pa.list_(pa.struct([("word", pa.binary()), ("c", pa.int64())]))),
        ("mass", pa.list_(pa.float64())), ("v", pa.int64()), ("c", pa.int64()),
    ]
)


def _deal(shift: int):
    """(block, words, counts) of a block to a row for each bucket of its words."""

    def go(batches):
        for batch in batches:
            for block, words, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words, counts = _words(words), _array(counts, np.int64)
                bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) >> shift
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(words)] if words else []
                rows = [(block, int(bucket[a]), _pack(b"\n".join(words[a:b])), _pack(counts[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
                for some in range(0, len(rows), 64):
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows[some : some + 64], strict=True), _KINDS[:1] * 2 + _KINDS[1:3], strict=True)], names=["block", "bucket", "words", "counts"])

    return go


def _sum(batches):
    """For each bucket: rows with the corpus counts of each block's words, and one of the bucket's own."""

    def bucket(number: int, rows: list[tuple[int, bytes, bytes]]):
        total: dict[bytes, int] = {}
        for _, words, counts in rows:
            for w, n in zip(_words(words), _array(counts, np.int64).tolist(), strict=True):
                total[w] = total.get(w, 0) + n
        for block, words, _ in rows:
            words = _words(words)
            yield {"block": block, "bucket": number, "counts": _pack(np.fromiter(map(total.__getitem__, words), np.int64, len(words)))}
        known = [(w, n) for w, n in total.items() if n]
        mass = np.bincount([gru.tail_class(w) for w, _ in known], [n + 0.5 for _, n in known], gru.TAILS) if known else np.zeros(gru.TAILS)
        top = sorted(known, key=lambda x: (-x[1], x[0]))[: gru.HEAD]
        yield {"bucket": number, "top": [{"word": w, "c": n} for w, n in top], "mass": mass.tolist(), "v": len(known), "c": sum(n for _, n in known)}

    def sent(rows):
        return pa.RecordBatch.from_pylist(list(rows), schema=_SUMS)

    now, held = None, []
    for batch in batches:
        for block, number, words, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if now is not None and number != now:
                yield sent(bucket(now, held))
                held = []
            now = number
            held.append((block, words, counts))
    if held:
        yield sent(bucket(now, held))


def lexicon(blocks: DataFrame) -> DataFrame:
    """Corpus counts (SUMS): for each block and bucket those of the block's words, in the block's order; and
    for each bucket (block null) its most frequent words, the mass of each tail class, words and tokens."""
    entries = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = 1 << max(0, ceil(log2(max(1, entries) / BUCKET_WORDS)))
    dealt = blocks.select("block", "words", "counts").mapInArrow(_deal(32 - int(log2(buckets))), "block long, bucket long, words binary, counts binary")
    rows = dealt.repartition(partitions(blocks.sparkSession, buckets // 8), "bucket").sortWithinPartitions("bucket", "block")
    return stored(rows.mapInArrow(_sum, SUMS), "lm-lexicon")


def vocabulary(blocks: DataFrame, sums: DataFrame) -> tuple[gru.Vocabulary, int, int]:
    """The network's vocabulary, all training tokens (N) and distinct ones (V), ends included."""
    own = sums.where("block is null")
    top = own.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("c"), "word").limit(gru.HEAD).collect()
    whole = own.agg(F.sum("v"), F.sum("c"), *(F.sum(F.get("mass", F.lit(k))) for k in range(gru.TAILS))).first()
    ends = blocks.agg(F.coalesce(F.sum("ends"), F.lit(0))).first()[0]
    tail = np.array([x or 0.0 for x in whole[2:]]) + 0.5
    for r in top:
        tail[gru.tail_class(bytes(r.word))] -= r.c + 0.5
    v = gru.Vocabulary([bytes(r.word) for r in top], np.array([r.c for r in top], float), ends, np.maximum(tail, 0.5))
    return v, (whole[1] or 0) + ends, (whole[0] or 0) + (ends > 0)


# -- the network ---------------------------------------------------------------------------------


def _codes(v: gru.Vocabulary, words: list[bytes], tails: np.ndarray) -> np.ndarray:
    """The network's code of each of a block's words."""
    code = 1 + len(v.head) + tails.astype(np.int32)
    number = dict(zip(words, range(len(words)), strict=True))
    for i, w in enumerate(v.head):
        if (at := number.get(w)) is not None:
            code[at] = 1 + i
    return code


def _documents(code: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The codes of each document's tokens, with an end (0) after each."""
    n = len(sizes)
    out = np.zeros(len(flat) + n, np.int32)
    out[np.arange(len(flat)) + np.repeat(np.arange(n), sizes)] = code[flat]
    return np.split(out, np.cumsum(sizes[:-1] + 1)) if n else []


def _flat(p: dict) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p.values()])


def _unflat(like: dict, flat: np.ndarray) -> dict:
    out, at = {}, 0
    for k, x in like.items():
        out[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
        at += x.size
    return out


def train(blocks: DataFrame, v: gru.Vocabulary, rate: float = RATE, rounds: int = ROUNDS) -> dict:
    """The network trained on every training document of the blocks, each block in one of the rounds."""
    spark = blocks.sparkSession
    schema = "weight double, p array<float>"
    p = gru.initial(v)

    def emit(weight: float, flat: np.ndarray):
        return pa.record_batch([pa.array([weight]), pa.array([flat.astype(np.float32)], pa.list_(pa.float32()))], names=["weight", "p"])

    def average(batches):
        total, weight = None, 0.0
        for batch in batches:
            for w, flat in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.asarray(flat.values, np.float64) * w
                total, weight = (x if total is None else total + x), weight + w
        if weight:
            yield emit(weight, total / weight)

    for now in range(rounds):
        sent = spark.sparkContext.broadcast((v, p))  # HEAD words and their weights

        def local(batches, sent=sent):
            v, p = sent.value
            p, weight, opt = {k: x.copy() for k, x in p.items()}, 0, None
            for batch in batches:
                for held, sizes, words, tails, flat in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    held, sizes = np.frombuffer(held, bool), np.frombuffer(sizes, np.int64)
                    docs = _documents(_codes(v, _words(words), _array(tails, np.uint8)), _array(flat, np.int32), sizes)
                    docs = [d for d, h in zip(docs, held.tolist(), strict=True) if not h]
                    if docs:
                        opt = gru.learn(p, v, docs, rate, opt=opt)
                        weight += sum(map(len, docs))
            if weight:
                yield emit(float(weight), _flat(p))

        mine = blocks.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == now)
        parts = mine.select("held", "sizes", "words", "tails", "tokens").mapInArrow(local, schema)
        some = max(1, round(parts.rdd.getNumPartitions() ** 0.5))
        done = parts.repartition(some).mapInArrow(average, schema).coalesce(1).mapInArrow(average, schema).collect()  # one row
        p = _unflat(p, np.array(done[0].p)) if done else p
    return p


def score(blocks: DataFrame, sums: DataFrame, v: gru.Vocabulary, n_all: int, n_distinct: int, p: dict) -> DataFrame:
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast((v, p))  # HEAD words and their weights

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        v, p = sent.value
        row = {k: left.column(k)[0].as_py() for k in ("doc_ids", "no_id", "held", "sizes", "words", "tails", "tokens")}
        sizes, flat, tails = np.frombuffer(row["sizes"], np.int64), _array(row["tokens"], np.int32), _array(row["tails"], np.uint8)
        c = np.concatenate([np.zeros(0, np.int64), *(_array(x, np.int64) for x in right.sort_by("bucket").column("counts").to_pylist())])
        code = _codes(v, _words(row["words"]), tails)
        total = n_all + 0.5 * (n_distinct + 1)
        base_of = np.log10((c + 0.5) / total)
        tail_of = np.where(code > len(v.head), np.log((c + 0.5) / v.tail_mass[tails]), 0.0)
        n = len(sizes)
        doc = np.repeat(np.arange(n), sizes)
        summed = lambda of: np.bincount(doc, of[flat], n)
        docs, at, whole = _documents(code, flat, sizes), 0, np.zeros(n)
        for to in [*(np.flatnonzero(np.diff(np.cumsum(sizes) // 2_500_000)) + 1).tolist(), n]:
            whole[at:to], at = gru.log_likelihood(p, v, docs[at:to]), to
        return pa.table(
            {
                "doc_id": pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=np.frombuffer(row["no_id"], bool)),
                "held_out": np.frombuffer(row["held"], bool),
                "n_tokens": sizes + 1,
                "n_known": summed((c > 0).astype(float)).astype(np.int64) + (v.ends > 0),
                "train_tokens": np.full(n, n_all, np.int64),
                "base_score": summed(base_of) + np.log10((v.ends + 0.5) / total),
                "score": (whole + summed(tail_of)) / np.log(10),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    parts = partitions(spark, blocks.count() // 4)
    rows = blocks.select("block", "doc_ids", "no_id", "held", "sizes", "words", "tails", "tokens").repartition(parts, "block")
    counts = sums.where("block is not null").select("block", "bucket", "counts").repartition(parts, "block")
    return rows.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, schema)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    blocks = blocked(docs)
    sums = lexicon(blocks)
    v, n_all, n_distinct = vocabulary(blocks, sums)
    return score(blocks, sums, v, n_all, n_distinct, train(blocks, v))
