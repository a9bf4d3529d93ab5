"""Benchmark decontamination: size-partitioned MinHash containment search, exactly verified.

Each test item keeps the arg-min shingles of independent permutations. A document holds one of them
with a probability that equals the item's containment in it, whatever the document's length, so
short items are found inside long documents. Items are partitioned by size; each partition has the
number of hits it asks for, set so that an item at the threshold is missed less than once in 10^6.
Candidates are verified by the exact share of the item's shingles that the document has.

The items are the query set: they run in blocks of bounded size against all documents, one pass over
the documents a block. Documents are neither shuffled nor grouped.

Defined results: null and empty texts match nothing; an item with fewer than five words is one
shingle of all its words and matches where those words stand in a row; repeated documents and items
are reported one by one; an empty table gives no rows; further columns are ignored, or kept as they
are by ``drop_contaminated``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import tidy
from citeloom.llm.shingles import chunked, flat_shingles, flat_words, mixed

WIDTH = 5
THRESHOLD = 0.8
PERMUTATIONS = 32
#: Items (and bytes of their texts) in a block; one block's index is sent to every executor.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
SCREEN_BITS = 20


def hits_needed(draws: int, threshold: float, miss: float = 1e-6) -> int:
    """The largest number of hits that ``draws`` draws reach with probability 1 - miss or more."""
    below, r = 0.0, 0
    while r < draws:
        below += comb(draws, r) * threshold**r * (1 - threshold) ** (draws - r)
        if below > miss:
            break
        r += 1
    return max(1, r)


@dataclass
class Partition:
    """Items of one shingle width and one size class."""

    width: int
    needed: int
    keys: np.ndarray  # sorted signature shingles
    owner_of: np.ndarray  # for each key, where its owners begin in owners
    owners: np.ndarray
    weights: np.ndarray
    screen: np.ndarray


@dataclass
class Index:
    ids: list
    sets: list[np.ndarray]
    partitions: list[Partition]


def item_shingles(text: str | None) -> tuple[int, np.ndarray]:
    words, starts = flat_words([(text or "").encode("utf-8", "surrogatepass")])
    width = min(WIDTH, max(1, len(words)))
    return width, np.unique(flat_shingles(words, starts, width)[0])


def build_index(items: list[tuple[object, str | None]], threshold: float = THRESHOLD, permutations: int = PERMUTATIONS) -> Index:
    ids, sets, groups = [], [], defaultdict(list)
    for item, text in items:
        width, s = item_shingles(text)
        if len(s):
            groups[width, len(s).bit_length()].append(len(ids))
            ids.append(item)
            sets.append(s)
    salts = np.random.default_rng(20).integers(1, 2**63, permutations, dtype=np.int64).astype(np.uint64)
    parts = []
    for (width, _), members in sorted(groups.items()):
        signed = defaultdict(lambda: defaultdict(int))
        for m in members:
            for salt in salts:
                signed[int(sets[m][np.argmin(mixed(sets[m] ^ salt))])][m] += 1
        keys = np.array(sorted(signed), np.uint64)
        rows = [sorted(signed[int(k)].items()) for k in keys]
        begin = np.zeros(len(keys) + 1, np.int64)
        np.cumsum([len(r) for r in rows], out=begin[1:])
        flat = np.array([x for r in rows for x in r], np.int64).reshape(-1, 2)
        screen = np.zeros(1 << SCREEN_BITS, bool)
        screen[keys >> np.uint64(64 - SCREEN_BITS)] = True
        parts.append(Partition(width, hits_needed(permutations, threshold), keys, begin, flat[:, 0], flat[:, 1], screen))
    return Index(ids, sets, parts)


def search(index: Index, texts: list[bytes], threshold: float = THRESHOLD) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, shingles of the item, shared) for each text and item at the threshold or above."""
    words, starts = flat_words(texts)
    shingled = {w: flat_shingles(words, starts, w, whole_if_short=False) for w in {p.width for p in index.partitions}}
    for part in index.partitions:
        shingles, begins = shingled[part.width]
        near = np.flatnonzero(part.screen[shingles >> np.uint64(64 - SCREEN_BITS)])
        place = np.minimum(np.searchsorted(part.keys, shingles[near]), len(part.keys) - 1)
        real = part.keys[place] == shingles[near]
        near, place = near[real], place[real]
        if not len(near):
            continue
        doc = np.searchsorted(begins, near, side="right") - 1
        pairs = np.unique(np.stack([doc, place], 1), axis=0)  # a shingle counts once in a document
        found: dict[tuple[int, int], int] = defaultdict(int)
        for d, k in pairs.tolist():
            for o in range(part.owner_of[k], part.owner_of[k + 1]):
                found[d, int(part.owners[o])] += int(part.weights[o])
        held: dict[int, np.ndarray] = {}
        for (d, item), n in sorted(found.items()):
            if n >= part.needed:
                if d not in held:
                    held = {d: np.unique(shingles[begins[d] : begins[d + 1]])}
                own = index.sets[item]
                shared = int(np.isin(own, held[d], assume_unique=True).sum())
                if shared >= threshold * len(own):
                    yield d, item, len(own), shared


def item_blocks(items: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of bounded size, streamed through the driver a partition at a time."""
    block, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        size += len(row.text or "")
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment: one row for each document and item in it."""
    spark = docs.sparkSession
    kinds = {"doc_id": docs.schema["doc_id"].dataType, "item_id": items.schema["item_id"].dataType}
    schema = f"doc_id {kinds['doc_id'].simpleString()}, item_id {kinds['item_id'].simpleString()}, n_shingles long, n_shared long, containment double"
    columns = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    out = None
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(build_index(block, threshold))

        def scan(batches, shared=shared):
            index = shared.value
            for batch in batches:
                ids, rows = batch.column(0), []
                for start, texts in chunked(x.as_py() for x in batch.column(1)):
                    rows += [(start + d, *x) for d, *x in search(index, texts, threshold)]
                if rows:
                    at, item, size, n = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                    yield pa.record_batch(
                        [ids.take(pa.array(at)), pa.array([index.ids[i] for i in item], batch_type), pa.array(size), pa.array(n), pa.array(n / size)],
                        names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"],
                    )

        batch_type = _arrow(items.schema["item_id"])
        part = columns.mapInArrow(tidy(scan), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item, with the same columns."""
    spark = docs.sparkSession
    place = docs.columns.index("text")
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(build_index(block, threshold))

        def scan(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for start, texts in chunked(x.as_py() for x in batch.column(place)):
                    for d, *_ in search(shared.value, texts, threshold):
                        keep[start + d] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(scan), docs.schema)
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns])


def _arrow(field):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)
