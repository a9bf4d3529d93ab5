"""Removal of byte strings that repeat across documents: difference-cover sampling on Spark.

The goal is the order of all suffixes only as far as their first ``LENGTH`` bytes: which of these
prefixes are equal, and in which document each is first. So the difference-cover recursion is run to
that depth and no further.

0. Copies. A text equal to one with a smaller id goes whole; only the others are looked at.
1. Sample. Positions whose residue modulo ``PERIOD`` is in a difference cover: any two positions have
   a shift below the period at which both are sampled. Sampled tuples of ``LENGTH - PERIOD + 1`` bytes
   are named and sorted; two equal prefixes share a name at such a shift.
2. Recurse on names. Only names that two documents have go on. Positions within a period before such
   a name are the ones whose prefix may repeat; their whole prefixes are named in turn.
3. Merge. Sorted prefix names of all blocks are merged: a prefix that a block of smaller ids has, too,
   repeats. Blocks are ranges of doc_id, so no id travels with a name.
4. Compare adjacent prefixes. A block shows the texts of such prefixes to the next block that has the
   same name, which compares the bytes. Two names that are equal where the bytes are not stop the job
   (another ``salt`` names anew): what is removed was compared byte by byte.

Names are hashes: they only bring equal prefixes together. They travel as sorted, delta-coded runs,
one for each block and bucket, never as rows of positions; answers come back as one bit a name. A name
common to many documents is one entry a block, and each block shows it to one other.

Defined results: null text is empty; texts under ``LENGTH`` bytes lose nothing; rows that share a
doc_id never remove each other's bytes; a null doc_id counts as larger than all others; an empty
table gives no rows; further columns are ignored. Rows of one id may fill many blocks; one text must fit
in a task's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import dropped, partitions, size_of, stored, text_of

LENGTH = 50
PERIOD = 13
#: A perfect difference set modulo 13; fixed values.
COVER = (0, 1, 3, 9)
TUPLE = LENGTH - PERIOD + 1
BLOCK_BYTES = 4 << 20
BUCKET_NAMES = 2 << 20
LAST = (1 << 63) - 1

_CODEC = "zstd"
_ODD = np.random.default_rng(10).integers(1, 2**62, 8, dtype=np.int64).astype(np.uint64) << np.uint64(1) | np.uint64(1)


# -- names and packed values ---------------------------------------------------------------------


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` (padded by 8 bytes)."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def _offsets(length: int) -> list[int]:
    """Where to read eight bytes so that ``length`` of them are read in all."""
    return [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]


def named(data: np.ndarray, at: np.ndarray, length: int, salt: int = 0, spread: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of the ``length`` bytes at each position ``at``, and with ``spread`` that many bits of a
    second hash of them: their bucket."""
    words, second = _words(data), np.zeros(len(at) if spread else 0, np.uint64)
    h = np.full(len(at), 0x243F6A8885A308D3 + length + 2 * salt, np.uint64)
    for k, offset in enumerate(_offsets(length)):
        word = words[at + offset]
        if spread:
            second += word * _ODD[k]
            second ^= second >> np.uint64(32)
        h ^= word
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h, (second * _ODD[7] >> np.uint64(64 - spread)).astype(np.int64) if spread else np.zeros(len(at), np.int64)


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray) -> bool:
    """Whether the ``LENGTH`` bytes at all positions ``at`` of ``a`` are those at ``to`` of ``b``."""
    left, right = _words(a), _words(b)
    return all((left[at + k] == right[to + k]).all() for k in _offsets(LENGTH))


def _begins(ranked: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Whether each of sorted values differs from the one before it."""
    new = np.ones(len(ranked), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    for x in more:
        new[1:] |= x[1:] != x[:-1]
    return new


def pack(sorted_values: np.ndarray) -> bytes:
    """Sorted 64-bit values as compressed differences, the bytes of one place together."""
    gaps = np.diff(sorted_values, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    raw = np.ascontiguousarray(planes).tobytes()
    return len(gaps).to_bytes(4, "little") + bytes([width]) + pa.compress(raw, codec=_CODEC, asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n, width = int.from_bytes(blob[:4], "little"), blob[4]
    raw = pa.decompress(blob[5:], decompressed_size=n * width, codec=_CODEC, asbytes=True)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def pack_bits(mask: np.ndarray) -> bytes:
    return len(mask).to_bytes(8, "little") + pa.compress(np.packbits(mask).tobytes(), codec=_CODEC, asbytes=True)


def unpack_bits(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], decompressed_size=(n + 7) // 8, codec=_CODEC, asbytes=True)
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _cuts(ranked: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of each run of equal values."""
    edges = [*np.flatnonzero(_begins(ranked)).tolist(), len(ranked)] if len(ranked) else []
    return zip(edges, edges[1:], strict=False)


# -- blocks --------------------------------------------------------------------------------------

BLOCK = "block long, ids binary, no_id binary, sizes binary, keys binary, n_bytes long, data binary"


def _split_ids(rows: DataFrame, most: int) -> DataFrame | None:
    """Ids whose rows have more than ``most`` characters together; None if no id is repeated."""
    repeated = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.limit(1).count():
        return None
    return rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.sum(F.length("text")).alias("n")).where(F.col("n") > most).select("doc_id", F.lit(True).alias("split"))


def blocked(docs: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """One row a block: ids, sizes and digests of its texts as arrays, the texts themselves compressed
    together; stored. Blocks are consecutive ranges of doc_id. Rows of one id stay together; an id with
    more than a block has blocks of its own."""
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("doc_id"), docs["doc_id"].isNull().alias("no_id"), text_of(docs).alias("text"))
    split = _split_ids(rows, most)
    if split is None:
        rows = rows.withColumns({"split": F.lit(False), "turn": F.lit(0).cast("long")})
    else:
        rows = rows.withColumn("turn", F.monotonically_increasing_id()).join(split, "doc_id", "left").withColumn("split", F.coalesce("split", F.lit(False)))
        rows = rows.withColumn("turn", F.when(F.col("split"), F.xxhash64("turn")).otherwise(0)).select("doc_id", "no_id", "text", "split", "turn")
    wanted = partitions(docs.sparkSession, size_of(docs) // (32 << 20))
    by = ("doc_id", "turn")
    dealt = (rows.repartitionByRange(wanted, *by) if wanted > partitions(docs.sparkSession, 0) else rows.repartitionByRange(*by)).sortWithinPartitions(*by)

    def pack_rows(batches):
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def packed():
            ids, no_id, texts = zip(*held, strict=True)
            keys = b"".join(hashlib.md5(t, usedforsecurity=False).digest() for t in texts)
            sizes = np.array([len(t) for t in texts], np.int64)
            data = pa.compress(b"".join([*texts, b"\0" * 8]), codec=_CODEC, asbytes=True)
            row = (block, np.array(ids, np.int64).tobytes(), np.array(no_id, bool).tobytes(), sizes.tobytes(), keys, int(sizes.sum()), data)
            kinds = (pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.binary())
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BLOCK.split(", ")])

        last = False
        for batch in batches:
            for doc, no_id, text, split in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                text = text.as_py().encode("utf-8", "surrogatepass")
                other = bool(held) and doc != held[-1][0]
                if held and (size + len(text) > most and (other or split) or other and (split or last)):
                    yield packed()
                    block, held, size = block + 1, [], 0
                held.append((doc, no_id, text))
                size, last = size + len(text), split
        if held:
            yield packed()

    return stored(dealt.mapInArrow(pack_rows, BLOCK), "repeats-blocks")


def _keys(batches):
    """block, place in it, doc_id, key of every text of the blocks."""
    for batch in batches:
        for block, ids, keys in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            ids = np.frombuffer(ids, np.int64)
            digests = [keys[i : i + 16] for i in range(0, len(keys), 16)]
            yield pa.record_batch([pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids))), pa.array(ids), pa.array(digests, pa.binary())], names=["block", "place", "doc_id", "key"])


#: What comes to a block beside its texts (block, kind, number, data): places of copies; a bit for each
#: of its sampled names in a bucket, whether two documents have it; a bit for each byte, whether its
#: prefix may repeat; a bit for each of its prefix names in a bucket, whether a block of smaller ids has
#: it; names that another block is to see; what another block has shown.
SIDE = "block long, kind int, number long, data binary"
SIDE_SCHEMA = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("number", pa.int64()), ("data", pa.binary())])
COPIES, SHARED, SUSPECT, OLDER, WANTED, SHOWN = range(6)
#: Sorted names of a block in a bucket, which of them two of its documents have, and the block's first id.
RUN = "block long, bucket long, era long, names binary, twice binary"
RUN_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("era", pa.int64()), ("names", pa.binary()), ("twice", pa.binary())])


def _side(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, SIDE_SCHEMA.types, strict=True)], schema=SIDE_SCHEMA)


class Texts:
    """A block's texts in one buffer, ordered by id, and which of them are copies of earlier ones."""

    def __init__(self, row: pa.Table, side: pa.Table):
        self.block, ids, no_id, sizes = (row.column(c)[0].as_py() for c in ("block", "ids", "no_id", "sizes"))
        self.ids, self.no_id, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(no_id, bool), np.frombuffer(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.n = int(self.starts[-1])
        data = pa.decompress(row.column("data")[0].as_py(), decompressed_size=self.n + 8, codec=_CODEC, asbytes=True)
        self.data = np.frombuffer(data, np.uint8)
        self.side = side
        self.copy = np.zeros(len(self.ids), bool)
        self.copy[side.filter(pc.equal(side.column("kind"), COPIES)).column("number").to_numpy()] = True

    def rows(self, kind: int) -> list[tuple[int, bytes]]:
        """(number, data) of what came of one kind, in the order of the numbers."""
        rows = self.side.filter(pc.equal(self.side.column("kind"), kind))
        return sorted(zip(rows.column("number").to_pylist(), rows.column("data").to_pylist(), strict=True))

    def bits(self, kind: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, bool), *(unpack_bits(x) for _, x in self.rows(kind))])

    @cached_property
    def doc(self) -> np.ndarray:
        """The document that each place is in."""
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)

    def sampled(self) -> np.ndarray:
        """Places in the difference cover that have a whole tuple, of texts that are no copies."""
        long = np.flatnonzero((self.sizes >= TUPLE) & ~self.copy)
        periods = -(-(self.sizes[long] - TUPLE + 1) // PERIOD)
        inside = np.arange(periods.sum()) - np.repeat(np.cumsum(periods) - periods, periods)
        at = (np.repeat(self.starts[long], periods) + PERIOD * inside)[:, None] + np.array(COVER)
        return at[at + TUPLE <= np.repeat(self.starts[long + 1], periods)[:, None]]

    def suspects(self, hit: np.ndarray) -> np.ndarray:
        """Of each place whether its prefix may repeat: a sample at ``hit`` is within a period."""
        seen = np.zeros(self.n + PERIOD + 1, np.int32)
        seen[hit + 1] = 1
        np.cumsum(seen, out=seen)
        out = seen[PERIOD : self.n + PERIOD] > seen[: self.n]
        for start, end, copy in zip(self.starts.tolist(), self.starts[1:].tolist(), self.copy.tolist(), strict=False):
            out[start if copy else max(start, end - LENGTH + 1) : end] = False
        return out


class Prefixes:
    """The prefixes at the suspect places: their names in order (by bucket, then name), once each."""

    def __init__(self, texts: Texts, at: np.ndarray, salt: int, spread: int):
        names, bucket = named(texts.data, at, LENGTH, salt, spread)
        order = np.argsort(names)
        if spread:
            order = order[np.argsort(bucket[order].astype(np.uint16 if spread <= 16 else np.int64), kind="stable")]
        names, bucket = names[order], bucket[order]
        new = _begins(names, bucket)
        first = np.flatnonzero(new)
        self.at, self.group = at[order], np.cumsum(new) - 1
        self.names, self.bucket = names[first], bucket[first]
        #: The first place in the block of each; documents stand in the order of their ids.
        self.lowest = np.minimum.reduceat(self.at, first) if len(first) else np.zeros(0, np.int64)

    def starts(self) -> dict[int, int]:
        return {int(self.bucket[a]): a for a, _ in _cuts(self.bucket)}


def _collide() -> None:
    raise ValueError("different strings have one name: call again with another salt")


# -- steps ---------------------------------------------------------------------------------------


def _sample(bits: int, shift: int, salt: int):
    """Runs of each block's sampled names."""

    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = Texts(left, right)
        at = texts.sampled()
        names, doc = named(texts.data, at, TUPLE, salt)[0] >> np.uint64(64 - bits), texts.doc[at]
        order = np.argsort(names)
        names, doc = names[order], doc[order]
        first = np.flatnonzero(_begins(names)) if len(names) else np.zeros(0, np.int64)
        many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
        names = names[first]
        bucket = (names >> np.uint64(shift)).astype(np.int64)
        era = int(texts.ids[0])
        rows = [(texts.block, int(bucket[a]), era, pack(names[a:b]), pack_bits(many[a:b])) for a, b in _cuts(bucket)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, RUN_SCHEMA.types, strict=True)], schema=RUN_SCHEMA)

    return go


def _suspects(bits: int, salt: int):
    """The places of each block whose prefix may repeat."""

    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = Texts(left, right)
        at = texts.sampled()
        names = named(texts.data, at, TUPLE, salt)[0] >> np.uint64(64 - bits)
        order = np.argsort(names)
        shared = texts.bits(SHARED)
        hit = at[order[shared[np.cumsum(_begins(names[order])) - 1]]] if len(at) else at
        return pa.Table.from_batches([_side([(texts.block, SUSPECT, 0, pack_bits(texts.suspects(hit)))])])

    return go


def _prefixes(salt: int, spread: int):
    """Runs of the names of each block's suspect prefixes."""

    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = Texts(left, right)
        own, era = Prefixes(texts, np.flatnonzero(texts.bits(SUSPECT)), salt, spread), int(texts.ids[0])
        rows = [(texts.block, int(own.bucket[a]), era, pack(own.names[a:b]), b"") for a, b in _cuts(own.bucket)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, RUN_SCHEMA.types, strict=True)], schema=RUN_SCHEMA)

    return go


def _merge(answer):
    """Merge the blocks' runs of each bucket: rows of SIDE that ``answer`` makes of (names, owner, sizes of
    the runs, rows) with the names in order and, where they are equal, the blocks."""

    def bucket(number: int, rows: list[tuple[int, int, bytes, bytes]]):
        parts = [unpack(names) for _, _, names, _ in rows]
        names = np.concatenate(parts)
        sizes = np.array([len(p) for p in parts])
        order = np.argsort(names, kind="stable")  # runs are in the order of their blocks
        return _side(answer(number, names[order], order, sizes, rows))

    def go(batches):
        rows, now = [], None
        for batch in batches:
            for b, k, era, names, twice in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if now is not None and k != now:
                    yield bucket(now, rows)
                    rows = []
                now = k
                rows.append((b, era, names, twice))
        if rows:
            yield bucket(now, rows)

    return go


def _masks(kind: int, number: int, mask: np.ndarray, order: np.ndarray, sizes: np.ndarray, rows: list[tuple]) -> list[tuple]:
    """A bit for each name of each run, from a mask over all names in order."""
    own = np.empty(len(mask), bool)
    own[order] = mask
    ends = np.cumsum(sizes)
    return [(r[0], kind, number, pack_bits(own[b - n : b])) for r, n, b in zip(rows, sizes.tolist(), ends.tolist(), strict=True)]


def _answer_shared(number, names, order, sizes, rows):
    """Names of two blocks, or of two documents of a block."""
    twice = np.concatenate([unpack_bits(r[3]) for r in rows])[order]
    group = np.cumsum(_begins(names)) - 1
    return _masks(SHARED, number, ((np.bincount(group) > 1) | (np.bincount(group, twice) > 0))[group], order, sizes, rows)


def _answer_older(number, names, order, sizes, rows):
    """Names that a block of smaller ids has too; and which names each block shows to the next that has them."""
    owner = np.repeat(np.arange(len(rows)), sizes)[order]
    era, block = np.array([r[1] for r in rows], np.int64)[owner], np.array([r[0] for r in rows], np.int64)
    first = np.flatnonzero(_begins(names))
    group = np.cumsum(_begins(names)) - 1
    low, high = np.minimum.reduceat(era, first)[group], np.maximum.reduceat(era, first)[group]
    out = _masks(OLDER, number, low < era, order, sizes, rows)
    to = np.flatnonzero(~_begins(names) & (low < high))
    place = order[to - 1] - (np.cumsum(sizes) - sizes)[owner[to - 1]]
    turn = np.lexsort((place, owner[to], owner[to - 1]))
    source, dest, place = owner[to - 1][turn], owner[to][turn], place[turn]
    for a, b in _cuts(source):
        dests, rank = np.unique(dest[a:b], return_inverse=True)
        data = block[dests].tobytes()
        out.append((int(block[source[a]]), WANTED, number, len(data).to_bytes(4, "little") + data + pack((rank.astype(np.uint64) << np.uint64(32)) | place[a:b].astype(np.uint64))))
    return out


def _show(salt: int, spread: int):
    """For each block that wants to see names of this one: the texts from where they begin, overlapping ones joined."""

    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = Texts(left, right)
        wanted = texts.rows(WANTED)
        if not wanted:
            return pa.Table.from_batches([], schema=SIDE_SCHEMA)
        own = Prefixes(texts, np.flatnonzero(texts.bits(SUSPECT)), salt, spread)
        starts, dest, at = own.starts(), [], []
        for bucket, data in wanted:
            n = int.from_bytes(data[:4], "little")
            both = unpack(data[4 + n :])
            dest.append(np.frombuffer(data[4 : 4 + n], np.int64)[(both >> np.uint64(32)).astype(np.int64)])
            at.append(own.lowest[starts[bucket] + (both & np.uint64(0xFFFFFFFF)).astype(np.int64)])
        dest, at = np.concatenate(dest), np.concatenate(at)
        order = np.lexsort((at, dest))
        dest, at = dest[order], at[order]
        rows = []
        for a, b in _cuts(dest):
            place = at[a:b]
            new = np.flatnonzero(np.append(True, np.diff(place) > LENGTH))
            begin, end = place[new], place[np.append(new[1:] - 1, len(place) - 1)] + LENGTH
            raw = np.concatenate([texts.data[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]).tobytes()
            head = (end - begin).astype(np.int64).tobytes()
            rows.append((int(dest[a]), SHOWN, texts.block, len(head).to_bytes(4, "little") + len(raw).to_bytes(8, "little") + head + pa.compress(raw, codec=_CODEC, asbytes=True)))
        return pa.Table.from_batches([_side(rows)])

    return go


def _shown(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """What other blocks have shown, in one buffer, and the places in it that are whole prefixes."""
    raws, places, base = [], [], 0
    for _, data in texts.rows(SHOWN):
        n, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:12], "little")
        length = np.frombuffer(data[12 : 12 + n], np.int64)
        raws.append(pa.decompress(data[12 + n :], decompressed_size=size, codec=_CODEC, asbytes=True))
        left = np.repeat(np.cumsum(length), length) - np.arange(size)
        places.append(np.flatnonzero(left >= LENGTH) + base)
        base += size
    return np.frombuffer(b"".join([*raws, b"\0" * 8]), np.uint8), np.concatenate([np.zeros(0, np.int64), *places])


def _cut(salt: int, spread: int):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def compare(texts: Texts, own: Prefixes, older: np.ndarray) -> None:
        """The bytes of prefixes that share a name: within the block, and with what other blocks show."""
        lowest = own.lowest[own.group]
        again = own.at != lowest
        if not same_bytes(texts.data, own.at[again], texts.data, lowest[again]):
            _collide()
        if older.any():
            data, at = _shown(texts)
            names = named(data, at, LENGTH, salt)[0]
            order = np.argsort(names)
            names, mine = names[order], own.names[older]
            place = np.minimum(np.searchsorted(names, mine), max(0, len(names) - 1))
            if not len(names) or not (names[place] == mine).all() or not same_bytes(texts.data, own.lowest[older], data, at[order[place]]):
                _collide()

    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = Texts(left, right)
        own, older = Prefixes(texts, np.flatnonzero(texts.bits(SUSPECT)), salt, spread), texts.bits(OLDER)
        compare(texts, own, older)
        before = older[own.group] | (texts.ids[texts.doc[own.lowest[own.group]]] < texts.ids[texts.doc[own.at]])
        edge = np.zeros(texts.n + 1, np.int32)
        edge[own.at[before]] += 1  # positions are distinct
        edge[own.at[before] + LENGTH] -= 1
        gone = (np.cumsum(edge[:-1]) > 0) | (texts.copy & (texts.sizes >= LENGTH))[texts.doc]
        spans, kept = [], []
        for a, b in zip(texts.starts, texts.starts[1:], strict=False):
            g = gone[a:b]
            change = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
            spans.append([{"start": s, "end": e} for s, e in change.reshape(-1, 2).tolist()])
            kept.append(texts.data[a:b][~g].tobytes())
        ids = pa.array(texts.ids, mask=texts.no_id)
        return pa.table({"doc_id": ids, "n_bytes": pa.array(texts.sizes), "spans": pa.array(spans, pa.list_(span)), "kept": pa.array(kept, pa.binary())})

    return go


def find_repeats(docs: DataFrame, salt: int = 0) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of removed runs), kept (the other bytes) of every row."""
    spark, blocks = docs.sparkSession, blocked(docs)
    total, n_blocks = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).cast("long") + 2, F.count("*")).first()
    bits = min(64, ceil(log2(total)) + 8)
    spread = ceil(log2(max(1, ceil(total * len(COVER) / PERIOD / BUCKET_NAMES))))  # bits of a bucket
    parts = partitions(spark, n_blocks // 4)

    keyed = blocks.select("block", "ids", "keys").mapInArrow(_keys, "block long, place long, doc_id long, key binary")
    firsts = keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = keyed.join(firsts, "key").where("doc_id > first").select("block", F.lit(COPIES).alias("kind"), F.col("place").alias("number"), F.lit(None).cast("binary").alias("data"))
    copies = stored(copies, "repeats-copies")
    rows = blocks.select("block", "ids", "no_id", "sizes", "data")

    def step(go, schema: str, *sides: DataFrame) -> DataFrame:
        side = sides[0]
        for more in sides[1:]:
            side = side.unionByName(more)
        return rows.repartition(parts, "block").groupBy("block").cogroup(side.repartition(parts, "block").groupBy("block")).applyInArrow(go, schema)

    def merged(runs: DataFrame, answer, label: str) -> DataFrame:
        dealt = runs.repartition(partitions(spark, (1 << spread) // 4), "bucket").sortWithinPartitions("bucket", "block")
        return stored(dealt.mapInArrow(_merge(answer), SIDE), label)

    shared = merged(step(_sample(bits, bits - spread, salt), RUN, copies), _answer_shared, "repeats-shared")
    suspects = stored(step(_suspects(bits, salt), SIDE, copies, shared), "repeats-suspects")
    dropped(shared)
    answers = merged(step(_prefixes(salt, spread), RUN, copies, suspects), _answer_older, "repeats-older")
    older, wanted = answers.where(F.col("kind") == OLDER), answers.where(F.col("kind") == WANTED)
    shown = stored(step(_show(salt, spread), SIDE, copies, suspects, wanted), "repeats-shown")
    out = "doc_id long, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept binary"
    return step(_cut(salt, spread), out, copies, suspects, older, shown)


def digest(repeats: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return repeats.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
