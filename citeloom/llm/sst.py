"""Token-id output: sorted-string-table shards with a sparse block index, a Bloom filter and a footer.

Documents are dealt into key ranges and sorted by Spark; every task streams one shard to the shared
folder, block by block. A shard is named by its task and a random suffix and counts only if the
manifest, which Spark commits, names it: a lost or repeated task leaves an orphan at worst.

File layout: data blocks (zstd), block index, Bloom filter, footer of fixed size. A block holds
entries (shared key bytes, own key bytes, value bytes: three varints; own key; ids). A key is one
byte, 0 for a null id or 1, then for an id its 8 bytes, big-endian with the sign flipped, so that
keys sort as ids do. Ids are little-endian, 2 bytes wide if the vocabulary allows, else 4.
A shard written in a given order (``order``) has the 8 bytes of a place before that in each key, so its
entries follow the order; its Bloom filter holds the ids alone, and a lookup reads such a shard through.

Defined results: null text is empty (its end id only); a null doc_id sorts before all others; rows
that share a doc_id are all kept, ordered by text, and a lookup returns each; no rows give shards
without blocks or none; further columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import partitions, size_of, stored, text_of

MAGIC = b"CLOOMSS1"
FOOTER = struct.Struct("<QQQQQQBB6x8s")  # the second B: bytes of a place before each key, 0 or 8
ENTRY = struct.Struct("<QII I")
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Input bytes and documents that a shard is meant to have: its writer holds the keys of all its documents.
SHARD_BYTES, SHARD_DOCS = 128 << 20, 2 << 20


# -- encoding ------------------------------------------------------------------------------------


class Encoder:
    """Texts to ids with a public byte-level vocabulary file, plus an end id.

    A space or a line break between two characters that are no white space always separates pieces,
    so the text is cut there, and the ids of pieces seen before come from a table of bounded size.
    Pieces not seen yet are encoded together, one a line, and told apart by the id of the line
    break. A text with other runs of white space at a cut is encoded as a whole.
    """

    most = 800_000

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.kind = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        self.line = self._ids("\n")
        self.known: dict[str, bytes | None] = {}
        self.marks: dict[str, bytes] = {m: self._ids(m) for m in ".,;:!?"}
        # The library's own letter for each byte, told from its pre-tokenizer.
        low = "".join(map(chr, range(0x20, 0x250)))
        shown = "".join(x for x, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(low))
        self.letters = {b: c for b, c in zip(low.encode(), shown, strict=True)}
        self.space = self.letters[ord(" ")]
        self.tokenize = self.model.model.tokenize
        self.code = "H" if self.kind.itemsize == 2 else "I"

    def _ids(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _letters(self, word: str) -> bytes:
        """The ids of Latin letters, perhaps after one space: the pre-tokenizer leaves them whole."""
        shown = word.replace(" ", self.space) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokenize(shown)]).tobytes()

    def _lines(self, words: list[str]) -> list[bytes]:
        """The ids of each word; no word holds white space but a leading space."""
        if not words:
            return []
        line = np.frombuffer(self.line, self.kind)
        ids = np.array(self.model.encode("\n".join(words), add_special_tokens=False).ids, self.kind)
        cuts = np.flatnonzero(ids == line[0]) if len(line) == 1 else []
        if len(cuts) != len(words) - 1:
            return [self._ids(w) for w in words]
        width, data = self.kind.itemsize, ids.tobytes()
        edges = [-1, *cuts.tolist(), len(ids)]
        return [data[(a + 1) * width : b * width] for a, b in zip(edges, edges[1:], strict=False)]

    def _learn(self, pieces: set[str]) -> None:
        """A piece is what stands after a space, or a line break and what stands after it."""
        known, marks = self.known, self.marks
        others: list[tuple[str, str, bytes, bytes]] = []
        for p in pieces:
            head = tail = b""
            core, mark = p, p[-1:]
            if mark in marks and p[-2:-1].isalpha():
                core, tail = p[:-1], marks[mark]
            if core[:1] == "\n":
                core, head = core[1:], self.line
            if tail and not head and (ids := known.get(core)) is not None:
                known[p] = ids + tail
            elif core.isalpha() and (core.isascii() or max(core) < "\u0250"):
                known[p] = head + self._letters(core if head else " " + core) + tail
            elif core.split() == [core]:
                others.append((p, core if head else " " + core, head, tail))
            else:
                known[p] = None
        for (p, _, head, tail), ids in zip(others, self._lines([x[1] for x in others]), strict=True):
            known[p] = head + ids + tail

    def encode(self, text: str) -> bytes:
        first, *rest = text.replace("\n", " \n").split(" ")
        if first.split() == [first]:
            try:
                got = list(map(self.known.__getitem__, rest))
            except KeyError:
                wanted = set(rest)
                new = wanted.difference(self.known)
                if len(self.known) + len(new) > self.most:
                    self.known.clear()
                    new = wanted
                self._learn(new)
                got = list(map(self.known.__getitem__, rest))
            if None not in got:
                return self._ids(first) + b"".join(got) + self.end
        return self._ids(text) + self.end


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder for each worker process."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


# -- file format ---------------------------------------------------------------------------------


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    def __init__(self, sink, width: int, places: bool = False):
        self.sink, self.width, self.codec, self.skip = sink, width, pa.Codec("zstd", 1), 8 * places
        self.at = self.docs = self.ids = 0
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.keys: list[bytes] = []
        self.block, self.last = bytearray(), b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.keys or self.keys[-1] != key[self.skip :]:
            self.keys.append(key[self.skip :])
        self.last, self.docs, self.ids = key, self.docs + 1, self.ids + len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _close_block(self) -> None:
        packed = self.codec.compress(bytes(self.block), asbytes=True)
        self.index.append((self.last, self.at, len(packed), len(self.block), zlib.crc32(packed)))
        self._put(packed)
        self.block = bytearray()

    def close(self) -> None:
        if self.block:
            self._close_block()
        start = self.at
        for last, *place in self.index:
            self._put(_varint(len(last)) + last + ENTRY.pack(*place))
        index_size, bloom_at = self.at - start, self.at
        bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, np.uint8)
        for key in self.keys:
            bloom[_bloom_places(key, bits)] = 1
        self._put(np.packbits(bloom).tobytes())
        self._put(FOOTER.pack(start, index_size, bloom_at, bits, self.docs, self.ids, self.width, self.skip, MAGIC))


class ShardReader:
    """Reads a shard in order, or one document by Bloom filter and binary search."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        start, index_size, bloom_at, self.bits, self.docs, self.ids, self.width, self.skip, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri}: not a shard")
        self.kind, self.codec = np.dtype(f"<u{self.width}"), pa.Codec("zstd")
        data, at = self.file.read_at(index_size, start), 0
        self.last: list[bytes] = []
        self.place: list[tuple[int, int, int, int]] = []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.last.append(data[at : at + n])
            self.place.append(ENTRY.unpack_from(data, at + n))
            at += n + ENTRY.size
        self.bloom = self.file.read_at(self.bits // 8, bloom_at)

    def close(self) -> None:
        self.file.close()

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, packed_size, size, crc = self.place[i]
        packed = self.file.read_at(packed_size, at)
        if zlib.crc32(packed) != crc:
            raise ValueError("damaged block")
        data, at, key = self.codec.decompress(packed, decompressed_size=size, asbytes=True), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, np.frombuffer(data, self.kind, n // self.width, at)
            at += n

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.place)):
            for key, ids in self.block(i):
                yield id_of(key[self.skip :]), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this doc_id."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] & (0x80 >> (p & 7)) for p in _bloom_places(key, self.bits)):
            return []
        if self.skip:
            return [ids for i in range(len(self.place)) for k, ids in self.block(i) if k[self.skip :] == key]
        found, i = [], bisect.bisect_left(self.last, key)
        while i < len(self.place):
            entries = [(k, ids) for k, ids in self.block(i) if k == key]
            found += [ids for _, ids in entries]
            if self.last[i] > key:
                break
            i += 1
        return found


# -- Spark ---------------------------------------------------------------------------------------

MANIFEST = "shard int, path string, first_id long, last_id long, n_docs long, n_ids long"


def order_of_rows(docs: DataFrame) -> list[Column]:
    """What sorts rows as they stand: by file name and row for a table read from files (Spark names the files of
    a write by partition and reads them in another order), else by partition and row."""
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta["file_name"], meta["row_index"])
    except AnalysisException:
        return [F.monotonically_increasing_id()]
    return [meta["file_name"], meta["row_index"]]


def write_shards(docs: DataFrame, folder: str, make_encoder: Callable[[], Encoder], shards: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Write ``docs`` as shards below ``folder`` (a URI all executors share); returns the manifest.

    ``shards`` key ranges; by default as many as the size of the documents asks for, Spark's shuffle
    partitions at least. With ``order`` the documents follow it, through a shard and from shard to shard,
    in place of their ids; the manifest then has the least and the largest id of a shard.
    """
    by = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), *[c.alias(f"order_{i}") for i, c in enumerate(order or [])])
    if shards is None:
        shards = partitions(docs.sparkSession, max(size_of(docs) // SHARD_BYTES, docs.count() // SHARD_DOCS))
    if order:
        by = [F.col(c) for c in rows.columns[2:]]
        dealt = rows.repartitionByRange(shards, *by).sortWithinPartitions(*by).select("doc_id", "text")
    else:
        dealt = rows.repartitionByRange(shards, by[0]).sortWithinPartitions(*by)

    ordered = bool(order)

    def write(batches):
        coder, n = make_encoder(), TaskContext.get().partitionId()
        uri = f"{folder}/shard-{n:05d}-{uuid.uuid4().hex[:12]}.sst"
        out = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    system, path = fs.FileSystem.from_uri(uri)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    sink = system.open_output_stream(path)
                    out, first, last = ShardWriter(sink, coder.kind.itemsize, ordered), doc_id, doc_id
                place = struct.pack(">Q", out.docs) if ordered else b""
                out.add(place + key_of(doc_id), coder.encode(text.as_py()))
                first, last = min(first, doc_id, key=key_of), max(last, doc_id, key=key_of)
        if out is not None:
            out.close()
            sink.close()
            row = (n, uri, first, last, out.docs, out.ids)
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), *[pa.int64()] * 4), strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    return stored(dealt.mapInArrow(write, MANIFEST), "sst-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, position of every document, read from the files the manifest names:
    ``start`` ids and ``position`` documents are before it in them."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    placed = manifest.select("path", earlier("n_ids").alias("start"), earlier("n_docs").alias("position"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, position long"

    def read(batches):
        for batch in batches:
            for path, start, position in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard, rows = ShardReader(path), []
                for doc_id, ids in shard:
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), position))
                    start, position = start + len(ids), position + 1
                    if len(rows) == 10_000:
                        yield _digests(rows)
                        rows = []
                shard.close()
                if rows:
                    yield _digests(rows)

    return placed.repartition(max(1, manifest.count())).mapInArrow(read, schema)


def by_ids(read: DataFrame) -> DataFrame:
    """What ``read_shards`` returns of shards in another order, with ``start`` counted in the order of ids (equal
    ids: of the shards) and ``mix_start``, where the document's ids begin in the shards."""
    rows = read.withColumnRenamed("start", "mix_start")
    order = [F.col("doc_id").asc_nulls_first(), F.col("position")]
    rows = stored(rows.repartitionByRange(partitions(read.sparkSession, 1), *order).withColumn("bucket", F.spark_partition_id()), "sst-by-ids")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    ahead = rows.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = (F.col("ahead") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).cast("long")
    return rows.join(ahead, "bucket").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32", "position", "mix_start")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "position"])


def lookup(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """The ids of every row with this doc_id: manifest rows whose range holds it, then each file's index."""
    if doc_id is None:
        hit = manifest.where(F.col("first_id").isNull())
    else:
        hit = manifest.where((F.col("first_id").isNull() | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id))
    found = []
    for row in hit.orderBy("shard").collect():
        shard = ShardReader(row.path)
        found += shard.get(doc_id)
        shard.close()
    return found
