"""N-gram Jaccard join by chosen paths.

Identical texts form a class; only one of them is joined. A class's set is its five-word shingles.
In each run a hash picks every shingle of a set x with probability 1 / (threshold * |x|); classes that
picked the same shingle in a run share a bucket. Two sets at the threshold share one pick a run on
average, so they share none with probability 1/e at most. A bucket over ``SMALL`` classes is split by
the shingles that its members pick with the run's next hash, and so on; what is still large at the
last level is compared block by block against block. Runs are repeated until a pair that meets in
hot buckets on every level is found with the target recall. Inside buckets, sketches of one-permutation minima keep the pairs that can be alike; they
become forests of candidate edges, linear in the rows, never lists of all pairs.

Every two classes of a candidate component that are alike in size are then compared exactly, in
blocks of one size class each; a block pair returns link counts and a spanning forest of its links. So
links between different texts are counted in full while the rows stay linear.

Defined results: null text reads as empty; a text with one to four words is one shingle of all its
words; texts without words have no links, equal ones still form a class; rows that repeat a doc_id
are documents of their own, and one id may have several texts; class and group ids are the smallest
doc_id, null only if no member has one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, log, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import dropped, stored, text_of, tidy
from citeloom.llm.components import components, tree_edges
from citeloom.llm.shingles import chunked, distinct, flat_shingles, flat_words, mixed

THRESHOLD = 0.8
RECALL = 0.9995
DEEP = (6.0, 5.0)  # picks expected at the levels below the first
SMALL = 4096
BLOCK = 256
BINS = 32
SLACK = 0.35  # how far a sketch's estimate may fall below the threshold; over five standard deviations

_ODD = (np.random.default_rng(6).integers(1, 2**62, 256, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD) -> int:
    """Runs after which a pair at the threshold was missed with probability 1 - recall at most, even if
    all buckets that it shares are split on every level. Of c picks expected, it shares c * threshold."""
    found = (1 - exp(-1)) * prod(1 - exp(-c * threshold) for c in DEEP)
    return ceil(log(1 - recall) / log(1 - found))


def picked(s: np.ndarray, which: int, expected: float) -> np.ndarray:
    """The shingles that hash number ``which`` picks from a set, ``expected`` of them on average."""
    h = s * _ODD[which]
    h ^= h >> np.uint64(31)
    h *= _ODD[which ^ 128]
    share = expected / max(1, len(s))
    return s if share >= 1 else s[h < np.uint64(int(share * 2**64))]


def sketch(s: np.ndarray) -> bytes:
    """The smallest hash of each of BINS bins, one byte each; 0 marks an empty bin."""
    g = np.sort(mixed(s ^ np.uint64(0x5851F42D4C957F2D)))
    edge = np.arange(BINS, dtype=np.uint64) << np.uint64(59)
    at = np.searchsorted(g, edge)
    found = g[np.minimum(at, len(g) - 1)]
    return np.where((at < len(g)) & (found >> np.uint64(59) == edge >> np.uint64(59)), 1 + (found >> np.uint64(3)) % np.uint64(255), 0).astype(np.uint8).tobytes()


def alike(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (sketches, set sizes) can reach the threshold."""
    same = np.zeros((len(a), len(b)), np.int16)
    either = np.zeros((len(a), len(b)), np.int16)
    for k in range(BINS):
        x, y = a[:, k, None], b[None, :, k]
        same += (x == y) & (x != 0)
        either += (x != 0) | (y != 0)
    near = same >= (threshold - SLACK) * either
    return near & (np.minimum(na[:, None], nb[None, :]) >= threshold * np.maximum(na[:, None], nb[None, :]))


def signatures(docs: DataFrame, threshold: float, runs: int) -> DataFrame:
    """doc_id, key, node, size, sketch, picks (first-level paths), deep (picks below): one row a document."""
    key = F.unhex(F.md5(text_of(docs)))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), key.alias("key"), text_of(docs).alias("text"))

    def sign(batches):
        for batch in batches:
            out = []
            for _, texts in chunked(batch.column(2).to_pylist()):
                shingles, begins = flat_shingles(*flat_words(texts))
                for a, b in zip(begins, begins[1:], strict=False):
                    s = distinct(shingles[a:b])
                    if not len(s):
                        out.append((0, b"", [], b""))
                        continue
                    first = [mixed(picked(s, r, 1 / threshold) ^ _ODD[64 + r]) for r in range(runs)]
                    paths = [np.stack([p, np.full(len(p), r, np.uint64)], 1) for r, p in enumerate(first)]
                    deep = [picked(s, 16 * (level + 1) + r, c) for level, c in enumerate(DEEP) for r in range(runs)]
                    head = np.array([len(d) for d in deep], np.uint16).tobytes()
                    out.append((len(s), sketch(s), np.concatenate(paths).tobytes(), head + np.concatenate(deep).tobytes()))
            size, sk, paths, deep = zip(*out, strict=True) if out else ((), (), (), ())
            node = [int.from_bytes(k[:8], "little", signed=True) for k in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [
                    batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(sk, pa.binary()),
                    pa.array([p or b"" for p in paths], pa.binary()), pa.array(deep, pa.binary()),
                ],
                names=["doc_id", "key", "node", "size", "sketch", "picks", "deep"],
            )

    return stored(rows.mapInArrow(tidy(sign), "doc_id long, key binary, node long, size int, sketch binary, picks binary, deep binary"), "join-signatures")


ROW = "path long, run int, node long, size int, sketch binary"


def _first_paths(batches):
    for batch in batches:
        node, size, sk, blobs = (batch.column(i) for i in range(4))
        parts = [np.frombuffer(x.as_py(), np.uint64).reshape(-1, 2) for x in blobs]
        at = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        if len(at):
            yield _rows(np.concatenate(parts), at, node, size, sk)


def _rows(paths: np.ndarray, at: np.ndarray, node, size, sk) -> pa.RecordBatch:
    take = pa.array(at)
    return pa.record_batch(
        [pa.array(paths[:, 0].astype(np.int64)), pa.array(paths[:, 1].astype(np.int32)), node.take(take), size.take(take), sk.take(take)],
        names=["path", "run", "node", "size", "sketch"],
    )


def _deeper(level: int, runs: int):
    """The next level's rows of rows (path, run, node, size, sketch, deep)."""

    def go(batches):
        for batch in batches:
            path, run = batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy()
            salt = path * np.uint64(3)
            parts, at = [], []
            for i, blob in enumerate(batch.column(5)):
                data, n = blob.as_py(), len(DEEP) * runs
                counts = np.frombuffer(data, np.uint16, n).astype(np.int64)
                k = level * runs + int(run[i])
                own = np.frombuffer(data, np.uint64, int(counts[k]), 2 * n + 8 * int(counts[:k].sum()))
                parts.append(np.stack([mixed(own ^ salt[i]), np.full(len(own), run[i], np.uint64)], 1))
                at.append(np.full(len(own), i))
            if sum(map(len, parts)):
                yield _rows(np.concatenate(parts), np.concatenate(at), *(batch.column(i) for i in (2, 3, 4)))

    return go


def _groups(batches, keys: int, least: int = 1) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows that agree in the first ``keys`` columns, ``least`` of them or more."""
    held, now, n = [], None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], 1)
        cuts = np.concatenate([[0], np.flatnonzero((cols[1:] != cols[:-1]).any(1)) + 1, [len(cols)]])
        ends = np.diff(cuts) >= least
        ends[[0, -1]] = True  # these may go on in the batches before and after
        for a, b in zip(cuts[:-1][ends].tolist(), cuts[1:][ends].tolist(), strict=True):
            k = tuple(cols[a].tolist())
            if now is not None and k != now:
                if n >= least:
                    yield now, pa.Table.from_batches(held)
                held, n = [], 0
            now, n = k, n + b - a
            held.append(batch.slice(a, b - a))
    if now is not None and n >= least:
        yield now, pa.Table.from_batches(held)


def _sketches(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _candidate_edges(threshold: float, keys: int):
    def find(batches):
        a, b = [], []
        for key, table in _groups(batches, keys, least=2):
            node, size, sk = table.column("node").to_numpy(), table.column("size").to_numpy(), _sketches(table)
            node, first = np.unique(node, return_index=True)
            size, sk, label = size[first], sk[first], np.arange(len(node))
            left = right = np.arange(len(node))
            if keys == 3 and key[1] != key[2]:
                block = table.column("block").to_numpy()[first]
                left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
            for at in range(0, len(left), 256):
                part = left[at : at + 256]
                near = alike(sk[part], sk[right], size[part], size[right], threshold)
                for i, j in tree_edges(near, part, right, label):
                    a.append(node[i])
                    b.append(node[j])
            if len(a) > 50_000:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=EDGE)
                a, b = [], []
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=EDGE)

    return find


def _block_pairs(rows: DataFrame, count: str, size: int, by: str) -> DataFrame:
    """Deal the rows of each large group ``by`` into blocks and give each row to every pair of blocks its
    block is in: columns by, lo, hi, block and the others."""
    blocks = F.ceil(F.col(count) / size).cast("long")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("other", other)
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    return rows.select(by, lo.alias("lo"), hi.alias("hi"), "block", *[c for c in rows.columns if c not in (by, "block", "blocks", "other", count)])


def candidates(classes: DataFrame, threshold: float, runs: int) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b) between classes that can be alike: forests of each bucket's pairs. And the steps they are in.

    Only the paths of large buckets are told apart beforehand, and they are few: all other rows are shuffled once,
    and rows that share a path with none cost no join.
    """
    rows = classes.where("size > 0").select("node", "size", "sketch", "picks").mapInArrow(tidy(_first_paths), ROW)
    found, steps = [], []
    for level in range(len(DEEP) + 1):
        crowded = stored(rows.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > SMALL), "join-crowded")
        steps.append(crowded)
        some = crowded.limit(1).count()
        small = (rows.join(crowded, "path", "left_anti") if some else rows).select("path", "node", "size", "sketch")
        small = small.repartition("path").sortWithinPartitions("path")
        found.append(stored(small.mapInArrow(tidy(_candidate_edges(threshold, 1)), "a long, b long"), "join-edges"))
        if not some:
            break
        large = stored(rows.join(crowded, "path").select("path", "run", "node", "size", "sketch", "n"), "join-buckets")
        steps.append(large)
        if level < len(DEEP):
            deep = large.join(classes.select("node", "deep"), "node").select("path", "run", "node", "size", "sketch", "deep")
            rows = stored(deep.mapInArrow(tidy(_deeper(level, runs)), ROW), "join-deeper")
            steps.append(rows)
        else:
            dealt = _block_pairs(large.drop("run"), "n", SMALL // 2, "path").repartition("path", "lo", "hi").sortWithinPartitions("path", "lo", "hi")
            found.append(stored(dealt.mapInArrow(tidy(_candidate_edges(threshold, 3)), "a long, b long"), "join-edges"))
    dropped(*steps)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.distinct(), found


def _shared(sets: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of ``sets`` with ``right``."""
    flat = np.concatenate(sets + right)
    values, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # what only one set has is in no intersection
    keep = (times > 1)[inverse]
    owner = np.repeat(np.arange(len(sets) + len(right)), [len(s) for s in sets + right])[keep]
    column = number[inverse[keep]]
    out = np.zeros((len(sets), len(right)), np.float32)
    step = 4096
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, step):
        lo, hi = np.searchsorted(column, [a, a + step])
        x = np.zeros((len(sets) + len(right), step), np.float32)
        x[owner[lo:hi], column[lo:hi] - a] = 1
        out += x[: len(sets)] @ x[len(sets) :].T
    return out


LINK = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])


def _links(threshold: float):
    """Rows (node, null, links counted here) and (node, other, null) of a forest, for groups (label, lo, hi)."""

    def find(batches):
        for key, table in _groups(batches, 3):
            node = table.column("node").to_numpy()
            node, first = np.unique(node, return_index=True)
            sets = [np.frombuffer(table.column("set")[int(i)].as_py(), np.uint64) for i in first]
            left = right = np.arange(len(node))
            if key[1] != key[2]:
                block = table.column("block").to_numpy()[first]
                left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
            if not len(left) or not len(right):
                continue
            shared = _shared([sets[i] for i in left], [sets[i] for i in right])
            size = np.array([len(s) for s in sets], np.float64)
            both = size[left][:, None] + size[right][None, :] - shared
            linked = (shared >= threshold * both) & (left[:, None] != right[None, :])
            n = np.zeros(len(node), np.int64)
            n[left] += linked.sum(1)
            if key[1] != key[2]:
                n[right] += linked.sum(0)
            edges = [(node[i], node[j]) for i, j in tree_edges(linked, left, right, np.arange(len(node)))]
            some = np.flatnonzero(n)
            yield pa.record_batch(
                [
                    pa.array([*node[some], *(a for a, _ in edges)], pa.int64()),
                    pa.array([*[None] * len(some), *(b for _, b in edges)], pa.int64()),
                    pa.array([*n[some], *[None] * len(edges)], pa.int64()),
                ],
                schema=LINK,
            )

    return find


def _sets(batches):
    """label, block, others, node, set of rows with a text in place of the set; rows of one text next to each
    other count once."""
    last = None
    for batch in batches:
        node = batch.column(3).to_pylist()
        new = [a != b for a, b in zip([last, *node], node, strict=False)]
        last = node[-1] if node else last
        batch = batch.filter(pa.array(new, pa.bool_()))
        sets = []
        for _, texts in chunked(batch.column(4).to_pylist()):
            shingles, begins = flat_shingles(*flat_words(texts))
            sets += [distinct(shingles[a:b]).tobytes() for a, b in zip(begins, begins[1:], strict=False)]
        yield pa.record_batch([*(batch.column(i) for i in range(4)), pa.array(sets, pa.binary())], names=["label", "block", "others", "node", "set"])


def _size_class(size: Column, threshold: float) -> Column:
    """Sets at the threshold are in the same class or in neighbouring ones (a little wider, for rounding)."""
    return F.floor(F.log(size.cast("double")) / (1.000001 * log(1 / threshold))).cast("long")


def _placed(members: DataFrame) -> DataFrame:
    """members (label, n, k, node and others) with their block and the blocks it is compared with: a small
    component is one block; a large one has blocks in each size class, compared if their classes are the
    same or neighbours."""
    counts = members.where(F.col("n") > BLOCK).groupBy("label", "k").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    counts = counts.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("k", "blocks"))).alias("blocks"))  # a few dozen classes at most
    code = lambda k, h: k * (1 << 32) + h
    own = code(F.col("k"), F.pmod(F.xxhash64("node"), F.try_element_at("blocks", F.col("k"))))
    none = F.array().cast("array<bigint>")

    def near(step: int) -> Column:
        k = F.col("k") + step
        n = F.try_element_at("blocks", k)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda h: code(k, h))).otherwise(none)

    whole = F.lit(0).cast("long")
    others = F.when(F.col("n") > BLOCK, F.concat(near(-1), near(0), near(1))).otherwise(F.array(whole))
    placed = members.join(counts, "label", "left").withColumns({"block": F.when(F.col("n") > BLOCK, own).otherwise(whole), "others": others})
    return placed.drop("n", "k", "blocks")


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, key, class_id, n_copies, n_links, group_id, group_key of every document.

    class_id: the smallest id among equal texts, n_copies: how many have it; n_links: how many other
    texts are at the threshold or above; group_id: the smallest id among all that links connect, and
    group_key: the key of one class of the group that has it.
    """
    runs = runs_for(recall, threshold)
    signed = signatures(docs, threshold, runs)
    first = F.min_by(F.struct("node", "size", "sketch", "picks", "deep"), F.struct("doc_id"))
    classes = signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), first.alias("s"))
    classes = stored(classes.select("key", "rep", "n_copies", "s.*"), "join-classes")

    edges, steps = candidates(classes, threshold, runs)
    labels = components(edges)
    dropped(*steps)
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    members = labels.join(sizes, "label").join(classes.select("node", "rep", "key", _size_class(F.col("size"), threshold).alias("k")), "node")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    wanted = F.expr("doc_id <=> rep") & (F.unhex(F.md5("text")) == F.col("key"))
    rows = texts.join(_placed(members), wanted).select("label", "block", "others", "node", "text")
    sets = rows.mapInArrow(tidy(_sets), "label long, block long, others array<long>, node long, set binary").withColumn("other", F.explode("others"))
    dealt = sets.select("label", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "set")
    dealt = dealt.repartition("label", "lo", "hi").sortWithinPartitions("label", "lo", "hi")
    links = stored(dealt.mapInArrow(tidy(_links(threshold)), "node long, other long, n long"), "join-links")

    degree = links.where("other is null").groupBy("node").agg(F.sum("n").alias("n_links"))
    groups = components(links.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    lead = F.min_by(F.struct("rep", "key"), F.struct(F.col("rep").isNull(), "rep", "key")).alias("lead")
    lowest = groups.join(classes.select("node", "rep", "key"), "node").groupBy("label").agg(lead)
    per_node = groups.join(lowest, "label").select("node", "lead")
    full = classes.select("key", "node", F.col("rep").alias("class_id"), "n_copies").join(degree, "node", "left").join(per_node, "node", "left")
    lead = F.coalesce("lead", F.struct(F.col("class_id").alias("rep"), "key"))
    full = full.select("key", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), lead["rep"].alias("group_id"), lead["key"].alias("group_key"))
    full = stored(full, "join-full")
    dropped(classes, links)
    return signed.select("doc_id", "key").join(full, "key").select("doc_id", "key", "class_id", "n_copies", "n_links", "group_id", "group_key")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group, with the same columns: of the class that leads it, the row with the
    smallest doc_id; among rows with that id and text, the first by all other columns."""
    found = join(docs, threshold)
    lead = F.expr("doc_id <=> group_id") & (F.col("key") == F.col("group_key"))
    kept = found.where(lead).select(F.col("doc_id").alias("__j_id"), F.col("key").alias("__j_key")).distinct()
    keyed = docs.withColumn("__j_hash", F.unhex(F.md5(text_of(docs))))
    rows = keyed.join(kept, F.expr("doc_id <=> __j_id") & (F.col("__j_hash") == F.col("__j_key")))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    once = Window.partitionBy("__j_key").orderBy(F.to_json(F.struct(*rest)) if rest else F.lit(1))
    return rows.withColumn("__j_n", F.row_number().over(once)).where("__j_n = 1").select(*[keyed[c] for c in docs.columns])
