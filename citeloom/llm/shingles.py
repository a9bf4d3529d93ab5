"""Word shingles as 64-bit hashes, many texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

#: One odd multiplier for each place of a shingle; fixed values.
PLACES = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)
CHUNK_BYTES = 1 << 20


class WordHash(dict):
    """Word to 64-bit hash; forgets everything at a fixed size."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHash()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (in place)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def chunked(texts: Iterable[str | None], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts as bytes) in runs of about ``most`` bytes; null reads as empty."""
    run: list[bytes] = []
    start = size = 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        run.append(data)
        size += len(data)
        if size >= most:
            yield start, run
            run, size, start = [], 0, i + 1
    if run:
        yield start, run


def flat_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in a row, and where each text begins (one more at the end)."""
    parts = [t.split() for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    flat = np.fromiter((_words[w] for p in parts for w in p), np.uint64, int(starts[-1]))
    return flat, starts


def flat_shingles(flat: np.ndarray, starts: np.ndarray, width: int = 5, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row, and where each text's shingles begin.

    A text with fewer words than ``width`` has one shingle, all its words, or none if it has no word
    (or if ``whole_if_short`` is false).
    """
    lengths = np.diff(starts)
    counts = np.maximum(lengths - width + 1, 0)
    short = (lengths > 0) & (lengths < width) if whole_if_short else np.zeros(len(lengths), bool)
    counts = counts + short
    begins = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=begins[1:])
    at = np.arange(begins[-1]) - np.repeat(begins[:-1] - starts[:-1], counts)
    if not len(at):
        return np.zeros(0, np.uint64), begins
    padded = np.concatenate([flat, np.zeros(width, np.uint64)])
    h = np.zeros(len(at), np.uint64)
    limit = np.repeat(starts[1:], counts) if short.any() else None
    for j in range(width):
        value = padded[at + j] * PLACES[j]
        if limit is not None:  # places beyond a short text count as empty
            value[at + j >= limit] = 0
        h += value
    return mixed(h), begins


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (a plain sort is many times faster here than numpy's hashing unique)."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]
