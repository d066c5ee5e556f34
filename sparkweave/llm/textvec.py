"""Texts as arrays: hashes of character n-grams, words and word windows of many texts at once, with numpy.

Everything runs over groups of neighbouring texts instead of single ones. A group holds about
``max_chars`` characters, so that its arrays stay small; only a single longer text makes a larger group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U32, U64 = np.uint32, np.uint64
BASE = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finalizer of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def portions(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches cut small, so that only a few texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def groups(texts: list, max_chars: int = 1 << 18) -> Iterator[tuple[int, list]]:
    """Where a group starts, and its texts."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > max_chars:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, texts[start:]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a zero, and where each text starts (one more at the end)."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), U32)
    return codes, np.concatenate([[0], np.cumsum(lengths)])


def char_ngrams(codes: np.ndarray, n: int, bits: int, seed: int = 0) -> np.ndarray:
    """Hash, below 2 ** bits, of the n code points that start at each place; the last n - 1 have none."""
    size = max(0, len(codes) - n + 1)
    h = np.full(size, n + (seed << 8), U32)
    for j in range(n):
        h = h * U32(0x9E3779B1) + codes[j : j + size]
    h ^= h >> U32(15)
    h *= U32(0x85EBCA6B)
    h ^= h >> U32(13)
    h *= U32(0xC2B2AE35)
    return h >> U32(32 - bits)


def sums_by_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the values at each text's places; ``starts`` as from code_points."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[np.minimum(starts[1:], len(values))] - total[np.minimum(starts[:-1], len(values))]


_BYTES = mix(np.arange(1, 257, dtype=U64))


def stretch_hashes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the stretches (none empty) that make up ``data``, an array of small numbers."""
    if not len(lengths):
        return np.zeros(0, U64)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, lengths)
    powers = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(int(lengths.max()), BASE, U64)]))
    return mix(np.add.reduceat(data * powers[place], starts) + lengths.astype(U64))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of many texts (UTF-8): their hashes and the texts they belong to."""

    def __init__(self, texts: list[bytes]):
        self.lists = [t.split() for t in texts]
        self.counts = np.fromiter((len(w) for w in self.lists), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        flat = [w for words in self.lists for w in words]
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        self.hashes = stretch_hashes(_BYTES[np.frombuffer(b"".join(flat), np.uint8)], lengths)
        self.text = np.repeat(np.arange(len(texts)), self.counts)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each place, and whether they lie in one text."""
        size = max(0, len(self.hashes) - n + 1)
        h = np.zeros(size, U64)
        for j in range(n):
            h = h * BASE + self.hashes[j : j + size]
        return mix(h), self.text[:size] == self.text[n - 1 : n - 1 + size]
