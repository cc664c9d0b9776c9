"""Words of many texts at once: places and 64-bit hashes, by numpy over one buffer.

A word's hash is the sum of random numbers chosen by (place in the word, byte), so different words of up to 64 bytes
share a hash with probability 2^-64; longer words are hashed whole by BLAKE2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_PLACES = 64
_TABLE = np.random.default_rng(20240229).integers(0, 2**64, (_PLACES, 256), dtype=np.uint64)
_STEPS = np.random.default_rng(20240301).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes of words: all but white space; letters, digits and what isn't ASCII.
INK = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
ALNUM = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """Words of ``texts`` (bytes, ASCII letters lowered here unless told not to): data, starts, ends, hashes, and first word by text (len + 1)."""

    def __init__(self, texts: list[bytes], table: np.ndarray, lower: bool = True):
        self.data = b" " + b" ".join(texts) + b" "
        self.data = self.data.lower() if lower else self.data
        raw = np.frombuffer(self.data, np.uint8)
        inside = table[raw]
        turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = turn[::2], turn[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])
        self.first = np.searchsorted(self.starts, begins)
        n = len(self.starts)
        if n:
            size = self.ends - self.starts
            at = np.repeat(self.starts, size)  # first byte of the word of each word byte
            place = np.flatnonzero(inside)
            values = _TABLE.ravel()[((place - at) & (_PLACES - 1)) * 256 + raw[place]]
            self.hashes = np.add.reduceat(values, np.concatenate([[0], np.cumsum(size)[:-1]]))
            for i in np.flatnonzero(size > _PLACES):
                word = self.data[self.starts[i] : self.ends[i]]
                self.hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        else:
            self.hashes = np.zeros(0, np.uint64)

    def windows(self, k: int) -> np.ndarray:
        """Hashes of k consecutive words from each word on, whatever text they are in (length n - k + 1, or 0)."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = self.hashes[:n] * _STEPS[0]
        for j in range(1, k):
            total = total + self.hashes[j : j + n] * _STEPS[j]
        return mix(total + np.uint64(k))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows and about ``most`` bytes, so that Python objects are made for those alone."""
    for batch in batches:
        step = max(1, min(rows, most * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def blocks(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive runs of texts of about ``most`` bytes, so that arrays stay in cache and memory stays bounded; with the first index."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]
