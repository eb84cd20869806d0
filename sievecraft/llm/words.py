"""Words of many texts at once, as numpy arrays over one byte buffer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: ASCII white space: 20 and 09 to 0D; words are maximal runs of other bytes of UTF-8.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = np.ones(1, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> np.ndarray:
    """0..n-1-th powers of an odd number modulo 2^64; kept and grown on demand."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 256), _BASE, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """buffer: all words, each with one space behind it; start, end: offsets of words; first: of each text, its first word, with the total at the end."""

    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        size = self.end - self.start
        place = np.arange(len(self.buffer), dtype=np.int32) - np.repeat(self.start.astype(np.int32), size + 1)
        value = _BYTE[self.buffer]
        value *= powers(int(size.max()) + 1)[place]
        value[self.end] = 0  # the space behind a word
        return mix(np.add.reduceat(value, self.start))


def split_words(texts: list[bytes]) -> Words:
    """Words of each text; white space between them becomes one space."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = SPACE[data]
    after = np.empty(len(data), dtype=bool)  # the byte before is part of a word
    after[0] = False
    np.logical_not(space[:-1], out=after[1:])
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    keep = ~space | after
    buffer = data[keep]
    gap = space[keep]
    buffer[gap] = 32
    end = np.flatnonzero(gap)
    start = np.r_[0, end[:-1] + 1] if len(end) else end
    place = np.r_[0, np.cumsum(keep)]
    return Words(buffer, start, end, np.searchsorted(start, place[bounds]))


def chunks(rows: Iterator, size, most: int = 1 << 21, most_rows: int = 4096) -> Iterator[list]:
    """Lists of rows of about ``most`` bytes together; a longer row is a list of its own."""
    out, total = [], 0
    for r in rows:
        n = size(r)
        if out and (total + n > most or len(out) >= most_rows):
            yield out
            out, total = [], 0
        out.append(r)
        total += n
    if out:
        yield out
