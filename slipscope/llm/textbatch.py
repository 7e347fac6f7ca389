"""Words, tokens and their hashes for a batch of texts at once, on arrays of bytes.

Hashes are 64-bit: a polynomial over the bytes of a word with random byte values, then a finalizer. Everything is
seeded by fixed values, so that all tasks agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
#: Bytes hashed at a time, to bound memory.
PORTION = 1 << 20
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_TABLES = [_RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1) for _ in range(2)]
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_POWERS: dict[int, np.ndarray] = {}

#: The white space of the contracts: blank and the bytes 9 to 13.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(which: int, n: int) -> np.ndarray:
    have = _POWERS.get(which)
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        steps = np.full(size, _BASES[which], np.uint64)
        steps[0] = 1
        have = _POWERS[which] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@dataclass
class Words:
    """Words of a batch, in order. data: all texts' bytes, each text followed by one blank."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    #: Index of the first word of each text, and one more.
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        """One hash for each word; which: 0 or 1, two independent functions. Works on about PORTION bytes at a time."""
        lengths = self.end - self.begin
        out = np.empty(len(lengths), np.uint64)
        if not len(lengths):
            return out
        table, power = _TABLES[which], powers(which, int(lengths.max()) + 1)
        ends = np.cumsum(lengths)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]), PORTION), "left"))
        for lo, hi in zip(cuts, [*cuts[1:], len(lengths)]):
            n = lengths[lo:hi]
            from_ = np.cumsum(n) - n
            at = np.arange(int(n.sum())) - np.repeat(from_, n)
            values = table[self.data[np.repeat(self.begin[lo:hi], n) + at]] * power[at]
            out[lo:hi] = mix(np.add.reduceat(values, from_) + n.astype(np.uint64))
        return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, a blank after each text; and where each text begins, and one more."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8) if texts else np.empty(0, np.uint8)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return data, offsets


def words(texts: list[bytes], lower: bool = False) -> Words:
    """Runs of bytes other than white space."""
    data, offsets = joined(texts)
    if lower:
        data = LOWER[data]
    return runs(data, offsets, ~WHITE[data])


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Words(data, begin, end, np.searchsorted(begin, offsets))


def windows(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hashes of k consecutive values each, by doubling; len(h) - k + 1 of them, across texts too."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = _BASES[which] ^ 0x5851F42D4C957F2D | 1
    total, done, block, size = None, 0, h, 1
    while True:
        if k & size:
            part = block[done : done + n]
            total = part.copy() if total is None else total * U(pow(base, size, 2**64)) + part
            done += size
        if 2 * size > k:
            return mix(total + U(k))
        block = block[: len(block) - size] * U(pow(base, size, 2**64)) + block[size:]
        size *= 2


def within(first: np.ndarray, k: int) -> np.ndarray:
    """Which of the windows over the words of a batch lie in one text."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.zeros(n, bool)
    counts = np.maximum(np.diff(first) - k + 1, 0)
    at = np.repeat(first[:-1], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    ok[at] = True
    return ok


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; first: index of its first value, and one more."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in texts]
