"""Vectorised word hashing: a batch of texts becomes flat numpy arrays.

A word is a maximal run of bytes above 0x20 of the lower-cased UTF-8 text, so
that every kind of ASCII white space separates; with plain, ASCII punctuation
separates as well.  Work is done over slices of
whole texts of about SLICE bytes; a longer text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SLICE = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size <= 4 * SLICE:
            _powers[base] = have
    return have[:n]


_INVERSE = {int(_BASE): pow(int(_BASE), -1, 2**64)}


def segments(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end], independent of the place."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _powers_of(int(_BASE), n), out=sums[1:])
    return (sums[end] - sums[start]) * _powers_of(_INVERSE[int(_BASE)], n + 1)[start]


def power(n: np.ndarray) -> np.ndarray:
    """The factor by which a polynomial hash is moved n values on."""
    return _powers_of(int(_BASE), int(n.max(initial=0)) + 1)[n]


@dataclass
class Words:
    """Words of a slice of texts; word i belongs to text doc[i] and is word pos[i] of it."""

    first: int
    count: np.ndarray
    begin: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: bytes

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows and the index of their first word; none crosses two texts."""
        n = len(self.hash)
        if n < k:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        left = np.repeat(self.begin + self.count, self.count)
        at = np.flatnonzero(np.arange(n) + k <= left)
        return mix(segments(self.hash, at, at + k)), at

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, joined by one blank."""
        return b" ".join(self.data[self.start[i] : self.end[i]] for i in range(a, b))


_PLAIN = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


def words(texts: list[str | None], plain: bool = False) -> Iterator[Words]:
    """Slices of the texts, in order; null counts as empty."""
    at, n = 0, len(texts)
    while at < n:
        part, size, first = [], 0, at
        while at < n and (not part or size < SLICE):
            t = (texts[at] or "").lower().encode("utf-8", "replace")
            if plain:
                t = t.translate(_PLAIN)
            part.append(t)
            size += len(t) + 1
            at += 1
        yield _slice(first, part)


def _slice(first: int, part: list[bytes]) -> Words:
    data = b"\n".join(part) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    inside = raw > 0x20
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in part])
    upto = np.searchsorted(start, ends, side="left")
    count = np.diff(np.concatenate(([0], upto)))
    hashes = mix(segments(_BYTE[raw], start, end)) if len(start) else np.empty(0, np.uint64)
    return Words(first, count, upto - count, hashes, start, end, data)
