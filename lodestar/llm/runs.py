"""Runs of equal keys in sorted Arrow batches, and pairs within runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole(batches: Iterator[pa.RecordBatch], key: str = "key") -> Iterator[pa.Table]:
    """The batches, sorted by key, regrouped so that no run of a key is divided."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b[key].to_numpy(zero_copy_only=False)
        if held and held[-1][key][-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        at = int(np.searchsorted(k, k[-1], side="left"))
        if at:
            yield pa.Table.from_batches([*held, b.slice(0, at)])
            held = []
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def bounds(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else np.zeros(1, np.int64)


def _within(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of equal keys; key is sorted.  One step for each distance j - i."""
    i, d, n = np.arange(len(key)), 1, len(key)
    while len(i):
        i = i[: np.searchsorted(i, n - d)]
        i = i[key[i] == key[i + d]]
        if len(i):
            yield i, i + d
        d += 1


def cross(key: np.ndarray, part: np.ndarray, small: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of equal key and different part, both sorted; pairs of one part cost nothing in large runs."""
    edge = bounds(key)
    if len(edge) < 2:
        return
    a, z = edge[:-1], edge[1:]
    mixed = part[a] != part[z - 1]
    few = mixed & (z - a <= small)
    own = np.flatnonzero(np.repeat(few, z - a))
    for i, j in _within(key[own]):
        i, j = own[i], own[j]
        other = part[i] != part[j]
        if other.any():
            yield i[other], j[other]
    for b, e in zip(a[mixed & ~few].tolist(), z[mixed & ~few].tolist(), strict=True):
        inner = (bounds(part[b:e]) + b).tolist()
        for x, y in zip(inner[:-2], inner[1:-1], strict=True):
            for row in range(x, y, step := max(1, 1_000_000 // (e - y))):
                i, j = np.meshgrid(np.arange(row, min(y, row + step)), np.arange(y, e), indexing="ij")
                yield i.ravel(), j.ravel()
