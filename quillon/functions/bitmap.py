"""Compressed bitmaps over integer codes, in containers of 65,536.

A container holds a sorted array of its low 16 bits while it has few members and 1,024 packed 64-bit words when it has
many, the layout published as Roaring bitmaps.
"""

from __future__ import annotations

import numpy as np

#: Members from which the packed words are smaller than the sorted array.
DENSE = 4096
_WORDS = 1024


def _pack(low: np.ndarray) -> np.ndarray:
    bits = np.zeros(_WORDS * 64, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _members(container: np.ndarray) -> np.ndarray:
    if container.dtype == np.uint16:
        return container
    return np.flatnonzero(np.unpackbits(container.view(np.uint8), bitorder="little")).astype(np.uint16)


def _shrink(words: np.ndarray) -> np.ndarray | None:
    n = int(np.bitwise_count(words).sum())
    return None if n == 0 else _members(words) if n < DENSE else words


class Bitmap:
    """A set of non-negative integers."""

    def __init__(self, containers: dict[int, np.ndarray] | None = None) -> None:
        self.containers = containers or {}

    @classmethod
    def of(cls, values: np.ndarray) -> Bitmap:
        """From integers in any order, repeated ones included."""
        unique = np.unique(values)
        if not len(unique):
            return cls()
        high = unique >> 16
        names, starts = np.unique(high, return_index=True)
        ends = [*starts[1:], len(unique)]
        low = (unique & 0xFFFF).astype(np.uint16)
        return cls({int(h): _pack(low[s:e]) if e - s >= DENSE else low[s:e] for h, s, e in zip(names, starts, ends, strict=True)})

    def _with(self, other: Bitmap, words_op, keep_left: bool, array_op) -> Bitmap:
        out = {}
        for h in self.containers.keys() | (other.containers.keys() if array_op is np.union1d else set()):
            a, b = self.containers.get(h), other.containers.get(h)
            if a is None or b is None:
                kept = (a if a is not None else b) if keep_left else None
            elif a.dtype == np.uint16 and b.dtype == np.uint16:
                kept = array_op(a, b)
                kept = None if not len(kept) else _pack(kept) if len(kept) >= DENSE else kept
            else:
                kept = _shrink(words_op(a if a.dtype == np.uint64 else _pack(a), b if b.dtype == np.uint64 else _pack(b)))
            if kept is not None:
                out[h] = kept
        return Bitmap(out)

    def __or__(self, other: Bitmap) -> Bitmap:
        return self._with(other, np.bitwise_or, True, np.union1d)

    def __and__(self, other: Bitmap) -> Bitmap:
        return self._with(other, np.bitwise_and, False, lambda a, b: np.intersect1d(a, b, assume_unique=True))

    def and_not(self, other: Bitmap) -> Bitmap:
        return self._with(other, lambda a, b: a & ~b, True, lambda a, b: np.setdiff1d(a, b, assume_unique=True))

    def __len__(self) -> int:
        return sum(len(c) if c.dtype == np.uint16 else int(np.bitwise_count(c).sum()) for c in self.containers.values())

    def decode(self) -> np.ndarray:
        """The members in rising order."""
        parts = [(np.int64(h) << 16) + _members(c).astype(np.int64) for h, c in sorted(self.containers.items())]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)
