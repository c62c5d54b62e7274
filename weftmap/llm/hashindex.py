"""A map from 64-bit hashes to numbers, looked up and filled with numpy; and rows of different lengths in one array."""

from __future__ import annotations

import numpy as np


class HashIndex:
    """Open addressing over two arrays; 0 marks a free place."""

    def __init__(self, bits: int = 16):
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)

    def __len__(self) -> int:
        return self.n

    def find(self, h: np.ndarray) -> np.ndarray:
        """The value of each hash, -1 for none."""
        h = np.where(h == 0, np.uint64(1), h)
        mask = (1 << self.bits) - 1
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == h, self.values[at], -1)
        todo = np.flatnonzero((key != h) & (key != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            key = self.keys[at[todo]]
            hit = key == h[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Puts in different hashes that it doesn't have."""
        while (self.n + len(h)) * 2 > 1 << self.bits:
            held = self.keys != 0
            k, v = self.keys[held], self.values[held]
            self._make(self.bits + 2)
            if len(k):
                self._put(k, v)
        self._put(np.where(h == 0, np.uint64(1), h), values)

    def _put(self, h: np.ndarray, values: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        self.n += len(h)
        while len(todo):
            free = self.keys[at[todo]] == 0
            place = at[todo[free]]
            self.keys[place] = h[todo[free]]  # the last of equal places wins
            won = self.keys[at[todo]] == h[todo]
            self.values[at[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & mask


class Rows:
    """Rows of different lengths, appended in blocks."""

    def __init__(self, kind: type = np.uint16):
        self.start = np.zeros(1, np.int64)
        self.data = np.empty(0, kind)
        self.n, self.used = 0, 0

    def append(self, lengths: np.ndarray, data: np.ndarray) -> None:
        n, used = self.n + len(lengths), self.used + len(data)
        if n + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(max(n + 1, 2 * len(self.start)) - len(self.start), np.int64)])
        if used > len(self.data):
            self.data = np.concatenate([self.data, np.empty(max(used, 2 * len(self.data)) - len(self.data), self.data.dtype)])
        self.start[self.n + 1 : n + 1] = self.used + np.cumsum(lengths)
        self.data[self.used : used] = data
        self.n, self.used = n, used

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these rows one after another, and each row's length."""
        return take(self.start, self.data, rows)


def take(start: np.ndarray, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = start[rows]
    lengths = start[rows + 1] - first
    done = np.cumsum(lengths)
    total = int(done[-1]) if len(done) else 0
    return data[np.repeat(first - (done - lengths), lengths) + np.arange(total)], lengths
