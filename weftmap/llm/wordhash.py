"""Words and word n-grams of whole texts as 64-bit hashes, with numpy only.

A text's bytes are hashed by one running sum, so a word costs nothing but its
two ends. Words are runs of bytes other than \\x20 and \\x09-\\x0D.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD1342543DE82EF95 | 1
_POWERS: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: Letters for lower-cased UTF-8: a-z and every byte of a longer character.
LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = True
LETTER[0x80:] = True


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size > 1 << 23:
            return have[:n]  # for one very long text; not kept
        _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _ranges(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), dtype=np.uint64, out=total[1:])
    inverse = pow(base, -1, 2**64)
    return (total[end] - total[start]) * _powers(inverse, len(values) + 1)[start]


class Words:
    """The words of some texts: byte ranges, hashes, and the first word of each text."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, inside: np.ndarray = NOT_SPACE):
        self.raw, self.at = raw, at
        n = len(raw)
        own = inside[raw]
        before = np.zeros(n, bool)
        before[1:] = own[:-1]
        cuts = at[:-1][at[:-1] < n]
        before[cuts] = False
        self.start = np.flatnonzero(own & ~before)
        after = np.zeros(n, bool)
        after[:-1] = own[1:]
        ends = at[1:]
        after[ends[ends > 0] - 1] = False
        self.end = np.flatnonzero(own & ~after) + 1
        self.first = np.searchsorted(self.start, at)  # of each text; one entry more
        self.counts = np.diff(self.first)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            if len(self.start):
                self._hash = mix(_ranges(_TABLE[self.raw], _BASE, self.start, self.end))
            else:
                self._hash = np.empty(0, np.uint64)
        return self._hash

    def doc(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row (across texts too: the caller drops those)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    start = np.arange(n)
    return mix(_ranges(words, _WORD_BASE, start, start + k))


def inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each of the ``n`` starts of k words in a row: whether they lie in one text."""
    ok = np.zeros(max(0, n), bool)
    if n <= 0:
        return ok
    change = np.zeros(n + 1, np.int32)
    lo, hi = first[:-1], first[1:] - k + 1
    good = hi > lo
    np.add.at(change, lo[good], 1)
    np.add.at(change, np.minimum(hi[good], n), -1)
    return np.cumsum(change[:-1]) > 0
