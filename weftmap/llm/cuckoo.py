"""Cuckoo filters over digests, with numpy: put in, take out, ask.

A filter is an array of buckets of four 16-bit fingerprints. A digest's first bucket
comes from its bytes, the second from the first and the fingerprint alone, so a
fingerprint can move between its two buckets without the digest, and a digest that goes
takes one of its fingerprint's places with it. What was put in is always found; something
else is found by chance, about once in 8,000 asks of a full filter.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
#: Moves that are tried before a filter counts as full.
KICKS = 200


def parts(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place hash, fingerprint) of each digest, rows of at least 16 bytes. The first four bytes are left to the caller's shards."""
    raw = np.ascontiguousarray(digests[:, 4:16])
    fp = raw[:, 8:10].copy().view(np.uint16).ravel()
    return raw[:, :8].copy().view(np.uint64).ravel(), np.where(fp == 0, np.uint16(1), fp)


def _other(at: np.ndarray, fp: np.ndarray, mask: int) -> np.ndarray:
    return at ^ ((fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) & mask)


class CuckooFilter:
    """``table``: buckets (a power of two) by four slots; 0 is a free slot."""

    def __init__(self, buckets: int = 256, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.mask = len(self.table) - 1

    @classmethod
    def load(cls, slots: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table))

    def _places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, fp = parts(digests)
        first = (h & np.uint64(self.mask)).astype(np.int64)
        return first, _other(first, fp, self.mask), fp

    def contains(self, digests: np.ndarray) -> np.ndarray:
        """Whether each digest may be inside; never false for one that is."""
        a, b, fp = self._places(digests)
        return (self.table[a] == fp[:, None]).any(1) | (self.table[b] == fp[:, None]).any(1)

    def _settle(self, at: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots of these buckets, as far as they go; which found one."""
        order = np.argsort(at, kind="stable")
        where = at[order]
        nth = np.arange(len(where)) - np.searchsorted(where, where)  # of those that want the same bucket
        free = self.table[where] == 0
        fits = nth < free.sum(1)
        slot = (np.cumsum(free, 1) == (nth + 1)[:, None]).argmax(1)
        self.table[where[fits], slot[fits]] = fp[order][fits]
        done = np.zeros(len(at), bool)
        done[order[fits]] = True
        return done

    def insert(self, digests: np.ndarray) -> bool:
        """Puts in digests that it doesn't hold. False: it is full, and what it holds now is of no use."""
        if len(self) + len(digests) > 0.95 * self.table.size:
            return False
        a, b, fp = self._places(digests)
        left = np.flatnonzero(~self._settle(a, fp))
        left = left[~self._settle(b[left], fp[left])]
        rng = np.random.default_rng(len(self))
        for i in left:
            at, carried = int(b[i]), fp[i]
            for _ in range(KICKS):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = carried
                    break
                slot = int(rng.integers(SLOTS))
                carried, self.table[at, slot] = self.table[at, slot], carried
                at = int(_other(np.array([at]), np.array([carried]), self.mask)[0])
            else:
                return False
        return True

    def delete(self, digests: np.ndarray) -> None:
        """Takes out digests that are inside."""
        a, b, fp = self._places(digests)
        for i, j, f in zip(a.tolist(), b.tolist(), fp, strict=True):
            for at in (i, j):
                hit = np.flatnonzero(self.table[at] == f)
                if len(hit):
                    self.table[at, hit[0]] = 0
                    break
            else:
                raise KeyError("a digest that isn't inside")

    @classmethod
    def build(cls, digests: np.ndarray, buckets: int = 256) -> CuckooFilter:
        """A filter of all these digests, with as many buckets as they need, ``buckets`` at least."""
        while buckets * SLOTS * 0.9 < len(digests):
            buckets *= 2
        while not (made := cls(buckets)).insert(digests):
            buckets *= 2
        return made
