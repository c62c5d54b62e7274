"""Benchmark decontamination: shared q-grams in diagonal bands, then banded alignment.

A passage that a text holds with at most e edits shares at least m + 1 - q (e + 1)
q-grams with an item of m characters, all within e diagonals of its start (q-gram
lemma). Every item has the whole budget e = floor(share m), and the largest q, up
to ``Q``, that keeps this bound above 0; items of one q form an index. A text's
q-grams are looked up in it; hits are counted in bands of 2 (2 e + 1) diagonals
that overlap by half, so some band holds any such match whole; bands that meet the
bound are aligned. So exactly the items within their budget are found.

Texts and items are compared in lower case (the final sigma as the other), with
every run of white space as one space and items without white space at their ends;
as one byte a character for the q-grams (a byte may stand for several characters,
which only adds candidates) and by whole characters in the alignment. ``start`` and
``end`` are places in the text as it was given.

Defined results: null and empty texts match nothing; null items and items of white
space alone are matched by nothing; equal items match alike; of equally near
places of one item the first counts; repeated rows match alike; a kept column named
like one that is made comes back with ``_in`` at the end of its name.

The benchmark comes to the driver in blocks of at most ``BLOCK_CHARS`` characters (a
longer item is a block), and a task holds the index of one block: more blocks are
more passes over the texts. Hits are expanded ``PAIRS`` at a time, so a text that
repeats one q-gram is bounded too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .common import batches, carry, columns, materialize

Q, EDIT_SHARE = 10, 0.08
BLOCK_CHARS = 1 << 23
#: Pairs of a place in a text and one in an item that are made at a time.
PAIRS = 1 << 21
#: Bands that are aligned together.
JOINED = 8
_TABLE_BITS = 22
_MUL = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.array(sorted(c for c in range(0x10000) if chr(c).isspace()), np.uint32)


def _lower(text: str) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points in lower case, and for each its place in ``text`` if they aren't one to one."""
    low = text.lower().replace("ς", "σ")
    place = None
    if len(low) != len(text):
        each = [c.lower().replace("ς", "σ") for c in text]
        low, place = "".join(each), np.repeat(np.arange(len(each)), [len(c) for c in each])
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32), place


def points(text: str) -> tuple[np.ndarray, np.ndarray | None]:
    """The characters compared, and for each its place in ``text`` (None: the same place)."""
    cp, place = _lower(text)
    white = np.isin(cp, _WHITE)
    if not white.any():
        return cp, place
    again = np.zeros(len(cp), bool)
    again[1:] = white[1:] & white[:-1]
    cp = np.where(white, np.uint32(32), cp)
    if again.any():
        place = (np.arange(len(cp)) if place is None else place)[~again]
        cp = cp[~again]
    return cp, place


def fold(cp: np.ndarray) -> np.ndarray:
    return np.where(cp < 128, cp, 128 + (cp & 127)).astype(np.uint8)


def qgrams(b: np.ndarray, q: int) -> np.ndarray:
    """Each q bytes in a row as a 64-bit value (q up to 8: themselves)."""
    n = len(b) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g, have = b.astype(np.uint64), 1
    while have * 2 <= min(q, 8):
        g = g[: len(g) - have] | (g[have:] << np.uint64(8 * have))
        have *= 2
    if have < q:
        g = g[:n] * _MUL ^ g[q - have : q - have + n]
    return (g[:n] ^ (g[:n] >> np.uint64(29))) * _MUL


class Part:
    """Postings of the q-grams of some items, all of one q."""

    def __init__(self, q: int, items: np.ndarray, points: list[np.ndarray], m: np.ndarray, e: np.ndarray):
        self.q = q
        self.bound = m + 1 - q * (e + 1)
        g = [qgrams(fold(points[i]), q) for i in items.tolist()]
        gram = np.concatenate(g)
        item = np.repeat(items, [len(x) for x in g]).astype(np.int32)
        pos = np.concatenate([np.arange(len(x)) for x in g]).astype(np.int32)
        order = np.argsort(gram, kind="stable")
        gram, self.item, self.pos = gram[order], item[order], pos[order]
        self.gram, self.start = np.unique(gram, return_index=True)
        self.start = np.append(self.start, len(gram))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.gram >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        self.least = int(self.bound[items].min())
        self.reach = int((m + 2 * e)[items].max())

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose gram an item has, and its number."""
        at = np.flatnonzero(self.table[(grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.gram, grams[at]), len(self.gram) - 1)
        same = self.gram[k] == grams[at]
        return at[same], k[same]

    def regions(self, grams: np.ndarray, m: np.ndarray, e: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first, last diagonal) of the bands of a text that meet the bound; bands that follow each other are one region, up to ``JOINED``."""
        at, k = self.hits(grams)
        if len(at) < self.least:
            return []
        # a match has ``least`` hits within ``reach`` places: drop hits that have fewer around them
        around = np.searchsorted(at, at + self.reach, "right") - np.searchsorted(at, at - self.reach)
        dense = around >= self.least
        at, k = at[dense], k[dense]
        if len(at) < self.least:
            return []
        size = self.start[k + 1] - self.start[k]
        done = np.cumsum(size)
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + PAIRS, "right")))
            new, n = self._bands(at[a:b], k[a:b], size[a:b], m, e)
            if len(keys):
                both, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
                keys, counts = both, np.bincount(back, np.concatenate([counts, n])).astype(np.int64)
            else:
                keys, counts = new, n
            a = b
        item = keys >> 40
        good = counts >= self.bound[item]
        out, of, first, last = [], -1, 0, 0
        for i, b in zip(item[good].tolist(), (keys[good] & ((1 << 40) - 1)).tolist(), strict=True):
            if i == of and b == last and last - first < JOINED:
                last += 1
            else:
                of, first, last = i, b, b + 1
                out.append([])
            w, off = 2 * int(e[i]) + 1, int(m[i] + e[i])
            out[-1] = (i, first * w - off, (last + 1) * w - off)
        return out

    def _bands(self, at: np.ndarray, k: np.ndarray, size: np.ndarray, m: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, band) as one number and how many hits it has. Band b has the diagonals from b w up to (b + 2) w."""
        post = np.repeat(self.start[k] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        item = self.item[post].astype(np.int64)
        diagonal = np.repeat(at, size) - self.pos[post] + m[item] + e[item]  # not negative
        band = diagonal // (2 * e[item] + 1)
        key = (item << 40) + band
        return np.unique(np.concatenate([key, key[band > 0] - 1]), return_counts=True)


class Index:
    """The items of a block, their budgets, and an index for each q."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, share: float = EDIT_SHARE):
        self.ids, self.points = [], []
        for i, text in items:
            cp = points(text)[0]
            cp = cp[int(len(cp) > 0 and cp[0] == 32) : len(cp) - int(len(cp) > 1 and cp[-1] == 32)]
            if len(cp):
                self.ids.append(i), self.points.append(cp)
        self.raw = [p.tobytes() for p in self.points]
        self.m = np.array([len(p) for p in self.points], np.int64)
        self.e = np.floor(self.m * share).astype(np.int64)
        own = np.minimum(q, self.m // (self.e + 1))  # m + 1 - q (e + 1) is then 1 at least
        self.parts = [Part(int(x), np.flatnonzero(own == x), self.points, self.m, self.e) for x in np.unique(own)]


def _find(text: bytes, item: bytes) -> int:
    """Where ``item`` begins in ``text``, both in four bytes a character; -1 if nowhere."""
    at = text.find(item)
    while at > 0 and at % 4:
        at = text.find(item, at + 1)
    return at // 4 if at >= 0 else -1


def align(text: np.ndarray, item: np.ndarray, first: int, last: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match of ``item`` with a part of ``text`` on diagonals first..last - 1, if at most ``most`` edits.

    A row for each character of the item, a place for each diagonal (place in
    the text less place in the item). Cost and start are one number, so the
    least cost with the first start wins.
    """
    n, m, d = len(text), len(item), last - first
    big = np.int64(n + 1)
    padded = np.full(d + m, 0xFFFFFFFF, np.uint32)
    a, b = max(0, first), min(n, last + m)
    if a < b:
        padded[a - first : b - first] = text[a:b]
    start = np.arange(first, last)
    none = np.int64(2 * m + 2) * big
    now = np.where((start >= 0) & (start <= n), start, none)
    gap = np.arange(d, dtype=np.int64) * big
    for r, c in enumerate(item):
        new = now + (padded[r : r + d] != c) * big
        new[:-1] = np.minimum(new[:-1], now[1:] + big)  # the item's character is missing in the text
        now = np.minimum.accumulate(new - gap) + gap  # characters of the text too many
        if now.min() >= (most + 1) * big:
            return None
    now = np.where((start + m >= 0) & (start + m <= n), now, none)
    k = int(now.argmin())
    cost, begin = divmod(int(now[k]), int(big))
    return (cost, begin, first + k + m) if cost <= most else None


def matches(index: Index, text: str) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits): the best match of each item that the text holds."""
    cp, place = points(text)
    b = fold(cp)
    best: dict[int, tuple[int, int, int]] = {}
    for part in index.parts:
        for i, first, last in part.regions(qgrams(b, part.q), index.m, index.e):
            m, e = int(index.m[i]), int(index.e[i])
            most = best[i][0] - 1 if i in best else e  # regions come in order of place, so of equals the first stays
            if most < 0:
                continue
            lo, hi = max(0, first - e), min(len(cp), last + m + e)
            whole = _find(cp[lo:hi].tobytes(), index.raw[i])
            got = (0, lo + whole, lo + whole + m) if whole >= 0 else align(cp, index.points[i], first - e, last + e, most)
            if got:
                best[i] = got
    out = []
    for i, (e, s, t) in sorted(best.items()):
        if place is not None:
            s, t = int(place[s]) if s < len(place) else len(text), int(place[t - 1]) + 1 if t > s else int(place[min(s, len(place) - 1)])
        out.append((i, s, t, e))
    return out


def find(shared, keep: list[str], text: str, kind: pa.DataType):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for rows, texts in batches(it, text):
            row, item, start, end, edits = [], [], [], [], []
            for r, t in enumerate(texts.to_pylist()):
                for i, s, last, e in matches(index, t):
                    row.append(r), item.append(index.ids[i]), start.append(s), end.append(last), edits.append(e)
            if row:
                own = [c.take(pa.array(row, pa.int64())) for c in columns(rows, keep)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(item, kind), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32())], [*keep, "item_id", "start", "end", "edits"])

    return run


def benchmark_blocks(benchmark: DataFrame, most: int | None = None) -> Iterator[list[tuple[int, str]]]:
    """Items with text, in blocks of bounded size."""
    block, held, most = [], 0, most or BLOCK_CHARS
    for row in benchmark.where("text is not null and length(text) > 0").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if block and held + len(row["text"]) > most:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += len(row["text"])
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: list[str], q: int = Q, share: float = EDIT_SHARE, block: int | None = None) -> DataFrame:
    """``keep`` columns with item_id, start, end (characters) and edits: a row for each text and item that it holds."""
    spark = docs.sparkSession
    own, names, (text,), schema = carry(docs, keep, f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, start long, end long, edits int")
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for items in benchmark_blocks(benchmark, block):
        shared = spark.sparkContext.broadcast(Index(items, q, share))
        found = own.mapInArrow(find(shared, names, text, kind), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean(shared, text: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for rows, texts in batches(it, text):
            yield rows.filter(pa.array([not matches(index, t) for t in texts.to_pylist()], pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, columns: list[str], q: int = Q, share: float = EDIT_SHARE, block: int | None = None) -> DataFrame:
    """``columns`` of the rows that hold no benchmark item, without a shuffle. A pass over the texts for each block; what a pass leaves is written for the next, so a task holds one block."""
    spark = docs.sparkSession
    own, names, (text,), _ = carry(docs, columns, "")
    blocks = benchmark_blocks(benchmark, block)
    items = next(blocks, None)
    while items is not None:
        more = next(blocks, None)
        own = own.mapInArrow(clean(spark.sparkContext.broadcast(Index(items, q, share)), text), own.schema)
        own = own if more is None else materialize(own, "clean")
        items = more
    return own.select(*names)
