"""Substring dedup: removes words covered by a window of words that also starts elsewhere.

Pass 1 puts the anchors of each partition into a count-min sketch: an anchor is
an ANCHOR-word gram whose hash is the least of a window's grams. Equal windows
have equal least grams at the same place, so an anchor's estimate is never below
the count of a window that has it. Partition sketches travel as cells, are
merged by block, and what is left is a bit for each cell: counted twice or more.
Its size, 2 x 2**bits bits, is fixed; a fuller sketch only lets more windows
through, and loses none.

Pass 2 counts the windows estimated repeated exactly, by a 96-bit hash: partial
counts first, whose repeated windows are written as a table, then a join with that
table. Both sides of the join are dealt anew for it, so Spark can split a window that
very many texts hold.

Defined results: a null text has no words; texts shorter than a window, and
empty tables, come back whole; repeated rows (same id, same text) repeat each
other's windows and are removed alike; a kept column named like one that is made comes
back with ``_in`` at the end of its name; ids may be of any type that can be joined on;
a very long text is handled alone and whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import wordhash as H
from .common import batches, carry, columns, materialize, quoted, text_bytes

WINDOW = 35
ANCHOR = 16
#: Cells of a row of the sketch, as a power of two, and rows. The merged bits take 2**(27-3) * 2 = 32 MB.
BITS, ROWS = 27, 2
BLOCK = 16  # cells of a block, as a power of two
_SEED = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_FLUSH = 1 << 20


def _least(g: np.ndarray, w: int) -> np.ndarray:
    """The least of each w in a row."""
    out, have = g, 1
    while have * 2 <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(out) - (w - have)], out[w - have :])
    return out


def _most(g: np.ndarray, w: int) -> np.ndarray:
    return ~_least(~g, w)


def windows_of(words: H.Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of ``window`` words: whether they lie in one text, and the least gram's hash."""
    n = len(words.hash) - window + 1
    if n <= 0:
        return np.empty(0, bool), np.empty(0, np.uint64)
    ok = H.inside(words.first, window, n)
    return ok, _least(H.grams(words.hash, anchor), window - anchor + 1)[:n]


def anchors_of(words: H.Words, window: int, anchor: int) -> np.ndarray:
    """Hashes of the anchors: grams that are the least of a window that holds them."""
    ok, least = windows_of(words, window, anchor)
    if not ok.any():
        return np.empty(0, np.uint64)
    w = window - anchor + 1
    g = H.grams(words.hash, anchor)
    held = np.zeros(len(g) + w - 1, np.uint64)  # of windows from w - 1 before a gram to the gram
    held[w - 1 : w - 1 + len(ok)] = np.where(ok, least, 0)
    return g[(_most(held, w)[: len(g)] == g)]


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashes * _SEED[row]) >> np.uint64(64 - bits)).astype(np.int64)


def sketch_cells(window: int, anchor: int, bits: int):
    """Partition -> (block, cells, twice): the cells that a partition's anchors fall in, and whether more than one did."""

    def emit(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate(parts)
        blocks, cells, twice = [], [], []
        for row in range(ROWS):
            cell, n = np.unique(cells_of(hashes, row, bits), return_counts=True)
            block = cell >> BLOCK
            cut = np.flatnonzero(np.diff(block, prepend=-1))
            for a, b in zip(cut, [*cut[1:], len(cell)], strict=True):
                blocks.append((row << 32) + int(block[a]))
                cells.append((cell[a:b] & ((1 << BLOCK) - 1)).astype("<u2").tobytes())
                twice.append(np.packbits(n[a:b] > 1).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(cells, pa.binary()), pa.array(twice, pa.binary())], ["block", "cells", "twice"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for _, texts in batches(it):
            got = anchors_of(H.Words(*text_bytes(texts)), window, anchor)
            if len(got):
                parts.append(got)
                held += len(got)
            if held >= _FLUSH:
                yield from emit(parts)
                parts, held = [], 0
        if parts:
            yield from emit(parts)

    return run


def merge_cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the cells of each block; (block, bits): a bit for each cell counted twice or more."""
    once: dict[int, np.ndarray] = {}
    size = 1 << BLOCK
    for batch in it:
        for block, cells, twice in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            cell = np.frombuffer(cells.as_buffer(), "<u2")
            more = np.unpackbits(np.frombuffer(twice.as_buffer(), np.uint8), count=len(cell)).astype(np.uint8)
            counts = once.get(block)
            if counts is None:
                counts = once[block] = np.zeros(size, np.uint8)
            counts[cell] = np.minimum(counts[cell] + 1 + more, 2)
    if once:
        keys = [k for k, c in once.items() if (c > 1).any()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([np.packbits(once[k] > 1).tobytes() for k in keys], pa.binary())], ["block", "bits"])


def repeated_cells(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bits: int = BITS) -> np.ndarray:
    """The merged sketch: a bit for each row and cell. At most ROWS * 2**bits bits come to the driver, whatever the input."""
    cells = docs.select("text").mapInArrow(sketch_cells(window, anchor, bits), "block long, cells binary, twice binary")
    merged = cells.repartition("block").mapInArrow(merge_cells, "block long, bits binary")
    out = np.zeros(ROWS << (bits - 3), np.uint8)
    step = 1 << (BLOCK - 3)
    for row in merged.toLocalIterator():
        at = ((row["block"] >> 32) << (bits - 3)) + (row["block"] & 0xFFFFFFFF) * step
        out[at : at + step] = np.frombuffer(row["bits"], np.uint8)
    return out


def may_repeat(hashes: np.ndarray, sketch: np.ndarray, bits: int) -> np.ndarray:
    yes = np.ones(len(hashes), bool)
    for row in range(ROWS):
        cell = cells_of(hashes, row, bits)
        yes &= (sketch[(row << (bits - 3)) + (cell >> 3)] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
    return yes


def candidate_windows(sketch, window: int, anchor: int, bits: int, key: pa.DataType):
    """Partition -> (doc_id, th, pos, h, h2): the windows estimated repeated."""
    schema = pa.schema([("doc_id", key), ("th", pa.int64()), ("pos", pa.int32()), ("h", pa.int64()), ("h2", pa.int32())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in batches(it):
            words = H.Words(*text_bytes(texts))
            ok, least = windows_of(words, window, anchor)
            at = np.flatnonzero(ok)
            at = at[may_repeat(least[at], sketch.value, bits)]
            if not len(at):
                continue
            doc = np.searchsorted(words.first, at, "right") - 1
            h = H.grams(words.hash, window)[at]
            h2 = H.grams(words.hash ^ _SEED[3], window)[at]
            pick = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pick), rows.column(1).take(pick), pa.array((at - words.first[doc]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32))],
                schema=schema,
            )

    return run


def with_candidates(sketch, window: int, anchor: int, bits: int, want: bool, text: str):
    """The rows whose texts have (or, not ``want``, haven't) a window estimated repeated."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in batches(it, text):
            words = H.Words(*text_bytes(texts))
            ok, least = windows_of(words, window, anchor)
            at = np.flatnonzero(ok)
            at = at[may_repeat(least[at], sketch.value, bits)]
            has = np.zeros(rows.num_rows, bool)
            has[np.searchsorted(words.first, at, "right") - 1] = True
            yield rows.filter(pa.array(has == want))

    return run


def repeated_windows(docs: DataFrame, sketch, window: int = WINDOW, anchor: int = ANCHOR, bits: int = BITS) -> DataFrame:
    """(doc_id, th, starts): the word positions where windows found elsewhere too begin. th is xxhash64 of the text."""
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    key = own.schema["doc_id"].dataType
    run = candidate_windows(sketch, window, anchor, bits, to_arrow_type(key))
    found = own.mapInArrow(run, f"doc_id {key.simpleString()}, th long, pos int, h long, h2 int")
    again = materialize(found.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "h2"), "repeated")
    return found.join(again, ["h", "h2"], "left_semi").groupBy("doc_id", "th").agg(F.collect_list("pos").alias("starts"))


def cover(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of ``starts``."""
    change = np.zeros(n + window + 1, np.int32)
    starts = np.unique(starts)
    change[starts] += 1
    change[starts + window] -= 1
    return np.cumsum(change)[:n] > 0


def cut(window: int, spans: bool, keep: list[str], text_name: str):
    """Rows with a text and, maybe, wm_starts -> ``keep``, counts, and what is left."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in batches(it, text_name):
            n_words, n_removed, digest, kept = [], [], [], []
            at = rows.schema.get_field_index("wm_starts")
            starts = rows.column(at) if at >= 0 else pa.nulls(rows.num_rows, pa.list_(pa.int32()))
            for text, found in zip(texts, starts, strict=True):
                words = text.as_buffer().to_pybytes().split()
                left = words
                if found.is_valid and len(found.values):
                    gone = cover(found.values.to_numpy(), len(words), window)
                    left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out = b" ".join(left)
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                if spans:
                    kept.append(out.decode() if len(left) < len(words) else None)
                else:
                    digest.append(hashlib.sha256(out).hexdigest())
            more = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
            more |= {"kept_text": pa.array(kept, pa.string())} if spans else {"kept_sha256": pa.array(digest, pa.string())}
            yield pa.RecordBatch.from_arrays([*columns(rows, keep), *more.values()], [*keep, *more])

    return run


def remove_repeats(docs: DataFrame, columns: list[str], digest: bool, window: int = WINDOW, anchor: int = ANCHOR, bits: int = BITS) -> DataFrame:
    """``columns`` with n_words, n_removed and kept_sha256, or (not ``digest``) kept_text: the words left, joined by a space; null where nothing was removed.

    Texts without a window that the sketch lets through are done where they are read; only the others are shuffled.
    """
    sketch = docs.sparkSession.sparkContext.broadcast(repeated_cells(docs, window, anchor, bits))
    found = repeated_windows(docs, sketch, window, anchor, bits).select(F.col("doc_id").alias("wm_id"), F.col("th").alias("wm_found"), F.col("starts").alias("wm_starts"))
    own, names, (row_id, text), out = carry(docs, columns, "n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept_text string"), ("doc_id", "text"))
    make = cut(window, not digest, names, text)
    whole = with_candidates(sketch, window, anchor, bits, False, text)
    done = own.drop(*{row_id} - set(names)).mapInArrow(lambda it: make(whole(it)), out)
    rest = own.mapInArrow(with_candidates(sketch, window, anchor, bits, True, text), own.schema).withColumn("wm_th", F.xxhash64(quoted(text)))
    # always by a shuffle, whatever the number of texts with repeats
    met = rest.join(found.hint("merge"), quoted(row_id).eqNullSafe(F.col("wm_id")) & (F.col("wm_th") == F.col("wm_found")), "left")
    return done.unionByName(met.select(*map(quoted, dict.fromkeys([*names, text])), "wm_starts").mapInArrow(make, out))
