"""N-gram Jaccard join: MinHash bands find pairs, full n-gram sets decide.

A class is a group of texts with the same words in the same order. The classes
that share a band's bucket meet with their full sets: in one task, or where they are
more than ``BLOCK`` shingles, dealt over blocks by hash, each pair of blocks in a
task of its own. There every pair is verified by matrix products over the shingles
that two texts share, so no pair is ever a row, and a bucket of any size is only
more blocks. A pair of several buckets counts in that of the first band that the two
share, which their band hashes tell. A bucket whose members all share an earlier
bucket has no pair of its own and is left out, so a small group of near copies meets
once. Texts that only a chain of buckets connects never meet: the work grows with
the pairs of buckets, not with the groups that chains would make. Groups are the
components of the verified links.

Bands and rows are chosen so that a pair at the threshold is found with
probability ``recall``.

Defined results: texts with fewer than n words have one shingle, all their
words; a text without words is linked to nothing; repeated rows are links of
each other; a null doc_id is a row like others (class_id is null only where no
row of the class has an id); an empty table gives an empty one. ``keep_first`` keeps,
of the rows of a group, one of least id, and of equal ids one of least text hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as H
from .common import batches, carry, materialize, quoted, text_bytes
from .components import components

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Shingles, and texts, that a side of a verifying task holds, about.
BLOCK, TEXTS = 1 << 20, 2048
COLUMNS = 2048


def bands_for(threshold: float, recall: float, rows: int = 4) -> tuple[int, int]:
    """Bands and rows that find a pair at the threshold with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def shingles(words: H.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all n-grams, text by text, and where each text's begin (one entry more)."""
    counts = words.counts
    g = H.grams(words.hash, n)
    ok = H.inside(words.first, n, len(g))
    got = np.maximum(counts - n + 1, 0)
    short = (counts > 0) & (counts < n)
    if not short.any():
        return g[ok], np.concatenate([[0], np.cumsum(got)])
    total = np.concatenate([[0], np.cumsum(np.where(short, 1, got))])
    out = np.empty(total[-1], np.uint64)
    single = np.zeros(total[-1], bool)
    single[total[:-1][short]] = True
    out[~single] = g[ok]
    out[single] = H.mix(H._ranges(words.hash, H._WORD_BASE, words.first[:-1][short], words.first[1:][short]))
    return out, total


def text_keys(words: H.Words) -> np.ndarray:
    """A hash of all words of each text, in order."""
    if not len(words.hash):
        return np.zeros(len(words.counts), np.uint64)
    return H.mix(H._ranges(words.hash, H._WORD_BASE, words.first[:-1], words.first[1:]) + words.counts.astype(np.uint64))


def signatures(n: int, bands: int, rows: int, key: pa.DataType):
    """Partition -> (doc_id, th, s, n_shingles, bands)."""
    rng = np.random.default_rng(7)
    factors = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    weights = rng.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_in, texts in batches(it, most=1 << 20):
            words = H.Words(*text_bytes(texts))
            g, first = shingles(words, n)
            size = np.diff(first)
            full = np.flatnonzero(size)
            low = np.zeros((bands * rows, len(size)), np.uint32)
            if len(full):
                g32 = (g >> np.uint64(32)).astype(np.uint32)
                starts = first[:-1][full]
                for i, f in enumerate(factors):
                    low[i, full] = np.minimum.reduceat(g32 * f, starts)
            key_of = H.mix((low.astype(np.uint64).reshape(bands, rows, -1) * weights[None, :, None]).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)[:, None])
            values = np.ascontiguousarray(key_of.T).reshape(-1).view(np.int64)
            offsets = np.arange(0, len(values) + 1, bands, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows_in.column(0), rows_in.column(1), pa.array(text_keys(words).view(np.int64)), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                ["doc_id", "th", "s", "n_shingles", "bands"],
            )

    return run


def sets(n: int):
    """Partition of (s, w, bands, buckets, text) -> (s, w, bands, buckets, set): the sorted different shingles as bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in batches(it):
            words = H.Words(*text_bytes(texts))
            g, first = shingles(words, n)
            keys = text_keys(words).view(np.int64)
            own = [np.unique(g[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            same = pa.array(keys == rows.column(0).to_numpy())
            out = pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(own, pa.binary())], ["s", "w", "bands", "buckets", "set"])
            yield out.filter(same)

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """How many shingles each set of a shares with each of b (b None: with those of a)."""
    both = a if b is None else [*a, *b]
    value = np.concatenate(both)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    start = np.flatnonzero(new)
    size = np.diff(start, append=len(value))
    shared = np.repeat(size > 1, size)
    col = (np.cumsum(size > 1) - 1).repeat(size)[shared]
    row = row[shared]
    out = np.zeros((len(a), len(a) if b is None else len(b)), np.float32)
    cuts = np.searchsorted(col, np.arange(0, (col[-1] + 1 if len(col) else 0) + COLUMNS, COLUMNS))
    for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if i < j:
            part = np.zeros((len(both), COLUMNS), np.float32)
            part[row[i:j], col[i:j] - k * COLUMNS] = 1
            out += part[: len(a)] @ (part if b is None else part[len(a) :]).T
    return out


def met_before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of a and b (a column for each earlier band) share an earlier bucket."""
    out = np.zeros((len(a), len(b)), bool)
    for k in range(a.shape[1]):
        out |= a[:, k][:, None] == b[:, k][None, :]
    return out


def verify(threshold: float):
    """Sorted rows (band, h, bi, bj, side, s, w, bands, set) -> (s, links, root): links by copies that count in this bucket, and the least text reached along links in this task."""

    def group(band: int, apart: bool, rows: list[tuple]) -> tuple[list, list, list]:
        a = [r for r in rows if r[0] == 0]
        b = [r for r in rows if r[0] == 1]
        if not a or apart and not b or len(a) < 2 and not b:
            return [], [], []
        one, two = [r[3] for r in a], [r[3] for r in b] or None
        na = np.array([len(x) for x in one], np.float64)
        nb = na if two is None else np.array([len(x) for x in two], np.float64)
        shared = overlaps(one, two)
        link = shared >= threshold * (na[:, None] + nb[None, :] - shared) - 1e-6
        early = np.array([r[4][:band] for r in a], np.int64).reshape(len(a), band)
        wa = np.array([r[2] for r in a], np.int64)
        if two is None:
            np.fill_diagonal(link, False)
            links = (link & ~met_before(early, early)) @ wa
            key = np.array([r[1] for r in a], np.int64)
            x, y = np.nonzero(np.triu(link))
        else:
            wb = np.array([r[2] for r in b], np.int64)
            new = link & ~met_before(early, np.array([r[4][:band] for r in b], np.int64).reshape(len(b), band))
            links = np.concatenate([new @ wb, wa @ new])
            key = np.array([r[1] for r in [*a, *b]], np.int64)
            x, y = np.nonzero(link)
            y = y + len(a)
        root = key.copy()
        while len(x):  # least key along links, until nothing changes
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            if (new == root).all():
                break
            root = new
        return key.tolist(), links.tolist(), root.tolist()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            for k, v in zip(out, group(at[0], at[2] != at[3], rows), strict=True):
                k.extend(v)

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["s", "links", "root"])
            for x in out:
                x.clear()
            return batch

        for batch in it:
            band, h, bi, bj, side, s, w = (batch.column(i).to_pylist() for i in range(7))
            for i, key in enumerate(zip(band, h, bi, bj, strict=True)):
                if key != at:
                    if rows:
                        close()
                    at, rows = key, []
                rows.append((side[i], s[i], w[i], np.frombuffer(batch.column(8)[i].as_py(), np.uint64), batch.column(7)[i].values.to_numpy()))
            if len(out[0]) > 10000:
                yield made()
        if rows:
            close()
        if out[0]:
            yield made()

    return run


def meetings(classes: DataFrame, bands: int, block: int = BLOCK) -> DataFrame:
    """(s, buckets) from classes (s, n_shingles, bands): the buckets (band, h, nb blocks) that a class's set goes to; classes that meet no other are left out."""
    cells = classes.select("s", F.posexplode("bands").alias("band", "h"))
    # tables of what is counted: the joins below then deal both sides anew, and Spark can split a bucket of very many rows
    shared = materialize(cells.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared")
    met = materialize(cells.join(shared, ["band", "h"]).select("s", "band", "h"), "met")
    # the hashes of a member's earlier bands; a bucket where all members have one in common has no pair of its own
    of = met.join(classes.select("s", "n_shingles", "bands"), "s")
    early = [F.when((F.col("band") > k) & (F.min(F.get("bands", F.lit(k))) == F.max(F.get("bands", F.lit(k)))), True).otherwise(False) for k in range(bands - 1)]
    size = F.greatest(F.ceil(F.sum("n_shingles") / F.lit(block)), F.ceil(F.count(F.lit(1)) / F.lit(TEXTS))).cast("int")
    buckets = of.groupBy("band", "h").agg(size.alias("nb"), *[e.alias(f"e{k}") for k, e in enumerate(early)])
    buckets = materialize(buckets.where(~F.greatest(F.lit(False), F.lit(False), *[F.col(f"e{k}") for k in range(bands - 1)])).select("band", "h", "nb"), "buckets")
    # at most one for each band
    return met.join(buckets, ["band", "h"]).groupBy("s").agg(F.collect_list(F.struct("band", "h", "nb")).alias("buckets"))


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, th, s, n_links, class_id, n_shingles, first): for each row of ``docs`` the rows linked to it (Jaccard similarity of at least ``threshold``), its class (least doc_id of those reached along links) and whether it is the row to keep. th is xxhash64 of the text, s the hash of its words."""
    bands, rows = bands_for(threshold, recall)
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    kind = dict(own.dtypes)["doc_id"]
    key = pa.int32() if kind == "int" else pa.int64()
    light = materialize(own.mapInArrow(signatures(n, bands, rows, key), f"doc_id {kind}, th long, s long, n_shingles long, bands array<long>"), "signatures")
    classes = materialize(light.where("n_shingles > 0").groupBy("s").agg(F.count(F.lit(1)).alias("w"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "classes")
    todo = meetings(classes, bands, block)
    reps = todo.join(classes.select(F.col("s").alias("of_s"), "w", "bands", "rep"), F.col("s") == F.col("of_s")).select("s", "w", "bands", "buckets", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th"))
    # always by a shuffle: how many texts there are decides nothing else about the plan
    texts = own.join(reps.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("th") == F.col("rep_th"))).select("s", "w", "bands", "buckets", "text")
    full = texts.mapInArrow(sets(n), "s long, w long, bands array<long>, buckets array<struct<band:int,h:long,nb:int>>, set binary")
    at = full.select("s", "w", "bands", "set", F.explode("buckets").alias("at")).select("s", "w", "bands", "set", "at.*")
    b = F.pmod(F.xxhash64("s"), F.col("nb")).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: F.struct(F.least(i, F.col("b")).alias("bi"), F.greatest(i, F.col("b")).alias("bj"), (i < F.col("b")).cast("int").alias("side")))
    dealt = at.withColumn("b", b).withColumn("p", F.explode(places)).select("band", "h", "p.bi", "p.bj", "p.side", "s", "w", "bands", "set")
    # repeated rows bring a text more than once
    dealt = dealt.repartition("band", "h", "bi", "bj").sortWithinPartitions("band", "h", "bi", "bj", "side", "s")
    links = materialize(dealt.mapInArrow(distinct_rows, dealt.schema).mapInArrow(verify(threshold), "s long, links long, root long"), "links")
    linked = links.groupBy("s").agg(F.sum("links").alias("links"))
    roots = components(links.where("s != root").select(F.col("s").alias("u"), F.col("root").alias("v")))
    of = classes.select("s", "w", "rep").join(linked, "s", "left").join(roots, F.col("s") == F.col("node"), "left")
    of = of.select("s", F.coalesce("root", "s").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "rep")
    least = materialize(of.groupBy("root").agg(F.min("rep").alias("least")), "least")
    of = of.join(least, "root").select(F.col("s").alias("of_s"), "n_links", "least")
    out = light.select("doc_id", "th", "s", "n_shingles").join(of, (F.col("s") == F.col("of_s")) & (F.col("n_shingles") > 0), "left")
    lone = F.col("of_s").isNull()
    return out.select(
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "n_shingles",
        "th",
        "s",
        (lone | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("th") == F.col("least.th")))).alias("first"),
    )


def distinct_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops rows of the text, bucket and block of the one before (the input is sorted)."""
    last = None
    for batch in it:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True))
        keep = [k != p for k, p in zip(keys, [last, *keys[:-1]], strict=True)]
        if keys:
            last = keys[-1]
        yield batch if all(keep) else batch.filter(pa.array(keep))


def keep_first(docs: DataFrame, columns: list[str], **how) -> DataFrame:
    """``columns`` of the rows of ``docs`` that stay: one of each class, and all rows without words."""
    judged = near_duplicates(docs, **how)
    stay = materialize(judged.where("first").select(F.col("doc_id").alias("wm_id"), F.col("th").alias("wm_stay"), (F.col("n_shingles") == 0).alias("wm_empty")).distinct(), "stay")
    own, names, (row_id, text), _ = carry(docs, columns, "", ("doc_id", "text"))
    own = own.withColumn("wm_th", F.xxhash64(quoted(text)))
    met = own.join(stay, quoted(row_id).eqNullSafe(F.col("wm_id")) & (F.col("wm_th") == F.col("wm_stay"))).select(*map(quoted, names), "wm_id", "wm_th", "wm_empty")
    worded = met.where("not wm_empty").dropDuplicates(["wm_id", "wm_th"])
    return worded.unionByName(met.where("wm_empty")).select(*map(quoted, names))
