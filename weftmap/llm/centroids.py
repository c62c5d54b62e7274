"""Clustering by Lloyd's rounds that touch only what changed, in whole numbers.

Vectors become integers once. Each row of the written table of assignments holds a
vector, its owner and its distance to it, and the sums of all vectors of a centroid are
kept too. In a round, a vector whose owner stayed where it was is compared with the
centroids that moved and with nothing else: its distance to the owner is known, and the
other centroids, which stayed, have lost to it before. A vector whose owner moved is
compared with all. Only vectors that change hands bring numbers to the sums: each takes
itself away from the old owner and adds itself to the new one. Every task adds up what
its rows bring before anything is shuffled, at most two rows a centroid.

The driver holds ``k`` centroids and their sums, never rows. No vector is shuffled, so no
key can be hot. A lost executor costs its tasks of one round, as each round is a table in
the shared folder.

Rows: vectors of another length, null ones, and those with a null, NaN or infinite
component are left out. A component's integer must lie within ±2^28, so that no distance
exceeds a long; larger ones are an error. A null id is an empty text to the hash that
picks the first centroids; rows of equal hash (repeated ids) are in order of their vectors.
Rows that repeat count each. Fewer vectors than ``k`` are so many centroids; without any
the result is empty. Kept columns that clash come back by the rule of ``common.carry``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import carry, columns, discard, materialize, quoted

#: Largest integer of a component.
MOST = 1 << 28
_STATE = "wm_vec array<bigint>, wm_owner int, wm_dist bigint, wm_before int, wm_moved boolean"


def quantised(vectors: DataFrame, keep: Iterable[str], ident: str = "vec_id", column: str = "embedding", dims: int = 64, scale: int = 256) -> tuple[DataFrame, list[str]]:
    """Kept vectors as ``wm_vec`` (floor of scale times each component) with their ids as text, ``wm_id``; and the names of the columns ``keep``."""
    own, names, (i, v), _ = carry(vectors, keep, "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string", (ident, column))
    x = quoted(v).cast("array<double>")
    whole = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    kept = own.where((F.size(x) == dims) & whole)
    made = F.transform(x, lambda c: F.floor(c * scale))
    sized = F.when(F.forall(made, lambda c: F.abs(c) <= MOST), made).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST}")).cast("array<bigint>"))
    return kept.select(*[quoted(n) for n in names], F.coalesce(quoted(i).cast("string"), F.lit("")).alias("wm_id"), sized.alias("wm_vec")), names


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the least hash of seed and id."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), "wm_id"), 256)
    rows = vectors.select(order.alias("h"), "wm_vec").orderBy("h", "wm_vec").limit(k).collect()
    return np.array([r["wm_vec"] for r in rows], np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all of ``c``."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 52:  # every term and sum is a whole number that a double holds
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1) if len(c) else np.empty((len(x), 0), np.int64)


def reassign(x: np.ndarray, owner: np.ndarray, dist: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances. ``owner`` -1: none yet. Of equal distances the smaller number wins."""
    owner, dist = owner.copy(), dist.copy()
    lost = (owner < 0) | changed[owner]
    if lost.any():
        d = distances(x[lost], centroids)
        owner[lost] = d.argmin(1)
        dist[lost] = d.min(1)
    moved = np.flatnonzero(changed)
    stays = np.flatnonzero(~lost)
    if len(moved) and len(stays):
        d = distances(x[stays], centroids[moved])
        near = d.argmin(1)
        d, number = d[np.arange(len(stays)), near], moved[near]
        won = (d < dist[stays]) | (d == dist[stays]) & (number < owner[stays])
        owner[stays[won]], dist[stays[won]] = number[won], d[won]
    return owner, dist


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1), np.int64)


def _assign(centroids: np.ndarray, changed: np.ndarray, n_keep: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            vec, owner, dist = columns(batch, ("wm_vec", "wm_owner", "wm_dist"))
            before = owner.to_numpy(zero_copy_only=False).astype(np.int32)
            now, d = reassign(_matrix(vec), before, dist.to_numpy(zero_copy_only=False), centroids, changed)
            made = [pa.array(now, pa.int32()), pa.array(d, pa.int64()), pa.array(before, pa.int32()), pa.array(now != before)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], vec, *made], [*batch.schema.names[:n_keep], "wm_vec", "wm_owner", "wm_dist", "wm_before", "wm_moved"])

    return run


def _transfers(k: int, dims: int):
    """What a task's moved vectors bring to the sums: a row for each centroid that gains or loses."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in it:
            vec, owner, before = columns(batch, ("wm_vec", "wm_owner", "wm_before"))
            x, to, gone = _matrix(vec), owner.to_numpy(), before.to_numpy()
            for who, sign in ((to, 1), (gone, -1)):
                rows = np.flatnonzero(who >= 0)
                rows = rows[np.argsort(who[rows], kind="stable")]
                if len(rows):
                    at = np.flatnonzero(np.diff(who[rows], prepend=-1))
                    sums[who[rows][at]] += sign * np.add.reduceat(x[rows], at)
                    n += sign * np.bincount(who[rows], minlength=k)
        touched = np.flatnonzero((n != 0) | sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(touched, pa.int32()), pa.array(n[touched]), pa.array(list(sums[touched]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _apply(state: DataFrame, sums: np.ndarray, n: np.ndarray) -> None:
    """Adds the transfers of the moved vectors to the sums and counts."""
    k, dims = sums.shape
    moved = state.where("wm_moved").select("wm_vec", "wm_owner", "wm_before")
    parts = moved.mapInArrow(_transfers(k, dims), "cluster int, n bigint, sums array<bigint>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dims)])
    for r in total.collect():  # a row for each centroid at most
        n[r["cluster"]] += r["n"]
        sums[r["cluster"]] += np.array(r[2:], np.int64)


def cluster(vectors: DataFrame, keep: Iterable[str], k: int = 40, rounds: int = 5, seed: int = 2, ident: str = "vec_id", column: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """The columns ``keep`` of each vector, its cluster, squared distance, the clusters' inertia and its centroid's digest."""
    spark = vectors.sparkSession
    given, names = quantised(vectors, keep, ident, column, dims, scale)
    given = materialize(given, "vectors")
    centroids = first_centroids(given, k, seed)
    shown = [*[quoted(n) for n in names], F.col("wm_owner").alias("cluster"), F.col("wm_dist").alias("distance")]
    schema = StructType([*[given.schema[n] for n in names], *StructType.fromDDL(_STATE).fields])
    start = given.select(*[quoted(n) for n in names], "wm_vec", F.lit(-1).alias("wm_owner"), F.lit(0).cast("bigint").alias("wm_dist"))
    if not len(centroids):
        return start.select(*shown, F.lit(0).cast("bigint").alias("cluster_inertia"), F.lit(0).cast("bigint").alias("inertia"), F.lit("").alias("centroid_sha256"))
    k = len(centroids)
    sums, n, changed = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.ones(k, bool)
    state = materialize(start.mapInArrow(_assign(centroids, changed, len(names)), schema), "assigned")
    discard(given)
    for _ in range(rounds):
        _apply(state, sums, n)
        moved = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centroids)
        changed, centroids = (moved != centroids).any(1), moved
        if not changed.any():
            break  # nothing would change in the rounds to come
        before = state
        state = materialize(before.select(*[quoted(x) for x in names], "wm_vec", "wm_owner", "wm_dist").mapInArrow(_assign(centroids, changed, len(names)), schema), "assigned")
        discard(before)
    by_cluster = state.groupBy("wm_owner").agg(F.sum("wm_dist").alias("d")).collect()  # at most k rows
    of = dict.fromkeys(range(k), 0) | {r["wm_owner"]: r["d"] for r in by_cluster}
    facts = [(c, of[c], sum(of.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in range(k)]
    table = spark.createDataFrame(facts, "wm_c int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # k rows, a parameter, so its size is known
    return state.select(*shown, "wm_owner").join(F.broadcast(table), F.col("wm_owner") == F.col("wm_c")).drop("wm_owner", "wm_c")
