"""PageRank with teleport weights (PR-1 to PR-5, AGG-3, 4, 5, 9).

new(v) = alpha (link(v) + dangling t(v)) + (1 - alpha) t(v), from 1 / N, all new
scores from all old ones, until their L1 difference is below the tolerance.

Files are dealt into blocks and numbered once, and all rounds are over numbers; paths come
back with the last scores. A number is a block and a place in it, so what rounds need of a
block lies packed in one row: its scores as doubles in order of place, which of them go to
each other block, and where what comes from each block is added. A round is two steps: each
block gives every other one number for each of its files that points there, and adds up what
it gets. That is all that a round shuffles, 8 bytes without a key; edges and places stay in
buckets of their block. The driver gets two sums a round, observed while the round is
written: what moved, and what dangling files hold for the next. The scores of the round
before go then.

A block is held by one task. Where a block would have more than ``BLOCK_EDGES`` edges (a hub
that very many files need), rounds go over rows instead (``one_round``): edges in buckets of
their source, a hub's in several parts, each in a bucket of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize, materialize_bucketed

ALPHA, ROUNDS, TOLERANCE = 0.85, 100, 1e-6
FOCUS_WEIGHT = 10.0
#: Edges of a file that lie in one part.
PART_EDGES = 100_000
#: Files of a block, if there are more than two blocks a core.
BLOCK_FILES = 100_000
#: Edges that a block may have, out or in.
BLOCK_EDGES = 50_000_000
#: A number is its block times this and its place.
PLACES = 1 << 32


@dataclass(frozen=True)
class Ranked:
    scores: DataFrame
    iterations: int
    converged: bool


def numbered(files: DataFrame) -> DataFrame:
    """(file_path, id): each file once, with a number."""
    spark = files.sparkSession
    paths = materialize(files.select("file_path").distinct(), "paths")
    n = paths.count()
    blocks = max(1, min(n, max(2 * spark.sparkContext.defaultParallelism, -(-n // BLOCK_FILES))))
    block = F.pmod(F.xxhash64("file_path"), F.lit(blocks)).alias("block")
    place = F.row_number().over(Window.partitionBy("block").orderBy("file_path")) - 1
    names = materialize(paths.select("file_path", block).select("file_path", (F.col("block") * PLACES + place).alias("id")), "names")
    discard(paths)
    return names


def teleport(names: DataFrame, personalization: DataFrame | dict[str, float] | None) -> DataFrame:
    """(id, t): weights over their sum; all alike if no known file has a weight."""
    if not isinstance(personalization, DataFrame):
        given = list((personalization or {}).items())
        personalization = names.sparkSession.createDataFrame([(p, float(w)) for p, w in given], "file_path string, weight double")
    known = names.join(personalization.groupBy("file_path").agg(F.sum("weight").alias("weight")), "file_path", "left")
    sums = known.agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n"))
    # one row of two numbers, so its size is known
    return known.join(F.broadcast(sums)).select("id", F.when(F.coalesce("total", F.lit(0.0)) > 0, F.coalesce("weight", F.lit(0.0)) / F.col("total")).otherwise(F.lit(1.0) / F.col("n")).alias("t"))


def known_edges(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) as numbers: edges between files that are known, each once."""
    of = lambda end: names.select(F.col("file_path").alias(f"{end}_path"), F.col("id").alias(f"{end}_id"))
    met = edges.select(F.col("src").alias("src_path"), F.col("dst").alias("dst_path"))
    # files are fewer than edges: their numbers are hashed, so edges are never sorted by path
    met = met.join(of("src").hint("shuffle_hash"), "src_path").join(of("dst").hint("shuffle_hash"), "dst_path")
    # edges that are the same lie where they met their target's path, so they are told apart there
    return met.select("dst_path", "dst_id", "src_id").distinct().select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))


def dealt_edges(edges: DataFrame, parts: DataFrame, buckets: int) -> DataFrame:
    """(src, part, dst) in buckets of (src, part)."""
    part = F.when(F.col("parts") > 1, F.pmod(F.hash("dst"), F.col("parts"))).otherwise(0).cast("int")
    dealt = edges.join(parts.select("src", "parts").hint("shuffle_hash"), "src").select("src", part.alias("part"), "dst")
    return materialize_bucketed(dealt.repartition(buckets, "src", "part"), "flows", buckets, "src", "part")


def one_round(state: DataFrame, flows: DataFrame, alpha: float, lost: float) -> DataFrame:
    """(file_path, t, k, parts, score, old): the scores of the next round; any key of a file goes."""
    given = state.where("k > 0").select("file_path", (F.col("score") / F.col("k")).alias("gives"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # the edges are the larger side: they are streamed past a hash table of each bucket's givers
    met = flows.join(given.hint("shuffle_hash"), (flows.src == given.file_path) & (flows.part == given.part))
    link = met.groupBy("dst").agg(F.sum("gives").alias("link"))
    new = F.lit(alpha) * (F.coalesce("link", F.lit(0.0)) + F.lit(lost) * F.col("t")) + F.lit(1 - alpha) * F.col("t")
    return state.join(link.hint("shuffle_hash"), state.file_path == link.dst, "left").select("file_path", "t", "k", "parts", new.alias("score"), F.col("score").alias("old"))


def _column(rows: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(name).to_numpy()


def _bytes(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _row(schema: str, **values) -> pa.Table:
    kinds = {"block": pa.int64(), "to": pa.int64(), "origin": pa.int64(), "n_edges": pa.int64(), "lost": pa.float64(), "delta": pa.float64()}
    return pa.table({k: pa.array([values[k]], kinds.get(k, pa.binary())) for k in schema.replace(",", " ").split()[::2]})


_OUT = "block long, degree binary, others binary, counts binary, places binary"
_IN = "block long, origins binary, counts binary, repeats binary, places binary"
_VECTOR = "block long, t binary"
_GIVEN = "to long, origin long, gives binary"
_STATE = "block long, score binary, lost double, delta double"


def _tiles(own: np.ndarray, other: np.ndarray, by_source: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's edges in order of (other block, source, target): the other blocks, and of each edge its other block, source and target."""
    block, far, near = other // PLACES, (other % PLACES).astype(np.int32), (own % PLACES).astype(np.int32)
    source, target = (near, far) if by_source else (far, near)
    order = np.lexsort((target, source, block))
    return np.unique(block), block[order], source[order], target[order]


def _firsts(block: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Where a source begins in the edges to or from a block."""
    return np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (source[1:] != source[:-1])]))


def _pack_out(key: tuple[pa.Scalar, ...], edges: pa.Table) -> pa.Table:
    """What a block gives: how many edges its files have, and the places of those that point to each other block."""
    others, block, source, _ = _tiles(_column(edges, "src"), _column(edges, "dst"), True)
    at = _firsts(block, source)
    counts = np.diff(np.append(np.searchsorted(block[at], others), len(at)))
    return _row(_OUT, block=key[0].as_py(), degree=_bytes(np.bincount(source), "<i8"), others=_bytes(others, "<i8"), counts=_bytes(counts, "<i8"), places=_bytes(source[at], "<i4"))


def _pack_in(key: tuple[pa.Scalar, ...], edges: pa.Table) -> pa.Table:
    """What a block gets: how many numbers from each other block, how many edges each stands for, and the places they lead to."""
    origins, block, source, target = _tiles(_column(edges, "dst"), _column(edges, "src"), False)
    at = _firsts(block, source)
    counts = np.diff(np.append(np.searchsorted(block[at], origins), len(at)))
    return _row(_IN, block=key[0].as_py(), origins=_bytes(origins, "<i8"), counts=_bytes(counts, "<i8"), repeats=_bytes(np.diff(np.append(at, len(block))), "<i4"), places=_bytes(target, "<i4"))


def _pack_vector(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    t = np.empty(rows.num_rows)
    t[_column(rows, "id") % PLACES] = _column(rows, "t")
    return _row(_VECTOR, block=key[0].as_py(), t=_bytes(t, "<f8"))


def _padded(degree: bytes | None, n: int) -> np.ndarray:
    known = np.frombuffer(degree or b"", "<i8")
    return np.concatenate([known, np.zeros(n - len(known), np.int64)])


def _start(one: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def made(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["t"]) // 8
                lost = one * int((_padded(row["degree"], n) == 0).sum())
                yield from _row(_STATE, block=row["block"], score=_bytes(np.full(n, one), "<f8"), lost=lost, delta=0.0).to_batches()

    return made


def _give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            degree, score = np.frombuffer(row["degree"], "<i8"), np.frombuffer(row["score"], "<f8")
            gives = score[: len(degree)] / np.maximum(degree, 1)
            given = gives[np.frombuffer(row["places"], "<i4")]
            ends = np.cumsum(np.frombuffer(row["counts"], "<i8"))
            for other, part in zip(np.frombuffer(row["others"], "<i8").tolist(), np.split(given, ends[:-1]), strict=True):
                yield from _row(_GIVEN, to=other, origin=row["block"], gives=_bytes(part, "<f8")).to_batches()


def _get(alpha: float, lost: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def added(own: pa.Table, given: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        t, old = np.frombuffer(row["t"], "<f8"), np.frombuffer(row["score"], "<f8")
        link = np.zeros(len(t))
        if row["origins"]:
            got = dict(zip(given.column("origin").to_pylist(), given.column("gives").to_pylist(), strict=True))
            values = np.concatenate([np.frombuffer(got[b], "<f8") for b in np.frombuffer(row["origins"], "<i8").tolist()])
            link = np.bincount(np.frombuffer(row["places"], "<i4"), np.repeat(values, np.frombuffer(row["repeats"], "<i4")), len(t))
        score = alpha * (link + lost * t) + (1 - alpha) * t
        dangling = _padded(row["degree"], len(t)) == 0
        return _row(_STATE, block=row["block"], score=_bytes(score, "<f8"), lost=float(score[dangling].sum()), delta=float(np.abs(score - old).sum()))

    return added


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            score = np.frombuffer(row["score"], "<f8")
            yield pa.record_batch({"file_path": row["block"] * PLACES + np.arange(len(score)), "score": score})


def packed_round(state: DataFrame, blocks: DataFrame, flows: DataFrame, buckets: int, alpha: float, lost: float) -> DataFrame:
    """(block, score, lost, delta): the scores of the next round, and of each block what dangling files hold and what moved."""
    # dealt as the tables of blocks lie, so that those stay where they are
    scores = state.select("block", "score").repartition(buckets, "block").hint("shuffle_hash")
    given = flows.join(scores, "block").mapInArrow(_give, _GIVEN).repartition(buckets, "to")
    return blocks.join(scores, "block").groupBy("block").cogroup(given.groupBy("to")).applyInArrow(_get(alpha, lost), _STATE)


def _observed(rows: DataFrame, *sums) -> tuple[DataFrame, Observation]:
    seen = Observation(uuid.uuid4().hex)
    return rows.observe(seen, *sums), seen


def _packed_rounds(base: DataFrame, edges: DataFrame, n: int, buckets: int, alpha: float, rounds: int, tolerance: float) -> tuple[DataFrame, int, bool]:
    block = lambda name: F.floor(F.col(name) / PLACES).alias("block")
    # a task of Python is dear, so there are no more than blocks
    buckets = min(buckets, base.select(block("id")).distinct().count())
    flows = edges.groupBy(block("src")).applyInArrow(_pack_out, _OUT)
    flows = materialize_bucketed(flows, "flows", buckets, "block")
    gets = edges.groupBy(block("dst")).applyInArrow(_pack_in, _IN)
    vectors = base.groupBy(block("id")).applyInArrow(_pack_vector, _VECTOR)
    blocks = vectors.join(flows.select("block", "degree"), "block", "left").join(gets, "block", "left")
    blocks = materialize_bucketed(blocks, "blocks", buckets, "block")

    def written(rows: DataFrame) -> tuple[DataFrame, dict]:
        rows, seen = _observed(rows, F.sum("lost").alias("lost"), F.sum("delta").alias("delta"))
        return materialize(rows, "packed"), seen.get

    state, sums = written(blocks.select("block", "t", "degree").mapInArrow(_start(1.0 / n), _STATE))
    done, converged = 0, False
    for done in range(1, rounds + 1):  # noqa: B007
        before = state
        state, sums = written(packed_round(before, blocks, flows, buckets, alpha, float(sums["lost"])))
        discard(before)
        converged = tolerance > 0 and sums["delta"] < tolerance
        if converged:
            break
    rank = materialize(state.select("block", "score").mapInArrow(_unpack, "file_path long, score double"), "rank")
    for table in (flows, blocks, state):
        discard(table)
    return rank, done, converged


def _row_rounds(base: DataFrame, edges: DataFrame, n: int, buckets: int, alpha: float, rounds: int, tolerance: float) -> tuple[DataFrame, int, bool]:
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("k"), F.ceil(F.count(F.lit(1)) / PART_EDGES).cast("int").alias("parts"))
    flows = dealt_edges(edges, degree, buckets)
    one = F.lit(1.0 / n)
    start = base.join(degree, base.id == degree.src, "left").select(F.col("id").alias("file_path"), "t", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("parts", F.lit(1)).alias("parts"), one.alias("score"), one.alias("old"))

    def written(rows: DataFrame) -> tuple[DataFrame, dict]:
        lost = F.sum(F.when(F.col("k") == 0, F.col("score")).otherwise(0.0)).alias("lost")
        rows, seen = _observed(rows, lost, F.sum(F.abs(F.col("score") - F.col("old"))).alias("delta"))
        return materialize_bucketed(rows, "rank", buckets, "file_path"), seen.get

    state, sums = written(start.repartition(buckets, "file_path"))
    done, converged = 0, False
    for done in range(1, rounds + 1):  # noqa: B007
        before = state
        state, sums = written(one_round(before, flows, alpha, float(sums["lost"] or 0.0)))
        discard(before)
        converged = tolerance > 0 and sums["delta"] < tolerance
        if converged:
            break
    discard(flows)
    return state, done, converged


def pagerank(files: DataFrame, edges: DataFrame, alpha: float = ALPHA, rounds: int = ROUNDS, tolerance: float = TOLERANCE, personalization: DataFrame | dict[str, float] | None = None) -> Ranked:
    """Scores of all files; edges between files that aren't known are left out. ``tolerance`` 0 runs all rounds."""
    spark = files.sparkSession
    names = numbered(files)
    edges = materialize(known_edges(names, edges), "edges")
    base = materialize(teleport(names, personalization), "teleport")
    n = base.count()
    if not n:
        return Ranked(spark.createDataFrame([], "file_path string, score double"), 0, True)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    largest = lambda end: edges.groupBy(F.floor(F.col(end) / PLACES)).count().agg(F.max("count")).first()[0] or 0
    way = _packed_rounds if max(largest("src"), largest("dst")) <= BLOCK_EDGES else _row_rounds
    state, done, converged = way(base, edges, n, buckets, alpha, rounds, tolerance)
    return Ranked(state.select(F.col("file_path").alias("id"), "score").join(names, "id").select("file_path", "score"), done, converged)


def top_files(files: DataFrame, scores: DataFrame, n: int = 10) -> DataFrame:
    """The n best (LIM-1)."""
    out = files.select("file_path").join(scores, "file_path", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.orderBy(F.desc("score"), F.collate("file_path", "UNICODE")).limit(n)
