"""Operators that keep state: the digest index, revised panes, clusters by deltas."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftmap.llm import centroids, exact, panes
from weftmap.llm.common import materialize
from weftmap.llm.cuckoo import CuckooFilter, parts

SPACE = re.compile(r"[\x20\x09-\x0D]")


# --- cuckoo filter and digest index


def hashes(n, salt=""):
    return np.frombuffer(b"".join(hashlib.sha256(f"{salt}{i}".encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)


@pytest.mark.parametrize("n", [0, 1, 900, 5000])
def test_filter_holds_what_is_put_in(n):
    own, other = hashes(n), hashes(4000, "other")
    f = CuckooFilter.build(own, 64)
    assert f.contains(own).all() and len(f) == n
    assert f.contains(other).mean() < 0.005
    f = CuckooFilter.load(f.dump())
    f.delete(own[: n // 2])
    assert f.contains(own[n // 2 :]).all() and len(f) == n - n // 2
    assert f.contains(own[: n // 2]).sum() <= 0.05 * n


def test_full_filter_says_so():
    f = CuckooFilter(4)
    assert not f.insert(hashes(40))
    f = CuckooFilter(256)
    done = [f.insert(hashes(100, str(k))) for k in range(11)]
    assert done[0] and not done[-1]
    with pytest.raises(KeyError):
        CuckooFilter(4).delete(hashes(1))


def test_filter_takes_equal_places():
    """Digests of the same bucket and fingerprint fill both buckets, and go one by one."""
    same = np.repeat(hashes(1), 8, 0)
    f = CuckooFilter(16)
    where, fp = parts(same)
    assert len(set(where.tolist())) == len(set(fp.tolist())) == 1
    assert f.insert(same) and len(f) == 8
    f.delete(same[:7])
    assert f.contains(same[:1]).all()
    f.delete(same[:1])
    assert not f.contains(same[:1]).any()


def signed(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string")
    return materialize(df.select(exact.digest(F.col("text")).alias("digest"), F.length("text").alias("chars"), "id", F.monotonically_increasing_id().alias("row")), "rows")


def live(index):
    return {bytes(r["digest"]): (r["n"], r["best"]["id"]) for r in index.owners().collect()}


def held(index):
    """Digests that the filters say they hold, by shard."""
    return {r["shard"]: len(CuckooFilter.load(r["slots"])) for r in index.filters.collect()}


def key(text):
    return hashlib.sha256(SPACE.sub("", text).encode()).digest()


def test_index_inserts_deletes_and_grows(spark):
    index = exact.DigestIndex(spark, shards=2, buckets=2)
    index.delete(signed(spark, [(1, "nothing")]))
    first = [(i, f"text {i % 40}") for i in range(60)]
    index.insert(signed(spark, first))
    assert index.resized == 2 and sum(held(index).values()) == 40
    index.insert(signed(spark, [(100 + i, f"te xt{i}") for i in range(30, 70)] + [(99, "text 3     ")]))
    got = live(index)
    assert len(got) == 70 == sum(held(index).values())
    assert got[key("text 35")] == (2, 35) and got[key("text 5")] == (2, 5)
    assert got[key("text 3")] == (3, 99) and got[key("text 69")] == (1, 169)
    index.delete(signed(spark, [(99, "text 3"), (5, "text 5"), (45, "text 5"), (169, "text 69"), (7, "text 8")]))
    got = live(index)
    assert got[key("text 3")] == (2, 3) and key("text 5") not in got and key("text 69") not in got
    assert got[key("text 7")] == (2, 7)
    assert len(got) == 68 == sum(held(index).values())
    index.insert(signed(spark, [(500, "text 5"), (501, "text 6")]))
    got = live(index)
    assert got[key("text 5")] == (1, 500) and got[key("text 6")] == (3, 6) and sum(held(index).values()) == 69


def test_chance_hits_are_verified(spark, monkeypatch):
    """With filters that always say yes, no text is lost all the same."""
    monkeypatch.setattr(exact, "_asked", lambda buckets: lambda held, given: given.append_column("hit", pa.array([True] * len(given))))
    index = exact.DigestIndex(spark, shards=2)
    for turn in range(3):
        index.insert(signed(spark, [(10 * turn + i, f"t{turn + i}") for i in range(5)]) if turn else materialize(signed(spark, [(0, "t0")]), "rows"))
    got = live(index)
    assert set(got) == {key(f"t{i}") for i in range(7)}
    assert got[key("t2")] == (2, 11)


def plain_dedup(rows):
    groups = defaultdict(list)
    for n, (i, text) in enumerate(rows):
        groups[hashlib.sha256(SPACE.sub("", text or "").encode()).hexdigest()].append((-len(text or ""), (i is not None, i or 0), n, i))
    out = []
    for h, own in groups.items():
        best = min(own)
        out += [(i, best[3], len(own), (s, k, n) == best[:3], h) for s, k, n, i in own]
    return sorted(map(str, out))


def test_dedup_odd(spark):
    long = "word " * 200_000 + "end"
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a b"), (5, "a b"), (6, "ab"), (6, "ab"), (None, "ab "), (None, "b"), (7, "é😀 "), (8, "é😀"), (9, long), (10, long + " "), (11, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumns({"kept": F.lit(1), "shard": F.lit(2), "wm_row": F.lit(3)})
    out = exact.deduplicate(df, ["doc_id", "kept", "wm_row", "shard"])
    assert out.columns == ["doc_id", "kept_in", "wm_row_in", "shard", "keep_id", "group_size", "kept", "text_sha256"]
    got = sorted(str(tuple(r)) for r in out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == plain_dedup(rows)


def test_dedup_other_ids_and_nothing(spark):
    df = spark.createDataFrame([("x", "a"), ("b", "a"), (None, "c")], "doc_id string, text string")
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.deduplicate(df, ["doc_id"], arrivals=2).collect()}
    assert got == {("x", "b", 2, False), ("b", "b", 2, True), (None, None, 1, True)}
    assert exact.deduplicate(df.limit(0), ["doc_id"]).count() == 0


# --- panes

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
ZERO = datetime(1970, 1, 1)


def plain_panes(rows, n=10, grace=12, keep=48):
    """The rules, one batch after another."""
    once = {}
    for c, ts, arrived, _, kind, value, _ in rows:
        if ts is None:
            continue
        day = (arrived - ZERO) // timedelta(days=1) if arrived else 0
        q = day % n
        b = min(n - 1, q + max(0, (zlib.crc32(str(c).encode()) if c is not None else 0) % 30 - 23))
        at = (ts - ZERO) // timedelta(microseconds=1) - (day - q) * 86_400_000_000
        cents = math.floor(100 * value + 0.5) if value is not None and math.isfinite(value) else 0
        once[c] = min(once.get(c, (b, at, kind or "none", cents)), (b, at, kind or "none", cents))
    totals, emitted, out, top = {}, set(), [], None
    for b in range(n):
        ends = lambda hour, more: top is not None and top >= (hour + 1 + more) * 3_600_000_000  # noqa: B023, E731
        old, got = dict(totals), [(c, *v) for c, v in once.items() if v[0] == b]
        for c, _, at, kind, cents in got:
            hour = at // 3_600_000_000
            if ends(hour, keep):
                out.append((b, hour, c, 1, cents, "late", kind))
            else:
                a = totals.get((kind, hour), (0, 0))
                totals[kind, hour] = (a[0] + 1, a[1] + cents)
        for (kind, hour), now in totals.items():
            if (kind, hour) in emitted:
                if now != old[kind, hour]:
                    out += [(b, hour, -1, *old[kind, hour], "retract", kind), (b, hour, -1, *now, "replace", kind)]
            elif ends(hour, grace):
                out.append((b, hour, -1, *now, "emit", kind))
                emitted.add((kind, hour))
            elif b == n - 1:
                out.append((b, hour, -1, *now, "final", kind))
        totals = {k: v for k, v in totals.items() if not ends(k[1], keep)}
        tops = [v[2] for v in got]
        top = max([*tops, *([] if top is None else [top])], default=None)
    return sorted(map(str, out))


def told(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_panes_are_those_of_the_rules(spark):
    """Rows before 1970 too, batches without rows, late rows, revised panes, and cents that cancel."""
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        day = rng.choice([0, 1, 2, 3, 6, 7, 9, 11, 12])  # no day 4, 5, 8
        arrived = ZERO + timedelta(days=19_720 + day, seconds=rng.randrange(86_400))
        ts = arrived - timedelta(hours=rng.choice([0, 0, 1, 5, 30, 70, 200]), microseconds=rng.randrange(10**9))
        rows.append((i, ts, arrived, 1, rng.choice(["view", "click", None]), rng.choice([None, 0.005, -1.005, 12.345, float("nan"), float("inf")]), None))
    rows += [rows[3], (3, rows[3][1] + timedelta(hours=5), rows[3][2], 1, "view", 1.0, None), (None, rows[0][1], rows[0][2], 1, "x", 2.0, None), (None, rows[0][1], rows[0][2], 1, "x", 2.0, None)]
    rows += [(5000, None, rows[0][2], 1, "x", 1.0, None), (5001, ZERO + timedelta(hours=3), None, None, "x", 1.0, None)]
    df = spark.createDataFrame(rows, CLICKS).withColumns({"batch": F.lit(1), "hour": F.lit(2), "record": F.lit("r"), "us": F.lit(3)})
    want = plain_panes(rows)
    assert {x for x in ("emit", "late", "retract", "replace", "final") if any(f"'{x}'" in w for w in want)} == {"emit", "late", "retract", "replace", "final"}
    assert told(panes.run(df)) == want


def test_panes_without_rows(spark):
    out = panes.run(spark.createDataFrame([], CLICKS), n_batches=2)
    assert out.count() == 0 and out.columns == ["batch", "hour", "click_id", "n_rows", "cents", "record", "kind"]
    one = [(1, ZERO, ZERO, None, None, None, None)]
    assert told(panes.run(spark.createDataFrame(one, CLICKS), n_batches=2)) == plain_panes(one, n=2)


# --- clusters


def plain_lloyd(rows, k, rounds, seed=2):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), n) for n, w in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if n in own else w for n, w in enumerate(c)]
    got = [(i, *near(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, d, n in got:
        inertia[n] += d
    return sorted(str((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest())) for i, d, n in got)


def test_clusters_are_lloyds(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.normal(size=64) * 0.2).astype(np.float32).tolist()) for i in range(160)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (1002, [0.0] * 64), (1003, None), (1004, [0.0] * 63), (1005, [float("nan")] * 64), (1006, [float("inf"), *[0.0] * 63]), (1007, [None, *[0.0] * 63]), (1008, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumns({"cluster": F.lit(1), "n": F.lit(2)})
    out = centroids.cluster(df, ["vec_id", "cluster", "n"], k=12, rounds=5)
    assert out.columns[:3] == ["vec_id", "cluster_in", "n"]
    assert sorted(str(tuple(r)) for r in out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()) == plain_lloyd(rows, 12, 5)


def test_clusters_of_few_rows(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(str(tuple(r)) for r in centroids.cluster(df, ["vec_id"]).collect()) == plain_lloyd(rows, 40, 5)
    assert centroids.cluster(df.limit(0), ["vec_id"]).count() == 0


def test_a_round_compares_only_what_changed():
    """Against full rounds, with large numbers too; unchanged centroids bring no work to vectors that stayed."""
    rng = np.random.default_rng(1)
    for size in (50, 1 << 27):
        x, c = rng.integers(-size, size, (300, 64)), rng.integers(-size, size, (9, 64))
        c[4] = c[2]
        owner, dist = centroids.reassign(x, np.full(300, -1), np.zeros(300, np.int64), c, np.ones(9, bool))
        moved = c.copy()
        moved[[1, 5]] += rng.integers(-size // 4, size // 4, (2, 64))
        changed = (moved != c).any(1)
        got = centroids.reassign(x, owner, dist, moved, changed)
        d = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in moved] for v in x], object)
        assert (got[0] == d.argmin(1)).all() and (got[1] == d.min(1)).all()
    asked = []
    plain = centroids.distances
    centroids.distances = lambda a, b: asked.append((len(a), len(b))) or plain(a, b)
    try:
        centroids.reassign(x, *got, moved, np.zeros(9, bool))
        centroids.reassign(x, *got, moved, np.arange(9) == 5)
    finally:
        centroids.distances = plain
    lost = int((got[0] == 5).sum())
    assert asked == [(lost, 9), (300 - lost, 1)]


def test_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [3e38] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="a component is beyond"):
        centroids.cluster(df, ["vec_id"]).collect()


def test_no_store_stays_in_memory(spark):
    """The stores of a start go with its commit."""
    assert panes.run(spark.read.parquet("/root/testdata/sf0.001/clicks.parquet"), n_batches=2).count()
    held = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.execution.streaming.state.StateStore$").getDeclaredField("loadedProviders")
    held.setAccessible(True)
    assert held.get(None).size() == 0


def test_stores_take_no_memory_beside_the_heap(spark, monkeypatch):
    """Commits are those of stores in the heap, not of RocksDB."""
    fed, feed = [], panes.PaneState.feed
    monkeypatch.setattr(panes.PaneState, "feed", lambda self, latest: (fed.append(self.base), feed(self, latest))[1])
    assert panes.run(spark.read.parquet("/root/testdata/sf0.001/clicks.parquet"), n_batches=2).count()
    kinds = {f.suffix for f in Path(fed[0].removeprefix("file:")).glob("checkpoint/state/0/[0-9]*/*")}
    assert len(fed) == 2 and ".delta" in kinds and not kinds & {".changelog", ".zip"}
