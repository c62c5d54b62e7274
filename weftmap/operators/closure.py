"""Transitive dependents by semi-naive rounds, in breadth-first order (JOIN-10, SRT-1, Q1).

A round joins the frontier with the edges and takes away what was visited; both
are written to the shared folder, so lineage doesn't grow with depth. A file is found by
the first of its neighbours in the level before, and files found by the same one are in
order of path. ``place`` keeps that order within a level: a level is sorted by range over all
tasks and numbered as it is written, with gaps between tasks, so no task numbers a whole level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize

_REACHED = "file_path string, depth int, place bigint"


def impact(edges: DataFrame, path: str, reverse: bool = True) -> DataFrame:
    """(file_path, depth, place): ``path`` at depth 0, known or not, and all that reach it (or, not ``reverse``, that it reaches)."""
    spark = edges.sparkSession
    near, far = ("dst", "src") if reverse else ("src", "dst")
    steps = edges.select(F.col(near).alias("near"), F.col(far).alias("far"))
    visited = frontier = spark.createDataFrame([(path, 0, 0)], _REACHED)
    depth = 0
    while True:
        depth += 1
        found = frontier.join(steps, frontier.file_path == steps.near).groupBy(F.col("far").alias("file_path")).agg(F.min("place").alias("by"))
        new = found.join(visited.select("file_path"), "file_path", "left_anti").orderBy("by", F.collate("file_path", "UNICODE"))
        frontier = materialize(new.select("file_path", F.lit(depth).alias("depth"), F.monotonically_increasing_id().alias("place")), "frontier")
        if frontier.isEmpty():
            return visited
        visited = materialize(visited.unionByName(frontier), "visited") if depth % 8 == 0 else visited.unionByName(frontier)


def _run_ends(ways: DataFrame) -> DataFrame:
    """(node, up, d, done): for each node with one way in, the end of the run of such nodes before it and how far that is, by pointer doubling.

    Rows not ``done`` lie on, or hang on, a cycle of such nodes, which nothing reaches from outside.
    Each round doubles what a pointer spans, so nodes on their way to an end get
    fewer in every round; once their number stays, only cycles are left.
    """
    single = ways.where("n = 1").select(F.col("far").alias("node"), F.col("only").alias("up"))
    ends = single.select(F.col("node").alias("of"))
    found = single.join(ends, single.up == ends.of, "left").select("node", "up", F.lit(1).cast("bigint").alias("d"), F.col("of").isNull().alias("done"))
    runs = materialize(found, "runs")
    left = runs.where("not done").count()
    while left:
        ahead = runs.select(F.col("node").alias("at"), F.col("up").alias("next_up"), F.col("d").alias("more"), F.col("done").alias("ends"))
        moved = runs.where("not done").join(ahead, F.col("up") == F.col("at")).select("node", F.col("next_up").alias("up"), (F.col("d") + F.col("more")).alias("d"), F.col("ends").alias("done"))
        before, held = runs, left
        runs = materialize(runs.where("done").unionByName(moved), "runs")
        discard(before)
        left = runs.where("not done").count()
        if left == held:
            break
    return runs


def depths(edges: DataFrame, path: str, reverse: bool = True, levels: int = 6) -> DataFrame:
    """(file_path, depth): what ``impact`` finds, without its order, in fewer jobs where the graph is deep.

    The first ``levels`` levels are jobs of their own. In what is left a file with one way in is
    as deep as the end of its run of such files, plus its place in the run, so runs are
    drawn together first, in jobs that grow with the logarithm of their length. The other files
    meet over arcs as long as the runs; a round carries on from files that came nearer. A
    chain or a tree of any depth needs no such round, a graph where every file has
    several ways in as many as it has levels.
    """
    spark = edges.sparkSession
    near, far = ("dst", "src") if reverse else ("src", "dst")
    steps = edges.select(F.col(near).alias("near"), F.col(far).alias("far"))
    reached = frontier = spark.createDataFrame([(path, 0)], "file_path string, depth bigint")
    for depth in range(1, levels + 1):
        found = frontier.join(steps, frontier.file_path == steps.near).select(F.col("far").alias("file_path")).distinct()
        new = found.join(reached.select("file_path"), "file_path", "left_anti")
        frontier = materialize(new.select("file_path", F.lit(depth).cast("bigint").alias("depth")), "frontier")
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)
    reached = materialize(reached, "reached")
    rest = materialize(steps.join(reached.select(F.col("file_path").alias("far")), "far", "left_anti").distinct(), "rest")
    ways = materialize(rest.groupBy("far").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("only")), "ways")
    runs = _run_ends(ways)
    met = rest.join(ways.where("n > 1").select("far"), "far", "left_semi").join(runs, F.col("near") == F.col("node"), "left").where("done is null or done")
    arcs = materialize(met.groupBy(F.coalesce("up", "near").alias("near"), "far").agg(F.min(F.coalesce("d", F.lit(0)) + 1).alias("w")), "arcs")
    known = active = frontier
    rounds = 0
    while True:
        rounds += 1
        nearer = active.join(arcs, active.file_path == arcs.near).groupBy("far").agg(F.min(F.col("depth") + F.col("w")).alias("depth"))
        old = known.select(F.col("file_path").alias("at"), F.col("depth").alias("had"))
        nearer = nearer.join(old, (F.col("far") == F.col("at")) & (F.col("had") <= F.col("depth")), "left_anti")
        active = materialize(nearer.select(F.col("far").alias("file_path"), "depth"), "nearer")
        if active.isEmpty():
            break
        known = known.unionByName(active)
        if rounds % 8 == 0:
            known = materialize(known.groupBy("file_path").agg(F.min("depth").alias("depth")), "known")
    known = known.groupBy("file_path").agg(F.min("depth").alias("depth"))
    inner = runs.where("done").join(known, F.col("up") == F.col("file_path")).select(F.col("node").alias("file_path"), (F.col("depth") + F.col("d")).alias("depth"))
    further = known.unionByName(inner).where(F.col("depth") > levels)
    return reached.unionByName(further)


def ranked(reached: DataFrame, scores: DataFrame) -> DataFrame:
    """With scores (0 where unknown), best first; ties in breadth-first order."""
    out = reached.join(scores, "file_path", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.orderBy(F.desc("score"), "depth", "place")
