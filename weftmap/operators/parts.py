"""Long texts as parts in order, placed by the tasks (Q-CTX, Q-SEARCH, Q-IMPACT, SNK-3).

An answer about a file that a million others need has a million lines. So it isn't put in
one row: its lines are sorted over all tasks, a task's lengths add up to one number, and
of these (a number a task) the driver makes the tasks' offsets. Where a line starts follows from
its task's offset and a running sum within the task. Parts in order of ``start`` are the text.

Defined results: equal lines stay, each with a place of its own; an empty list says
``(none)`` or 0; names and paths may hold any character, lengths are UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.paths import relative
from ..functions.text import fixed4, units
from ..sources.shared import materialize
from .graph import definitions
from .render import definition_line


def size(text: str) -> int:
    return len(text.encode("utf-16-le")) // 2


def placed(ordered: DataFrame, between: str = "\n") -> tuple[DataFrame, int, int]:
    """(start, text) of the sorted rows' ``text``, from 0 on, how many they are, and the length of all.

    ``between`` stands before each part but the first, and belongs to it.
    """
    spark, gap = ordered.sparkSession, size(between)
    rows = ordered.select(F.monotonically_increasing_id().alias("place"), "text", units(F.col("text")).alias("length"))
    made = materialize(rows, "parts").withColumn("task", F.shiftright("place", 33))
    sums = sorted(tuple(r) for r in made.groupBy("task").agg(F.sum("length"), F.count(F.lit(1))).collect())  # a row for each task
    offsets, at = [], 0
    for k, (task, length, count) in enumerate(sums):
        offsets.append((task, at, k == 0))
        at += length + gap * (count - (k == 0))
    begins = spark.createDataFrame(offsets, "task bigint, base bigint, first boolean")
    w = Window.partitionBy("task").orderBy("place")
    lead = F.col("first") & (F.row_number().over(w) == 1)
    own = F.col("length") + F.when(lead, 0).otherwise(gap)
    # a row for each task, so its size is known
    near = made.join(F.broadcast(begins), "task").withColumn("lead", lead).withColumn("own", own)
    before = F.coalesce(F.sum("own").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = near.select((F.col("base") + before).alias("start"), F.concat(F.when(F.col("lead"), "").otherwise(between), "text").alias("text"))
    return parts, sum(c for _, _, c in sums), at


def counted(ordered: DataFrame, one: str, many: str) -> DataFrame:
    """The parts behind a line that says how many there are."""
    parts, n, _ = placed(ordered)
    text = f"{n} {one if n == 1 else many}" + ("\n\n" if n else "")
    first = ordered.sparkSession.createDataFrame([(0, text)], "start bigint, text string")
    return first.unionByName(parts.select((F.col("start") + size(text)).alias("start"), "text"))


def context_parts(path: str, nodes: DataFrame, edges: DataFrame, scores: DataFrame, root: str) -> DataFrame:
    """(start, text): what ``render.context_text`` says of a file, a part for each line."""
    spark = nodes.sparkSession
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, section: int, line: Column, first: Column = F.lit(0), second: Column = F.lit(0), by: Column = none) -> DataFrame:
        return df.select(F.lit(section).alias("section"), first.cast("long").alias("first"), second.cast("long").alias("second"), by.alias("by"), line.alias("text"))

    def or_none(df: DataFrame, section: int) -> DataFrame:
        empty = df.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
        return df.unionByName(rows(empty, section, F.lit("(none)")))

    score = scores.where(F.col("file_path") == path).agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    title = rows(score, 0, F.concat(F.lit("# "), relative(F.lit(path), root), F.lit(" [score: "), fixed4(F.col("score")), F.lit("]")))
    heads = spark.createDataFrame([(1, "\n## Definitions"), (3, "\n## Dependencies"), (5, "\n## Dependents")], "section int, text string")
    own = rows(definitions(nodes).where(F.col("file_path") == path), 2, definition_line(F.col("kind"), F.col("name"), F.col("start_line")), F.col("start_line"), F.col("seq"))
    link = lambda c: F.concat(F.lit("  "), relative(F.col(c), root))
    needs = rows(edges.where(F.col("src") == path).select("dst").distinct(), 4, link("dst"), by=F.col("dst"))
    needed = rows(edges.where(F.col("dst") == path).select("src").distinct(), 6, link("src"), by=F.col("src"))
    whole = title.unionByName(heads.select("section", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("second"), none.alias("by"), "text"))
    for section, df in ((2, own), (4, needs), (6, needed)):
        whole = whole.unionByName(or_none(df, section))
    return placed(whole.orderBy("section", "first", "second", F.collate("by", "UNICODE")))[0]


def search_parts(found: DataFrame, root: str) -> DataFrame:
    """(start, text): the matches, sorted as ``plans.index.search`` gives them, as the search's text."""
    line = F.concat("kind", F.lit(" "), "name", F.lit(" in "), relative(F.col("file_path"), root), F.lit(":L"), F.col("start_line").cast("string"))
    ordered = found.orderBy(F.collate("file_path", "UNICODE"), "start_line", "seq")
    return counted(ordered.select(line.alias("text")), "match", "matches")


def impact_parts(ranked: DataFrame, root: str) -> DataFrame:
    """(start, text): dependents (file_path, score, depth, place), best first, as the impact's text."""
    line = F.concat(relative(F.col("file_path"), root), F.lit(" [score: "), fixed4(F.col("score")), F.lit("]"))
    ordered = ranked.orderBy(F.desc("score"), "depth", "place")
    return counted(ordered.select(line.alias("text")), "file affected", "files affected")
