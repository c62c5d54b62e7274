"""An index kept from a stream of (file_path, source, version) rows.

Each micro-batch parses its files and writes them as one more Parquet folder of
the parsed table; the current state is the latest version of each file, by an
aggregation over the keys alone. A batch that is run again writes the same folder
again, so a lost executor or a restart changes nothing.

Every ``every`` batches what counts by then is written as a base. A reader takes the last base and the batches after it, so a read costs what the files
and some batches do, however long the stream has run. The base before the last stays for
readers that have begun; older ones, and batches that both bases hold, go.
"""

from __future__ import annotations

import re

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.index import Index, from_parsed
from ..sources.files import parse_sources
from ..sources.tree import opened

_NODES = "array<struct<id:string,name:string,kind:string,start_line:int,end_line:int,references:array<string>,seq:int>>"
_TABLE = f"file_path string, parse_time_ms double, nodes {_NODES}, version bigint, gone boolean, batch bigint"


def _numbers(folder: str, name: str) -> list[int]:
    """Numbers of the folders ``name``=n whose writing has ended."""
    system, path = opened(folder)
    if system.get_file_info(path).type == pafs.FileType.NotFound:
        return []
    found = [re.fullmatch(name + r"=(\d+)", i.base_name) for i in system.get_file_info(pafs.FileSelector(path))]
    whole = [m for m in found if m and system.get_file_info(f"{path}/{m[0]}/_SUCCESS").type == pafs.FileType.File]
    return sorted(int(m[1]) for m in whole)


def _drop(folder: str) -> None:
    system, path = opened(folder)
    system.delete_dir(path)


def state(spark: SparkSession, table: str) -> DataFrame:
    """The latest row of each file, those that are gone too, from the last base and the batches after it."""
    bases = _numbers(f"{table}-base", "upto")
    last = bases[-1] if bases else -1
    # with the folders' numbers as a column, of which batches before the base are never listed as input
    parts = [spark.read.parquet(f"{table}/batch={n}").withColumn("batch", F.lit(n).cast("bigint")) for n in _numbers(table, "batch") if n > last]
    if bases:
        parts.append(spark.read.parquet(f"{table}-base/upto={last}"))
    rows = spark.createDataFrame([], _TABLE)
    for p in parts:
        rows = rows.unionByName(p)
    newest = rows.groupBy("file_path").agg(F.max(F.struct("version", "batch")).alias("newest")).select(F.col("file_path").alias("p"), "newest.*").withColumnsRenamed({"version": "v", "batch": "b"})
    return rows.join(newest, (F.col("file_path") == F.col("p")) & F.col("version").eqNullSafe(F.col("v")) & (F.col("batch") == F.col("b"))).drop("p", "v", "b")


def compact(spark: SparkSession, table: str) -> None:
    """Writes the state as the next base."""
    numbers = _numbers(table, "batch")
    bases = _numbers(f"{table}-base", "upto")
    if not numbers or bases and bases[-1] >= numbers[-1]:
        return
    # a file that is gone stays as a row without nodes, so that an older version that comes late doesn't bring it back
    state(spark, table).write.mode("overwrite").parquet(f"{table}-base/upto={numbers[-1]}")
    for old in bases[:-1]:
        _drop(f"{table}-base/upto={old}")
    for n in numbers:
        if bases and n <= bases[-1]:
            _drop(f"{table}/batch={n}")


def keep_parsed(stream: DataFrame, table: str, checkpoint: str, once: bool = False, every: int = 20) -> StreamingQuery:
    """Starts parsing the stream into ``table``. A null source marks a file that is gone."""

    def batch(rows: DataFrame, number: int) -> None:
        latest = rows.groupBy("file_path").agg(F.max_by(F.struct("source", "version"), "version").alias("r")).select("file_path", "r.source", "r.version")
        parsed = parse_sources(latest.select("file_path", "source"))
        parsed.join(latest.select("file_path", "version", F.col("source").isNull().alias("gone")), "file_path").write.mode("overwrite").parquet(f"{table}/batch={number}")
        if (number + 1) % every == 0:
            compact(rows.sparkSession, table)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, table: str, root: str, **how) -> Index:
    """The index of the latest version of each file."""
    return from_parsed(root, state(spark, table).where("not gone").select("file_path", "parse_time_ms", "nodes"), **how)
