"""The folder that driver and executors share, tables written there to cut lineage, and rows dealt out for costly work."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Where the tables lie that this process has written.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Names of those that are tables of the session's catalog.
_NAMED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a local one that goes at exit, or on a cluster an error, as executors couldn't share that."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is unset, and {master} needs a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="weftmap-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back.

    This cuts the lineage: a lost executor costs the tasks that it ran, not the
    steps before. The table keeps row counts, so later joins are planned on them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftmap/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[table] = path
    return table


def materialize_bucketed(df: DataFrame, label: str, buckets: int, *keys: str) -> DataFrame:
    """The same in ``buckets`` buckets of ``keys``: a join or sum on these keys then reads the table as it lies.

    Each bucket is one file if the rows come dealt out by the keys, as from
    ``repartition(buckets, *keys)`` or from a join with a table that has these buckets.
    """
    spark = df.sparkSession
    name = f"weftmap_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/weftmap/{label}-{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    table = spark.table(name)
    _WRITTEN[table] = path
    _NAMED[table] = name
    return table


def discard(table: DataFrame) -> None:
    """Deletes a table that was written here, once nothing will read it again: all made from it has been written."""
    path, name = _WRITTEN.pop(table), _NAMED.pop(table, None)
    spark = table.sparkSession
    if name:
        spark.sql(f"DROP TABLE {name}")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes that Spark plans for a partition of a small input; work on files wants more, smaller ones.
PLANNED_BYTES = 64_000_000


def spread(rows: DataFrame, partitions: int | None = None, by: str = "file_path") -> DataFrame:
    """The rows dealt out by path, in the column ``by``, for work that costs far more than moving them.

    Without a number, an input that Spark estimates so small that it would come in fewer
    partitions than there are cores is dealt over as many as a shuffle has; a
    larger one stays as it lies and is never shuffled.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if partitions is None:
        size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size >= cores * PLANNED_BYTES:
            return rows
        partitions = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(partitions, by)
