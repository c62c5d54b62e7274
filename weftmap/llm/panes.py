"""Hourly panes of events that come in batches: emitted once due, revised when more rows come.

Each batch is fed to a streaming query that is started anew for it, on one checkpoint.
The query is a windowed aggregation of Spark with a state store: its watermark, which
lags behind by ``keep``, forgets panes that are closed. What the query writes is not used.
After each batch the state store is read at the batch id just committed, and
the totals are held against the snapshot before. A pane whose totals differ and that the
lifecycle table has as emitted is retracted and replaced; one that is due and isn't in that
table is emitted, and goes into it. Snapshots, records and the lifecycle table are tables in
the shared folder, with a folder for each batch, so a batch can be run again.

Of the input, only a number for each batch comes to the driver: its latest time. Panes are
tables, joined by kind and hour, and late rows are found by a filter. No task gets all rows.

Rows: without ``ts`` they go; a null ``arrived_at`` is day 0; rows of one ``click_id`` (null is
one too) count once, the least of (batch, time, kind, cents); a null ``value`` and one that isn't finite are 0
cents; a null ``kind`` is ``none``. An empty table gives no records. Times have no zone
and mean UTC. The ids may be of any type that has a text. Other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import shared_dir

HOUR = 3_600_000_000
DAY = 24 * HOUR
#: Added to times inside the query: Spark's watermark begins at 1970, times may lie before.
SHIFT = 36_500 * DAY
#: How the query runs. Its stores are Spark's own in the heap, as RocksDB takes memory beside it. A start commits once
#: and leaves its stores for good, so each goes from memory with its commit: a task holds the open panes of one partition.
STORES = {
    "stateStore__providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "stateStore__unloadOnCommit": "true",
    "checkpoint__fileChecksum__enabled": "false",
    "noDataMicroBatches__enabled": "false",
}
_PANES = "kind string, hour bigint, n_rows bigint, cents bigint"


def micros(at: Column) -> Column:
    """Microseconds of a time without a zone since 1970."""
    past = at.cast("timestamp_ntz") - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    part = lambda name: F.extract(F.lit(name), past).cast("bigint")
    return part("DAY") * DAY + part("HOUR") * HOUR + part("MINUTE") * (HOUR // 60) + (F.extract(F.lit("SECOND"), past) * 1_000_000).cast("bigint")


def floored(value: Column, by: int) -> Column:
    """Whole parts of ``by``, downwards."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by)).cast("bigint")


def dealt(clicks: DataFrame, n_batches: int = 10) -> DataFrame:
    """(click_id, us, hour, kind, cents, batch): each click once, with the batch that it comes in and its time there."""
    day = F.coalesce(floored(micros(F.col("arrived_at")), DAY), F.lit(0))
    q = F.pmod(day, F.lit(n_batches))
    lag = F.greatest(F.lit(0), F.coalesce(F.crc32(F.col("click_id").cast("string")), F.lit(0)) % 30 - 23)
    cents = F.when(F.abs("value") < float("inf"), F.floor(F.col("value") * 100 + 0.5)).otherwise(0)
    rows = clicks.where("ts is not null").select(
        "click_id",
        F.struct(F.least(F.lit(n_batches - 1), q + lag).cast("int").alias("batch"), (micros(F.col("ts")) - (day - q) * DAY).alias("us"), F.coalesce("kind", F.lit("none")).alias("kind"), cents.alias("cents")).alias("r"),
    )
    once = rows.groupBy("click_id").agg(F.min("r").alias("r"))
    return once.select("click_id", "r.us", floored(F.col("r.us"), HOUR).alias("hour"), "r.kind", "r.cents", "r.batch")


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    names = {k: "spark.sql.streaming." + k.replace("__", ".") for k in values}
    before = {k: spark.conf.get(n, None) for k, n in names.items()}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(names[k])
            else:
                spark.conf.set(names[k], v)


class PaneState:
    """The streaming aggregation and its snapshots."""

    def __init__(self, spark: SparkSession, base: str, schema, keep: int):
        self.spark, self.base, self.schema, self.keep = spark, base, schema, keep

    def feed(self, latest: int | None) -> int:
        """Starts the query for what is new in its folder; the id of the batch that it commits. Panes closed at ``latest`` take no rows."""
        rows = self.spark.readStream.schema(self.schema).parquet(f"{self.base}/in").withColumn("at", F.timestamp_micros(F.col("us") + SHIFT)).withWatermark("at", f"{self.keep // 1_000_000} seconds")
        if latest is not None:
            rows = rows.where(~closed(F.col("hour"), latest, self.keep))
        panes = rows.groupBy("kind", F.window("at", "1 hour")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("cents").alias("cents"))
        query = panes.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return max(p["batchId"] for p in query.recentProgress if p["numInputRows"])

    def snapshot(self, number: int) -> DataFrame:
        """The panes held after a batch of the query."""
        rows = self.spark.read.format("statestore").option("batchId", number).load(f"{self.base}/checkpoint")
        hour = floored(F.unix_micros("key.window.start") - SHIFT, HOUR)
        return rows.select(F.col("key.kind").alias("kind"), hour.alias("hour"), F.col("value.count").alias("n_rows"), F.col("value.sum").alias("cents"))


def closed(hour: Column, latest: int | None, keep: int) -> Column:
    return F.lit(False) if latest is None else (hour + 1) * HOUR + keep <= latest


def revisions(now: DataFrame, before: DataFrame, lifecycle: DataFrame, latest: int | None, grace: int, last: bool) -> DataFrame:
    """(kind, hour, n_rows, cents, record) of what two snapshots, the panes emitted before and the time ask for."""
    old = before.select("kind", "hour", F.col("n_rows").alias("n0"), F.col("cents").alias("c0"))
    known = lifecycle.select("kind", "hour", F.lit(True).alias("emitted"))
    # instead of a full outer join, which Spark never does without a shuffle, however small the tables are
    new = now.join(old, ["kind", "hour"], "left")
    gone = before.join(now.select("kind", "hour"), ["kind", "hour"], "left_anti").select("*", F.col("n_rows").alias("n0"), F.col("cents").alias("c0"))
    panes = new.unionByName(gone).join(known, ["kind", "hour"], "left")
    emitted = F.coalesce("emitted", F.lit(False))
    total = F.struct("n_rows", "cents")
    told = lambda name, value: F.struct(F.lit(name).alias("record"), value.alias("total"))
    due = closed(F.col("hour"), latest, grace)
    gave = F.when(~emitted & due, F.array(told("emit", total)))
    gave = gave.when(emitted & (F.col("n_rows") != F.col("n0")), F.array(told("retract", F.struct(F.col("n0").alias("n_rows"), F.col("c0").alias("cents"))), told("replace", total)))
    if last:
        gave = gave.when(~emitted, F.array(told("final", total)))
    return panes.select("kind", "hour", F.explode(gave).alias("t")).select("kind", "hour", "t.total.*", "t.record")


def _empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def run(clicks: DataFrame, n_batches: int = 10, grace: int = 12 * HOUR, keep: int = 48 * HOUR) -> DataFrame:
    """(batch, hour, click_id, n_rows, cents, record, kind): all that the batches write, in a folder of its own at every call."""
    spark = clicks.sparkSession
    base = f"{shared_dir(spark)}/weftmap/panes-{uuid.uuid4().hex}"
    rows = dealt(clicks, n_batches)
    rows.write.partitionBy("batch").parquet(f"{base}/batches")
    schema = rows.drop("batch").schema
    staged = spark.read.schema(rows.schema).parquet(f"{base}/batches")
    tops = {r["batch"]: r["top"] for r in staged.groupBy("batch").agg(F.max("us").alias("top")).collect()}  # a row for each batch
    state = PaneState(spark, base, schema, keep)
    nothing = _empty(spark, StructType.fromDDL(_PANES))
    snapshot, lifecycle, latest = nothing, nothing.select("kind", "hour"), None
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(fs_path(f"{base}/in"))
    records = f"{base}/records"
    for b in range(n_batches):
        now, late = snapshot, _empty(spark, schema)
        if b in tops:
            fs.rename(fs_path(f"{base}/batches/batch={b}"), fs_path(f"{base}/in/batch={b}"))
            late = spark.read.schema(schema).parquet(f"{base}/in/batch={b}").where(closed(F.col("hour"), latest, keep))
            with _settings(spark, **STORES):
                state.snapshot(state.feed(latest)).write.mode("overwrite").parquet(f"{base}/snapshots/{b}")
            now = spark.read.schema(_PANES).parquet(f"{base}/snapshots/{b}")
        change = revisions(now, snapshot, lifecycle, latest, grace, b + 1 == n_batches)
        told = change.select("hour", F.lit(-1).cast(schema["click_id"].dataType).alias("click_id"), "n_rows", "cents", "record", "kind")
        told = told.unionByName(late.select("hour", "click_id", F.lit(1).cast("bigint").alias("n_rows"), "cents", F.lit("late").alias("record"), "kind"))
        told.write.mode("overwrite").parquet(f"{records}/batch={b}")
        written = spark.read.schema(told.schema).parquet(f"{records}/batch={b}")
        written.where("record = 'emit'").select("kind", "hour").write.mode("overwrite").parquet(f"{base}/lifecycle/batch={b}")
        lifecycle = spark.read.schema("kind string, hour bigint").parquet(f"{base}/lifecycle")
        snapshot = now
        if b in tops:
            latest = tops[b] if latest is None else max(latest, tops[b])
    out = StructType([StructField("batch", LongType()), *told.schema.fields])
    return spark.read.schema(out).parquet(records).select("batch", "hour", "click_id", "n_rows", "cents", "record", "kind")
