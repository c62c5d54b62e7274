"""Exact duplicates by an index of live digests: cuckoo filters in shards, content beside them.

A text's digest is the SHA-256 of the text without white space. Digests are dealt to
shards by their first bytes. A shard has a cuckoo filter (``cuckoo.py``) of the digests
that are live in it, and its bucket of content: live digests with their number of rows
and the row that stays. ``insert`` asks the filters first. A miss is new for certain; a
hit is verified against the content, and is new too if it isn't there. New digests go
into the filters; a filter that is full is made anew, larger, from the stored keys of its
shard. ``delete`` takes rows out, and the digest from its filter when its last row goes.

Rows of one digest are counted before they are shuffled, so a digest with a third of all
rows is a row a task. A shard holds some ``SHARD_ROWS`` digests and is what a task keeps in
memory. The join that gives each row its group reads written tables on both sides, so
Spark can split a hot digest. Texts are read once and never shuffled. All tables lie in the
shared folder; an insertion adds tables to those before, a deletion writes them anew.

Rows: null and empty texts are one group, with all texts of white space alone. Of equal
texts the row with the most code points stays, then the least id (null before all others),
then the first of repeated rows. Ids may be of any type that has an order. Very long texts
are hashed whole by Spark. Kept columns that clash come back by the rule of ``common.carry``.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import carry, materialize, quoted
from .cuckoo import CuckooFilter

SPACES = " \t\n\x0b\x0c\r"
#: Rows for which a shard is planned.
SHARD_ROWS = 100_000
LEAST_SHARDS = 32
_FILTERS = "shard int, slots binary, full boolean"


def digest(text) -> F.Column:
    """SHA-256 of a text without white space (null: empty)."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACES, ""), 256))


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _filter(table: pa.Table, buckets: int) -> CuckooFilter:
    return CuckooFilter.load(table.column("slots")[0].as_py()) if len(table) else CuckooFilter(buckets)


def _asked(buckets: int):
    def run(held: pa.Table, given: pa.Table) -> pa.Table:
        hit = _filter(held, buckets).contains(_digests(given.column("digest")))
        return given.append_column("hit", pa.array(hit))

    return run


def _grown(buckets: int):
    def run(held: pa.Table, new: pa.Table) -> pa.Table:
        if not len(new):
            return held
        own = _filter(held, buckets)
        done = own.insert(_digests(new.column("digest")))
        return pa.table({"shard": new.column("shard")[:1], "slots": pa.array([own.dump() if done else b""]), "full": pa.array([not done])})

    return run


def _shrunk(held: pa.Table, gone: pa.Table) -> pa.Table:
    if not len(gone):
        return held
    own = _filter(held, 0)
    own.delete(_digests(gone.column("digest")))
    return pa.table({"shard": held.column("shard"), "slots": pa.array([own.dump()]), "full": pa.array([False])})


def _built(buckets: int):
    def run(keys: pa.Table) -> pa.Table:
        made = CuckooFilter.build(_digests(keys.column("digest")), buckets)
        return pa.table({"shard": keys.column("shard")[:1], "slots": pa.array([made.dump()]), "full": pa.array([False])})

    return run


class DigestIndex:
    """Live rows by digest. Rows come as (digest, chars, id, row); ``row`` tells the rows of one insertion apart."""

    def __init__(self, spark: SparkSession, shards: int = LEAST_SHARDS, buckets: int = 256):
        self.spark, self.shards, self.buckets = spark, shards, buckets
        self.filters = spark.createDataFrame([], _FILTERS)
        self.members: list[DataFrame] = []
        self.content: list[DataFrame] = []
        self.keys: list[DataFrame] = []
        self.resized = 0

    def _together(self, tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def _counted(self, rows: DataFrame) -> DataFrame:
        best = F.struct((-F.col("chars")).alias("short"), "id", "turn", "row")
        return rows.groupBy("shard", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("best"))

    def _with(self, rows: DataFrame, run, schema) -> DataFrame:
        """The filters met with the rows of their shards."""
        return self.filters.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(run, schema)

    def insert(self, signed: DataFrame) -> None:
        """Makes these rows live."""
        shard = F.pmod(F.conv(F.hex(F.substr("digest", F.lit(1), F.lit(4))), 16, 10).cast("bigint"), F.lit(self.shards)).cast("int")
        rows = materialize(signed.select(shard.alias("shard"), "digest", F.col("chars").cast("bigint").alias("chars"), "id", F.lit(len(self.members)).alias("turn"), F.col("row").cast("bigint").alias("row")), "members")
        counted = self._counted(rows)
        seen = materialize(self._with(counted, _asked(self.buckets), StructType([*counted.schema.fields, StructField("hit", BooleanType())])), "content")
        new = seen.select("shard", "digest")
        if self.keys:
            # a hit that no stored key bears out was one by chance
            verified = seen.where("hit").join(self._together(self.keys).select("digest"), "digest", "left_anti")
            new = seen.where("not hit").select("shard", "digest").unionByName(verified.select("shard", "digest"))
        new = materialize(new, "keys")
        self.members, self.content, self.keys = [*self.members, rows], [*self.content, seen.drop("hit")], [*self.keys, new]
        self._grow(new)

    def _grow(self, new: DataFrame) -> None:
        tried = materialize(self._with(new, _grown(self.buckets), _FILTERS), "filters")
        full = tried.where("full").select("shard")
        if more := full.count():
            self.resized += more
            rebuilt = self._together(self.keys).join(full, "shard", "left_semi").groupBy("shard").applyInArrow(_built(2 * self.buckets), _FILTERS)
            tried = materialize(tried.where("not full").unionByName(rebuilt), "filters")
        self.filters = tried

    def delete(self, signed: DataFrame) -> None:
        """Takes out the rows with these digests and ids."""
        if not self.members:
            return
        gone = signed.select(F.col("digest").alias("d"), F.col("id").alias("i")).distinct()
        rows = self._together(self.members)
        rows = materialize(rows.join(gone, (rows.digest == gone.d) & rows.id.eqNullSafe(gone.i), "left_anti"), "members")
        content = materialize(self._counted(rows), "content")
        dead = self._together(self.keys).join(content.select("digest"), "digest", "left_anti")
        self.filters = materialize(self._with(dead, _shrunk, _FILTERS), "filters")
        self.members, self.content, self.keys = [rows], [content], [materialize(content.select("shard", "digest"), "keys")]

    def owners(self) -> DataFrame:
        """(digest, n, best): the live digests, how many rows each has, and the row that stays."""
        return self._together(self.content).groupBy("digest").agg(F.sum("n").alias("n"), F.min("best").alias("best"))


def deduplicate(docs: DataFrame, keep: Iterable[str], ident: str = "doc_id", text: str = "text", arrivals: int = 4) -> DataFrame:
    """The columns ``keep`` of every row, and keep_id, group_size, kept, text_sha256.

    The rows come to an empty index in ``arrivals`` insertions, so later ones meet what
    is live by then.
    """
    spark = docs.sparkSession
    kind = docs.schema[ident].dataType
    made = StructType([StructField("keep_id", kind), *StructType.fromDDL("group_size bigint, kept boolean, text_sha256 string").fields])
    own, names, (i, t), _ = carry(docs, keep, made, (ident, text))
    cut = [quoted(n) for n in names]
    signed = materialize(own.select(*cut, quoted(i).alias("wm_key"), digest(quoted(t)).alias("wm_digest"), F.length(F.coalesce(quoted(t), F.lit(""))).cast("bigint").alias("wm_chars"), F.monotonically_increasing_id().alias("wm_row")), "signed")
    n = signed.count()
    index = DigestIndex(spark, max(LEAST_SHARDS, -(-n // SHARD_ROWS)))
    rows = signed.select(F.col("wm_digest").alias("digest"), F.col("wm_chars").alias("chars"), F.col("wm_key").alias("id"), F.col("wm_row").alias("row"))
    for k in range(arrivals):
        index.insert(rows.where(F.pmod("row", F.lit(arrivals)) == k))
    owners = materialize(index.owners().select(F.col("digest").alias("wm_d"), F.col("n").alias("group_size"), F.col("best.id").alias("keep_id"), F.col("best.row").alias("wm_best")), "owners")
    met = signed.join(owners, signed.wm_digest == owners.wm_d)
    return met.select(*cut, "keep_id", "group_size", (F.col("wm_row") == F.col("wm_best")).alias("kept"), F.lower(F.hex("wm_digest")).alias("text_sha256"))
