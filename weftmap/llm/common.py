"""What the operators share: columns that are carried along, batches, row keys, and the tables in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import sys
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import discard, materialize, shared_dir

__all__ = ["CHUNK_BYTES", "as_strings", "batches", "carry", "chunks", "columns", "crc", "discard", "held_out", "materialize", "quoted", "shared_dir", "text_bytes", "trim"]

#: Bytes of text that a Python worker handles at a time (a longer text is handled alone).
CHUNK_BYTES = 1_000_000


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def carry(docs: DataFrame, keep: Iterable[str], made: str | StructType, needs: Iterable[str] = ("text",)) -> tuple[DataFrame, list[str], list[str], StructType]:
    """What a function over rows is given, and the schema of what it gives back.

    ``docs`` with the columns ``keep``, each once, and the columns ``needs``; the names
    of both; and the schema of ``keep`` followed by ``made``. A kept column whose name
    is that of a made one, or begins with ``wm_`` like those used inside, whatever the
    case, comes back with ``_in`` at the end.
    """
    made = made if isinstance(made, StructType) else StructType.fromDDL(made) if made else StructType([])
    taken = {f.name.lower() for f in made.fields}
    names: dict[str, str] = {}
    for column in dict.fromkeys(keep):
        name = column
        while name.lower() in taken or name.lower().startswith("wm_") and not name.endswith("_in"):
            name += "_in"
        taken.add(name.lower())
        names[column] = name
    given = [names.get(n, f"wm_{n}") for n in needs]
    extra = [quoted(n).alias(f"wm_{n}") for n in needs if n not in names]
    own = docs.select(*[quoted(c).alias(n) for c, n in names.items()], *extra)
    return own, list(names.values()), given, StructType([*[own.schema[n] for n in names.values()], *made.fields])


def columns(rows: pa.RecordBatch, names: Iterable[str]) -> list[pa.Array]:
    return [rows.column(rows.schema.get_field_index(n)) for n in names]


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the rows that no label may be learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2, F.lit(False))


def crc(values: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(values, dtype="<u4"))


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    return column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text starts in them (one entry more than texts)."""
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together, or a single longer one."""
    at = text_bytes(column)[1]
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def trim() -> None:
    """Gives memory that a partition has used back to the system, as workers live on."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def batches(it: Iterator[pa.RecordBatch], name: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the incoming batches with their texts (null: empty), each of bounded size."""
    for batch in it:
        texts = as_strings(batch.column(batch.schema.get_field_index(name)))
        for i, j in chunks(texts, most):
            yield batch.slice(i, j - i), texts.slice(i, j - i)
        del batch, texts
    trim()
