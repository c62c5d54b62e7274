"""The JSON document in parts, made and placed by the tasks (SNK-3, Q-JSON, Q12).

Files are sorted by score over all tasks and each becomes a part, its own text, placed as in
``parts``. The count of tokens comes from the same sums. Parts in order of ``start`` are the text
that ``render.render_json`` makes on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parts import placed, size
from .render import _dump, json_rows

PER_TOKEN = 3
#: How a value deeper in the document begins its lines.
_INNER = "    "


def _entry(row: dict) -> str:
    made = _dump({"filePath": row["filePath"], "score": row["score"], "definitions": row["definitions"]})
    return "\n".join(_INNER + line for line in made.split("\n"))


def _texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows = batch.to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(3), pa.array([_entry(r) for r in rows], pa.string())], ["score", "file_path", "text"])


def _frame(n_files: int, n_edges: int, tokens: int, root: str) -> tuple[str, str]:
    """What stands before and behind the files."""
    whole = _dump({"metadata": {"fileCount": n_files, "edgeCount": n_edges, "tokenCount": tokens, "rootDir": root}, "files": []})
    head = whole[: -len("[]\n}")]
    return (head + "[\n", "\n  ]\n}") if n_files else (head + "[]", "\n}")


def json_parts(files: DataFrame, nodes: DataFrame, edges: DataFrame, scores: DataFrame, root: str) -> DataFrame:
    """(start, text): the parts of the document, with the place in UTF-16 units where each starts."""
    spark = files.sparkSession
    rows = json_rows(files, nodes, scores, root)
    texts = rows.mapInArrow(_texts, "score double, file_path string, text string")
    parts, n, length = placed(texts.orderBy(F.desc("score"), F.collate("file_path", "UNICODE")), ",\n")
    n_edges = edges.distinct().count()
    total = length + sum(size(x) for x in _frame(n, n_edges, 0, root))
    head, tail = _frame(n, n_edges, -(-total // PER_TOKEN), root)
    ends = spark.createDataFrame([(0, head), (size(head) + length, tail)], "start bigint, text string")
    return parts.select((F.col("start") + size(head)).alias("start"), "text").unionByName(ends)
