"""Extraction in SQL text: a table function for LATERAL joins (EXT-0)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import extract, registered

NAME = "extract_nodes"
_ROW = "id string, name string, kind string, start_line int, end_line int, references array<string>, seq int"


def register_function(spark: SparkSession, name: str = NAME) -> None:
    """Makes ``name(path, source)`` known to SQL, a row for each node of a file: ``SELECT n.* FROM sources s, LATERAL extract_nodes(s.file_path, s.source) n``.

    It takes along the languages registered by now. Rows go to Python and back in Arrow batches.
    """
    known = registered()

    class Extract:
        def eval(self, path: str, source: str) -> Iterator[tuple]:
            for n in extract(path or "", source or "", *known):
                yield n["id"], n["name"], n["kind"], n["start_line"], n["end_line"], n["references"], n["seq"]

    spark.udtf.register(name, udtf(Extract, returnType=_ROW, useArrow=True))
