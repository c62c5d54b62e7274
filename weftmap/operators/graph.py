"""The file graph: distinct edges, degrees, neighbours, counts (AGG-1, 2, 6, 7, 8, JOIN-8, JOIN-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import LINK_KINDS
from .resolve import resolve


def build_edges(nodes: DataFrame, files: DataFrame, resolution: str = "compat") -> DataFrame:
    """(src, dst), each once; a file may point to itself. Within a file, the name of an import tells where it leads."""
    links = nodes.select(F.col("name").alias("id"), "name", "kind", "file_path")
    return resolve(links, files, resolution).select("src", "dst").distinct()


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("file_path")).agg(F.count(F.lit(1)).alias("out_degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("file_path")).agg(F.count(F.lit(1)).alias("in_degree"))


def dangling(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files without an edge out."""
    return files.select("file_path").join(edges.select(F.col("src").alias("file_path")), "file_path", "left_anti")


def forward_deps(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("src") == path).select(F.col("dst").alias("file_path"))


def reverse_deps(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("dst") == path).select(F.col("src").alias("file_path"))


def definitions(nodes: DataFrame) -> DataFrame:
    """Nodes but imports and re-exports (FLT-2)."""
    return nodes.where(~F.col("kind").isin(*LINK_KINDS))


def counts(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, edges, all nodes, definitions."""
    by_node = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum((~F.col("kind").isin(*LINK_KINDS)).cast("long")), F.lit(0).cast("long")).alias("definitions"))
    return files.agg(F.count(F.lit(1)).alias("files")).join(edges.agg(F.count(F.lit(1)).alias("edges"))).join(by_node)
