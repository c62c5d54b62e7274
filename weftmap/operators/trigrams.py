"""An inverted index of names by their runs of three characters (FLT-4, Q-SEARCH).

The postings, a row for each different trigram of a lower-cased name, lie in buckets of
the trigram and are sorted by it within one, so a search reads only the buckets of its own
trigrams, and in them only the row groups that can hold these. What all of them hold in common is
checked for the whole text. A search of fewer than three characters scans the names.
Postings are by name, not by node: a name that very many nodes have is one row for each
trigram. A trigram that a third of the names hold is a third of that bucket's rows, and a
search counts its rows before it shuffles them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize_bucketed


def trigrams(name: Column) -> Column:
    """The different runs of three characters of a lower-cased name."""
    low = F.lower(name)
    starts = F.sequence(F.lit(1), F.length(low) - 2)
    return F.when(F.length(low) > 2, F.array_distinct(F.transform(starts, lambda i: F.substr(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class NameIndex:
    nodes: DataFrame
    postings: DataFrame

    def candidates(self, query: str) -> DataFrame:
        """(name): names that hold every trigram of the query, in whatever order."""
        low = self.nodes.sparkSession.range(1).select(F.lower(F.lit(query))).first()[0]
        asked = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        met = self.postings.where(F.col("gram").isin(asked)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        return met.where(F.col("n") == len(asked)).select("name")

    def search(self, query: str, kind: str | None = None) -> DataFrame:
        """Nodes whose name holds ``query`` in any case; in order of path and line."""
        nodes = self.nodes if kind is None else self.nodes.where(F.col("kind") == kind)
        hit = F.contains(F.lower("name"), F.lower(F.lit(query)))
        if len(query) > 2:
            nodes = nodes.join(self.candidates(query).where(hit), "name", "left_semi").select(*self.nodes.columns)
        else:
            nodes = nodes.where(hit)
        return nodes.orderBy(F.collate("file_path", "UNICODE"), "start_line", "seq")


def build(nodes: DataFrame, buckets: int | None = None) -> NameIndex:
    """Writes the postings of all names."""
    n = buckets or int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select("name").where("name is not null").distinct().select(F.explode(trigrams(F.col("name"))).alias("gram"), "name")
    return NameIndex(nodes, materialize_bucketed(rows.repartition(n, "gram").sortWithinPartitions("gram"), "postings", n, "gram"))
