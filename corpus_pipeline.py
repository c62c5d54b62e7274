"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark passages, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmap.llm import decontam, ngram_join, quality, spm, substring
from weftmap.llm.common import materialize
from weftmap.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.judge(docs, table(spark, sf_dir, "labels"), COLUMNS).where("wm_kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least id."""
    return ngram_join.keep_first(docs, COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows go. A text that loses words is the rest joined by spaces; one that loses all goes."""
    cut = substring.remove_repeats(docs, COLUMNS, digest=False)
    text = F.coalesce("kept_text", "text")
    kept = cut.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), COLUMNS)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, as little-endian 16-bit numbers."""
    return spm.encode(docs, tokenizer_path("piece_bpe_32k.model"), ["doc_id", "lang", "source"])


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("SentencePiece encoding", sentencepiece_ids),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
