"""The training-data queries: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontam, exact, langid, ngram_join, panes, quality, spm, sql, substring, toxicity, urls, wavelet
from .common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    f = [F.col(f"wm_f.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    return judged.select("doc_id", *f, F.col("wm_kept").alias("kept"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, ["doc_id"], index)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence", "cosines")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shards = wavelet.encode_shards(docs, tokenizer_path("byte_bpe_50k.json"))
    return wavelet.shard_digests(shards, dict(docs.dtypes)["doc_id"])


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = {"conv_id": F.lit(-7), "turn": F.col("id"), "role": F.when(F.col("id") == 0, "user").otherwise("assistant"), "text": F.lit("</s>[INST] ok [/INST]")}
    own = spark.range(2).select(*[added[f.name].cast(f.dataType).alias(f.name) for f in given.schema])
    return chat.digests(chat.read_back(chat.format_conversations(given.unionByName(own))))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"], digest=True)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_shingles")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), ["doc_id"], with_ids=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = langid.identify(docs.select("doc_id", "text"), ["doc_id"], langid.fit(docs))
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: (verdict, host, path start)
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(table(spark, sf_dir, "pages"), URL_RULES)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(table(spark, sf_dir, "documents"), ["doc_id"])


def op12_pane_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panes.run(table(spark, sf_dir, "clicks"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), ["vec_id"])


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_token_ids, op4_chat_format, op5_substring_dedup, op6_ngram_join, op7_decontaminate, op8_sentencepiece, op9_language_id, op10_url_filter, op11_exact_dedup, op12_pane_revisions, op13_centroids)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
