"""The registered queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import aligning, chat, decontam, lexical, linededup, mixing, ngramlm, quality, records, simhash, toxicity, trietokens, urlfilter

VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
    return rows.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32", "shard", F.col("at").alias("offset"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op3_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ngramlm.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), least=1)
    return rows.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.drop_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.find_leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return rows.select(F.col("id").alias("doc_id"), "item_id", "share", "cosine", "first_word")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trietokens.token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(PIECES))
    return rows.withColumnRenamed("id", "doc_id")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = urlfilter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), urlfilter.train(urlfilter.labelled(spark)))
    return rows.select("row.page_id", "host", "path", "rule", "verdict")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.whole_parts(_table(spark, sf_dir, "conversations"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.assess(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return rows.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexical.search(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return rows.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op12_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return rows.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", predicted, F.size("offending").alias("n_offending"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, of = _table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path
    return aligning.align(docs, of(VOCABULARY), public_tokenizers.PATTERN, of(PIECES)).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_records, op2_mix, op3_score, op4_lines, op5_leaks, op6_tokens, op7_urls, op8_simhash, op9_chats, op10_quality,
        op11_search, op12_toxic, op13_align,
    )
    return {f.__name__: f for f in every}
