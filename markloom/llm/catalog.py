"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.llm import bpe, chat, collocations, fingerprint, langid, linededup, mixing, neardup, quality, secret_scan, sql, toxicity, warc, whitening
from markloom.llm.common import documents

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(documents(spark, sf_dir)))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(documents(spark, sf_dir), k=4)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(documents(spark, sf_dir))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = chat.read_back(chat.format_conversations(rows.unionByName(own)))
    turns = F.concat_ws("", F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))))
    return back.select(
        "conv_id", F.size("texts").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"), "valid_order")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = secret_scan
    paths, _ = s.scan(documents(spark, sf_dir).select(F.col("doc_id").alias("path"), "text"))
    return paths.select(F.col("path").alias("doc_id"), *[s.count(r).alias(f"n_{r.kind}") for r in s.BASE],
                        F.sha2(s.listed(s.BASE), 256).alias("base_sha256"), s.listed(s.BASE + s.MORE).alias("spans"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").cast("bigint"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_byte_bpe, op2_source_mix, op3_minhash_near_dedup, op4_line_dedup, op5_fingerprints, op6_warc,
    op7_chat_format, op8_language_id, op9_secret_scan, op10_quality_rules, op11_collocations, op12_toxicity,
    op13_embedding_whitening)}
ORACLES: dict[str, str] = sql.ORACLES
