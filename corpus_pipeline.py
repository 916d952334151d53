"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.llm import bpe, linededup, mixing, neardup, quality
from markloom.llm.common import land


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without boilerplate lines."""
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that another document or an earlier line has; n_chars is counted anew."""
    out = linededup.dedup(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the smallest doc_id, null last. Rows are compared by themselves, whatever their ids: an
    id may name several texts, and of rows that are equal in all columns one stays."""
    keyed = docs.withColumn("llm_row_key", F.xxhash64(*docs.columns))
    found = neardup.cluster(keyed.select(F.col("llm_row_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("llm_row_key"), "component_id")
    ids = keyed.select("llm_row_key", "doc_id").distinct().join(found.distinct(), "llm_row_key")
    keep = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "llm_row_key"))["llm_row_key"].alias("llm_row_key"))
    return keyed.join(keep, "llm_row_key", "left_semi").dropDuplicates(["llm_row_key"]).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: a row for each document and pass, with the words taken."""
    return mixing.mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row (packed 32-bit little-endian), with digests of the ids and of the decoded text."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # Workers of the stages before stay beside those of this one, so tasks remember fewer words than in op1 and merge some again.
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, with_ids=True, with_decoded=False, remembered=200_000)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("source_mix", source_mix), ("byte_bpe", byte_bpe)]
ORACLE_SQL = None  # merges and MinHash have no SQL; tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
