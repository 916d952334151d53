"""Result tables, one per key where asked, and incremental reruns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def write_table(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    df.write.mode("overwrite").options(**options).format(fmt).save(path)


def write_per_key(df: DataFrame, path: str, keys: list[str], fmt: str = "parquet", rows_per_file: int = 5_000_000) -> None:
    """One directory per key. Rows are clustered by key first, a large key over several tasks, so files are few and bounded."""
    df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).option("maxRecordsPerFile", rows_per_file).format(fmt).save(path)


def write_texts(df: DataFrame, path: str, keys: list[str], place: str, text: str, sep: str = "\n") -> None:
    """One directory per key with the key's texts in order, ``sep`` after each. Rows are dealt by ranges of (key, place), so a
    large key is several files, whose names are in order, and no task holds more than the row it writes. Null texts are empty."""
    rows = df.select(*keys, place, F.coalesce(text, F.lit("")).alias(text)).repartitionByRange(*keys, place).sortWithinPartitions(*keys, place)
    rows.drop(place).write.mode("overwrite").partitionBy(*keys).option("lineSep", sep).text(path)


def replace_keys(df: DataFrame, path: str, keys: list[str], fmt: str = "parquet") -> None:
    """Replace only the keys that occur in ``df``; other directories stay."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*keys).format(fmt).save(path))


def done_keys(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """Keys already in an output, or nothing if it does not exist yet."""
    try:
        return spark.read.parquet(path).select(key).distinct()
    except AnalysisException:
        return None


def rerun_missing(df: DataFrame, path: str, key: str, work) -> None:
    """Do ``work`` only for keys that the output lacks, and add them to it."""
    done = done_keys(df.sparkSession, path, key)
    todo = df if done is None else df.join(done, key, "left_anti")
    replace_keys(work(todo), path, [key])


def with_json_text(df: DataFrame, nested: list[str]) -> DataFrame:
    """Nested columns as JSON text."""
    return df.withColumns({c: F.to_json(c) for c in nested})


def write_flat_and_nested(df: DataFrame, path: str, nested: str, promoted: list[str]) -> None:
    """Two copies of one export: promoted keys as columns, and the map as JSON text."""
    flat = df.select("*", *[F.try_element_at(nested, F.lit(k)).alias(k) for k in promoted]).drop(nested)
    write_table(flat, f"{path}/flat")
    write_table(with_json_text(df, [nested]), f"{path}/nested")
