"""Readers for landed exports. One directory per sheet; a sheet name is a partition value."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Quotes inside a cell are doubled.
CSV = {"header": "true", "escape": '"'}


def read_sheet(spark: SparkSession, path: str, schema: str, fmt: str = "csv", multi_line: bool = False, **options: str) -> DataFrame:
    """One sheet with a header row and a declared schema.

    ``multi_line``: cells may hold line breaks, as in survey exports; a file is then read by one task.
    """
    reader = spark.read.schema(schema).options(**(CSV | {"multiLine": str(multi_line).lower()} if fmt == "csv" else {}), **options)
    return reader.csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def read_all_sheets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """All sheets at once; the directory ``item=...`` becomes the column ``item``."""
    return spark.read.format(fmt).load(path)


def text_encoding(spark: SparkSession, path: str) -> str:
    """utf-8 unless a line cannot be read as such; a zero byte after a letter means utf-16.

    The search stops at the first hit and gives one row to the driver.
    """
    lines = spark.read.text(path)
    if lines.filter(F.col("value").contains("\u0000")).limit(1).count():
        return "UTF-16"
    return "ISO-8859-1" if lines.filter(~F.is_valid_utf8("value")).limit(1).count() else "UTF-8"


def read_csv_any_encoding(spark: SparkSession, path: str, schema: str, encoding: str | None = None) -> DataFrame:
    return read_sheet(spark, path, schema, encoding=encoding or text_encoding(spark, path))


def head_rows(spark: SparkSession, path: str, n: int) -> list[list[str]]:
    """The first ``n`` rows of an export as text: header metadata, as wide as the sheet."""
    rows = spark.read.options(header="false", escape='"', multiLine="true").csv(path).limit(n).collect()
    return [["" if v is None else v for v in r] for r in rows]


def read_two_row_header(spark: SparkSession, header_path: str, data_path: str, sep: str = " | ", multi_line: bool = False) -> DataFrame:
    """Columns named ``a | b`` from two header rows; an empty top cell continues the one before."""
    top, low = head_rows(spark, header_path, 2)
    names, group = [], ""
    for a, b in zip(top, low):
        group = a or group
        names.append(f"{group}{sep}{b}" if group else b)
    rows = spark.read.options(header="false", escape='"', multiLine=multi_line).csv(data_path)
    return rows.toDF(*names)


def lift_label_row(spark: SparkSession, df: DataFrame, label: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(question table, facts): the label row becomes (column, full_text) and leaves the data."""
    text = json.dumps(label)
    pairs = spark.range(1).select(F.explode(F.from_json(F.lit(text), "map<string,string>")).alias("column", "full_text"))
    is_label = F.lit(True)
    for column, value in label.items():
        is_label = is_label & F.col(f"`{column}`").eqNullSafe(F.lit(value))
    return pairs, df.filter(~is_label)


def read_payload(spark: SparkSession, path: str, record: str, multi_line: bool = False) -> DataFrame:
    """Export pages with the records in a list named ``result``."""
    pages = spark.read.schema(f"result array<struct<{record}>>").option("multiLine", str(multi_line).lower()).json(path)
    return pages.select(F.inline("result"))


def read_lookup(spark: SparkSession, path: str, value_type: str = "string") -> DataFrame:
    """A JSON object of key to value as (key, value)."""
    whole = spark.read.option("wholetext", "true").text(path)
    parsed = F.from_json(F.col("value"), f"map<string,{value_type}>")
    return whole.select(F.explode(parsed).alias("key", "value"))


def read_named_files(spark: SparkSession, path: str, patterns: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """All files below a folder, with parts of the file path as columns."""
    df = spark.read.option("recursiveFileLookup", "true").format(fmt).load(path)
    return df.withColumns({name: F.regexp_extract(F.col("_metadata.file_path"), p, 1) for name, p in patterns.items()})


def read_text_columns(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Every column as text; only the empty string is null, the text NA stays."""
    df = spark.read.options(**CSV, nullValue="", emptyValue="", multiLine=multi_line).csv(path)
    return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def roster(df: DataFrame, key: str, cohort: str | None = None, cohort_column: str = "cohort") -> DataFrame:
    """Distinct whole-number ids, of one cohort if named."""
    kept = df if cohort is None else df.filter(F.col(cohort_column) == cohort)
    return kept.select(F.col(key).try_cast("bigint").alias(key)).filter(F.col(key).isNotNull()).distinct()


def repaired_headers(df: DataFrame, synonyms: list[tuple[str, str]]) -> DataFrame:
    """Rename columns that contain a known word; the first synonym that fits wins, once per name."""
    names, used = [], set()
    for column in df.columns:
        new = next((n for word, n in synonyms if word.lower() in column.lower() and n not in used), column)
        used.add(new)
        names.append(new)
    return df.toDF(*names)


def cohort_lookup(df: DataFrame, key: str, label: str, year: str) -> DataFrame:
    """First word of the cohort label for ids whose label names the year."""
    return df.filter(F.col(label).contains(year)).select(key, F.get(F.split(label, " "), F.lit(0)).alias("cohort")).distinct()


