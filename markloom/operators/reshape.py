"""Wide to long and back, column choice, header-driven selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wide_to_long(df: DataFrame, ids: list[str], columns: list[str], name: str = "header",
                 value: str = "value", position: str = "position") -> DataFrame:
    """One row per (row, column). Thousands of columns go through one array, not one branch each."""
    cells = F.array(*[F.struct(F.lit(c).alias("n"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    return df.select(*ids, F.posexplode(cells).alias(position, "_c")).select(
        *ids, position, F.col("_c.n").alias(name), F.col("_c.v").alias(value)
    )


def existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that are there, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def without_duplicate_columns(df: DataFrame) -> DataFrame:
    """The first of equally named columns."""
    seen: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        seen.setdefault(c, i)
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"_{i}").alias(c) for c, i in seen.items()])


def filled_counts(df: DataFrame) -> DataFrame:
    """(column, n_filled) of every column in one pass."""
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return row.unpivot([], list(df.columns), "column_name", "n_filled")


def without_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without any value. One pass over the data gives one row of counts."""
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if row[c] > 0])


def counts_by_value(df: DataFrame, keys: list[str], column: str, values: list, names: list[str]) -> DataFrame:
    """Count of each listed value as its own column: a pivot in one aggregation."""
    return df.groupBy(*keys).agg(
        *[F.count_if(F.col(column) == v).alias(n) for v, n in zip(values, names)]
    )


def pivot_cells(df: DataFrame, keys: list[str], column: str, values: list, cell) -> DataFrame:
    """``groupBy.pivot`` with the values given, so no job runs to find them."""
    return df.groupBy(*keys).pivot(column, values).agg(cell)


def pivot_texts(texts: DataFrame, keys: list[str], column: str, values: list, text: str, missing: str) -> DataFrame:
    """Ordered texts side by side, a row for each place. A value without a first text was never given and reads ``missing`` there;
    further down, where only another value goes on, the cell is null. A null text is an empty one."""
    wide = pivot_cells(texts, [*keys, "place"], column, values, F.max(F.coalesce(F.col(text), F.lit(""))))
    return wide.select(*keys, "place", *[F.coalesce(v, F.when(F.col("place") == 1, missing)).alias(v) for v in values])


def repeated_cells(df: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that a strict pivot must refuse."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def column_totals(df: DataFrame, keys: list[str], sums: list[Column], label: str = "Total") -> DataFrame:
    """Groups with the grand total as one more row, by rollup."""
    out = df.rollup(*keys).agg(F.grouping_id().alias("_g"), *sums)
    full = (1 << len(keys)) - 1
    out = out.filter((F.col("_g") == 0) | (F.col("_g") == full))
    return out.withColumns(
        {k: F.when(F.col("_g") == full, label).otherwise(F.col(k).cast("string")) for k in keys}
    ).drop("_g")
