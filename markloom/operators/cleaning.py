"""Whole-frame cleaning steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.operators.ordering import row_numbers


def roster_split(forms: DataFrame, roster: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(forms of roster members, forms of others)."""
    ids = roster.select(key).distinct()
    return forms.join(ids, key, "left_semi"), forms.join(ids, key, "left_anti")


def real_names(df: DataFrame, name: str, test_words: list[str]) -> DataFrame:
    """Leave out null, blank and test names."""
    n = F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))
    fake = n == ""
    for word in test_words:
        fake = fake | n.contains(word.lower())
    return df.filter(~fake)


def resit_rule(df: DataFrame, key: str, day: str, main_month: int, resit_month: int) -> DataFrame:
    """Who sat the resit month loses the rows of the main month; rows without a date stay."""
    resit = df.filter(F.month(day) == resit_month).select(F.col(key).alias("_sat")).distinct()
    return df.join(resit, (F.col(key) == F.col("_sat")) & (F.month(day) == main_month), "left_anti")


def meaningful(text: Column, ignored: list[str]) -> Column:
    """Not null, not blank, and none of the ignored phrases."""
    t = F.lower(F.trim(text))
    return text.isNotNull() & (t != "") & ~t.isin(*[i.lower() for i in ignored])


def large_groups(df: DataFrame, key: str, at_least: int) -> DataFrame:
    """Rows of groups with ``at_least`` rows; the groups are counted first, then kept by a semi join."""
    keep = df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= at_least).select(key)
    return df.join(keep, key, "left_semi")


def apply_corrections(df: DataFrame, corrections: DataFrame, key: str, column: str) -> DataFrame:
    """Replace the old value by the new one where a correction names this row."""
    wanted = corrections.filter(F.col("column") == column).select(
        F.col(key), F.col("old").alias("_old"), F.col("new").alias("_new"))
    hit = F.col("_new").isNotNull() & F.col(column).eqNullSafe(F.col("_old"))
    return df.join(wanted, key, "left").withColumn(
        column, F.when(hit, F.col("_new")).otherwise(F.col(column))).drop("_old", "_new")


def pseudonyms(df: DataFrame, value: str, seen: str, piece: Column) -> DataFrame:
    """(value, number): distinct values numbered in the order they are first seen.

    ``piece`` is a rising expression of ``first_seen``; it splits the numbering over tasks.
    """
    first = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(seen).alias("first_seen"))
    return row_numbers(first, [], ["first_seen", value], piece, "number")


def frequent_codes(df: DataFrame, group: list[str], code: str, at_least: int = 2, longest: int = 5) -> DataFrame:
    """Code counts of a group after hygiene; rare codes go unless nothing else would stay."""
    plain = F.trim(F.col(code), F.lit(",. "))
    kept = df.withColumn(code, plain).filter(
        F.col(code).isNotNull() & ~F.col(code).isin("nan", "") & (F.length(code) <= longest))
    counts = kept.groupBy(*group, code).agg(F.count("*").alias("n"))
    best = counts.groupBy(*group).agg(F.max("n").alias("_best"))
    return counts.join(best, group).filter((F.col("n") >= at_least) | (F.col("_best") < at_least)).drop("_best")
