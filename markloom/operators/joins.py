"""Lookups, gaps, merges and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# distinct members of one group handled by one task before the group is split
PAIR_BLOCK = 1_000


def one_per_key(dim: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """A lookup with one row per key: the first by ``order``. Partial aggregation, no window."""
    rest = [c for c in dim.columns if c not in keys]
    first = dim.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return first.select(*keys, "_r.*")


def null_safe_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which a null key meets a null key."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    out = left.join(right, condition, "left")
    for k in keys:
        out = out.drop(right[k])
    return out


def unmapped(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Keys in the data that the dimension does not know, with their row counts."""
    used = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_rows"))
    return used.join(dim.select(key).distinct(), key, "left_anti")


def membership_gap(roster: DataFrame, forms: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, tagged by the side they are missing from."""
    a, b = roster.select(key).distinct(), forms.select(key).distinct()
    no_form = a.join(b, key, "left_anti").withColumn("gap", F.lit("no form"))
    stranger = b.join(a, key, "left_anti").withColumn("gap", F.lit("not on roster"))
    return no_form.unionByName(stranger)


def fill_from(df: DataFrame, sources: list[DataFrame], key: str, column: str) -> DataFrame:
    """Take ``column`` from the next source where it is null or empty. Sources have one row per key."""
    value = F.nullif(F.col(column), F.lit(""))
    out = df
    for i, source in enumerate(sources):
        out = out.join(source.select(key, F.col(column).alias(f"_fill{i}")), key, "left")
        value = F.coalesce(value, F.nullif(F.col(f"_fill{i}"), F.lit("")))
    return out.withColumn(column, value).drop(*[f"_fill{i}" for i in range(len(sources))])


def merge_sides(df: DataFrame, keys: list[str], side: str, sides: tuple[str, str], values: list[str]) -> DataFrame:
    """Rows of two kinds on one line per key, both sides kept; a single grouping, no join."""
    a, b = sides
    cells = [
        F.max(F.when(F.col(side) == s, F.col(v))).alias(f"{v}_{s}") for s in (a, b) for v in values
    ]
    return df.filter(F.col(side).isin(a, b)).groupBy(*keys).agg(*cells)


def final_attempt(results: DataFrame, keys: list[str], attempt: str, result: str, passed: str = "Pass") -> DataFrame:
    """The latest attempt decides; the first result and the number of attempts stay visible."""
    return results.groupBy(*keys).agg(
        F.min_by(result, attempt).alias("first_result"),
        F.max_by(result, attempt).alias("final_result"),
        F.count("*").alias("n_attempts"),
    )


def pairs_within(df: DataFrame, group: str | None, member: str, block: int = PAIR_BLOCK) -> DataFrame:
    """Unordered pairs ``a < b`` of the distinct members of a group, or of the whole frame.

    The right side of a large group is cut into blocks and the left side is repeated once
    per block, so the pairs of one hot group are made by many tasks. A group smaller than
    ``block`` is not repeated.
    """
    keys = [group] if group else []
    once = df.select(*keys, member).filter(F.col(member).isNotNull()).distinct()
    blocks = F.ceil(F.count("*") / block).cast("int").alias("_blocks")
    if group:
        sized = once.join(once.groupBy(group).agg(blocks), group)
    else:
        sized = once.withColumn("_blocks", once.agg(blocks).scalar())
    left = sized.select(*keys, F.col(member).alias("a"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_b"))
    right = sized.select(*keys, F.col(member).alias("b"),
                         F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int").alias("_b"))
    return left.join(right, [*keys, "_b"]).filter("a < b").select(*keys, "a", "b")


def pair_counts(df: DataFrame, group: str, member: str, block: int = PAIR_BLOCK) -> DataFrame:
    """How many groups each pair of members shares."""
    return pairs_within(df, group, member, block).groupBy("a", "b").agg(F.count("*").alias("n_pairs"))


def long_matrix(matrix: DataFrame, row_key: str, columns: list[str], column_key: str, value: str) -> DataFrame:
    """A two-way lookup table as (row, column, value), to be joined on two keys."""
    return matrix.unpivot(row_key, columns, column_key, value)


def zero_filled(roster: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Every roster member with its counts, 0 where it has none."""
    return roster.join(counts, key, "left").fillna(0)
