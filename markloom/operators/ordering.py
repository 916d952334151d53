"""Row numbers, running values and ordered texts that hold when one group is a third of the data.

A plain window puts a whole group into one task. Here each group is cut into
pieces by ``piece``, an expression that never falls as the order rises (a day, an id
divided by a constant). Rows are ordered inside a piece; what comes before a piece is
carried in from a summary with a row per (group, piece). Choose pieces of many thousand rows:
with no group the summary, a row per piece, is ordered by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _carried(df: DataFrame, group: list[str], piece: Column, summary: list[Column], carry) -> DataFrame:
    """Attach the carry-in of the (group, piece) of every row as ``_carry``."""
    pieces = df.withColumn("_piece", piece)
    totals = pieces.groupBy(*group, "_piece").agg(*summary)
    carried = totals.select(*group, "_piece", carry.alias("_carry"))
    same = [pieces[g].eqNullSafe(carried[g]) for g in [*group, "_piece"]]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    joined = pieces.join(carried, condition, "left")
    for g in [*group, "_piece"]:
        joined = joined.drop(carried[g])
    return joined


def row_numbers(df: DataFrame, group: list[str], order: list, piece: Column, name: str = "rn") -> DataFrame:
    """1, 2, 3 ... inside each group; with no group, over the whole frame."""
    before = W.partitionBy(*group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    carry = F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint"))
    out = _carried(df, group, piece, [F.count("*").alias("_n")], carry)
    inside = W.partitionBy(*group, "_piece").orderBy(*order)
    return out.withColumn(name, F.col("_carry") + F.row_number().over(inside)).drop("_piece", "_carry")


def running_sum(df: DataFrame, group: list[str], order: list, piece: Column, value: str, name: str) -> DataFrame:
    """Sum of ``value`` from the first row of the group to this one."""
    before = W.partitionBy(*group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    carry = F.coalesce(F.sum("_s").over(before), F.lit(0))
    out = _carried(df, group, piece, [F.sum(value).alias("_s")], carry)
    inside = W.partitionBy(*group, "_piece").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    total = F.col("_carry") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return out.withColumn(name, total).drop("_piece", "_carry")


def fill_from_neighbours(df: DataFrame, group: list[str], order: str, piece: Column, value: str, name: str) -> DataFrame:
    """The last value at or before the row, else the first one after it."""
    known = F.col(value).isNotNull()
    pos = F.when(known, F.col(order))
    summary = [F.max_by(value, pos).alias("_last"), F.min_by(value, pos).alias("_first")]
    before = W.partitionBy(*group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*group).orderBy("_piece").rowsBetween(1, W.unboundedFollowing)
    carry = F.struct(
        F.last("_last", True).over(before).alias("back"), F.first("_first", True).over(after).alias("ahead")
    )
    out = _carried(df, group, piece, summary, carry)
    inside = W.partitionBy(*group, "_piece").orderBy(order)
    back = F.last(value, True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first(value, True).over(inside.rowsBetween(0, W.unboundedFollowing))
    filled = F.coalesce(back, F.col("_carry.back"), ahead, F.col("_carry.ahead"))
    return out.withColumn(name, filled).drop("_piece", "_carry")


def ordered_texts(df: DataFrame, group: list[str], order: list, piece: Column, text: str, name: str = "text",
                  ends: bool = False) -> DataFrame:
    """The texts of a group in order, a row each: (group, place from 1, text), in the same shape at every size.

    ``ends`` leaves out blank texts before the first and after the last that is not blank. Joined by a separator the rows are
    one text; ``writers.write_texts`` writes that, since a cell could not hold the text of a large group.
    """
    rows = row_numbers(df, group, order, piece, "place")
    if ends:
        full = F.when(F.btrim(F.coalesce(text, F.lit(""))) != "", F.col("place"))
        span = rows.groupBy(*group).agg(F.min(full).alias("_low"), F.max(full).alias("_high"))
        rows = rows.join(span, group).filter(F.col("place").between(F.col("_low"), F.col("_high")))
    return rows.select(*group, "place", F.col(text).alias(name))


def ordered_distinct(df: DataFrame, group: list[str], text: str, name: str = "text", piece: Column | None = None) -> DataFrame:
    """Sorted distinct texts of a group, a row each; duplicates go before anything is ordered."""
    once = df.select(*group, text).filter(F.col(text).isNotNull()).distinct()
    piece = F.left(F.col(text), F.lit(1)) if piece is None else piece
    return ordered_texts(once, group, [F.col(text)], piece, text, name)


def joined_text(df: DataFrame, group: list[str], order: list[str], piece: Column, text: str, sep: str, name: str = "text",
                strip: str | None = None) -> DataFrame:
    """All texts of a group in order, joined by ``sep`` into one cell, at every size; ``strip`` are characters taken off both ends.

    Many tasks sort and join the pieces of a large group; only their texts, a row for each piece, meet at the end. Null texts
    are left out, a group without any other has null. Nothing is cut: a text beyond the 2 GB that a cell holds is an error,
    and ``ordered_texts`` with ``writers.write_texts`` is the way for it.
    """
    def in_order(keys: list[str], value: str) -> Column:
        entry = F.struct(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col(value).alias("_t"))
        cells = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), entry)))
        return F.when(F.count(value) > 0, F.array_join(F.transform(cells, lambda x: x["_t"]), sep))

    parts = df.withColumn("_piece", piece).groupBy(*group, "_piece").agg(in_order(order, text).alias("_part"))
    whole = in_order(["_piece"], "_part")
    return parts.groupBy(*group).agg((whole if strip is None else F.btrim(whole, F.lit(strip))).alias(name))


def joined_distinct(df: DataFrame, group: list[str], text: str, sep: str, name: str = "text", piece: Column | None = None) -> DataFrame:
    """Sorted distinct texts of a group, joined into one cell; duplicates go before anything is ordered. A group without texts has null."""
    once = df.select(*group, text).distinct()
    return joined_text(once, group, [text], F.left(F.col(text), F.lit(1)) if piece is None else piece, text, sep, name)


def joined_set(df: DataFrame, group: list[str], value: str, sep: str, name: str) -> DataFrame:
    """Sorted distinct values of a group in one cell. Only for values of a fixed list (clinics, item codes), which bounds the cell."""
    return df.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_set(value)), sep).alias(name))


def beside_text(totals: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered texts with the totals of their group. The totals stand beside the first text alone and are null beside the
    others, so each is in the table once, however many texts there are."""
    once = totals.withColumn("place", F.lit(1).cast("bigint"))
    return texts.join(once, [*keys, "place"], "left")


def top_rows(df: DataFrame, group: list[str], order: list, k: int, name: str = "rn") -> DataFrame:
    """The first ``k`` rows of each group. Spark keeps only ``k`` rows per group and map task before the shuffle."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
