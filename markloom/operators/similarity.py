"""Similar answers and comments without forming every pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from markloom.operators.ordering import top_rows

TILE_ROWS = 2_048


def unit_vector(vector: Column) -> Column:
    """The vector over its length; null for the zero vector."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def pair_summary(df: DataFrame, block: str, vector: str, mark: str) -> DataFrame:
    """Pairs ``i < j`` of a block summed up exactly, without making one pair.

    With unit vectors u and whole-number marks m the sums over pairs are
      sum u_i.u_j        = (|U|^2 - n) / 2            U = sum of the vectors
      sum (u_i.u_j)^2    = (|G|^2 - n) / 2            G = sum of outer products
      sum |m_i-m_j|, sum |m_i-m_j| u_i.u_j            from running sums over the mark values
    so the work is linear in the rows. Sums are first made per (block, mark) with map-side
    combining, then only the tables of sums are joined and ordered.
    Gives n, pairs, mean similarity, mean mark distance and the correlation of
    (1 - similarity) with mark distance.
    """
    unit = df.select(block, F.col(mark).cast("double").alias("m"), unit_vector(F.col(vector)).alias("u")).filter(
        "u is not null and m is not null"
    )
    counts = unit.groupBy(block).agg(F.count("*").alias("n"), F.sum("m").alias("sm"), F.sum(F.expr("m*m")).alias("smm"))

    dims = unit.select(block, "m", F.posexplode("u").alias("d", "x"))
    per_mark = dims.groupBy(block, "m", "d").agg(F.sum("x").alias("x"))
    whole = per_mark.groupBy(block, "d").agg(F.sum("x").alias("x")).groupBy(block).agg(F.sum(F.expr("x*x")).alias("uu"))

    size = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def outer_sums(batches):
        """Sums of outer products of the rows at hand: a few thousand numbers per block and batch."""
        for pdf in batches:
            parts = []
            for value, rows in pdf.groupby(block)["u"]:
                x = np.stack(rows.to_numpy())
                d, e = np.triu_indices(x.shape[1])
                parts.append(pd.DataFrame({block: value, "d": d, "e": e, "g": (x.T @ x)[d, e]}))
            if parts:
                yield pd.concat(parts)

    partial = unit.select(block, "u").mapInPandas(outer_sums, f"{block} {size[block]}, d int, e int, g double")
    gram = partial.groupBy(block, "d", "e").agg(F.sum("g").alias("g"))
    gg = gram.groupBy(block).agg(F.sum(F.when(F.col("d") == F.col("e"), F.col("g") * F.col("g")).otherwise(
        F.lit(2.0) * F.col("g") * F.col("g"))).alias("gg"))

    # rows below are one per (block, mark[, dimension]); marks are a fixed scale
    prior = W.partitionBy(block, "d").orderBy("m").rowsBetween(W.unboundedPreceding, -1)
    cross = per_mark.select(
        block, F.col("x") * (F.col("m") * F.sum("x").over(prior) - F.sum(F.expr("m*x")).over(prior)).alias("c")
    ).toDF(block, "c").groupBy(block).agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("cross"))
    marks = unit.groupBy(block, "m").agg(F.count("*").alias("k"))
    lower = W.partitionBy(block).orderBy("m").rowsBetween(W.unboundedPreceding, -1)
    gaps = marks.select(
        block, F.col("k") * (F.col("m") * F.sum("k").over(lower) - F.sum(F.expr("m*k")).over(lower))
    ).toDF(block, "g").groupBy(block).agg(F.coalesce(F.sum("g"), F.lit(0.0)).alias("gap"))

    t = counts.join(whole, block).join(gg, block).join(cross, block).join(gaps, block)
    n = F.col("n").cast("double")
    pairs = n * (n - 1) / 2
    s = (F.col("uu") - n) / 2
    s2 = (F.col("gg") - n) / 2
    g2 = n * F.col("smm") - F.col("sm") * F.col("sm")
    top = pairs * (F.col("gap") - F.col("cross")) - (pairs - s) * F.col("gap")
    dx = pairs * (pairs - 2 * s + s2) - (pairs - s) * (pairs - s)
    dy = pairs * g2 - F.col("gap") * F.col("gap")
    return t.select(
        block, "n", pairs.cast("bigint").alias("n_pairs"),
        F.try_divide(s, pairs).alias("mean_similarity"), F.try_divide(F.col("gap"), pairs).alias("mean_mark_distance"),
        F.when((dx > 1e-9) & (dy > 1e-9), top / F.sqrt(dx * dy)).alias("correlation"),
    )


def nearest(df: DataFrame, block: str, key: str, vector: str, k: int, tile_rows: int = TILE_ROWS,
            tone: str | None = None, tone_weight: float = 0.0) -> DataFrame:
    """The ``k`` most similar rows of the same block for every row, exact.

    A block is cut into tiles by a hash of the key, as many as its row count asks for. Each
    task compares two tiles and gives at most ``k`` neighbours per row; the best ``k`` over
    the tiles remain. A hot block becomes many tile pairs, and no pair list is ever written.
    With ``tone`` the similarity of two rows of positive tone grows by ``tone_weight`` times
    the distance of their tones, and is kept within [0, 1].
    """
    p = (F.lit(0.0) if tone is None else F.coalesce(F.col(tone).cast("double"), F.lit(0.0))).alias("p")
    unit = df.select(block, key, unit_vector(F.col(vector)).alias("u"), p).filter("u is not null")
    sizes = unit.groupBy(block).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("_tiles"))
    tiled = unit.join(sizes, block).withColumn("_t", F.pmod(F.xxhash64(key), F.col("_tiles")).cast("int"))
    spread = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    queries = tiled.select(block, F.col("_t").alias("_q"), spread.alias("_c"), key, "u", "p", F.lit(True).alias("_is_query"))
    base = tiled.select(block, spread.alias("_q"), F.col("_t").alias("_c"), key, "u", "p", F.lit(False).alias("_is_query"))
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        q, b = pdf[pdf["_is_query"]], pdf[~pdf["_is_query"]]
        out = {block: [], key: [], "neighbour": [], "similarity": []}
        if len(q) and len(b):
            sims = np.stack(q["u"].to_numpy()) @ np.stack(b["u"].to_numpy()).T
            keys_b = b[key].to_numpy()
            if tone is not None:
                pq, pb = q["p"].to_numpy()[:, None], b["p"].to_numpy()[None, :]
                sims = np.clip(sims + np.where((pq > 0) & (pb > 0), tone_weight * np.abs(pq - pb), 0.0), 0.0, 1.0)
            own = q[key].to_numpy()
            sims[(own[:, None] == keys_b[None, :]) | np.isnan(sims)] = -np.inf
            # Ties go to the smaller key, so all rows at the least similarity that may stay are ordered, not k of them.
            least = -np.partition(-sims, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
            row, at = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
            order = np.lexsort((keys_b[at], -sims[row, at], row))
            row, at = row[order], at[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, at = row[first], at[first]
            out = {block: q[block].to_numpy()[row], key: own[row], "neighbour": keys_b[at], "similarity": sims[row, at]}
        return pd.DataFrame(out)

    schema = f"{block} {fields[block]}, {key} {fields[key]}, neighbour {fields[key]}, similarity double"
    local = queries.unionByName(base).groupBy(block, "_q", "_c").applyInPandas(compare, schema)
    return top_rows(local, [block, key], [F.desc("similarity"), F.asc("neighbour")], k, "rank")


def pick_dissimilar(df: DataFrame, group: list[str], key: str, vector: str, k: int = 4,
                    largest_sum: bool = False) -> DataFrame:
    """From each small block: the least similar pair, then one row at a time by its sum of similarities.

    Blocks hold a dozen rows by construction (consecutive rows of a section).
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        u = np.stack(pdf[vector].to_numpy()).astype("float64")
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        sims = u @ u.T
        n = len(pdf)
        if n <= k:
            chosen = list(range(n))
        else:
            chosen = [int(i) for i in np.unravel_index(np.argmin(sims), sims.shape)]
            while len(chosen) < k:
                rest = [i for i in range(n) if i not in chosen]
                total = [sims[i, chosen].sum() for i in rest]
                chosen.append(rest[int(np.argmax(total) if largest_sum else np.argmin(total))])
        out = pdf.iloc[chosen][[*group, key]].copy()
        out["pick"] = np.arange(1, len(chosen) + 1)
        return out

    schema = ", ".join(f"{c} {fields[c]}" for c in [*group, key]) + ", pick int"
    return df.select(*group, key, vector).groupBy(*group).applyInPandas(choose, schema)
