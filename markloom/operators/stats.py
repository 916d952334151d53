"""Statistics from sums that Spark makes in one pass."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType

from markloom.operators.joins import pairs_within
from markloom.operators.ordering import running_sum


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log) * _beta_fraction(b, a, 1.0 - x) / b


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0) if f > 0 else 1.0


def t_tail(t: float, df: float) -> float:
    """Two-sided P(|T| > |t|)."""
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5)


def chi2_tail(x: float, df: float) -> float:
    """P(X > x) by series or continued fraction of the incomplete gamma function."""
    a, x = df / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    log = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - total * math.exp(log)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return math.exp(log) * h


_GL_X, _GL_W = np.polynomial.legendre.leggauss(64)


def studentized_range_tail(q: float, k: int, df: float) -> float:
    """P(Q > q) for k groups, by quadrature over the scale and the normal range."""
    if q <= 0:
        return 1.0
    z = 8.0 * _GL_X
    phi = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    cdf = 0.5 * (1.0 + np.vectorize(math.erf)(z / math.sqrt(2)))

    def range_cdf(w: float) -> float:
        low = 0.5 * (1.0 + np.vectorize(math.erf)((z - w) / math.sqrt(2)))
        return float(np.sum(8.0 * _GL_W * k * phi * (cdf - low) ** (k - 1)))

    if math.isinf(df):
        return max(0.0, 1.0 - range_cdf(q))  # the scale is known
    spread = 8.0 / math.sqrt(2.0 * df)
    lo, hi = max(1e-9, 1.0 - spread), 1.0 + spread
    s = (hi - lo) / 2.0 * _GL_X + (hi + lo) / 2.0
    log = (df / 2.0) * math.log(df / 2.0) - math.lgamma(df / 2.0) + math.log(2.0)
    dens = np.exp(log + (df - 1.0) * np.log(s) - df * s * s / 2.0)
    inner = np.array([range_cdf(q * v) for v in s])
    return max(0.0, 1.0 - float(np.sum((hi - lo) / 2.0 * _GL_W * dens * inner)))


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_tail(a, b, c) if a == a and c > 0 else None for a, b, c in zip(f, d1, d2)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_tail(a, b) if a == a and b > 0 else None for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def chi2_p_value(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(a, b) if a == a and b > 0 else None for a, b in zip(x, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def range_p_value(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([studentized_range_tail(a, int(b), c) for a, b, c in zip(q, k, df)], dtype="float64")


def group_moments(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, sum and sum of squares per group."""
    v = F.col(value)
    return df.filter(v.isNotNull()).groupBy(*group).agg(
        F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss")
    )


def one_way_anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """F of a value by group: one row (k, n, ss_between, ss_within, f)."""
    g = group_moments(df, [group], value)
    row = g.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"),
        F.sum("s").alias("_s"), F.sum("ss").alias("_ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("_b"),
    )
    ssb = F.col("_b") - F.col("_s") * F.col("_s") / F.col("n")
    ssw = F.col("_ss") - F.col("_b")
    return row.select(
        "k", "n", ssb.alias("ss_between"), ssw.alias("ss_within"),
        F.try_divide(ssb / (F.col("k") - 1), F.try_divide(ssw, (F.col("n") - F.col("k")).cast("double"))).alias("f"),
    )


def mid_ranks(df: DataFrame, value: str, piece: Column) -> DataFrame:
    """(value, n, mid_rank) of the distinct values: counted first, then ranked in pieces."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    upto = running_sum(counts, [], [F.col(value)], piece, "n", "upto")
    return upto.select(value, "n", (F.col("upto") - (F.col("n") - 1) / F.lit(2.0)).alias("mid_rank"))


def kruskal(df: DataFrame, group: str, value: str, piece: Column) -> DataFrame:
    """Tie-corrected H over groups."""
    cells = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    ranks = mid_ranks(df, value, piece)
    per_group = cells.join(ranks.select(value, "mid_rank"), value).groupBy(group).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("mid_rank")).alias("r")
    )
    top = per_group.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"))
    nd = F.col("n").cast("double")
    ties = ranks.agg(F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")).alias("t")).scalar()
    h = F.lit(12.0) / (nd * (nd + 1)) * F.col("q") - F.lit(3.0) * (nd + 1)
    return top.select("k", "n", F.try_divide(h, F.lit(1.0) - ties / (nd * nd * nd - nd)).alias("h"))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r as an aggregate; null for a constant side instead of an error."""
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    varied = (F.min(xs) < F.max(xs)) & (F.min(ys) < F.max(ys))
    n, sx, sy = F.count(xs), F.sum(xs), F.sum(ys)
    sxy, sxx, syy = F.sum(xs * ys), F.sum(xs * xs), F.sum(ys * ys)
    r = F.try_divide(n * sxy - sx * sy, F.sqrt(n * sxx - sx * sx) * F.sqrt(n * syy - sy * sy))
    return F.when(varied, r)


def tukey_pairs(df: DataFrame, group: str, value: str) -> DataFrame:
    """All pairs of group means with the studentized range statistic.

    The pairs come from the table of group statistics, a row per group.
    """
    g = group_moments(df, [group], value).withColumn("m", F.col("s") / F.col("n"))
    overall = one_way_anova(df, group, value).select(
        F.struct("k", (F.col("n") - F.col("k")).alias("dof"), (F.col("ss_within") / (F.col("n") - F.col("k"))).alias("ms"))
    ).scalar()
    a = g.select(F.col(group).alias("group1"), F.col("m").alias("m1"), F.col("n").alias("n1"))
    b = g.select(F.col(group).alias("group2"), F.col("m").alias("m2"), F.col("n").alias("n2"))
    named = pairs_within(g, None, group)
    pairs = named.select(F.col("a").alias("group1"), F.col("b").alias("group2")).join(a, "group1").join(b, "group2")
    pairs = pairs.withColumn("_t", overall)
    diff = F.col("m2") - F.col("m1")
    se = F.sqrt(F.col("_t.ms") / F.lit(2.0) * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n2")))
    return pairs.select("group1", "group2", diff.alias("meandiff"), F.abs(diff / se).alias("q"),
                        F.col("_t.k").alias("k"), F.col("_t.dof").alias("dof"), se.alias("se"))


def t_test(df: DataFrame, group: Column, value: str) -> DataFrame:
    """Equal-variance t of two groups given as a boolean column: one row."""
    v = F.col(value).cast("double")
    known = group.isNotNull() & v.isNotNull()
    parts = []
    for name, c in (("a", known & group), ("b", known & ~group)):
        x = F.when(c, v)
        parts += [F.count(x).alias(f"n_{name}"), F.sum(x).alias(f"s_{name}"), F.sum(x * x).alias(f"q_{name}")]
    row = df.agg(*parts)
    ma, mb = F.col("s_a") / F.col("n_a"), F.col("s_b") / F.col("n_b")
    ssa = F.col("q_a") - F.col("s_a") * ma
    ssb = F.col("q_b") - F.col("s_b") * mb
    dof = F.col("n_a") + F.col("n_b") - 2
    pooled = (ssa + ssb) / dof
    t = F.try_divide(ma - mb, F.sqrt(pooled * (F.lit(1.0) / F.col("n_a") + F.lit(1.0) / F.col("n_b"))))
    return row.select("n_a", "n_b", ma.alias("mean_a"), mb.alias("mean_b"), t.alias("t"), dof.alias("dof"))


def variance_shares(df: DataFrame, factors: list[str], value: str) -> DataFrame:
    """Share of the total sum of squares between the levels of each factor (a moment estimate)."""
    frames = []
    for name in factors:
        a = one_way_anova(df, name, value)
        frames.append(a.select(
            F.lit(name).alias("factor"), F.col("k").alias("n_levels"),
            F.try_divide(F.col("ss_between"), F.col("ss_between") + F.col("ss_within")).alias("share"), "f",
        ))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
