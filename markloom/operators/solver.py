"""Linear systems held as tables, and the analysis of variance that rests on them."""

from __future__ import annotations

import math
import uuid
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from markloom.operators.stats import f_p_value
from markloom.session import landing_path

TOLERANCE = 1e-9
MOST_STEPS = 2000
#: Cells in a bucket, and cells of a level that is still taken out whole.
BUCKET_CELLS, HOT_CELLS = 2_000_000, 100_000


def _land(df: DataFrame, name: str) -> DataFrame:
    path = landing_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _of_system(values: dict[str, float]) -> Column:
    """A value for each system."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("system")]


def solve(matrix: DataFrame, right: DataFrame, tolerance: float = TOLERANCE, most_steps: int = MOST_STEPS) -> DataFrame:
    """(system, row, x) with matrix x = right for each system, by conjugate gradients on tables.

    ``matrix``: (system, row, col, value), symmetric and without negative eigenvalues; ``right``: (system, row, value), in
    the range of the matrix. Systems are few and are solved side by side; their sizes have no bound. A step is one join of
    the entries with the direction, a sum for each row, and a landed vector; only sums of squares, one row a system, come to the
    driver. Rows are scaled by the diagonal. A system that does not settle in ``most_steps`` raises an error.
    """
    diagonal = _land(matrix.where("row = col AND value > 0").select("system", "row", F.sqrt("value").alias("d")), "diagonal")
    at_col = diagonal.select("system", F.col("row").alias("col"), F.col("d").alias("e"))
    entries = _land(matrix.join(diagonal, ["system", "row"]).join(at_col, ["system", "col"])
                    .select("system", "row", "col", (F.col("value") / (F.col("d") * F.col("e"))).alias("value")), "entries")
    b = F.col("value") / F.col("d")
    state = right.join(diagonal, ["system", "row"]).select("system", "row", F.lit(0.0).alias("x"), b.alias("r"), b.alias("p"))
    goal: dict[str, float] = {}
    for _ in range(most_steps):
        moved = (entries.join(state.select("system", F.col("row").alias("col"), "p"), ["system", "col"])
                 .groupBy("system", "row").agg(F.sum(F.col("value") * F.col("p")).alias("q")))
        held = _land(state.join(moved, ["system", "row"], "left").fillna(0.0, ["q"]), "direction")
        sums = held.groupBy("system").agg(*[F.sum(F.col(m) * F.col(n)).alias(m + n) for m, n in (("r", "r"), ("p", "q"), ("r", "q"), ("q", "q"))]).collect()
        goal = goal or {s.system: s.rr * tolerance**2 for s in sums}
        going = {s.system: s for s in sums if s.rr > goal[s.system] and s.pq > 0}
        if not going:
            return held.join(diagonal, ["system", "row"]).select("system", "row", (F.col("x") / F.col("d")).alias("x"))
        alpha = {s.system: s.rr / s.pq if s.system in going else 0.0 for s in sums}
        after = {k: max(0.0, s.rr - 2 * alpha[k] * s.rq + alpha[k] ** 2 * s.qq) for k, s in going.items()}
        beta = {s.system: after[s.system] / s.rr if s.system in going else 0.0 for s in sums}
        r = F.col("r") - _of_system(alpha) * F.col("q")
        state = held.select("system", "row", (F.col("x") + _of_system(alpha) * F.col("p")).alias("x"), r.alias("r"),
                            (r + _of_system(beta) * F.col("p")).alias("p"))
    raise ValueError("the system does not settle")


def cells_of(df: DataFrame, factors: list[str], value: str) -> DataFrame:
    """(factors as strings, n, mean, within): one row for each combination of levels; rows with a null are left out."""
    v = F.col(value).cast("double")
    known = v.isNotNull()
    for f in factors:
        known = known & F.col(f).isNotNull()
    return df.where(known).groupBy(*[F.col(f).cast("string").alias(f) for f in factors]).agg(
        F.count("*").cast("double").alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count("*")).alias("within"))


def _level(f: str) -> Column:
    return F.concat(F.lit(f"{f}:"), F.col(f))


def pair_counts(cells: DataFrame, factors: list[str]) -> DataFrame:
    """(f, g, row, col, value): how many rows two levels share, for all pairs of factors and each factor with itself."""
    out = None
    for f, g in [(f, f) for f in factors] + list(combinations(factors, 2)):
        n = cells.groupBy(_level(f).alias("row"), _level(g).alias("col")).agg(F.sum("n").alias("value"))
        n = n.select(F.lit(f).alias("f"), F.lit(g).alias("g"), "row", "col", "value")
        out = n if out is None else out.unionByName(n)
    turned = out.where("f != g").select(F.col("g").alias("f"), F.col("f").alias("g"), F.col("col").alias("row"), F.col("row").alias("col"), "value")
    return out.unionByName(turned)


def _own(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """The frame as a landed table cut and bucketed by ``by``: windows and sums over these columns move no row again."""
    spark, count = df.sparkSession, df.count()
    parts = -(-count // BUCKET_CELLS) or 1
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(parts, *by).write.bucketBy(parts, *by).option("path", landing_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def explained(cells: DataFrame, factors: list[str], systems: list[list[str]], tolerance: float = TOLERANCE, most_steps: int = MOST_STEPS) -> tuple[list[float], dict[str, int]]:
    """The sum of squares that each additive model (a list of factors) explains, and the number of levels of each factor.

    ``cells``: (factors as strings, n, away), one row for each combination of levels, ``away`` being the mean less that of all
    rows. The first factor is in all systems. Its effects are taken out exactly, level by level, so that only the levels of the other factors are unknown, and
    those are found by conjugate gradients without a table of the matrix: the cells lie in buckets of the first factor's levels, where a step reads them, takes the vector beside
    them, removes the level's mean and adds up by level of the other factors. Only these sums and the vectors move. A level of
    the first factor with more than ``HOT_CELLS`` cells is cut into pieces and is an unknown like those of the other factors.
    """
    first, others = factors[0], factors[1:]
    groups = _land(cells.groupBy(first).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("away")).alias("b"), F.count("*").alias("cells")), "groups")
    small = groups.agg(F.count("*").alias("levels"), F.sum(F.when(F.col("cells") <= HOT_CELLS, F.col("b") * F.col("b") / F.col("n"))).alias("ss"),
                       F.max("cells").alias("most")).first()
    levels = {first: small.levels}
    if not others:
        return [groups.agg(F.sum(F.col("b") * F.col("b") / F.col("n"))).first()[0] or 0.0 for _ in systems], levels
    hot = groups.where(F.col("cells") > HOT_CELLS).select(first, F.ceil(F.col("cells") / HOT_CELLS).alias("_pieces"))
    cut = cells.withColumns({"_hot": F.lit(None).cast("string"), "_piece": F.lit(0)})
    kept = list(others)
    if small.most > HOT_CELLS:
        kept.append("_hot")
        cut = cells.join(hot, first, "left").withColumns({
            "_hot": F.when(F.col("_pieces").isNotNull(), F.col(first)),
            "_piece": F.coalesce(F.pmod(F.xxhash64(*others), F.col("_pieces")), F.lit(0)).cast("int")}).drop("_pieces")
    held = _own(cut, [first, "_piece"], "cells")
    which = range(len(systems))
    has = {f: [j for j in which if f == "_hot" or f in systems[j]] for f in kept}
    level = W.partitionBy(first, "_piece")

    def by_level(df: DataFrame, sums: list[Column]) -> DataFrame:
        """For each level of the kept factors the sums, one a system (null in systems without the factor)."""
        each = [F.struct(F.lit(f).alias("factor"), F.col(f).alias("level"), F.col("n"), F.col("away"),
                         *[(sums[j] if j in has[f] else F.lit(None).cast("double")).alias(f"s{j}") for j in which]) for f in kept]
        return df.select(F.inline(F.array(*each))).where("level IS NOT NULL").groupBy("factor", "level").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("away")).alias("b"), *[F.sum(f"s{j}").alias(f"s{j}") for j in which])

    def without_mean(values: list[str]) -> list[Column]:
        """n times the value less its mean in the level of the first factor, where that is taken out."""
        return [F.col("n") * (F.col(v) - F.when(F.col("_hot").isNull(), F.col(f"{v}_mean")).otherwise(0.0)) for v in values]

    def means(df: DataFrame, values: list[str]) -> DataFrame:
        return df.withColumns({f"{v}_mean": F.sum(F.col("n") * F.col(v)).over(level) / F.sum("n").over(level) for v in values})

    start = by_level(means(held, ["away"]), without_mean(["away"]) * len(systems))
    d = F.sqrt("n")
    state = _land(start.select("factor", "level", d.alias("d"), "b", *[c for j in which for c in (
        (F.col(f"s{j}") / d).alias(f"r{j}"), (F.col(f"s{j}") / d).alias(f"p{j}"))]), "state")
    about = state.groupBy("factor").agg(F.count("*").alias("levels"), F.sum(F.expr("b * b / d / d")).alias("scale"),
                                        *[F.sum(F.expr(f"r{j} * r{j}")).alias(f"rr{j}") for j in which]).collect()
    levels |= {a.factor: a.levels for a in about if a.factor != "_hot"}
    goal = [tolerance**2 * sum(a.scale for a in about if j in has[a.factor]) for j in which]
    rr = [sum(a[f"rr{j}"] for a in about if j in has[a.factor]) for j in which]
    found = [small.ss or 0.0 for _ in which]
    for _ in range(most_steps):
        going = [j for j in which if rr[j] > goal[j]]
        if not going:
            return found, levels
        wide, fits = held, {}
        for f in kept:
            own = [j for j in going if j in has[f]]
            vector = state.where(F.col("factor") == f).select(F.col("level").alias(f), *[(F.col(f"p{j}") / F.col("d")).alias(f"{f}_{j}") for j in own])
            wide = wide.join(vector, f, "left" if f == "_hot" else "inner")
            for j in own:
                fits.setdefault(j, []).append(F.coalesce(F.col(f"{f}_{j}"), F.lit(0.0)))
        wide = wide.withColumns({f"fit{j}": sum(parts[1:], parts[0]) for j, parts in fits.items()})
        wide = means(wide, [f"fit{j}" for j in going])
        moved = by_level(wide, [without_mean([f"fit{j}"])[0] if j in going else F.lit(0.0) for j in which])
        q = _land(state.join(moved.select("factor", "level", *[f"s{j}" for j in going]), ["factor", "level"])
                  .select(*state.columns, *[(F.col(f"s{j}") / F.col("d")).alias(f"q{j}") for j in going]), "direction")
        sums = q.agg(*[F.sum(F.col(f"{m}{j}") * F.col(f"{n}{j}")).alias(f"{m}{n}{j}") for j in going for m, n in (("r", "r"), ("p", "q"), ("r", "q"), ("q", "q"))]).first()
        step = {}
        for j in going:
            pq = sums[f"pq{j}"] or 0.0
            if pq <= 0:
                rr[j] = 0.0
                continue
            alpha = sums[f"rr{j}"] / pq
            rr[j] = max(0.0, sums[f"rr{j}"] - 2 * alpha * sums[f"rq{j}"] + alpha**2 * sums[f"qq{j}"])
            step[j] = alpha, rr[j] / sums[f"rr{j}"]
            # a step along p lowers the squared error by alpha r.r, and the squares explained at the end are the sum of these
            found[j] += alpha * sums[f"rr{j}"]
        state = q.select("factor", "level", "d", "b", *[c for j in which for c in _stepped(j, step)])
    raise ValueError("the system does not settle")


def _stepped(j: int, step: dict[int, tuple[float, float]]) -> list[Column]:
    if j not in step:
        return [F.col(f"r{j}"), F.col(f"p{j}")]
    alpha, beta = map(F.lit, step[j])
    r = F.col(f"r{j}") - alpha * F.col(f"q{j}")
    return [r.alias(f"r{j}"), (r + beta * F.col(f"p{j}")).alias(f"p{j}")]


def type_two_anova(df: DataFrame, factors: list[str], value: str) -> DataFrame:
    """(factor, sum_sq, df, f, p): what each factor explains beyond all others, tested against the full additive model.

    Rows become cells with counts and means; the full model and those without one factor are fitted side by side
    (``explained``), so no factor has a bound on its levels and none is one-hot
    encoded. The spread inside cells is part of the residual. Levels are taken to be connected over the data, so a factor has one
    degree less than levels. Null values and levels are left out; with no degrees for the residual F and p are null. No rows: no rows.
    """
    cells = _land(cells_of(df, factors, value), "cells")
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum("within").alias("w"),
                      *[F.approx_count_distinct(f).alias(f"levels_{f}") for f in factors]).first()
    schema = "factor string, sum_sq double, df double, f double, p double"
    if not total.n:
        return df.sparkSession.createDataFrame([], schema)
    cells = cells.select(*factors, "n", (F.col("mean") - F.lit(total.s / total.n)).alias("away"))
    between = cells.agg(F.sum(F.expr("n * away * away"))).first()[0]
    order = sorted(factors, key=lambda f: -total[f"levels_{f}"])  # most levels first, as those cost least when taken out
    systems = [order, *([g for g in order if g != f] for f in order[1:])]
    ss, levels = explained(cells, order, systems)
    fitted = {"all": ss[0]} | {f"no {f}": v for f, v in zip(order[1:], ss[1:])}
    if order[1:]:
        rest = cells.groupBy(*order[1:]).agg(F.sum("n").alias("n"), (F.sum(F.expr("n * away")) / F.sum("n")).alias("away"))
        fitted[f"no {order[0]}"] = explained(_land(rest, "cells"), order[1:], [order[1:]])[0][0]
    degrees = {f: levels[f] - 1 for f in factors}
    rest = max(0.0, between - fitted["all"]) + total.w
    rest_df = total.n - 1 - sum(degrees.values())
    rows = []
    for f in factors:
        ss = max(0.0, fitted["all"] - fitted.get(f"no {f}", 0.0))
        known = degrees[f] > 0 and rest_df > 0 and rest > 0
        rows.append((f, ss, float(degrees[f]), ss / degrees[f] / (rest / rest_df) if known else None))
    rows.append(("Residual", rest, float(rest_df), None))
    out = df.sparkSession.createDataFrame(rows, "factor string, sum_sq double, df double, f double")
    return out.withColumn("p", F.when(F.col("f").isNotNull(), f_p_value(F.coalesce("f", F.lit(1.0)), "df", F.lit(float(rest_df)))))


def quadratic_forms(df: DataFrame, factors: list[str], value: str) -> DataFrame:
    """(form, of, coefficient, square): for each factor, the sum over its levels of the squared sum of the centred values by the count
    (square), and how often the variance of each factor ``of`` enters its expected value (coefficient).

    The forms 'mean' (one level for all) and 'rows' (each row a level) complete them; 'rows' as ``of`` is the variance of
    single rows. Everything comes from counts that two levels share.
    """
    cells = _land(cells_of(df, factors, value), "cells")
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum("within").alias("w")).first()
    schema = "form string, of string, coefficient double, square double"
    if not total.n:
        return df.sparkSession.createDataFrame([], schema)
    away = F.col("mean") - F.lit(total.s / total.n)
    out = None
    for f, g in combinations(factors, 2):
        # a level's count is the sum of its pairs, so the table of pairs meets no other
        shared = _land(cells.groupBy(f, g).agg(F.sum("n").alias("n")), "pairs")
        for form, of in ((f, g), (g, f)):
            one = shared.groupBy(form).agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("c")).agg(F.sum("c").alias("coefficient"))
            one = one.select(F.lit(form).alias("form"), F.lit(of).alias("of"), "coefficient")
            out = one if out is None else out.unionByName(one)
    n = F.lit(float(total.n))
    squares = None
    for f in factors:
        s = cells.groupBy(f).agg(F.sum("n").alias("n"), F.sum(F.col("n") * away).alias("s")).agg(
            F.sum(F.col("s") * F.col("s") / F.col("n")).alias("square"), F.count("*").cast("double").alias("levels"), (F.sum(F.col("n") * F.col("n")) / n).alias("mean"))
        s = s.select(F.lit(f).alias("form"), "square", "levels", "mean")
        squares = s if squares is None else squares.unionByName(s)
    squares = _land(squares, "squares")
    of_rows = cells.agg(F.sum(F.col("n") * away * away + F.col("within")).alias("square"))
    # each row has one level, so the pairs of a factor with itself are its levels, and their coefficient is the number of rows
    same = squares.select("form", F.col("form").alias("of"), n.alias("coefficient"), "square")
    by_factor = same if out is None else same.unionByName(out.join(squares.select("form", "square"), "form").select(*same.columns))
    own = squares.select("form", F.lit("rows").alias("of"), F.col("levels").alias("coefficient"), "square")
    mean = squares.select(F.lit("mean").alias("form"), F.col("form").alias("of"), F.col("mean").alias("coefficient"), F.lit(0.0).alias("square"))
    every = of_rows.select(F.explode(F.array(*[F.lit(f) for f in [*factors, "rows"]])).alias("of"), "square").select(F.lit("rows").alias("form"), "of", n.alias("coefficient"), "square")
    one = df.sparkSession.range(1).select(F.lit("mean").alias("form"), F.lit("rows").alias("of"), F.lit(1.0).alias("coefficient"), F.lit(0.0).alias("square"))
    columns = ["form", "of", "coefficient", "square"]
    return by_factor.select(*columns).unionByName(own.select(*columns)).unionByName(mean).unionByName(every.select(*columns)).unionByName(one)


def variance_components(df: DataFrame, factors: list[str], value: str) -> DataFrame:
    """(component, variance, share): the variances of crossed random factors and of what is left, without bias for any design.

    The quadratic forms less that of the mean are set equal to their expected values, a small linear system with a row for each
    factor and one for the rest. An estimate may be negative; shares are of the sum of the positive ones. Where the forms do
    not tell the components apart (a factor with one level, or with a level for each row) all are null. No rows: no rows.
    """
    forms = quadratic_forms(df, factors, value).collect()  # (factors + 2) * (factors + 1) rows
    names = [*factors, "rows"]
    schema = "component string, variance double, share double"
    if not forms:
        return df.sparkSession.createDataFrame([], schema)
    coefficient = {(r.form, r.of): r.coefficient for r in forms}
    square = {r.form: r.square for r in forms}
    a = np.array([[coefficient[f, g] - coefficient["mean", g] for g in names] for f in names])
    b = np.array([square[f] - square["mean"] for f in names])
    scale = np.abs(a).max(1, keepdims=True)
    found = [None] * len(names)
    if (scale > 0).all() and np.linalg.cond(a / scale) < 1e12:
        found = np.linalg.solve(a, b).tolist()
    whole = math.fsum(max(0.0, v) for v in found if v is not None)
    rows = [(n if n != "rows" else "Residual", v, max(0.0, v) / whole if v is not None and whole > 0 else None) for n, v in zip(names, found)]
    return df.sparkSession.createDataFrame(rows, schema)
