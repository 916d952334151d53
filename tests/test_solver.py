"""The solver on tables, the analysis of variance on it, and variance components."""

import numpy as np
import pytest

from markloom.operators import solver as SV
from markloom.operators import stats as ST


def test_solver_two_systems_side_by_side(spark):
    rng = np.random.default_rng(3)
    rows, right, want = [], [], {}
    for system, n in (("a", 7), ("b", 3)):
        m = rng.normal(size=(n, n))
        m = m @ m.T + np.eye(n)
        b = rng.normal(size=n)
        rows += [(system, f"r{i}", f"r{j}", float(m[i, j])) for i in range(n) for j in range(n)]
        right += [(system, f"r{i}", float(b[i])) for i in range(n)]
        want |= {(system, f"r{i}"): x for i, x in enumerate(np.linalg.solve(m, b))}
    matrix = spark.createDataFrame(rows, "system string, row string, col string, value double")
    got = {(r.system, r.row): r.x for r in SV.solve(matrix, spark.createDataFrame(right, "system string, row string, value double")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in want)


def test_solver_of_zero_and_of_no_rows(spark):
    matrix = spark.createDataFrame([("s", "x", "x", 2.0)], "system string, row string, col string, value double")
    right = spark.createDataFrame([("s", "x", 0.0)], "system string, row string, value double")
    assert [tuple(r) for r in SV.solve(matrix, right).collect()] == [("s", "x", 0.0)]
    assert SV.solve(matrix.where("false"), right.where("false")).count() == 0


def test_solver_gives_up(spark):
    matrix = spark.createDataFrame([("s", "x", "x", 1.0), ("s", "y", "y", 4.0), ("s", "x", "y", 1.0), ("s", "y", "x", 1.0)], "system string, row string, col string, value double")
    right = spark.createDataFrame([("s", "x", 1.0), ("s", "y", 5.0)], "system string, row string, value double")
    with pytest.raises(ValueError, match="settle"):
        SV.solve(matrix, right, most_steps=1)


def simulated(spark, seed, n, levels, deviations, rest):
    rng = np.random.default_rng(seed)
    at = [rng.integers(0, k, n) for k in levels]
    effects = [rng.normal(0, d, k) for k, d in zip(levels, deviations)]
    y = 5 + sum(e[a] for e, a in zip(effects, at)) + rng.normal(0, rest, n)
    rows = [(*(int(a[i]) for a in at), float(y[i])) for i in range(n)]
    return at, effects, y, spark.createDataFrame(rows, "marker int, student int, item int, y double")


def test_anova_of_three_factors_equals_least_squares(spark):
    at, _, y, df = simulated(spark, 1, 900, (5, 30, 7), (2, 1, 0.5), 1.5)
    extra = spark.createDataFrame([(None, 1, 1, 9.0), (1, None, 1, 9.0), (1, 1, 1, None)], df.schema)

    def rss(*factors):
        x = np.hstack([np.ones((len(y), 1)), *(np.eye(a.max() + 1)[a] for a in factors)])
        e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        return e @ e

    got = {r.factor: r for r in SV.type_two_anova(df.union(extra), ["marker", "student", "item"], "y").collect()}
    full = rss(*at)
    for i, name in enumerate(("marker", "student", "item")):
        d = at[i].max()
        ss = rss(*(a for j, a in enumerate(at) if j != i)) - full
        rest = len(y) - 1 - sum(a.max() for a in at)
        assert got[name].sum_sq == pytest.approx(ss, rel=1e-7) and got[name].df == d
        assert got[name].f == pytest.approx(ss / d / (full / rest), rel=1e-7) and got[name].p == pytest.approx(ST.f_tail(got[name].f, d, rest))
    assert got["Residual"].sum_sq == pytest.approx(full, rel=1e-9) and got["Residual"].p is None


def test_anova_of_ten_thousand_students(spark):
    """Two factors have a closed form: the item effects within students."""
    at, _, y, df = simulated(spark, 2, 40_000, (2, 10_000, 3), (1, 1, 1), 1.0)
    got = {r.factor: r for r in SV.type_two_anova(df, ["student", "marker"], "y").collect()}
    student = np.unique(at[1], return_inverse=True)[1]
    n = np.bincount(student)
    d = at[0] - (np.bincount(student, at[0]) / n)[student]
    e = y - (np.bincount(student, y) / n)[student]
    assert got["marker"].sum_sq == pytest.approx((d @ e) ** 2 / (d @ d), rel=1e-7)
    assert got["student"].df == len(n) - 1
    assert got["Residual"].sum_sq == pytest.approx(e @ e - (d @ e) ** 2 / (d @ d), rel=1e-9)


def test_anova_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, y double")
    rows = {r.factor: r for r in SV.type_two_anova(df, ["g"], "y").collect()}
    assert rows["g"].sum_sq == 0 and rows["g"].f is None and rows["Residual"].sum_sq == 0
    assert SV.type_two_anova(df.where("false"), ["g"], "y").count() == 0
    one = {r.factor: r for r in SV.type_two_anova(df.where("g = 'a'"), ["g"], "y").collect()}
    assert one["g"].df == 0 and one["g"].f is None and one["g"].p is None


def test_components_of_balanced_data_are_mean_squares(spark):
    rng = np.random.default_rng(4)
    a, b = np.repeat(np.arange(6), 8), np.tile(np.arange(8), 6)
    y = rng.normal(0, 2, 6)[a] + rng.normal(0, 1, 8)[b] + rng.normal(0, 1, 48)
    df = spark.createDataFrame([(int(i), int(j), float(v)) for i, j, v in zip(a, b, y)], "a int, b int, y double")
    rows, columns = y.reshape(6, 8).mean(1), y.reshape(6, 8).mean(0)
    ms_a, ms_b = 8 * rows.var(ddof=1), 6 * columns.var(ddof=1)
    ms = ((y - rows[a] - columns[b] + y.mean()) ** 2).sum() / 35
    got = {r.component: r.variance for r in SV.variance_components(df, ["a", "b"], "y").collect()}
    assert got == {"a": pytest.approx((ms_a - ms) / 8), "b": pytest.approx((ms_b - ms) / 6), "Residual": pytest.approx(ms)}


def test_components_of_a_simulated_table_come_back(spark):
    _, effects, _, df = simulated(spark, 5, 30_000, (300, 2000, 40), (1.0, 1.5, 0.7), 2.0)
    got = {r.component: r for r in SV.variance_components(df, ["marker", "student", "item"], "y").collect()}
    for name, e in zip(("marker", "student", "item"), effects):
        assert got[name].variance == pytest.approx(e.var(ddof=1), rel=0.12)
    assert got["Residual"].variance == pytest.approx(4.0, rel=0.05) and sum(r.share for r in got.values()) == pytest.approx(1)


def test_components_edges(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("b", "x", None)], "g string, h string, y double")
    assert SV.variance_components(df.where("false"), ["g"], "y").count() == 0
    assert {r.variance for r in SV.variance_components(df, ["g", "h"], "y").collect()} == {None}


def test_forms_join_no_table_of_pairs(spark, monkeypatch):
    """Coefficients are sums over the pairs of two factors alone; the pairs meet no other table."""
    monkeypatch.setattr(SV, "pair_counts", None)
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), ("a", "y", 4.0), ("b", "y", 3.0), (None, "y", 9.0)], "f string, g string, v double")
    got = {(r.form, r.of): r.coefficient for r in SV.quadratic_forms(df, ["f", "g"], "v").collect()}
    assert got["f", "f"] == got["g", "g"] == 4.0
    assert got["f", "g"] == pytest.approx((4 + 1) / 3 + 1) and got["g", "f"] == pytest.approx(4 / 2 + (1 + 1) / 2)
    assert got["mean", "f"] == pytest.approx((9 + 1) / 4) and got["f", "rows"] == 2.0


def test_anova_holds_no_table_of_pairs_and_cuts_hot_levels(spark, monkeypatch):
    """No step moves the counts that two levels share; levels with many cells, in several buckets, change nothing in the result."""
    rng = np.random.default_rng(6)
    student = np.r_[np.zeros(300, int), rng.integers(1, 40, 400)]
    marker, item = rng.integers(0, 6, 700), rng.integers(0, 5, 700)
    y = rng.normal(0, 1, 40)[student] + rng.normal(0, 2, 6)[marker] + rng.normal(0, 1, 700)
    df = spark.createDataFrame([(int(s), int(m), int(i), float(v)) for s, m, i, v in zip(student, marker, item, y)], "student int, marker int, item int, y double")

    def rss(*factors):
        x = np.hstack([np.ones((700, 1)), *(np.eye(a.max() + 1)[a] for a in factors)])
        e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        return e @ e

    for name in ("pair_counts", "solve"):
        monkeypatch.setattr(SV, name, None)
    monkeypatch.setattr(SV, "HOT_CELLS", 10)
    monkeypatch.setattr(SV, "BUCKET_CELLS", 100)
    got = {r.factor: r for r in SV.type_two_anova(df, ["marker", "student", "item"], "y").collect()}
    full = rss(student, marker, item)
    for name, others in (("marker", (student, item)), ("student", (marker, item)), ("item", (student, marker))):
        assert got[name].sum_sq == pytest.approx(rss(*others) - full, rel=1e-7)
    assert got["student"].df == len(set(student.tolist())) - 1 and got["Residual"].sum_sq == pytest.approx(full, rel=1e-9)
