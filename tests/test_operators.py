"""Operators against brute force, with pieces, blocks and tiles small enough to split the hot group."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from markloom.functions import jsonmap as J
from markloom.operators import joins as JN
from markloom.operators import models as MD
from markloom.operators import ordering as ORD
from markloom.operators import reshape as R
from markloom.operators import similarity as SIM
from markloom.operators import solver as SV
from markloom.operators import stats as ST
from markloom.operators import textstats as TX
from markloom.plans.statistics import weight_search
from markloom.sources import readers as RD
from markloom.sources import writers as WR


@pytest.fixture(scope="module")
def hot(spark):
    """Group 0 holds most rows; one group key is null."""
    rnd = random.Random(3)
    rows = [(None if i % 50 == 49 else 0 if i % 3 else i % 5, i, rnd.choice([None, 1, 2, 3])) for i in range(400)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g int, o int, v int").repartition(5)


def by_group(rows):
    out = {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(g, []).append((o, v))
    return out


def test_row_numbers_in_pieces(hot):
    rows, df = hot
    got = {(r["g"], r["o"]): r["rn"] for r in ORD.row_numbers(df, ["g"], ["o"], F.floor(F.col("o") / 10)).collect()}
    assert len(got) == 400
    for g, items in by_group(rows).items():
        assert [got[g, o] for o, _ in items] == list(range(1, len(items) + 1))
    whole = ORD.row_numbers(df, [], ["o"], F.floor(F.col("o") / 7)).collect()
    assert all(r["rn"] == r["o"] + 1 for r in whole)


def test_running_sum_and_fill(hot):
    rows, df = hot
    piece = F.floor(F.col("o") / 10)
    sums = {(r["g"], r["o"]): r["s"] for r in ORD.running_sum(df, ["g"], ["o"], piece, "v", "s").collect()}
    fills = {(r["g"], r["o"]): r["f"] for r in ORD.fill_from_neighbours(df, ["g"], "o", piece, "v", "f").collect()}
    for g, items in by_group(rows).items():
        total = 0
        for i, (o, v) in enumerate(items):
            total += v or 0
            assert sums[g, o] == total
            back = [x for _, x in items[: i + 1] if x is not None]
            ahead = [x for _, x in items[i:] if x is not None]
            assert fills[g, o] == (back[-1] if back else ahead[0] if ahead else None)


def test_ordered_texts(hot):
    rows, df = hot
    text = df.withColumn("t", F.col("o").cast("string"))
    got = ORD.ordered_texts(text, ["g"], ["o"], F.floor(F.col("o") / 10), "t").collect()
    assert len(got) == len(rows)
    for g, items in by_group(rows).items():
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])
        assert [(r["place"], r["text"]) for r in mine] == [(i + 1, str(o)) for i, (o, _) in enumerate(items)]


def test_ordered_texts_without_blank_ends(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["", " ", "a", None, "b", ""])] + [(2, 1, ""), (2, 2, None)], "g int, o int, t string")
    got = sorted((r.g, r.place, r.text) for r in ORD.ordered_texts(df, ["g"], ["o"], F.floor(F.col("o") / 2), "t", ends=True).collect())
    assert got == [(1, 3, "a"), (1, 4, None), (1, 5, "b")]
    assert [(r.g, r.x) for r in ORD.joined_set(df.filter("t <> ''"), ["g"], "t", "|", "x").collect()] == [(1, " |a|b")]


def test_totals_and_gaps_beside_long_texts(spark):
    """A group of 25,000: its totals stand once, and only a setting never given reads as missing."""
    df = spark.range(25_000).select(F.lit(1).alias("g"), F.lit("a").alias("s"), F.col("id").alias("o"), F.col("id").cast("string").alias("t"))
    df = df.union(spark.createDataFrame([(1, "b", i, str(i)) for i in range(5)] + [(2, "b", 1, "x"), (3, "a", 1, None)], "g int, s string, o bigint, t string"))
    texts = ORD.ordered_texts(df, ["g", "s"], ["o"], F.floor(F.col("o") / 1000), "t", "t")
    wide = {(r.g, r.place): (r.a, r.b) for r in R.pivot_texts(texts, ["g"], "s", ["a", "b"], "t", "none").collect()}
    assert len(wide) == 25_002
    assert [wide[1, k + 1] for k in range(25_000)] == [(str(k), str(k) if k < 5 else None) for k in range(25_000)]
    assert wide[2, 1] == ("none", "x") and wide[3, 1] == ("", "none")
    totals = df.groupBy("g", "s").agg(F.count("*").alias("n"))
    got = ORD.beside_text(totals, texts, ["g", "s"]).collect()
    assert sum(r.n or 0 for r in got) == 25_007 == len(got) and all((r.n is None) == (r.place > 1) for r in got)


def test_texts_written_in_order(spark, tmp_path):
    """A large key is cut over tasks; its files, read by name, are its text in order."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 < 2, "hot key").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"), F.col("id").alias("o"))
    texts = ORD.ordered_texts(df.withColumn("t", F.concat(F.lit("- "), F.col("o"))), ["k"], ["o"], F.floor(F.col("o") / 1000), "t")
    WR.write_texts(texts, str(tmp_path / "out"), ["k"], "place", "text", sep="; ")
    for key in ["hot key", *[f"k{i}" for i in range(5)]]:
        parts = sorted(p for d in (tmp_path / "out").iterdir() if d.name in (f"k={key}", "k=" + key.replace(" ", "%20")) for p in d.glob("part-*"))
        want = [o for o in range(30_000) if ("hot key" if o % 3 < 2 else f"k{o % 5}") == key]
        assert "".join(p.read_text() for p in parts) == "".join(f"- {o}; " for o in want)


def test_literal_words_inside_quotes_stay(spark):
    df = spark.createDataFrame([("{'k': None, 'b': 'x, None, y', \"c\": True}",), ("{'a': [None, False], 'b': \"it's, None, so\"}",), (None,)], "t string")
    got = [r.m for r in df.select(J.parse_map(F.col("t")).alias("m")).collect()]
    assert got[0] == {"k": None, "b": "x, None, y", "c": "true"} and got[1]["b"] == "it's, None, so" and got[2] == {}


def test_pairs_once_for_any_block(spark):
    rows = [(1, m) for m in range(23)] + [(2, 5), (2, 9), (2, 5), (3, 1)]
    df = spark.createDataFrame(rows, "g int, m int")
    for block in (1000, 4):
        got = sorted((r["g"], r["a"], r["b"]) for r in JN.pairs_within(df, "g", "m", block).collect())
        assert got == sorted([(1, a, b) for a, b in itertools.combinations(range(23), 2)] + [(2, 5, 9)])
    assert JN.pairs_within(df.filter("g = 1"), None, "m", 4).count() == 253


def test_roster_is_attended_and_absent(spark):
    roster = spark.range(10).withColumnRenamed("id", "s")
    forms = spark.createDataFrame([(1,), (2,), (2,), (77,)], "s long")
    gap = [(r["s"], r["gap"]) for r in JN.membership_gap(roster, forms, "s").collect()]
    absent = {s for s, g in gap if g == "no form"}
    assert absent | {1, 2} == set(range(10)) and (77, "not on roster") in gap


def vectors(n, blocks, seed=1):
    rnd = np.random.default_rng(seed)
    return [(int(b), i, [float(x) for x in rnd.normal(size=6)], int(rnd.integers(0, 5))) for i, b in enumerate(rnd.integers(0, blocks, n))]


def unit(v):
    return np.array(v) / np.linalg.norm(v)


def test_pair_summary_equals_brute_force(spark):
    rows = vectors(60, 3) + [(9, 100, [1.0] * 6, 2), (9, 101, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 2)]
    df = spark.createDataFrame(rows, "b int, k int, v array<double>, m int").repartition(4)
    got = {r["b"]: r for r in SIM.pair_summary(df, "b", "v", "m").collect()}
    for b in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == b]
        sims = [unit(x[2]) @ unit(y[2]) for x, y in itertools.combinations(own, 2)]
        gaps = [abs(x[3] - y[3]) for x, y in itertools.combinations(own, 2)]
        assert got[b]["n_pairs"] == len(sims)
        assert got[b]["mean_similarity"] == pytest.approx(np.mean(sims))
        assert got[b]["mean_mark_distance"] == pytest.approx(np.mean(gaps))
        if np.std(gaps) > 0:
            assert got[b]["correlation"] == pytest.approx(np.corrcoef(1 - np.array(sims), gaps)[0, 1])
        else:
            assert got[b]["correlation"] is None


@pytest.mark.parametrize("tile", [1000, 7])
@pytest.mark.parametrize("tone", [None, "t"])
def test_nearest_equals_brute_force(spark, tile, tone):
    rows = [(b, i, v, (i % 5 - 2) / 2) for b, i, v, _ in vectors(50, 2)]
    df = spark.createDataFrame(rows, "b int, k int, v array<double>, t double").repartition(3)
    got = {}
    for r in SIM.nearest(df, "b", "k", "v", 3, tile_rows=tile, tone=tone, tone_weight=0.3).collect():
        got.setdefault(r["k"], {})[r["rank"]] = (r["neighbour"], r["similarity"])

    def sim(x, y):
        s = unit(x[2]) @ unit(y[2])
        if tone is None:
            return s
        return min(1.0, max(0.0, s + (0.3 * abs(x[3] - y[3]) if x[3] > 0 and y[3] > 0 else 0.0)))

    for x in rows:
        best = sorted(((-sim(x, y), y[1]) for y in rows if y[0] == x[0] and y[1] != x[1]))[:3]
        assert [got[x[1]][i + 1][1] for i in range(3)] == pytest.approx([-s for s, _ in best])


def test_nearest_of_equal_vectors_goes_by_key(spark):
    nan = float("nan")
    rows = [(1, k, [1.0, 0.0]) for k in range(40)] + [(1, 90, [0.0, 1.0]), (2, 91, [1.0, 1.0]), (2, 92, [nan, 1.0]), (2, 93, [1.0, 0.5]), (3, 94, [1.0, 1.0])]
    got = {}
    for r in SIM.nearest(spark.createDataFrame(rows, "b int, k int, v array<double>"), "b", "k", "v", 3).orderBy("k", "rank").collect():
        got.setdefault(r["k"], []).append(r["neighbour"])
    assert got == {**{k: [x for x in range(4) if x != k][:3] for k in range(40)}, 90: [0, 1, 2], 91: [93], 93: [91]}


def test_polarity_counts_only_words_of_the_lexicon(spark):
    docs = spark.createDataFrame([(1, "good good bad table"), (2, "table chair"), (3, None)], "doc_id bigint, text string")
    lexicon = spark.sql("SELECT * FROM VALUES ('good', 1.0D), ('bad', -0.5D) AS l(word, polarity)")
    out = TX.text_polarity(docs, "doc_id", "text", lexicon)
    assert {r.doc_id: r.polarity for r in out.collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[plan.index("Join Inner"):]


def test_pick_dissimilar(spark):
    v = {0: [1.0, 0.0, 0.0], 1: [0.9, 0.1, 0.0], 2: [-1.0, 0.0, 0.0], 3: [0.0, 1.0, 0.0], 4: [0.0, 0.0, 1.0]}
    df = spark.createDataFrame([(1, k, x) for k, x in v.items()], "g int, k int, v array<double>")
    picked = [r["k"] for r in SIM.pick_dissimilar(df, ["g"], "k", "v", 3).orderBy("pick").collect()]
    assert picked[:2] == [0, 2]
    sums = {k: sum(unit(v[k]) @ unit(v[j]) for j in (0, 2)) for k in (1, 3, 4)}
    assert sums[picked[2]] == pytest.approx(min(sums.values()))


def test_tails():
    assert ST.f_tail(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-5)
    assert ST.t_tail(2.2281, 10) == pytest.approx(0.05, abs=1e-5)
    assert ST.chi2_tail(7.8147, 3) == pytest.approx(0.05, abs=1e-5)
    assert ST.chi2_tail(0.5, 3) == pytest.approx(0.9189, abs=1e-4)
    for q, k, df in ((3.877, 3, 10), (3.977, 5, 60), (3.314, 3, math.inf)):
        assert ST.studentized_range_tail(q, k, df) == pytest.approx(0.05, abs=2e-4)


def test_anova_kruskal_ttest_tukey(spark):
    groups = {"a": [1.0, 2.0, 3.0, 4.0], "b": [2.0, 4.0, 6.0], "c": [7.0, 8.0, 8.0, 9.0, 7.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    allv = np.array([v for _, v in rows])
    ssb = sum(len(v) * (np.mean(v) - allv.mean()) ** 2 for v in groups.values())
    ssw = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values())
    a = ST.one_way_anova(df, "g", "v").first()
    assert a["f"] == pytest.approx((ssb / 2) / (ssw / 9))
    order = sorted(allv)
    rank = {v: np.mean([i + 1 for i, x in enumerate(order) if x == v]) for v in set(allv)}
    n = len(allv)
    h = 12 / (n * (n + 1)) * sum(sum(rank[v] for v in vs) ** 2 / len(vs) for vs in groups.values()) - 3 * (n + 1)
    ties = sum(c ** 3 - c for c in (order.count(v) for v in set(order)))
    assert ST.kruskal(df, "g", "v", F.floor(F.col("v") / 3)).first()["h"] == pytest.approx(h / (1 - ties / (n ** 3 - n)))
    t = ST.t_test(df.filter("g != 'c'"), F.col("g") == "a", "v").first()
    pooled = (np.var(groups["a"], ddof=1) * 3 + np.var(groups["b"], ddof=1) * 2) / 5
    assert t["t"] == pytest.approx((2.5 - 4) / math.sqrt(pooled * (1 / 4 + 1 / 3)))
    q = {(r["group1"], r["group2"]): r["q"] for r in ST.tukey_pairs(df, "g", "v").collect()}
    assert len(q) == 3
    assert q["a", "c"] == pytest.approx((7.8 - 2.5) / math.sqrt(ssw / 9 / 2 * (1 / 4 + 1 / 5)))


def test_constant_group_has_no_correlation(spark):
    df = spark.createDataFrame([("x", 1.0, 2.0), ("x", 1.0, 3.0), ("y", 1.0, 2.0), ("y", 2.0, 4.0)], "g string, a double, b double")
    got = {r["g"]: r["r"] for r in df.groupBy("g").agg(ST.safe_corr(F.col("a"), F.col("b")).alias("r")).collect()}
    assert got["x"] is None and got["y"] == pytest.approx(1.0)


def test_type_two_anova_equals_least_squares(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("abc"), rnd.choice("xy"), rnd.random() * 5) for _ in range(60)]
    df = spark.createDataFrame(rows, "p string, q string, v double")

    def rss(factors):
        cols = [np.ones(len(rows))]
        for i in factors:
            cols += [np.array([r[i] == level for r in rows], float) for level in sorted({r[i] for r in rows})[1:]]
        x, y = np.stack(cols, 1), np.array([r[2] for r in rows])
        return float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())

    got = {r["factor"]: r["sum_sq"] for r in SV.type_two_anova(df, ["p", "q"], "v").collect()}
    full = rss([0, 1])
    assert got["p"] == pytest.approx(rss([1]) - full, rel=1e-6)
    assert got["q"] == pytest.approx(rss([0]) - full, rel=1e-6)
    assert got["Residual"] == pytest.approx(full, rel=1e-6)


def test_forest_and_elbow(spark):
    rnd = random.Random(1)
    rows = [(i, float(a), float(rnd.randint(0, 1)), a * 50.0) for i, a in enumerate (rnd.randint(0, 1) for _ in range(120))]
    imp = {r["feature"]: r["importance"] for r in MD.forest_importance(
        spark.createDataFrame(rows, "i int, a double, b double, y double"), "i", ["a", "b"], "y", trees=5).collect()}
    assert imp["a"] > 0.9
    pts = spark.createDataFrame([([float(i % 2) * 10, float(i)],) for i in range(10)], "v array<double>")
    cost = {r["k"]: r["cost"] for r in MD.elbow(pts, "v", [1, 2]).collect()}
    x = np.array([[i % 2 * 10, i] for i in range(10)], float)
    assert cost[1] == pytest.approx(((x - x.mean(0)) ** 2).sum()) and cost[2] < cost[1]


def test_weight_search_equals_grid(spark):
    items = [("s", w) for w in [10, 10, 10, 5, 2, 2]] + [("t", w) for w in [10, 3]] + [("none", 5)]
    df = spark.createDataFrame(items, "section string, w bigint")
    got = sorted((r["section"], r["critical_weight"], r["moderate_weight"], r["minor_weight"], round(r["cutoff"] * 100)) for r in weight_search(df, "section", "w").collect())
    want = []
    for section, c, m, l in (("s", 3, 1, 2), ("t", 1, 0, 1), ("none", 0, 1, 0)):
        for cw, mw, lw, cut in itertools.product(range(1, 26), range(1, 10), range(1, 10), range(30, 95)):
            if mw >= cw or lw >= mw:
                continue
            total = cw * c + mw * m + lw * l
            missed_fails = c == 0 or (total - cw) * 100 < cut * total
            if missed_fails and cw * c * 100 >= cut * total:
                want.append((section, cw, mw, lw, cut))
    assert got == sorted(want)


def test_phrases(spark):
    df = spark.createDataFrame([("The good, good work!",), ("good work\tagain",), ("x",), ("",), (None,)], "t string")
    got = [(r["phrase"], r["n"]) for r in TX.common_phrases(df, "t", 2, 10, ["the"]).collect()]
    assert got == [("good work", 2), ("good good", 1), ("work again", 1)]
    pmi = TX.collocations(df, "t", at_least=2).first()
    assert pmi["phrase"] == "good work" and pmi["pmi"] == pytest.approx(math.log2(2 * 8 / (3 * 2)))


def test_rerun_leaves_done_keys_alone(spark, tmp_path):
    path = str(tmp_path / "out")
    work = lambda d: d.groupBy("k").agg(F.sum("v").alias("s")).select("s", "k")
    WR.rerun_missing(spark.createDataFrame([("a", 1)], "k string, v int"), path, "k", work)
    WR.rerun_missing(spark.createDataFrame([("a", 100), ("b", 2)], "k string, v int"), path, "k", work)
    assert sorted((r["k"], r["s"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2)]


def test_encodings_and_two_row_header(spark, tmp_path):
    for name, enc in (("u.csv", "utf-8"), ("l.csv", "latin-1"), ("w.csv", "utf-16")):
        (tmp_path / name).write_bytes("id,t\n1,é\n".encode(enc))
    assert [RD.text_encoding(spark, str(tmp_path / n)) for n in ("u.csv", "l.csv", "w.csv")] == ["UTF-8", "ISO-8859-1", "UTF-16"]
    (tmp_path / "h.csv").write_text("A,,B\nx,y,z\n")
    (tmp_path / "d.csv").write_text("1,2,3\n")
    df = RD.read_two_row_header(spark, str(tmp_path / "h.csv"), str(tmp_path / "d.csv"))
    assert df.columns == ["A | x", "A | y", "B | z"] and df.count() == 1


def test_payload_and_lookup(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"result": [{"id": 1,\n "m": {"a": "x"}}, {"id": 2, "m": null}]}')
    got = RD.read_payload(spark, str(tmp_path / "p.json"), "id: bigint, m: map<string,string>", multi_line=True).collect()
    assert [(r["id"], r["m"]) for r in got] == [(1, {"a": "x"}), (2, None)]
    (tmp_path / "l.json").write_text('{"a": "1", "b": "2"}')
    assert sorted(map(tuple, RD.read_lookup(spark, str(tmp_path / "l.json")).collect())) == [("a", "1"), ("b", "2")]
