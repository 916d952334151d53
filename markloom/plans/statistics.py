"""Statistics, text and models (M ids) and the user-function surface (Y ids)."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markloom import constants as K
from markloom.functions import scoring as S
from markloom.operators import models as MD
from markloom.operators import report as RP
from markloom.operators import reshape as R
from markloom.operators import similarity as SIM
from markloom.operators import solver as SV
from markloom.operators import stats as ST
from markloom.operators import textstats as TX
from markloom.plans.base import Tables, query, r6
from markloom.plans.joins import PAIR_SQL, pair_table
from markloom.plans.windows import blocks_of_twelve

c, lit = F.col, F.lit
STOP = ["the", "and", "of", "in", "to", "is", "for", "des", "les", "un", "la", "le"]
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"

ANOVA_SQL = """
, g AS (SELECT clinic AS grp, count(*) AS n, CAST(sum(cents) AS DOUBLE) AS s, sum(CAST(cents AS DOUBLE) * cents) AS ss FROM frm GROUP BY clinic),
a AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(s * s / n) - sum(s) * sum(s) / sum(n) AS ssb, sum(ss) - sum(s * s / n) AS ssw FROM g)
"""


@query("M01_anova_by_marker", """
, g AS (SELECT marker, count(*) AS n, CAST(sum(level) AS DOUBLE) AS s, CAST(sum(level * level) AS DOUBLE) AS ss FROM ans GROUP BY marker),
a AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(s * s / n) - sum(s) * sum(s) / sum(n) AS ssb, sum(ss) - sum(s * s / n) AS ssw FROM g)
SELECT k, n, round(ssb, 4) AS ss_between, round(ssw, 4) AS ss_within, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f FROM a
""")
def m01(t: Tables):
    a = ST.one_way_anova(t.answers, "marker", "level")
    return a.withColumns({"ss_between": F.round("ss_between", 4), "ss_within": F.round("ss_within", 4), "f": r6(c("f"))})


@query("M01_anova_p_value", ANOVA_SQL + """
, f AS (SELECT k, n, (ssb / (k - 1)) / (ssw / (n - k)) AS f, (n - k) / 2e0 AS h FROM a),
x AS (SELECT *, (n - k) / ((n - k) + (k - 1) * f) AS x FROM f)
SELECT k, n, round(f, 6) AS f, round(pow(x, h) * (1 + h * (1 - x)), 6) AS p FROM x
""")
def m01p(t: Tables):
    """Five clinics: with four degrees of freedom the tail has a closed form, used in the SQL."""
    a = ST.one_way_anova(t.forms.withColumn("y", c("cents").cast("double")), "clinic", "y")
    p = ST.f_p_value(c("f"), (c("k") - 1).cast("double"), (c("n") - c("k")).cast("double"))
    return a.select("k", "n", r6(c("f")).alias("f"), r6(p).alias("p"))


KRUSKAL_SQL = """
, r AS (SELECT clinic, rank() OVER (ORDER BY cents) + (count(*) OVER (PARTITION BY cents) - 1) / 2e0 AS r, cents FROM frm),
g AS (SELECT clinic, count(*) AS n, sum(r) AS s FROM r GROUP BY clinic),
tie AS (SELECT sum(CAST(n AS DOUBLE) * n * n - n) AS t FROM (SELECT count(*) AS n FROM frm GROUP BY cents)),
tot AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(s * s / n) AS q FROM g)
"""
H_SQL = "(12e0 / (CAST(n AS DOUBLE) * (n + 1)) * q - 3e0 * (n + 1)) / (1e0 - t / (CAST(n AS DOUBLE) * n * n - n))"


@query("M02_kruskal_wallis", KRUSKAL_SQL + f"SELECT k, n, round({H_SQL}, 5) AS h FROM tot, tie")
def m02(t: Tables):
    h = ST.kruskal(t.forms, "clinic", "cents", F.floor(c("cents") / 1_000_000))
    return h.withColumn("h", F.round("h", 5))


@query("M02_kruskal_p_value", KRUSKAL_SQL + f", h AS (SELECT k, n, {H_SQL} AS h FROM tot, tie) SELECT k, n, round(exp(-h / 2) * (1 + h / 2), 6) AS p FROM h")
def m02p(t: Tables):
    """Five clinics: with four degrees of freedom the tail has a closed form, used in the SQL."""
    h = ST.kruskal(t.forms, "clinic", "cents", F.floor(c("cents") / 1_000_000))
    return h.select("k", "n", r6(ST.chi2_p_value(c("h"), (c("k") - 1).cast("double"))).alias("p"))


@query("M03_tukey_pairs", ANOVA_SQL + """
SELECT x.grp AS group1, y.grp AS group2, round(y.s / y.n - x.s / x.n, 4) AS meandiff,
  round(abs((y.s / y.n - x.s / x.n) / sqrt(ssw / (a.n - a.k) / 2e0 * (1e0 / x.n + 1e0 / y.n))), 6) AS q FROM g x JOIN g y ON x.grp < y.grp, a
""")
def m03(t: Tables):
    return tukey(t).select("group1", "group2", F.round("meandiff", 4).alias("meandiff"), r6(c("q")).alias("q"))


def tukey(t: Tables):
    return ST.tukey_pairs(t.forms.withColumn("y", c("cents").cast("double")), "clinic", "y")


@query("M03_tukey_p_value")
def m03p(t: Tables):
    pairs = tukey(t).withColumn("p_adj", ST.range_p_value(c("q"), c("k").cast("double"), c("dof").cast("double")))
    return pairs.withColumn("reject", c("p_adj") < 0.05)


@query("M04_pearson_by_marker", """
SELECT marker, count(*) AS n, CASE WHEN count(*) > 1 THEN round(corr(level, cents), 6) END AS r FROM ans GROUP BY marker
""")
def m04(t: Tables):
    return pearson(t).select("marker", "n", r6(c("r")).alias("r"))


def pearson(t: Tables):
    return t.answers.groupBy("marker").agg(F.count("*").alias("n"), ST.safe_corr(c("level"), c("cents")).alias("r"))


@query("M04_pearson_p_value")
def m04p(t: Tables):
    dof = (c("n") - 2).cast("double")
    stat = c("r") * F.sqrt(F.try_divide(dof, lit(1.0) - c("r") * c("r")))
    return pearson(t).filter("n > 2").withColumn("p", ST.t_p_value(stat, dof))


@query("M05_t_test", """
, v AS (SELECT quality = 1 AS g, CAST(n_chars AS DOUBLE) AS x FROM documents JOIN labels USING (doc_id)),
m AS (SELECT count(*) FILTER (g) AS n_a, count(*) FILTER (NOT g) AS n_b, avg(x) FILTER (g) AS mean_a, avg(x) FILTER (NOT g) AS mean_b,
        var_samp(x) FILTER (g) AS va, var_samp(x) FILTER (NOT g) AS vb FROM v)
SELECT n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, n_a + n_b - 2 AS dof,
  round((mean_a - mean_b) / sqrt((va * (n_a - 1) + vb * (n_b - 1)) / (n_a + n_b - 2) * (1e0 / n_a + 1e0 / n_b)), 6) AS t FROM m
""")
def m05(t: Tables):
    both = t["documents"].select("doc_id", "n_chars").join(t["labels"], "doc_id")
    out = ST.t_test(both, c("quality") == 1, "n_chars")
    return out.withColumns({k: r6(c(k)) for k in ("mean_a", "mean_b", "t")})


@query("M06_type_two_anova")
def m06(t: Tables):
    """Marker, student and item, each given the two others."""
    rows = t.answers.select("form_id", "marker", "item", "level").join(t.forms.select("form_id", "student_id"), "form_id")
    return SV.type_two_anova(rows, ["marker", "student_id", "item"], "level")


@query("M06_two_factor_anova", """
, g AS (SELECT item, count(*) AS n, avg(level) AS my, avg((grader = 'supervisor')::INT) AS md FROM ans GROUP BY item),
d AS (SELECT sum((level - my) * ((grader = 'supervisor')::INT - md)) AS dy, sum(((grader = 'supervisor')::INT - md) ** 2) AS dd, sum((level - my) ** 2) AS within_item, count(*) AS n FROM ans JOIN g USING (item)),
w AS (SELECT sum((level - m) ** 2) AS within_grader FROM ans JOIN (SELECT grader, avg(level) AS m FROM ans GROUP BY grader) USING (grader)),
k AS (SELECT count(DISTINCT item) - 1 AS items FROM ans),
s AS (SELECT dy * dy / dd AS grader, within_item - dy * dy / dd AS rest, within_grader - (within_item - dy * dy / dd) AS item, n - 2 - items AS dof, items FROM d, w, k)
SELECT 'grader' AS factor, round(grader, 6) AS sum_sq, 1e0 AS df, round(grader / (rest / dof), 6) AS f FROM s
UNION ALL SELECT 'item', round(item, 6), items, round(item / items / (rest / dof), 6) FROM s
UNION ALL SELECT 'Residual', round(rest, 6), dof, NULL FROM s
""")
def m06b(t: Tables):
    out = SV.type_two_anova(t.answers, ["grader", "item"], "level")
    return out.select("factor", r6(c("sum_sq")).alias("sum_sq"), "df", r6(c("f")).alias("f"))


@query("M07_variance_shares", """
, u AS (SELECT 'marker' AS factor, CAST(marker AS VARCHAR) AS g, level FROM ans UNION ALL SELECT 'item', item, level FROM ans UNION ALL SELECT 'qno', CAST(qno AS VARCHAR), level FROM ans),
g AS (SELECT factor, g, count(*) AS n, CAST(sum(level) AS DOUBLE) AS s, CAST(sum(level * level) AS DOUBLE) AS ss FROM u GROUP BY ALL),
a AS (SELECT factor, count(*) AS n_levels, sum(n) AS n, sum(s * s / n) - sum(s) * sum(s) / sum(n) AS ssb, sum(ss) - sum(s * s / n) AS ssw FROM g GROUP BY factor)
SELECT factor, n_levels, round(ssb / (ssb + ssw), 8) AS share, round((ssb / (n_levels - 1)) / (ssw / (n - n_levels)), 6) AS f FROM a
""")
def m07(t: Tables):
    out = ST.variance_shares(t.answers, ["marker", "item", "qno"], "level")
    return out.withColumns({"share": F.round("share", 8), "f": r6(c("f"))})


FACTORS = ["marker", "student_id", "item"]
FORMS_SQL = ", m AS (SELECT *, level - avg(level) OVER () AS y FROM mk), n AS (SELECT count(*) AS n FROM m)\n" + "".join(
    f", c_{f} AS (SELECT {f}, count(*) AS n, sum(y) AS s FROM m GROUP BY {f})\n" for f in FACTORS) + ", q AS (\n" + "\nUNION ALL ".join(
    [f"SELECT '{f}' AS form, '{g}' AS of, (SELECT sum(p.n * p.n / c.n::DOUBLE) FROM (SELECT {', '.join(dict.fromkeys([f, g]))}, count(*) AS n FROM m GROUP BY ALL) p JOIN c_{f} c USING ({f})) AS coefficient, "
     f"(SELECT sum(s * s / n) FROM c_{f}) AS square" for f in FACTORS for g in FACTORS]
    + [f"SELECT '{f}', 'rows', (SELECT count(*) FROM c_{f})::DOUBLE, (SELECT sum(s * s / n) FROM c_{f})" for f in FACTORS]
    + [f"SELECT 'mean', '{f}', (SELECT sum(c.n * c.n) / (SELECT n FROM n)::DOUBLE FROM c_{f} c), 0" for f in FACTORS] + ["SELECT 'mean', 'rows', 1, 0"]
    + [f"SELECT 'rows', '{g}', (SELECT n FROM n), (SELECT sum(y * y) FROM m)" for g in [*FACTORS, "rows"]]) + ")\n"


def _determinant(cells: list[list[str]]) -> str:
    """A determinant written out in SQL."""
    terms = []
    for order in permutations(range(len(cells))):
        odd = sum(a > b for a, b in combinations(order, 2)) % 2
        terms.append(("-" if odd else "+") + " * ".join(cells[i][j] for i, j in enumerate(order)))
    return "(" + " ".join(terms) + ")"


def _components_sql() -> str:
    names = [*FACTORS, "rows"]
    picked = [f"max(coefficient) FILTER (form = '{f}' AND of = '{g}') AS k{i}{j}" for i, f in enumerate([*names, "mean"]) for j, g in enumerate(names)]
    picked += [f"max(square) FILTER (form = '{f}') AS s{i}" for i, f in enumerate(names)]
    rows = [[f"(k{i}{j} - k{len(names)}{j})" for j in range(len(names))] for i in range(len(names))]
    solved = [_determinant([[f"s{i}" if j == g else x for j, x in enumerate(r)] for i, r in enumerate(rows)]) for g in range(len(names))]
    shown = "\nUNION ALL ".join(f"SELECT '{n if n != 'rows' else 'Residual'}' AS component, {solved[j]} / {_determinant(rows)} AS variance FROM w" for j, n in enumerate(names))
    return FORMS_SQL + f", w AS (SELECT {', '.join(picked)} FROM q), v AS ({shown})\n" + (
        "SELECT component, round(variance, 6) AS variance, round(greatest(variance, 0) / sum(greatest(variance, 0)) OVER (), 6) AS share FROM v")


@query("M07_quadratic_forms", FORMS_SQL + "SELECT form, of, round(coefficient, 6) AS coefficient, round(square, 6) AS square FROM q")
def m07f(t: Tables):
    """What the variance components rest on."""
    rows = t.answers.select("form_id", "marker", "item", "level").join(t.forms.select("form_id", "student_id"), "form_id")
    return SV.quadratic_forms(rows, FACTORS, "level").withColumns({k: r6(c(k)) for k in ("coefficient", "square")})


@query("M07_variance_components", _components_sql())
def m07c(t: Tables):
    rows = t.answers.select("form_id", "marker", "item", "level").join(t.forms.select("form_id", "student_id"), "form_id")
    return SV.variance_components(rows, FACTORS, "level").withColumns({k: r6(c(k)) for k in ("variance", "share")})


@query("M08_item_importance")
def m08(t: Tables):
    """Questions as columns, one row per form with more than five answered questions."""
    value = F.when(c("outcome") == "Yes", 1.0).when(c("outcome") == "No", 0.0)
    wide = t.answers.groupBy("form_id").pivot("qno", list(range(1, 8))).agg(F.avg(value))
    wide = wide.toDF("form_id", *[f"MC{i}" for i in range(1, 8)])
    totals = t.form_counts.filter("n_yes + n_no > 5").select("form_id", S.percent_yes(c("n_yes"), c("n_no")).alias("pct"))
    return MD.forest_importance(wide.join(totals, "form_id"), "form_id", [f"MC{i}" for i in range(1, 8)], "pct")


@query("M09_straight_line", """
SELECT item, round(regr_slope(CAST(cents AS DOUBLE), CAST(level AS DOUBLE)), 4) AS slope, round(regr_intercept(CAST(cents AS DOUBLE), CAST(level AS DOUBLE)), 3) AS intercept FROM ans GROUP BY item
""")
def m09(t: Tables):
    y, x = c("cents").cast("double"), c("level").cast("double")
    return t.answers.groupBy("item").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"))


@query("M10_item_total_correlation", """
, q AS (SELECT form_id, qno, CAST(sum(level) AS BIGINT) AS part FROM ans GROUP BY ALL), w AS (SELECT form_id, CAST(sum(level) AS BIGINT) AS total FROM ans GROUP BY form_id)
SELECT qno, round(corr(part, total), 6) AS r, count(*) AS n FROM q JOIN w USING (form_id) GROUP BY qno
""")
def m10(t: Tables):
    part = t.answers.groupBy("form_id", "qno").agg(F.sum("level").alias("part"))
    total = part.groupBy("form_id").agg(F.sum("part").alias("total"))
    return part.join(total, "form_id").groupBy("qno").agg(r6(ST.safe_corr(c("part"), c("total"))).alias("r"), F.count("*").alias("n"))


@query("M10_item_total_by_marker", """
, q AS (SELECT marker, form_id, qno, CAST(sum(level) AS BIGINT) AS part FROM ans GROUP BY ALL), w AS (SELECT form_id, CAST(sum(level) AS BIGINT) AS total FROM ans GROUP BY form_id)
SELECT marker, qno, CASE WHEN count(*) > 1 AND min(part) < max(part) AND min(total) < max(total) THEN round(corr(part, total), 6) END AS r FROM q JOIN w USING (form_id) GROUP BY ALL
""")
def m10b(t: Tables):
    part = t.answers.groupBy("marker", "form_id", "qno").agg(F.sum("level").alias("part"))
    total = part.groupBy("form_id").agg(F.sum("part").alias("total"))
    return part.join(total, "form_id").groupBy("marker", "qno").agg(r6(ST.safe_corr(c("part"), c("total"))).alias("r"))


@query("M10_correlation_matrix", """
SELECT 'ps-cs' AS pair, round(corr(ps, cs), 6) AS r FROM frm UNION ALL SELECT 'ps-ts', round(corr(ps, ts), 6) FROM frm UNION ALL SELECT 'cs-ts', round(corr(cs, ts), 6) FROM frm
""")
def m10c(t: Tables):
    names = [("ps", "cs"), ("ps", "ts"), ("cs", "ts")]
    row = t.forms.agg(*[r6(ST.safe_corr(c(a), c(b))).alias(f"{a}-{b}") for a, b in names])
    return row.unpivot([], [f"{a}-{b}" for a, b in names], "pair", "r")


@query("M11_level_score_correlation", "SELECT clinic, round(corr(es, checklist_score), 6) AS r FROM fs WHERE es > 0 GROUP BY clinic")
def m11(t: Tables):
    return t.form_scores.filter("es > 0").groupBy("clinic").agg(r6(ST.safe_corr(c("es"), c("checklist_score"))).alias("r"))


@query("M12_predicted_grade", PAIR_SQL.replace("a.vec_id < b.vec_id", "a.vec_id <> b.vec_id").replace("SELECT a.block,", "SELECT a.vec_id, b.vec_id AS nb, b.mark AS nb_mark, a.mark AS own,") + """
SELECT vec_id, round(avg(nb_mark), 6) AS predicted, max(own) AS grade FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, nb) AS rn FROM p) WHERE rn <= 5 GROUP BY vec_id
""")
def m12(t: Tables):
    near = SIM.nearest(t["embeddings"], "label", "vec_id", "embedding", 5)
    grade = t["embeddings"].select("vec_id", (c("vec_id") % 11).cast("double").alias("grade"))
    told = near.join(grade.select(c("vec_id").alias("neighbour"), c("grade").alias("g")), "neighbour")
    return told.groupBy("vec_id").agg(r6(F.avg("g")).alias("predicted")).join(grade, "vec_id")


@query("M13_similarity_against_marks", PAIR_SQL + "SELECT block, count(*) AS n_pairs, round(corr(1 - sim, gap), 6) AS correlation FROM p GROUP BY block")
def m13(t: Tables):
    return pair_table(t).select("block", "n_pairs", r6(c("correlation")).alias("correlation"))


WORDS_SQL = r"""
, wd AS (SELECT doc_id, unnest(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')), ' '), lambda w: w <> '')) AS word FROM documents),
"""
LEXICON_SQL = "lx(word, polarity) AS (VALUES " + ", ".join(f"('{w}', CAST({p} AS DOUBLE))" for w, p in K.POLARITY_WORDS.items()) + ")"
POLARITY_SQL = WORDS_SQL + LEXICON_SQL + """
, pl AS (SELECT d.doc_id, coalesce(p, 0) AS polarity FROM documents d LEFT JOIN (SELECT doc_id, sum(polarity) / count(*) AS p FROM wd JOIN lx USING (word) GROUP BY doc_id) USING (doc_id))
"""


def lexicon(t: Tables):
    rows = ", ".join(f"('{w}', {p}D)" for w, p in K.POLARITY_WORDS.items())
    return t.spark.sql(f"SELECT * FROM VALUES {rows} AS l(word, polarity)")


def polarity(t: Tables):
    return TX.text_polarity(t["documents"], "doc_id", "text", lexicon(t))


@query("M14_mean_polarity_by_outcome", POLARITY_SQL + "SELECT CAST(quality AS BIGINT) AS quality, round(avg(polarity), 6) AS polarity, count(*) AS n FROM pl JOIN labels USING (doc_id) GROUP BY quality")
def m14(t: Tables):
    both = polarity(t).join(t["labels"], "doc_id")
    return both.groupBy(c("quality").cast("bigint").alias("quality")).agg(r6(F.avg("polarity")).alias("polarity"), F.count("*").alias("n"))


@query("M14_tone_adjusted_neighbours", POLARITY_SQL + """
, e AS (SELECT label, vec_id, polarity AS t, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings JOIN pl ON vec_id = doc_id),
p AS (SELECT a.vec_id, b.vec_id AS neighbour, least(1e0, greatest(0e0, list_cosine_similarity(a.v, b.v) + CASE WHEN a.t > 0 AND b.t > 0 THEN 0.5e0 * abs(a.t - b.t) ELSE 0e0 END)) AS sim FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT vec_id, round(avg(sim), 6) AS mean_similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, neighbour) AS rn FROM p) WHERE rn <= 3 GROUP BY vec_id
""")
def m14b(t: Tables):
    toned = t["embeddings"].join(polarity(t).select(c("doc_id").alias("vec_id"), "polarity"), "vec_id")
    near = SIM.nearest(toned, "label", "vec_id", "embedding", 3, tone="polarity", tone_weight=0.5)
    return near.groupBy("vec_id").agg(r6(F.avg("similarity")).alias("mean_similarity"))


@query("M15_tf_idf", r"""
, wd AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_][\p{L}\p{M}\p{N}_]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM wd GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, tf * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1e0)) + 1e0) AS w FROM tf JOIN df USING (term))
SELECT doc_id, count(*) AS n_terms, round(sum(w) / sqrt(sum(w * w)) / count(*), 6) AS mean_weight, round(max(w) / sqrt(sum(w * w)), 6) AS top_weight FROM w GROUP BY doc_id
""")
def m15(t: Tables):
    w = TX.tf_idf(t["documents"].select("doc_id", "text"), "doc_id", "text")
    return w.groupBy("doc_id").agg(F.count("*").alias("n_terms"), r6(F.avg("weight")).alias("mean_weight"), r6(F.max("weight")).alias("top_weight"))


@query("M16_clusters")
def m16(t: Tables):
    return MD.clusters(t["embeddings"], "vec_id", "embedding", 10)


@query("M17_elbow")
def m17(t: Tables):
    return MD.elbow(t["embeddings"], "embedding", list(range(1, 21)))


@query("M17_total_spread", """
, x AS (SELECT generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT round(sum(s), 5) AS cost FROM (SELECT sum(v * v) - sum(v) * sum(v) / count(*) AS s FROM x GROUP BY d)
""")
def m17b(t: Tables):
    return MD.total_spread(t["embeddings"], "embedding").select(F.round("cost", 5).alias("cost"))


@query("M18_topics")
def m18(t: Tables):
    return MD.topics(t["conversations"], "text", n_topics=10, n_words=10, stop_words=STOP)


@query("M19_common_phrases", WORDS_SQL.replace("SELECT doc_id, unnest(list_filter(", "SELECT doc_id, list_filter(").replace(", lambda w: w <> '')) AS word FROM documents),",
       f", lambda w: w <> '' AND w NOT IN {STOP_SQL}) AS l FROM documents),") + """
bg AS (SELECT l[i] || ' ' || l[i + 1] AS phrase FROM (SELECT l, unnest(range(1, len(l))) AS i FROM wd))
SELECT phrase, count(*) AS n FROM bg GROUP BY phrase ORDER BY n DESC, phrase LIMIT 10
""")
def m19(t: Tables):
    return TX.common_phrases(t["documents"], "text", 2, 10, STOP)


@query("M20_collocations", WORDS_SQL.replace("SELECT doc_id, unnest(list_filter(", "SELECT doc_id, list_filter(").replace(", lambda w: w <> '')) AS word FROM documents),",
       ", lambda w: w <> '') AS l FROM documents),") + """
bg AS (SELECT l[i] AS w1, l[i + 1] AS w2, count(*) AS n FROM (SELECT l, unnest(range(1, len(l))) AS i FROM wd) GROUP BY ALL HAVING count(*) >= 3),
ug AS (SELECT w, count(*) AS c FROM (SELECT unnest(l) AS w FROM wd) GROUP BY w), tot AS (SELECT CAST(sum(c) AS BIGINT) AS t FROM ug)
SELECT w1 || ' ' || w2 AS phrase, n, round(log2(CAST(n AS DOUBLE) * t / (CAST(a.c AS DOUBLE) * b.c)), 6) AS pmi
FROM bg JOIN ug a ON a.w = w1 JOIN ug b ON b.w = w2, tot ORDER BY log2(CAST(n AS DOUBLE) * t / (CAST(a.c AS DOUBLE) * b.c)) DESC, phrase LIMIT 10
""")
def m20(t: Tables):
    return TX.collocations(t["documents"], "text").withColumn("pmi", r6(c("pmi")))


@query("M21_dissimilar_questions")
def m21(t: Tables):
    return SIM.pick_dissimilar(blocks_of_twelve(t), ["section", "block"], "vec_id", "embedding", 4)


@query("M21_least_similar_pair", """
, q AS (SELECT label AS section, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
   (row_number() OVER (PARTITION BY label ORDER BY vec_id % 11 DESC, vec_id) - 1) // 12 AS block FROM embeddings),
b AS (SELECT section, block FROM q GROUP BY ALL HAVING count(*) > 4),
p AS (SELECT x.section, x.block, x.vec_id AS first_id, y.vec_id AS second_id, list_cosine_similarity(x.v, y.v) AS sim
      FROM q x JOIN q y ON x.section = y.section AND x.block = y.block AND x.vec_id < y.vec_id JOIN b ON b.section = x.section AND b.block = x.block)
SELECT section, block, arg_min(first_id, sim) AS first_id, arg_min(second_id, sim) AS second_id FROM p GROUP BY ALL
""")
def m21b(t: Tables):
    """The pair the greedy pick starts from, in blocks that leave a choice."""
    blocks = blocks_of_twelve(t)
    sizes = blocks.groupBy("section", "block").agg(F.count("*").alias("n")).filter("n > 4").select("section", "block")
    picked = SIM.pick_dissimilar(blocks, ["section", "block"], "vec_id", "embedding", 4).filter("pick <= 2")
    pair = picked.groupBy("section", "block").agg(F.min("vec_id").alias("first_id"), F.max("vec_id").alias("second_id"))
    return pair.join(sizes, ["section", "block"], "left_semi")


@query("M22_question_means", """
SELECT clinic, CAST(year(form_date) AS BIGINT) AS year, question, CAST(sum(mark) AS DOUBLE) / count(mark) AS mean_mark
FROM (SELECT clinic, form_date, unnest(['ps', 'cs', 'ts', 'es']) AS question, unnest([ps, cs, ts, es]) AS mark FROM frm) GROUP BY ALL
""")
def m22(t: Tables):
    long = t.forms.select("clinic", F.year("form_date").cast("bigint").alias("year"), "ps", "cs", "ts", "es").unpivot(
        ["clinic", "year"], ["ps", "cs", "ts", "es"], "question", "mark")
    return long.groupBy("clinic", "year", "question").agg(F.avg("mark").alias("mean_mark"))


@query("M23_weight_and_cutoff_search", """
, n AS (SELECT section || ' ' || sub AS section, count(*) FILTER (weight = 10) AS c, count(*) FILTER (weight BETWEEN 4 AND 9) AS m, count(*) FILTER (weight < 4) AS l FROM itm GROUP BY ALL),
gr AS (SELECT section, c, m, l, cw, mw, lw, cut FROM n, (SELECT unnest(range(1, 26)) AS cw), (SELECT unnest(range(1, 10)) AS mw), (SELECT unnest(range(1, 10)) AS lw), (SELECT unnest(range(30, 95)) AS cut) WHERE mw < cw AND lw < mw),
s AS (SELECT *, CAST(cw * c + mw * m + lw * l AS DOUBLE) AS total FROM gr)
SELECT section, cw AS critical_weight, mw AS moderate_weight, lw AS minor_weight, cut / 100e0 AS cutoff, cw * c / total AS all_critical_correct, (total - cw * c) / total AS all_critical_wrong, (total - cw) / total AS one_critical_wrong
FROM s WHERE c + m + l > 0 AND cw * c * 100 >= cut * total AND (c = 0 OR (total - cw) * 100 < cut * total)
""")
def m23(t: Tables):
    parts = t.items.withColumn("section", F.concat_ws(" ", "section", "sub"))
    return weight_search(parts, "section", "weight")


def weight_search(items, section: str, weight: str):
    """All weights and cutoffs with which one missed critical item fails and all critical items pass.

    Closed forms per grid point: no answer patterns are listed, and the cutoffs that hold (whole
    percents) are a range, so only those become rows.
    """
    w = c(weight)
    n = items.groupBy(section).agg(
        F.count_if(w == 10).alias("c"), F.count_if(w.between(4, 9)).alias("m"), F.count_if(w < 4).alias("l"))
    steps = lambda a, b: F.explode(F.sequence(lit(a), lit(b)).cast("array<bigint>"))
    g = n.withColumn("cw", steps(1, 25)).withColumn("mw", steps(1, 9)).filter("mw < cw").withColumn("lw", steps(1, 9)).filter("lw < mw")
    g = g.withColumn("total", c("cw") * c("c") + c("mw") * c("m") + c("lw") * c("l")).withColumn("right", c("cw") * c("c"))
    lowest = F.when(c("c") == 0, 30).otherwise(F.greatest(lit(30), F.expr("(total - cw) * 100 div total") + 1))
    highest = F.least(lit(94), F.expr("right * 100 div total"))
    g = g.withColumns({"lowest": lowest, "highest": highest}).filter("lowest <= highest")
    g = g.withColumn("cut", F.explode(F.sequence("lowest", "highest")))
    total = c("total").cast("double")
    return g.select(
        section, c("cw").alias("critical_weight"), c("mw").alias("moderate_weight"), c("lw").alias("minor_weight"),
        (c("cut") / lit(100.0)).alias("cutoff"), (c("right") / total).alias("all_critical_correct"),
        ((total - c("right")) / total).alias("all_critical_wrong"), ((total - c("cw")) / total).alias("one_critical_wrong"))


@query("M24_marker_distributions", """
SELECT marker, quantile_cont(level, 0.25) AS q1, quantile_cont(level, 0.5) AS median, quantile_cont(level, 0.75) AS q3, min(level) AS lowest, max(level) AS highest FROM ans GROUP BY marker
""")
def m24(t: Tables):
    """Exact quantiles keep one counter per distinct level."""
    q = lambda p: F.percentile("level", lit(p))
    return t.answers.groupBy("marker").agg(q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.min("level").alias("lowest"), F.max("level").alias("highest"))


@query("M24_marker_bins", "SELECT marker, floor(cents / 1000000e0) * 1000000e0 AS bin, count(*) AS n FROM ans GROUP BY ALL")
def m24b(t: Tables):
    return RP.histogram(t.answers, ["marker"], "cents", 1_000_000)


@query("M25_model_guard", """
SELECT form_id, n_yes, n_no FROM fc WHERE n_yes + n_no > 5 AND n_yes <> n_no
""")
def m25(t: Tables):
    """Forms with more than five answered questions whose answers vary."""
    return t.form_counts.filter((c("n_yes") + c("n_no") > 5) & (c("n_yes") != c("n_no"))).select("form_id", "n_yes", "n_no")


# ---------------------------------------------------------------- user functions


@query("Y01_scalar_function", "SELECT form_id, CASE WHEN cents % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM frm")
def y01(t: Tables):
    """A row function is an expression built by a Python function."""
    kind = lambda x: F.when(x % 2 == 0, "even").otherwise("odd")
    return t.forms.select("form_id", kind(c("cents")).alias("kind"))


@query("Y02_two_results_per_row", "SELECT form_id, greatest(ps, cs, ts) AS highest, least(ps, cs, ts) AS lowest FROM frm")
def y02(t: Tables):
    both = F.struct(F.greatest("ps", "cs", "ts").alias("highest"), F.least("ps", "cs", "ts").alias("lowest"))
    return t.forms.select("form_id", both.alias("r")).select("form_id", "r.*")


@query("Y03_element_wise", "SELECT form_id, ps * 10 AS ps, cs * 10 AS cs, ts * 10 AS ts FROM frm")
def y03(t: Tables):
    return t.forms.select("form_id", *[(c(x) * 10).alias(x) for x in ("ps", "cs", "ts")])


@query("Y04_user_aggregate", "SELECT clinic, CAST(max(cents) - min(cents) AS BIGINT) AS spread, count(*) FILTER (incident = 'Yes') AS hits FROM frm GROUP BY clinic")
def y04(t: Tables):
    spread = lambda x: F.max(x) - F.min(x)
    return t.forms.groupBy("clinic").agg(spread(c("cents")).alias("spread"), F.count_if(c("incident") == "Yes").alias("hits"))


@query("Y05_group_transform", "SELECT form_id, cents - max(cents) OVER (PARTITION BY clinic) AS below_best FROM frm")
def y05(t: Tables):
    best = t.forms.groupBy("clinic").agg(F.max("cents").alias("best"))
    return t.forms.join(best, "clinic").select("form_id", (c("cents") - c("best")).alias("below_best"))


@query("Y06_row_to_rows", "SELECT form_id, unnest(['first', 'second']) AS slot, unnest([age1, age2]) AS age FROM frm")
def y06(t: Tables):
    slots = F.array(F.struct(lit("first").alias("slot"), c("age1").alias("age")), F.struct(lit("second").alias("slot"), c("age2").alias("age")))
    return t.forms.select("form_id", F.inline(slots))


@query("Y07_group_to_rows", """
, q AS (SELECT label AS section, vec_id, vec_id % 11 AS score, (row_number() OVER (PARTITION BY label ORDER BY vec_id % 11 DESC, vec_id) - 1) // 12 AS block FROM embeddings)
SELECT section, block, vec_id, round(score - avg(score) OVER (PARTITION BY section, block), 6) AS above_mean FROM q
""")
def y07(t: Tables):
    """A Python function over one block of twelve rows at a time."""

    def above_mean(pdf):
        pdf["above_mean"] = (pdf["score"] - pdf["score"].mean()).round(6)
        return pdf[["section", "block", "vec_id", "above_mean"]]

    blocks = blocks_of_twelve(t).select("section", "block", "vec_id", "score")
    return blocks.groupBy("section", "block").applyInPandas(above_mean, "section int, block bigint, vec_id bigint, above_mean double")


@query("Y08_function_as_parameter", """
SELECT clinic, max(cents) FILTER (setting = 'Clinic') AS in_clinic, max(cents) FILTER (setting = 'Simulation') AS in_simulation FROM frm GROUP BY clinic
""")
def y08(t: Tables):
    def pivot_with(cell: Column):
        return R.pivot_cells(t.forms, ["clinic"], "setting", ["Clinic", "Simulation"], cell).toDF("clinic", "in_clinic", "in_simulation")

    return pivot_with(F.max("cents"))
