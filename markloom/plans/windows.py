"""Window, order and set queries (W, T and U ids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom.functions import jsonmap as J
from markloom.operators import marks as M
from markloom.operators import ordering as ORD
from markloom.operators import similarity as SIM
from markloom.plans.base import Tables, query, r6
from markloom.plans.cleaning import s

c, lit = F.col, F.lit


@query("W01_highest_and_lowest", """
SELECT student_id, arg_max(form_id, (checklist_score, -form_id)) AS best_form, max(checklist_score) AS best_score,
       arg_min(form_id, (checklist_score, form_id)) AS worst_form, min(checklist_score) AS worst_score
FROM fs WHERE checklist_score IS NOT NULL GROUP BY student_id
""")
def w01(t: Tables):
    """Ties go to the smaller form; ``max_by`` keeps one row per student and map task."""
    scored = t.form_scores.filter(c("checklist_score").isNotNull())
    return scored.groupBy("student_id").agg(
        F.max_by("form_id", F.struct("checklist_score", (-c("form_id")).alias("k"))).alias("best_form"), F.max("checklist_score").alias("best_score"),
        F.min_by("form_id", F.struct("checklist_score", "form_id")).alias("worst_form"), F.min("checklist_score").alias("worst_score"))


@query("W02_fill_from_other_rows", """
, w AS (SELECT form_id, student_id, es,
   last_value(es IGNORE NULLS) OVER (PARTITION BY student_id ORDER BY form_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back,
   first_value(es IGNORE NULLS) OVER (PARTITION BY student_id ORDER BY form_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM frm)
SELECT form_id, student_id, coalesce(back, ahead) AS es_filled FROM w
""")
def w02(t: Tables):
    forms = t.forms.select("form_id", "student_id", "es")
    return ORD.fill_from_neighbours(forms, ["student_id"], "form_id", F.floor(c("form_id") / 1000), "es", "es_filled").drop("es")


@query("W03_any_yes_on_rows", "SELECT form_id, CASE WHEN max(CASE WHEN incident = 'Yes' THEN 1 ELSE 0 END) OVER (PARTITION BY student_id) = 1 THEN 'Yes' ELSE 'No' END AS any_incident FROM frm")
def w03(t: Tables):
    """The flag is aggregated and joined back: a hot student is never gathered in one task."""
    hit = t.forms.filter("incident = 'Yes'").select("student_id", lit("Yes").alias("hit")).distinct()
    return t.forms.join(hit, "student_id", "left").select("form_id", F.coalesce("hit", lit("No")).alias("any_incident"))


@query("W04_marker_disagreement", """
SELECT DISTINCT f.form_id, f.qno, (SELECT count(DISTINCT outcome) > 1 FROM ans a WHERE a.form_id = f.form_id AND a.qno = f.qno) AS disagree FROM ans f
""")
def w04(t: Tables):
    return t.answers.groupBy("form_id", "qno").agg(F.coalesce(F.min("outcome") < F.max("outcome"), lit(False)).alias("disagree"))


@query("W05_running_number", """
, w AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS rn,
          count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS n FROM events)
SELECT event_id, strftime(d, '%d/%m/%Y') || CASE WHEN n > 1 THEN ' (' || rn || ')' ELSE '' END AS label FROM w
""")
def w05(t: Tables):
    """The size of a day is counted apart and joined, so the numbering alone uses a window, in pieces."""
    e = t["events"].select("event_id", "user_id", F.to_date("ts").alias("d"))
    numbered = ORD.row_numbers(e, ["user_id", "d"], ["event_id"], F.floor(c("event_id") / 100_000), "rn")
    sizes = e.groupBy("user_id", "d").agg(F.count("*").alias("n"))
    suffix = F.when(c("n") > 1, F.concat(lit(" ("), s(c("rn")), lit(")"))).otherwise("")
    return numbered.join(sizes, ["user_id", "d"]).select("event_id", F.concat(F.date_format("d", "dd/MM/yyyy"), suffix).alias("label"))


@query("W06_points_on_one_spot", """
SELECT form_id, row_number() OVER (PARTITION BY form_date, checklist_score ORDER BY form_id) - 1 AS shift FROM fs WHERE checklist_score IS NOT NULL
""")
def w06(t: Tables):
    points = t.form_scores.filter(c("checklist_score").isNotNull()).select("form_id", "form_date", "checklist_score")
    rows = ORD.row_numbers(points, ["form_date", "checklist_score"], ["form_id"], F.floor(c("form_id") / 100_000), "rn")
    return rows.select("form_id", (c("rn") - 1).alias("shift"))


@query("W07_first_row_per_key", "SELECT student_id, min(form_id) AS form_id, arg_min(clinic, form_id) AS clinic FROM frm GROUP BY student_id")
def w07(t: Tables):
    return ORD.top_rows(t.forms.select("student_id", "form_id", "clinic"), ["student_id"], ["form_id"], 1).drop("rn")


@query("W08_blocks_of_twelve", """
, q AS (SELECT label AS section, vec_id, vec_id % 11 AS score FROM embeddings)
SELECT section, vec_id, (row_number() OVER (PARTITION BY section ORDER BY score DESC, vec_id) - 1) // 12 AS block FROM q
""")
def w08(t: Tables):
    return blocks_of_twelve(t).select("section", "vec_id", "block")


def blocks_of_twelve(t: Tables):
    q = t["embeddings"].select(c("label").alias("section"), "vec_id", (c("vec_id") % 11).alias("score"), "embedding")
    rows = ORD.row_numbers(q, ["section"], [F.desc("score"), "vec_id"],
                           F.struct((-c("score")).alias("a"), F.floor(c("vec_id") / 10_000).alias("b")), "rn")
    return rows.withColumn("block", F.floor((c("rn") - 1) / 12))


@query("W09_sequential_labels", "SELECT part_id, 'MC' || row_number() OVER (PARTITION BY section ORDER BY part_id) AS label FROM itm")
def w09(t: Tables):
    rows = ORD.row_numbers(t.items.select("part_id", "section"), ["section"], ["part_id"], F.floor(c("part_id") / 10_000), "rn")
    return rows.select("part_id", F.concat(lit("MC"), s(c("rn"))).alias("label"))


@query("W10_score_series", """
, sc AS (SELECT student_id, form_id, form_date, CASE WHEN form_id % 3 = 0 THEN n_yes WHEN form_id % 3 = 1 THEN n_no ELSE n_na END AS score FROM fs)
SELECT student_id, form_id, score, row_number() OVER (PARTITION BY student_id ORDER BY form_date, form_id) AS seq FROM sc
""")
def w10(t: Tables):
    """The wanted score, else the first fallback that is there."""
    k = c("form_id") % 3
    m = F.when(k == 0, F.create_map(lit("Total"), c("n_yes"), lit("Weighted"), c("n_no"))).when(
        k == 1, F.create_map(lit("Weighted"), c("n_no"), lit("Plain"), c("n_na"))).otherwise(F.create_map(lit("Plain"), c("n_na")))
    series = t.form_scores.select("student_id", "form_id", "form_date", J.first_score(m, "Total", ["Weighted", "Plain"]).alias("score"))
    return ORD.row_numbers(series, ["student_id"], ["form_date", "form_id"], c("form_date"), "seq").drop("form_date")


@query("W11_date_axis", """
, r AS (SELECT student_id, form_date, row_number() OVER (PARTITION BY student_id ORDER BY form_date, form_id) AS rn FROM frm)
SELECT student_id, strftime(form_date, '%Y-%m-%d') AS day, max(rn) AS place FROM r GROUP BY ALL
""")
def w11(t: Tables):
    rows = ORD.row_numbers(t.forms.select("student_id", "form_date", "form_id"), ["student_id"], ["form_date", "form_id"], c("form_date"), "rn")
    return rows.groupBy("student_id", s(c("form_date")).alias("day")).agg(F.max("rn").alias("place"))


@query("T01_multi_key_sort", "SELECT form_id, clinic, checklist_score FROM fs ORDER BY clinic, checklist_score DESC NULLS LAST, form_id")
def t01(t: Tables):
    return t.form_scores.select("form_id", "clinic", "checklist_score").orderBy("clinic", F.desc_nulls_last("checklist_score"), "form_id")


@query("T02_top_five_codes", "SELECT item, count(*) AS n FROM ans GROUP BY item ORDER BY n DESC, item LIMIT 5")
def t02(t: Tables):
    return t.answers.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(5)


@query("T03_top_questions", """
SELECT part_id, count(*) FILTER (outcome IN ('Yes', 'No')) AS total FROM ans GROUP BY part_id ORDER BY total DESC, part_id LIMIT 15
""")
def t03(t: Tables):
    per = M.outcome_counts(t.answers, ["part_id"]).select("part_id", (c("n_yes") + c("n_no")).alias("total"))
    return per.orderBy(F.desc("total"), "part_id").limit(15)


@query("T04_nearest_rows", """
, e AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT a.label, a.vec_id, b.vec_id AS neighbour, list_cosine_similarity(a.v, b.v) AS sim FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT label, vec_id, neighbour, round(sim, 6) AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, neighbour) AS rank FROM p) WHERE rank <= 6
""")
def t04(t: Tables):
    near = SIM.nearest(t["embeddings"], "label", "vec_id", "embedding", 6)
    return near.withColumn("similarity", r6(c("similarity"))).withColumn("rank", c("rank").cast("bigint"))


@query("T05_best_and_worst_question", """
, q AS (SELECT clinic, qno, count(*) FILTER (outcome = 'Yes') / (count(*) FILTER (outcome IN ('Yes', 'No')) + 0.0001e0) AS score FROM mk GROUP BY ALL)
SELECT clinic, arg_max(qno, (score, -qno)) AS best_question, arg_min(qno, (score, qno)) AS worst_question FROM q GROUP BY clinic
""")
def t05(t: Tables):
    per = M.roll_up(t.question_counts.join(t.forms.select("form_id", "clinic"), "form_id"), ["clinic", "qno"])
    score = (c("n_yes") / (c("n_yes") + c("n_no") + lit(0.0001))).alias("score")
    return per.withColumn("score", score).groupBy("clinic").agg(
        F.max_by("qno", F.struct("score", (-c("qno")).alias("k"))).alias("best_question"),
        F.min_by("qno", F.struct("score", "qno")).alias("worst_question"))


YEARS = list(range(1992, 2008))


@query("T06_columns_by_date", "SELECT item, " + ", ".join(f"count(*) FILTER (year(day) = {y}) AS y{y}" for y in YEARS) + """,
  count(*) FILTER (year(day) < 1992 OR year(day) > 2007 OR day IS NULL) AS other FROM ans GROUP BY item
""")
def t06(t: Tables):
    """A column for each year of the form's calendar, in the order of the dates in their names, and one for all other days."""
    names = sorted((f"y{y}" for y in reversed(YEARS)), key=lambda n: int(n[1:]))
    year = F.year("day")
    years = t.answers.withColumn("col", F.when(year.between(YEARS[0], YEARS[-1]), F.concat(lit("y"), s(year))).otherwise("other"))
    return years.groupBy("item").pivot("col", [*names, "other"]).count().fillna(0)


@query("T07_detail_without_total", "SELECT item, count(*) AS n FROM ans GROUP BY item ORDER BY item DESC")
def t07(t: Tables):
    """Totals are a grouping level, so leaving them out is a filter."""
    both = t.answers.rollup("item").agg(F.grouping("item").alias("g"), F.count("*").alias("n"))
    return both.filter("g = 0").drop("g").orderBy(F.desc("item"))


@query("U01_stacked_frames", """
SELECT student_id AS id, cohort AS label, CAST(NULL AS VARCHAR) AS section FROM stu UNION ALL SELECT part_id, NULL, section FROM itm
""")
def u01(t: Tables):
    a = t.students.select(c("student_id").alias("id"), c("cohort").alias("label"))
    b = t.items.select(c("part_id").alias("id"), "section")
    return a.unionByName(b, allowMissingColumns=True)


@query("U02_columns_into_one", "SELECT form_id, 'age1' AS source, age1 AS age FROM frm UNION ALL SELECT form_id, 'age2', age2 FROM frm")
def u02(t: Tables):
    return t.forms.unpivot("form_id", ["age1", "age2"], "source", "age")


@query("U03_distinct_values", "SELECT DISTINCT cohort FROM stu")
def u03(t: Tables):
    return t.students.select("cohort").distinct()


@query("U04_set_difference", "SELECT DISTINCT part_id FROM itm WHERE part_id NOT IN (SELECT part_id FROM ans WHERE outcome = 'Yes' AND level = 4 AND qno = 1)")
def u04(t: Tables):
    seen = t.answers.filter("outcome = 'Yes' AND level = 4 AND qno = 1").select("part_id").distinct()
    return t.items.select("part_id").distinct().join(seen, "part_id", "left_anti")


@query("U05_subtotals_stacked", """
SELECT clinic, coalesce(setting, 'All') AS setting, count(*) AS n FROM frm GROUP BY GROUPING SETS ((clinic, setting), (clinic))
""")
def u05(t: Tables):
    g = t.forms.groupingSets([["clinic", "setting"], ["clinic"]], "clinic", "setting").agg(F.grouping("setting").alias("g"), F.count("*").alias("n"))
    return g.select("clinic", F.when(c("g") == 1, "All").otherwise(c("setting")).alias("setting"), "n")
