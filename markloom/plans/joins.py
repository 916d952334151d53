"""Lookups, gaps, merges and pairs (J ids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom.operators import joins as JN
from markloom.operators import marks as M
from markloom.operators import similarity as SIM
from markloom.plans.base import Tables, query, r6
from markloom.plans.cleaning import ROLE_SQL, by_role, s

c, lit = F.col, F.lit


@query("J01_section_mapping", """
SELECT coalesce(section, '(unmapped)') AS section, sub, count(*) AS n
FROM ans LEFT JOIN (SELECT * FROM itm WHERE sub <> 'Brand#1') m USING (part_id) GROUP BY ALL
""")
def j01(t: Tables):
    """Answers are counted per item first, so a hot item is one row when it meets its section."""
    per_item = t.answers.groupBy("part_id").agg(F.count("*").alias("n"))
    mapping = t.items.filter("sub <> 'Brand#1'").select("part_id", "section", "sub")
    mapped = per_item.join(mapping, "part_id", "left")
    return mapped.groupBy(F.coalesce("section", lit("(unmapped)")).alias("section"), "sub").agg(F.sum("n").alias("n"))


@query("J01_unmapped_items", "SELECT part_id, count(*) AS n_rows FROM ans JOIN itm USING (part_id) WHERE sub = 'Brand#1' GROUP BY part_id")
def j01b(t: Tables):
    return JN.unmapped(t.answers, t.items.filter("sub <> 'Brand#1'"), "part_id")


@query("J02_question_weight", """
, a AS (SELECT part_id, count(*) FILTER (outcome = 'Yes') AS y FROM ans GROUP BY part_id)
SELECT part_id, item_name, weight, y * weight AS weighted_yes FROM a LEFT JOIN itm USING (part_id)
""")
def j02(t: Tables):
    per = M.outcome_counts(t.answers, ["part_id"])
    joined = JN.null_safe_left(per, t.items, ["part_id"])
    return joined.select("part_id", "item_name", "weight", (c("n_yes") * c("weight")).alias("weighted_yes"))


@query("J03_attach_marker_pair", """
, b AS (SELECT form_id, max(level) AS best FROM ans GROUP BY form_id),
p AS (SELECT form_id, min(marker) AS first_marker, max(marker) AS last_marker FROM ans GROUP BY form_id HAVING count(DISTINCT marker) = 2)
SELECT b.form_id, best, first_marker, last_marker FROM b LEFT JOIN p USING (form_id)
""")
def j03(t: Tables):
    best = t.answers.groupBy("form_id").agg(F.max("level").alias("best"))
    two = t.answers.select("form_id", "marker").distinct().groupBy("form_id").agg(
        F.count("*").alias("k"), F.min("marker").alias("first_marker"), F.max("marker").alias("last_marker")).filter("k = 2")
    return best.join(two.drop("k"), "form_id", "left")


@query("J04_two_code_merge", """
SELECT student_id, clinic, max(score) FILTER (setting = 'Simulation') AS score_Simulation, max(score) FILTER (setting = 'Clinic') AS score_Clinic,
  max(es) FILTER (setting = 'Simulation') AS es_Simulation, max(es) FILTER (setting = 'Clinic') AS es_Clinic
FROM (SELECT student_id, clinic, setting, checklist_score AS score, es FROM fs) GROUP BY ALL
""")
def j04(t: Tables):
    scored = t.form_scores.select("student_id", "clinic", "setting", c("checklist_score").alias("score"), "es")
    return JN.merge_sides(scored, ["student_id", "clinic"], "setting", ("Simulation", "Clinic"), ["score", "es"])


@query("J05_pivot_beside_totals", """
SELECT student_id, count(*) FILTER (setting = 'Simulation') AS simulation, count(*) FILTER (setting = 'Clinic') AS clinic, count(*) FILTER (incident = 'Yes') AS incidents FROM frm GROUP BY student_id
""")
def j05(t: Tables):
    return t.forms.groupBy("student_id").agg(
        F.count_if(c("setting") == "Simulation").alias("simulation"), F.count_if(c("setting") == "Clinic").alias("clinic"),
        F.count_if(c("incident") == "Yes").alias("incidents"))


@query("J06_lookup_by_id", """
, d AS (SELECT student_id, arg_min(clinic, form_id) AS first_clinic FROM frm GROUP BY student_id)
SELECT student_id, student_name, first_clinic FROM stu LEFT JOIN d USING (student_id)
""")
def j06(t: Tables):
    first = JN.one_per_key(t.forms.select("student_id", "form_id", c("clinic").alias("first_clinic")), ["student_id"], c("form_id"))
    return t.students.join(first.select("student_id", "first_clinic"), "student_id", "left").select("student_id", "student_name", "first_clinic")


@query("J07_fill_from_other_tables", """
SELECT form_id, CASE WHEN ps = 1 THEN 'own' WHEN setting = 'Clinic' AND cs > 2 THEN 'second' WHEN incident = 'Yes' THEN 'third' END AS note FROM frm
""")
def j07(t: Tables):
    own = t.forms.select("form_id", F.when(c("ps") == 1, "own").when(c("ps") == 2, "").alias("note"))
    second = t.forms.filter("setting = 'Clinic'").select("form_id", F.when(c("cs") > 2, "second").otherwise("").alias("note"))
    third = t.forms.filter("incident = 'Yes'").select("form_id", lit("third").alias("note"))
    return JN.fill_from(own, [second, third], "form_id", "note")


@query("J08_rows_of_listed_keys", "SELECT form_id FROM frm WHERE student_id IN (SELECT student_id FROM stu WHERE home = 3)")
def j08(t: Tables):
    return t.forms.join(t.students.filter("home = 3"), "student_id", "left_semi").select("form_id")


@query("J09_attendance_gap", """
, r AS (SELECT student_id FROM stu WHERE cohort <> 'BUILDING'), f AS (SELECT student_id FROM frm WHERE incident = 'Yes')
SELECT DISTINCT student_id, 'no form' AS gap FROM r WHERE student_id NOT IN (SELECT student_id FROM f)
UNION ALL SELECT DISTINCT student_id, 'not on roster' FROM f WHERE student_id NOT IN (SELECT student_id FROM r)
""")
def j09(t: Tables):
    return JN.membership_gap(t.students.filter("cohort <> 'BUILDING'"), t.forms.filter("incident = 'Yes'"), "student_id")


@query("J10_marker_pairs", """
, m AS (SELECT DISTINCT form_id, marker FROM ans)
SELECT l.marker AS a, r.marker AS b, count(*) AS n_pairs FROM m l JOIN m r ON l.form_id = r.form_id AND l.marker < r.marker GROUP BY ALL
""")
def j10(t: Tables):
    return JN.pair_counts(t.answers, "form_id", "marker")


PAIR_SQL = """
, e AS (SELECT label AS block, vec_id, CAST(vec_id % 11 AS DOUBLE) AS mark, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT a.block, list_cosine_similarity(a.v, b.v) AS sim, abs(a.mark - b.mark) AS gap FROM e a JOIN e b ON a.block = b.block AND a.vec_id < b.vec_id)
"""


def pair_table(t: Tables):
    e = t["embeddings"].select(c("label").alias("block"), "embedding", (c("vec_id") % 11).alias("mark"))
    return SIM.pair_summary(e, "block", "embedding", "mark")


@query("J11_all_pairs_summary", PAIR_SQL + """
SELECT block, count(*) AS n_pairs, round(avg(sim), 6) AS mean_similarity, round(avg(gap), 6) AS mean_mark_distance FROM p GROUP BY block
""")
def j11(t: Tables):
    return pair_table(t).select("block", "n_pairs", r6(c("mean_similarity")).alias("mean_similarity"),
                                r6(c("mean_mark_distance")).alias("mean_mark_distance"))


@query("J12_shared_students", """
, sm AS (SELECT student_id, marker, count(*) AS n, count(*) FILTER (outcome = 'Yes') AS y FROM mk GROUP BY ALL)
SELECT a.marker, CAST(sum(DISTINCT_N.own_n) AS BIGINT) AS own_n, CAST(sum(DISTINCT_N.own_y) AS BIGINT) AS own_yes, CAST(sum(other_n) AS BIGINT) AS others_n, CAST(sum(other_y) AS BIGINT) AS others_yes
FROM (SELECT l.marker, l.student_id, l.n AS own_n, l.y AS own_y, sum(r.n) AS other_n, sum(r.y) AS other_y
      FROM sm l JOIN sm r ON l.student_id = r.student_id AND l.marker <> r.marker GROUP BY ALL) AS DISTINCT_N, (SELECT DISTINCT marker FROM sm) a
WHERE a.marker = DISTINCT_N.marker GROUP BY a.marker
""")
def j12(t: Tables):
    """Others' sums are the student's total less one's own, so no marker meets another marker."""
    per_form = t.answers.groupBy("form_id", "marker").agg(F.count("*").alias("n"), F.count_if(c("outcome") == "Yes").alias("y"))
    own = per_form.join(t.forms.select("form_id", "student_id"), "form_id").groupBy("student_id", "marker").agg(
        F.sum("n").alias("n"), F.sum("y").alias("y"))
    total = own.groupBy("student_id").agg(F.sum("n").alias("tn"), F.sum("y").alias("ty"), F.count("*").alias("k")).filter("k > 1")
    return own.join(total, "student_id").groupBy("marker").agg(
        F.sum("n").alias("own_n"), F.sum("y").alias("own_yes"),
        F.sum(c("tn") - c("n")).alias("others_n"), F.sum(c("ty") - c("y")).alias("others_yes"))


@query("J13_matrix_lookup", """
, m AS (SELECT p_size AS importance, p_type AS difficulty, count(*) AS weight FROM part GROUP BY ALL)
SELECT part_id, weight FROM (SELECT p_partkey AS part_id, p_size, p_type FROM part) p JOIN m ON p_size = importance AND p_type = difficulty
""")
def j13(t: Tables):
    """The matrix has a row per importance and a column per difficulty."""
    kinds = ["ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE"]
    matrix = t["part"].groupBy(c("p_size").alias("importance")).pivot("p_type", kinds).count()
    long = JN.long_matrix(matrix, "importance", kinds, "difficulty", "weight")
    part = t["part"].select(c("p_partkey").alias("part_id"), c("p_size").alias("importance"), c("p_type").alias("difficulty"))
    return part.join(long, ["importance", "difficulty"]).select("part_id", "weight")


@query("J14_answers_by_prefix", "SELECT item, CAST(qno AS VARCHAR) AS q, raw AS answer, count(*) AS n FROM ans GROUP BY ALL")
def j14(t: Tables):
    from markloom.plans.cleaning import answer_map

    entries = answer_map(t).select("item", F.explode("m").alias("key", "answer"))
    parts = F.split("key", "_")
    own = entries.filter((F.get(parts, lit(0)) == "assessor") & (F.get(parts, lit(1)) == c("item")))
    return own.groupBy("item", F.regexp_extract("key", r"MC(\d+)", 1).alias("q"), "answer").agg(F.count("*").alias("n"))


@query("J15_frames_side_by_side", "SELECT form_id, n_yes, n_no, clinic, age1 FROM fs")
def j15(t: Tables):
    return t.form_counts.select("form_id", "n_yes", "n_no").join(t.forms.select("form_id", "clinic", "age1"), "form_id")


@query("J16_parameter_grid", """
SELECT cohort, weight, cutoff / 100e0 AS cutoff, n_students FROM (SELECT cohort, count(*) AS n_students FROM stu GROUP BY cohort),
  (SELECT unnest(range(1, 6)) AS weight), (SELECT unnest(range(30, 95, 5)) AS cutoff)
""")
def j16(t: Tables):
    per = t.students.groupBy("cohort").agg(F.count("*").alias("n_students"))
    grid = per.withColumn("weight", F.explode(F.sequence(lit(1), lit(5)).cast("array<bigint>"))).withColumn(
        "step", F.explode(F.sequence(lit(30), lit(90), lit(5))))
    return grid.select("cohort", "weight", (c("step") / lit(100.0)).alias("cutoff"), "n_students")


@query("J17_roster_zero_fill", """
SELECT student_id, count(form_id) AS n_forms, count(form_id) FILTER (setting = 'Clinic') AS n_clinic
FROM stu LEFT JOIN (SELECT * FROM frm WHERE incident = 'Yes') USING (student_id) GROUP BY student_id
""")
def j17(t: Tables):
    counts = t.forms.filter("incident = 'Yes'").groupBy("student_id").agg(
        F.count("*").alias("n_forms"), F.count_if(c("setting") == "Clinic").alias("n_clinic"))
    return JN.zero_filled(t.students.select("student_id"), counts, "student_id")


@query("J18_report_manifest", """
SELECT form_id, CASE WHEN form_id % 4 < 2 THEN student_id END AS matched FROM frm
""")
def j18(t: Tables):
    """Match by the id in parentheses, else by the lower-case name."""
    name = F.concat(lit("Customer#"), F.lpad(s(c("student_id")), 9, "0"))
    file = F.when(c("form_id") % 4 == 0, F.concat(lit("Report ("), s(c("student_id")), lit(").pdf"))).when(
        c("form_id") % 4 == 1, F.concat(F.upper(name), lit(".pdf"))).otherwise("loose.pdf")
    files = t.forms.select("form_id", file.alias("file"))
    by_id = F.nullif(F.regexp_extract("file", r"\((\d+)\)", 1), lit(""))
    key = F.coalesce(by_id, F.lower(F.regexp_replace("file", r"\.pdf$", "")))
    roster = t.students.select("student_id", F.lower("student_name").alias("name"))
    known = roster.select(s(c("student_id")).alias("key"), c("student_id").alias("matched")).unionByName(
        roster.select(c("name").alias("key"), c("student_id").alias("matched")))
    return files.withColumn("key", key).join(known, "key", "left").select("form_id", "matched")


@query("J19_question_reference", """
, q AS (SELECT item, qno, count(*) AS n FROM ans GROUP BY ALL), r AS (SELECT 'IT' || (part_id % 12) AS item, arg_min(section, part_id) AS section FROM itm GROUP BY ALL)
SELECT item, qno, n, section || ' question ' || qno AS full_text FROM q LEFT JOIN r USING (item)
""")
def j19(t: Tables):
    used = t.answers.groupBy("item", "qno").agg(F.count("*").alias("n"))
    questions = JN.one_per_key(t.items.select(F.concat(lit("IT"), s(c("part_id") % 12)).alias("item"), "section", "part_id"), ["item"], c("part_id"))
    return used.join(questions, "item", "left").select("item", "qno", "n", F.concat("section", lit(" question "), s(c("qno"))).alias("full_text"))


@query("J20_answers_beside", ROLE_SQL + "SELECT * FROM ro WHERE stu_answer IS NOT NULL OR sup_answer IS NOT NULL")
def j20(t: Tables):
    return by_role(t).filter(c("stu_answer").isNotNull() | c("sup_answer").isNotNull())


@query("J21_station_outcome", """
SELECT form_id, section, CASE WHEN y * 100 >= 50 * n THEN 'good ' || section ELSE 'weak ' || section END AS remark
FROM (SELECT form_id, section, count(*) FILTER (outcome = 'Yes') AS y, count(*) FILTER (outcome IN ('Yes', 'No')) AS n FROM ans JOIN itm USING (part_id) GROUP BY ALL)
""")
def j21(t: Tables):
    per = M.roll_up(t.part_counts.join(t.items, "part_id"), ["form_id", "section"])
    remarks = t.items.select("section").distinct().select(
        "section", F.concat(lit("good "), "section").alias("good"), F.concat(lit("weak "), "section").alias("weak"))
    passed = c("n_yes") * 100 >= (c("n_yes") + c("n_no")) * 50
    return per.join(remarks, "section", "left").select("form_id", "section", F.when(passed, c("good")).otherwise(c("weak")).alias("remark"))


@query("J22_longitudinal_record", """
, a AS (SELECT student_id, clinic, form_id, CASE WHEN checklist_score >= 0.5 THEN 'Pass' ELSE 'Fail' END AS result FROM fs)
SELECT student_id, clinic, arg_min(result, form_id) AS first_result, arg_max(result, form_id) AS final_result, count(*) AS n_attempts FROM a GROUP BY ALL
""")
def j22(t: Tables):
    done = t.form_scores.select("student_id", "clinic", "form_id", F.when(c("checklist_score") >= 0.5, "Pass").otherwise("Fail").alias("result"))
    return JN.final_attempt(done, ["student_id", "clinic"], "form_id", "result")
