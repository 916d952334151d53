"""Counting, combining and pivoting (A01 to A37)."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom.functions import outcome as O
from markloom.functions import scoring as S
from markloom.operators import marks as M
from markloom.operators import ordering as ORD
from markloom.operators import reshape as R
from markloom.plans.base import Tables, query, r6
from markloom.plans.cleaning import s

c, lit = F.col, F.lit


@query("A01_value_counts", "SELECT coalesce(es, -1) AS es, count(*) AS n FROM frm GROUP BY ALL")
def a01(t: Tables):
    return t.forms.groupBy(F.coalesce("es", lit(-1)).alias("es")).agg(F.count("*").alias("n"))


@query("A02_counts_over_domain", """
SELECT event_type, hour, count(event_id) AS n FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(range(0, 25)) AS hour)
LEFT JOIN (SELECT event_id, event_type AS et, hour(ts) AS h FROM events) e ON et = event_type AND h = hour GROUP BY ALL
""")
def a02(t: Tables):
    """Counts over the hours 0 to 24 of a day, zeros shown."""
    e = t["events"]
    domain = e.select("event_type").distinct().withColumn("hour", F.explode(F.sequence(lit(0), lit(24)).cast("array<bigint>")))
    seen = e.groupBy("event_type", F.hour("ts").cast("bigint").alias("hour")).agg(F.count("*").alias("n"))
    return domain.join(seen, ["event_type", "hour"], "left").fillna(0, ["n"])


@query("A03_group_size", "SELECT item, qno, count(*) AS n FROM ans GROUP BY ALL")
def a03(t: Tables):
    return t.answers.groupBy("item", "qno").agg(F.count("*").alias("n"))


@query("A04_non_null_count", "SELECT student_id, count(es) AS n FROM frm GROUP BY student_id")
def a04(t: Tables):
    return t.forms.groupBy("student_id").agg(F.count("es").alias("n"))


@query("A05_days_attended", "SELECT student_id, count(DISTINCT form_date) AS n_days FROM frm GROUP BY student_id")
def a05(t: Tables):
    return t.forms.groupBy("student_id").agg(F.countDistinct("form_date").alias("n_days"))


@query("A06_marker_statistics", """
SELECT marker, CAST(sum(level) AS DOUBLE) / count(*) AS mean_level, count(*) AS n, min(level) AS lowest, max(level) AS highest FROM ans GROUP BY marker
""")
def a06(t: Tables):
    return t.answers.groupBy("marker").agg(F.avg("level").alias("mean_level"), F.count("*").alias("n"), F.min("level").alias("lowest"), F.max("level").alias("highest"))


@query("A07_marker_list_statistics", """
, m AS (SELECT 'M' || ps AS marker, cents FROM frm UNION ALL SELECT 'M' || (cs + 2), cents FROM frm)
SELECT marker, CAST(sum(cents) AS DOUBLE) / count(*) AS mean_cents, count(*) AS n FROM m GROUP BY marker
""")
def a07(t: Tables):
    names = F.concat(lit("M"), s(c("ps")), lit(" , M"), s(c("cs") + 2))
    each = t.forms.select("cents", F.explode(F.split(names, ",")).alias("marker")).withColumn("marker", F.trim("marker"))
    return each.groupBy("marker").agg((F.sum("cents").cast("double") / F.count("*")).alias("mean_cents"), F.count("*").alias("n"))


@query("A08_mean_and_deviation", """
SELECT coalesce(CAST(marker AS VARCHAR), 'overall') AS marker, round(avg(level), 6) AS mean, round(stddev_samp(level), 6) AS std, count(*) AS n
FROM ans GROUP BY GROUPING SETS ((marker), ())
""")
def a08(t: Tables):
    g = t.answers.rollup("marker").agg(F.avg("level").alias("mean"), F.stddev_samp("level").alias("std"), F.count("*").alias("n"))
    return g.select(F.coalesce(s(c("marker")), lit("overall")).alias("marker"), r6(c("mean")).alias("mean"), r6(c("std")).alias("std"), "n")


@query("A09_best_of", """
, b AS (SELECT student_id, form_date, qno, CASE WHEN count(*) FILTER (outcome = 'Yes') > 0 THEN 'Yes' WHEN count(*) FILTER (outcome = 'No') > 0 THEN 'No'
           WHEN count(outcome) > 0 THEN 'NA' END AS outcome FROM mk GROUP BY ALL),
q AS (SELECT student_id, form_date, count(*) FILTER (outcome = 'Yes') AS n_yes, count(*) FILTER (outcome = 'No') AS n_no, count(*) FILTER (outcome = 'NA') AS n_na FROM b GROUP BY ALL),
f AS (SELECT student_id, form_date, max(ps) AS ps, max(cs) AS cs, max(ts) AS ts, max(es) AS es,
        CASE WHEN count(*) FILTER (incident = 'Yes') > 0 THEN 'Yes' ELSE 'No' END AS incident, count(*) AS n_forms, arg_min(clinic, form_id) AS clinic FROM frm GROUP BY ALL)
SELECT student_id, strftime(form_date, '%Y-%m-%d') AS day, n_yes, n_no, n_na, ps, cs, ts, es, incident, n_forms, clinic FROM f JOIN q USING (student_id, form_date)
""")
def a09(t: Tables):
    best = M.best_of(t.question_counts, t.forms, "form_id", "student_id", "form_date", ["qno"])
    marks = M.outcome_counts(best, ["student_id", "form_date"]).drop("n_blank")
    rest = M.best_of_forms(t.forms, "student_id", "form_date", ["ps", "cs", "ts", "es"], ["incident"])
    first = t.forms.groupBy("student_id", "form_date").agg(F.min_by("clinic", "form_id").alias("clinic"))
    out = rest.join(first, ["student_id", "form_date"]).join(marks, ["student_id", "form_date"])
    return out.withColumn("day", s(c("form_date"))).drop("form_date")


@query("A10_outcome_merge", """
SELECT form_id, qno, CASE WHEN count(*) FILTER (outcome = 'Yes') > 0 THEN 'Yes' WHEN count(*) FILTER (outcome = 'No') > 0 THEN 'No'
  WHEN count(DISTINCT outcome) = 1 THEN max(outcome) END AS outcome FROM ans GROUP BY ALL
""")
def a10(t: Tables):
    return t.answers.groupBy("form_id", "qno").agg(O.merged(c("outcome")).alias("outcome"))


@query("A11_any_yes", "SELECT student_id, CASE WHEN bool_or(incident = 'Yes') THEN 'Yes' ELSE 'No' END AS any_incident FROM frm GROUP BY student_id")
def a11(t: Tables):
    return t.forms.groupBy("student_id").agg(O.any_yes(c("incident")).alias("any_incident"))


@query("A12_ordered_join", """
, r AS (SELECT student_id, trim(CASE WHEN ps = 1 THEN ' ' ELSE clinic || ' ' || form_id END) AS x, form_id FROM frm)
SELECT student_id, trim(string_agg(x, ', ' ORDER BY form_id), ', ') AS notes FROM r GROUP BY student_id
""")
def a12(t: Tables):
    text = F.trim(F.when(c("ps") == 1, " ").otherwise(F.concat_ws(" ", "clinic", "form_id")))
    notes = t.forms.select("student_id", "form_id", text.alias("x"))
    return ORD.joined_text(notes, ["student_id"], ["form_id"], F.floor(c("form_id") / 10_000), "x", ", ", "notes", strip=", ")


@query("A13_sorted_distinct_join", "SELECT student_id, CAST(0 AS BIGINT) AS segment, string_agg(DISTINCT clinic, ', ' ORDER BY clinic) AS clinics FROM frm GROUP BY student_id")
def a13(t: Tables):
    clinics = ORD.joined_distinct(t.forms, ["student_id"], "clinic", ", ", "clinics")
    return clinics.select("student_id", lit(0).cast("bigint").alias("segment"), "clinics")


@query("A14_list_concatenation", """
, r AS (SELECT student_id, clinic, form_id, unnest(['IT' || (form_id % 12), 'LA']) AS item, unnest([0, 1]) AS pos FROM frm)
SELECT student_id, clinic, row_number() OVER (PARTITION BY student_id, clinic ORDER BY form_id, pos) AS place, item FROM r
""")
def a14(t: Tables):
    lists = t.forms.select("student_id", "clinic", "form_id", F.array(F.concat(lit("IT"), s(c("form_id") % 12)), lit("LA")).alias("l"))
    rows = lists.select("student_id", "clinic", "form_id", F.posexplode("l").alias("pos", "x"))
    return ORD.ordered_texts(rows, ["student_id", "clinic"], ["form_id", "pos"], F.floor(c("form_id") / 10_000), "x", "item")


@query("A15_list_element_counts", """
SELECT student_id, x AS item, count(*) AS n FROM (SELECT student_id, unnest(['IT' || (form_id % 12), 'IT' || (cents % 12)]) AS x FROM frm) GROUP BY ALL
""")
def a15(t: Tables):
    lists = F.array(F.concat(lit("IT"), s(c("form_id") % 12)), F.concat(lit("IT"), s(c("cents") % 12)))
    return t.forms.select("student_id", F.explode(lists).alias("item")).groupBy("student_id", "item").agg(F.count("*").alias("n"))


@query("A16_multi_choice_counts", """
SELECT trim(x) AS choice, count(*) AS n FROM (SELECT unnest(string_split(role, ',')) AS x FROM frm UNION ALL SELECT unnest(string_split('Operator,' || clinic, ',')) FROM frm) GROUP BY ALL
""")
def a16(t: Tables):
    two = t.forms.select("role", F.concat(lit("Operator,"), "clinic").alias("other"))
    each = two.unpivot([], ["role", "other"], "source", "value").select(F.explode(F.split("value", ",")).alias("choice"))
    return each.groupBy(F.trim("choice").alias("choice")).agg(F.count("*").alias("n"))


@query("A17_merged_score_maps", """
SELECT student_id, coalesce(item, 'Total') AS item, count(*) FILTER (outcome = 'Yes') AS n_yes, count(*) FILTER (outcome = 'No') AS n_no, count(*) FILTER (outcome = 'NA') AS n_na,
  count(*) FILTER (outcome = 'Yes') * 100e0 / nullif(count(*) FILTER (outcome IN ('Yes', 'No')), 0) AS pct_yes
FROM mk GROUP BY GROUPING SETS ((student_id, item), (student_id))
""")
def a17(t: Tables):
    """Counted per form and item before the join; the total row is the outer grouping level."""
    per = M.outcome_counts(t.answers, ["form_id", "item"]).join(t.forms.select("form_id", "student_id"), "form_id")
    g = per.groupingSets([["student_id", "item"], ["student_id"]], "student_id", "item").agg(F.grouping("item").alias("g"), *O.sum_counts())
    return g.select("student_id", F.when(c("g") == 1, "Total").otherwise(c("item")).alias("item"), "n_yes", "n_no", "n_na",
                    S.percent_yes(c("n_yes"), c("n_no")).alias("pct_yes"))


SECTION_SQL = """
, sec AS (SELECT student_id, section, coalesce(sub, 'All') AS sub, count(*) FILTER (outcome = 'Yes') AS n_yes, count(*) FILTER (outcome = 'No') AS n_no, count(*) FILTER (outcome = 'NA') AS n_na
  FROM mk JOIN itm USING (part_id) GROUP BY GROUPING SETS ((student_id, section, sub), (student_id, section)))
"""


@query("A18_section_subtotals", SECTION_SQL + """
SELECT *, n_yes * 100e0 / nullif(n_yes + n_no, 0) AS pct_yes,
  CASE WHEN n_yes + n_no > 0 THEN CASE WHEN n_yes * 100e0 / (n_yes + n_no) < 80 THEN 'Yes' ELSE 'No' END END AS below_threshold FROM sec
""")
def a18(t: Tables):
    per = t.part_counts.join(t.items.select("part_id", "section", "sub"), "part_id").join(t.forms.select("form_id", "student_id"), "form_id")
    return M.section_table(per, "student_id", "section", "sub")


@query("A19_total_row", """
SELECT coalesce(item, 'Column Total') AS item, count(*) FILTER (outcome = 'Yes') AS n_yes, count(*) FILTER (outcome = 'No') AS n_no FROM ans GROUP BY ROLLUP (item)
""")
def a19(t: Tables):
    counts = M.outcome_counts(t.answers, ["item"])
    return R.column_totals(counts, ["item"], [F.sum("n_yes").alias("n_yes"), F.sum("n_no").alias("n_no")], "Column Total")


@query("A20_modal_value", """
, n AS (SELECT student_id, clinic, count(*) AS n FROM frm GROUP BY ALL)
SELECT student_id, first(clinic ORDER BY n DESC, clinic) AS modal_clinic, max(n) AS n FROM n GROUP BY student_id
""")
def a20(t: Tables):
    counts = t.forms.groupBy("student_id", "clinic").agg(F.count("*").alias("n"))
    return counts.groupBy("student_id").agg(F.min_by("clinic", F.struct((-c("n")).alias("a"), "clinic")).alias("modal_clinic"), F.max("n").alias("n"))


@query("A21_form_outcome_counts", "SELECT * FROM fc")
def a21(t: Tables):
    return t.form_counts


@query("A22_item_outcome_counts", """
SELECT item, qno, count(*) FILTER (outcome = 'Yes') AS n_yes, count(*) FILTER (outcome = 'No') AS n_no, count(*) FILTER (outcome = 'NA') AS n_na, count(*) FILTER (outcome IS NULL) AS n_blank FROM ans GROUP BY ALL
""")
def a22(t: Tables):
    return M.outcome_counts(t.answers, ["item", "qno"])


@query("A23_student_outcome_counts", """
SELECT student_id, count(*) FILTER (outcome = 'Yes') AS n_yes, count(*) FILTER (outcome = 'No') AS n_no, count(*) FILTER (outcome = 'NA') AS n_na, count(*) FILTER (outcome IS NULL) AS n_blank FROM mk GROUP BY ALL
""")
def a23(t: Tables):
    return M.roll_up(t.form_counts.join(t.forms.select("form_id", "student_id"), "form_id"), ["student_id"])


@query("A24_student_and_supervisor", """
, r AS (SELECT form_id, count(*) FILTER (outcome = 'Yes' AND grader = 'student') AS stu_yes, count(*) FILTER (outcome = 'No' AND grader = 'student') AS stu_no,
   count(*) FILTER (outcome = 'Yes' AND grader = 'supervisor') AS sup_yes, count(*) FILTER (outcome = 'No' AND grader = 'supervisor') AS sup_no FROM ans GROUP BY form_id)
SELECT *, stu_yes / (stu_yes + stu_no + 0.0001e0) AS stu_score, sup_yes / (sup_yes + sup_no + 0.0001e0) AS sup_score,
  stu_yes / (stu_yes + stu_no + 0.0001e0) - sup_yes / (sup_yes + sup_no + 0.0001e0) AS difference FROM r
""")
def a24(t: Tables):
    return role_scores(t)


def role_scores(t: Tables):
    cells = [F.count_if((c("outcome") == o) & (c("grader") == g)).alias(f"{p}_{o.lower()}")
             for p, g in (("stu", "student"), ("sup", "supervisor")) for o in ("Yes", "No")]
    r = t.answers.groupBy("form_id").agg(*cells)
    stu, sup = S.ratio_with_epsilon(c("stu_yes"), c("stu_no")), S.ratio_with_epsilon(c("sup_yes"), c("sup_no"))
    return r.withColumns({"stu_score": stu, "sup_score": sup, "difference": stu - sup})


@query("A25_contingency", """
SELECT quality, count(*) FILTER (toxic = 0) AS toxic_0, count(*) FILTER (toxic = 1) AS toxic_1 FROM labels GROUP BY quality
""")
def a25(t: Tables):
    return R.counts_by_value(t["labels"], ["quality"], "toxic", [0, 1], ["toxic_0", "toxic_1"])


@query("A26_level_counts", """
SELECT student_id, count(*) FILTER (es = 1) AS level_1, count(*) FILTER (es = 2) AS level_2, count(*) FILTER (es = 3) AS level_3, count(*) FILTER (es = 4) AS level_4
FROM frm GROUP BY student_id HAVING count(*) FILTER (es IN (1, 2, 3, 4)) > 0
""")
def a26(t: Tables):
    names = [f"level_{i}" for i in (1, 2, 3, 4)]
    wide = R.counts_by_value(t.forms, ["student_id"], "es", [1, 2, 3, 4], names)
    return wide.filter(c("level_1") + c("level_2") + c("level_3") + c("level_4") > 0)


@query("A27_pivot", """
SELECT student_id, max(cents) FILTER (setting = 'Clinic') AS Clinic_max, CAST(sum(cents) FILTER (setting = 'Clinic') AS DOUBLE) / count(*) FILTER (setting = 'Clinic') AS Clinic_mean, count(*) FILTER (setting = 'Clinic') AS Clinic_n,
  max(cents) FILTER (setting = 'Simulation') AS Simulation_max, CAST(sum(cents) FILTER (setting = 'Simulation') AS DOUBLE) / nullif(count(*) FILTER (setting = 'Simulation'), 0) AS Simulation_mean, count(*) FILTER (setting = 'Simulation') AS Simulation_n
FROM frm GROUP BY student_id
""")
def a27(t: Tables):
    wide = t.forms.groupBy("student_id").pivot("setting", ["Clinic", "Simulation"]).agg(
        F.max("cents").alias("max"), (F.sum("cents").cast("double") / F.count("cents")).alias("mean"), F.count("cents").alias("n"))
    return wide.fillna(0, ["Clinic_n", "Simulation_n"])


@query("A28_pivot_joined_text", """
, r AS (SELECT student_id, setting, form_id, role || ' ' || form_id AS x FROM frm),
j AS (SELECT student_id, setting, string_agg(x, '; ' ORDER BY form_id) AS x FROM r GROUP BY ALL)
SELECT student_id, coalesce(max(x) FILTER (setting = 'Clinic'), 'Not completed') AS Clinic, coalesce(max(x) FILTER (setting = 'Simulation'), 'Not completed') AS Simulation FROM j GROUP BY student_id
""")
def a28(t: Tables):
    rows = t.forms.select("student_id", "setting", "form_id", F.concat_ws(" ", "role", "form_id").alias("x"))
    joined = ORD.joined_text(rows, ["student_id", "setting"], ["form_id"], F.floor(c("form_id") / 10_000), "x", "; ", "x")
    return R.pivot_cells(joined, ["student_id"], "setting", ["Clinic", "Simulation"], F.max("x")).fillna("Not completed")


#: Line numbers of the given orders.
QUESTIONS = [1, 2, 3, 4, 5, 6, 7]


@query("A29_unique_pivot", """
, b AS (SELECT form_id, qno, max(level) AS level FROM ans GROUP BY ALL)
SELECT form_id, """ + ", ".join(f"max(level) FILTER (qno = {q}) AS q{q}" for q in QUESTIONS) + """ FROM b GROUP BY form_id
""")
def a29(t: Tables):
    """A column for each question that a form can have; one aggregation, so a task holds its forms once."""
    return t.answers.groupBy("form_id").agg(*[F.max(F.when(c("qno") == q, c("level"))).alias(f"q{q}") for q in QUESTIONS])


@query("A29_repeated_cells", "SELECT form_id, qno, count(*) AS n_rows FROM ans GROUP BY ALL HAVING count(*) > 1")
def a29b(t: Tables):
    """What a strict pivot must refuse."""
    return R.repeated_cells(t.answers, ["form_id", "qno"])


@query("A30_wide_to_long", """
SELECT form_id, CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS position, unnest(['ps', 'cs', 'ts', 'es']) AS header, CAST(unnest([ps, cs, ts, es]) AS VARCHAR) AS value FROM frm
""")
def a30(t: Tables):
    return R.wide_to_long(t.forms, ["form_id"], ["ps", "cs", "ts", "es"])


@query("A31_marker_question_mean", "SELECT marker, qno, CAST(sum(level) AS DOUBLE) / count(*) AS mean_level FROM ans GROUP BY ALL")
def a31(t: Tables):
    return t.answers.groupBy("marker", "qno").agg(F.avg("level").alias("mean_level"))


@query("A32_marker_leniency", """
SELECT marker, count(*) FILTER (outcome = 'Yes') AS n_yes, count(*) FILTER (outcome = 'No') AS n_no, count(*) FILTER (outcome = 'NA') AS n_na, count(*) AS n_answers,
  count(*) FILTER (outcome = 'Yes') / CAST(nullif(count(*) FILTER (outcome IN ('Yes', 'No')), 0) AS DOUBLE) AS leniency,
  count(*) FILTER (level = 1) AS level_1, count(*) FILTER (level = 2) AS level_2, count(*) FILTER (level = 3) AS level_3, count(*) FILTER (level = 4) AS level_4 FROM ans GROUP BY marker
""")
def a32(t: Tables):
    levels = [F.count_if(c("level") == i).alias(f"level_{i}") for i in (1, 2, 3, 4)]
    g = t.answers.groupBy("marker").agg(*O.counts(c("outcome")), F.count("*").alias("n_answers"), *levels).drop("n_blank")
    return g.withColumn("leniency", F.try_divide(c("n_yes").cast("double"), (c("n_yes") + c("n_no")).cast("double")))


@query("A33_first_minus_second", """
, r AS (SELECT student_id, cents, row_number() OVER (PARTITION BY student_id ORDER BY form_date, form_id) AS rn FROM frm)
SELECT student_id, max(cents) FILTER (rn = 1) - max(cents) FILTER (rn = 2) AS difference FROM r WHERE rn <= 2 GROUP BY student_id HAVING count(*) = 2
""")
def a33(t: Tables):
    two = ORD.top_rows(t.forms.select("student_id", "form_date", "form_id", "cents"), ["student_id"], ["form_date", "form_id"], 2)
    cell = lambda i: F.max(F.when(c("rn") == i, c("cents")))
    return two.groupBy("student_id").agg((cell(1) - cell(2)).alias("difference")).filter("difference is not null")


@query("A34_marker_pair_difference", """
, m AS (SELECT form_id, marker, count(*) FILTER (outcome = 'Yes') AS checklist, CAST(sum(level) AS BIGINT) AS rubric, checklist + rubric AS total FROM ans GROUP BY ALL)
SELECT form_id, min(marker) AS marker_1, max(marker) AS marker_2, arg_min(checklist, marker) - arg_max(checklist, marker) AS checklist_diff, arg_min(rubric, marker) - arg_max(rubric, marker) AS rubric_diff,
  min_by(total, marker) - max_by(total, marker) AS total_diff
FROM m GROUP BY form_id HAVING count(*) = 2
""")
def a34(t: Tables):
    per = t.answers.groupBy("form_id", "marker").agg(F.count_if(c("outcome") == "Yes").alias("checklist"), F.sum("level").alias("rubric"))
    per = per.withColumn("total", c("checklist") + c("rubric"))
    two = M.two_markings(per, "form_id", "marker", ["marker", "checklist", "rubric", "total"])
    return two.select("form_id", "marker_1", "marker_2", "checklist_diff", "rubric_diff", "total_diff")


@query("A35_answer_flips", """
, k AS (SELECT form_id, min(marker) AS m1, max(marker) AS m2 FROM ans GROUP BY form_id HAVING count(DISTINCT marker) = 2),
q AS (SELECT k.form_id, qno, CASE WHEN count(*) FILTER (marker = m1 AND outcome = 'Yes') > 0 THEN 'Yes' WHEN count(*) FILTER (marker = m1 AND outcome = 'No') > 0 THEN 'No' END AS a,
   CASE WHEN count(*) FILTER (marker = m2 AND outcome = 'Yes') > 0 THEN 'Yes' WHEN count(*) FILTER (marker = m2 AND outcome = 'No') > 0 THEN 'No' END AS b FROM ans JOIN k USING (form_id) GROUP BY ALL)
SELECT form_id, count(*) FILTER (a = 'Yes' AND b = 'No') AS yes_to_no, count(*) FILTER (a = 'No' AND b = 'Yes') AS no_to_yes,
  count(*) FILTER (a = 'Yes' AND b = 'No') - count(*) FILTER (a = 'No' AND b = 'Yes') AS first_more_by FROM q GROUP BY form_id
""")
def a35(t: Tables):
    """Both markers of a form on one line per question by conditional counts; no self join."""
    per = M.outcome_counts(t.answers, ["form_id", "qno", "marker"])
    ends = per.groupBy("form_id").agg(F.min("marker").alias("m1"), F.max("marker").alias("m2"), F.countDistinct("marker").alias("k")).filter("k = 2")
    both = per.join(ends, "form_id")
    said = lambda m: O.merged_from_counts(
        *[F.sum(F.when(c("marker") == c(m), c(x)).otherwise(0)) for x in ("n_yes", "n_no")], lit(0))
    q = both.groupBy("form_id", "qno").agg(said("m1").alias("a"), said("m2").alias("b"))
    down, up = (c("a") == "Yes") & (c("b") == "No"), (c("a") == "No") & (c("b") == "Yes")
    return q.groupBy("form_id").agg(F.count_if(down).alias("yes_to_no"), F.count_if(up).alias("no_to_yes"),
                                    (F.count_if(down) - F.count_if(up)).alias("first_more_by"))


@query("A36_average_and_maxima", """
, f AS (SELECT student_id, form_id, CAST(sum(level) AS BIGINT) AS total FROM mk GROUP BY ALL),
q AS (SELECT student_id, qno, max(level) AS best FROM mk GROUP BY ALL)
SELECT student_id, mean_total, max_total, total_of_maxima FROM (SELECT student_id, CAST(sum(total) AS DOUBLE) / count(*) AS mean_total, max(total) AS max_total FROM f GROUP BY student_id)
JOIN (SELECT student_id, CAST(sum(best) AS BIGINT) AS total_of_maxima FROM q GROUP BY student_id) USING (student_id)
""")
def a36(t: Tables):
    per = t.answers.groupBy("form_id", "qno").agg(F.sum("level").alias("total"), F.max("level").alias("best"))
    marks = per.join(t.forms.select("form_id", "student_id"), "form_id")
    totals = marks.groupBy("student_id", "form_id").agg(F.sum("total").alias("total")).groupBy("student_id").agg(
        F.avg("total").alias("mean_total"), F.max("total").alias("max_total"))
    maxima = marks.groupBy("student_id", "qno").agg(F.max("best").alias("best")).groupBy("student_id").agg(F.sum("best").alias("total_of_maxima"))
    return totals.join(maxima, "student_id")


@query("A37_student_clinic_table", """
SELECT student_id, clinic, count(*) AS n_forms, CAST(sum(n_yes) AS BIGINT) AS n_yes, CAST(sum(n_no) AS BIGINT) AS n_no, max(es) AS best_level,
  CAST(sum(n_yes) AS BIGINT) / (CAST(sum(n_yes) AS BIGINT) + CAST(sum(n_no) AS BIGINT) + 0.0001e0) AS score FROM fs GROUP BY ALL
""")
def a37(t: Tables):
    g = t.form_scores.groupBy("student_id", "clinic").agg(
        F.count("*").alias("n_forms"), F.sum("n_yes").alias("n_yes"), F.sum("n_no").alias("n_no"), F.max("es").alias("best_level"))
    return g.withColumn("score", S.ratio_with_epsilon(c("n_yes"), c("n_no")))
