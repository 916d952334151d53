"""Report tables (A38 to A73)."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom.functions import dates as D
from markloom.functions import scoring as S
from markloom.functions import text as X
from markloom.operators import marks as M
from markloom.operators import ordering as ORD
from markloom.operators import report as RP
from markloom.operators import reshape as R
from markloom.plans.aggregates import role_scores
from markloom.plans.base import Tables, query, r6
from markloom.plans.cleaning import s

c, lit = F.col, F.lit
CLINICS = ["Clinic 1-URGENT", "Clinic 2-HIGH", "Clinic 3-MEDIUM", "Clinic 4-NOT SPECIFIED", "Clinic 5-LOW"]

FRONT_SQL = """
, rs AS (SELECT form_id, count(*) FILTER (outcome = 'Yes' AND grader = 'student') AS a, count(*) FILTER (outcome = 'No' AND grader = 'student') AS b,
   count(*) FILTER (outcome = 'Yes' AND grader = 'supervisor') AS d, count(*) FILTER (outcome = 'No' AND grader = 'supervisor') AS e FROM ans GROUP BY form_id),
f AS (SELECT frm.*, CASE form_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN greatest(1, form_id % 4 + 1) ELSE form_id % 3 + 1 END AS n_patients, form_id % 7 = 0 AS is_fta,
   a / (a + b + 0.0001e0) AS stu_score, d / (d + e + 0.0001e0) AS sup_score FROM frm LEFT JOIN rs USING (form_id)),
main AS (SELECT coalesce(clinic, 'All') AS clinic, count(*) AS n_forms, count(DISTINCT student_id) AS n_students, count(DISTINCT student_id) FILTER (role = 'Operator') AS n_operator_students,
   count(*) FILTER (role = 'Operator') AS n_operator_forms, CAST(sum(n_patients) AS BIGINT) AS n_patients, count(*) FILTER (is_fta) AS n_fta,
   count(*) FILTER (es = 1) AS level_1, count(*) FILTER (es = 2) AS level_2, count(*) FILTER (es = 3) AS level_3, count(*) FILTER (es = 4) AS level_4,
   avg(stu_score - sup_score) AS mean_score_difference, corr(es, sup_score) AS level_score_correlation FROM f GROUP BY GROUPING SETS ((clinic), ())),
sp AS (SELECT clinic, max(p) AS most_patients, min(p) AS fewest_patients FROM (SELECT coalesce(clinic, 'All') AS clinic, student_id, CAST(sum(n_patients) AS BIGINT) AS p FROM f GROUP BY GROUPING SETS ((clinic, student_id), (student_id))) GROUP BY clinic),
qs AS (SELECT coalesce(clinic, 'All') AS clinic, qno, count(*) FILTER (outcome = 'Yes') / (count(*) FILTER (outcome IN ('Yes', 'No')) + 0.0001e0) AS score FROM mk GROUP BY GROUPING SETS ((clinic, qno), (qno))),
en AS (SELECT clinic, arg_max(qno, (score, -qno)) AS best_question, arg_min(qno, (score, qno)) AS worst_question FROM qs GROUP BY clinic),
cd AS (SELECT coalesce(clinic, 'All') AS clinic, code, count(*) AS n FROM (SELECT clinic, unnest(['IT' || (form_id % 12), 'IT' || (cents % 12)]) AS code FROM frm) GROUP BY GROUPING SETS ((clinic, code), (code))),
tp AS (SELECT clinic, string_agg(code || ': ' || n, chr(10) ORDER BY rn) AS top_codes FROM (SELECT *, row_number() OVER (PARTITION BY clinic ORDER BY n DESC, code) AS rn FROM cd) WHERE rn <= 5 GROUP BY clinic)
"""


def patients(t: Tables):
    text = c("patients_text")
    return t.forms.withColumns({"n_patients": X.patient_count(text), "is_fta": X.failed_to_attend(text)})


def two_codes(t: Tables):
    return F.array(F.concat(lit("IT"), s(c("form_id") % 12)), F.concat(lit("IT"), s(c("cents") % 12)))


def front(t: Tables):
    forms = patients(t).join(role_scores(t).select("form_id", "stu_score", "sup_score"), "form_id", "left").withColumn("level", c("es"))
    questions = t.question_counts.join(t.forms.select("form_id", "clinic"), "form_id")
    codes = t.forms.select("clinic", F.explode(two_codes(t)).alias("code"))
    return RP.front_table(forms, questions, codes, "clinic", "student_id")


@query("A38_front_table", FRONT_SQL + """
SELECT main.* REPLACE (round(mean_score_difference, 6) AS mean_score_difference, round(level_score_correlation, 6) AS level_score_correlation),
  n_patients / (n_operator_students + 0.00001e0) AS patients_per_student, CAST(n_patients AS DOUBLE) / n_operator_forms AS patients_per_form,
  most_patients, fewest_patients, best_question, worst_question, top_codes
FROM main JOIN sp USING (clinic) JOIN en USING (clinic) JOIN tp USING (clinic)
""")
def a38(t: Tables):
    out = front(t)
    return out.withColumns({k: r6(c(k)) for k in ("mean_score_difference", "level_score_correlation")})


@query("A39_clinics_as_columns", FRONT_SQL + """
, l AS (SELECT clinic, unnest(['n_forms', 'n_students', 'n_patients', 'n_fta', 'level_1']) AS metric, unnest([n_forms, n_students, n_patients, n_fta, level_1]) AS v FROM main)
SELECT metric, max(CAST(v AS DOUBLE)) FILTER (clinic = 'All') AS everyone, max(CAST(v AS DOUBLE)) FILTER (clinic = 'Clinic 1-URGENT') AS urgent, max(CAST(v AS DOUBLE)) FILTER (clinic = 'Clinic 2-HIGH') AS high,
  max(CAST(v AS DOUBLE)) FILTER (clinic = 'Clinic 3-MEDIUM') AS medium, max(CAST(v AS DOUBLE)) FILTER (clinic = 'Clinic 4-NOT SPECIFIED') AS unspecified, max(CAST(v AS DOUBLE)) FILTER (clinic = 'Clinic 5-LOW') AS low FROM l GROUP BY metric
""")
def a39(t: Tables):
    table = RP.by_subset(patients(t).withColumn("level", c("es")), "clinic", [], F.count("*").alias("n_forms"), F.countDistinct("student_id").alias("n_students"),
                         F.sum("n_patients").alias("n_patients"), F.count_if(c("is_fta")).alias("n_fta"), F.count_if(c("level") == 1).alias("level_1"))
    wide = RP.clinics_as_columns(table, "clinic", ["n_forms", "n_students", "n_patients", "n_fta", "level_1"], ["All", *CLINICS])
    return wide.toDF("metric", "everyone", "urgent", "high", "medium", "unspecified", "low")


@query("A40_clinic_summary", """
SELECT clinic, count(DISTINCT student_id) AS n_students, count(DISTINCT 'IT' || (form_id % 12)) AS n_items,
  CAST(sum(CASE form_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN greatest(1, form_id % 4 + 1) ELSE form_id % 3 + 1 END) AS DOUBLE) / count(*) AS mean_patients,
  CAST(sum(es) AS DOUBLE) / count(es) AS mean_level, count(*) FILTER (form_id % 7 = 0) AS n_fta FROM frm GROUP BY clinic
""")
def a40(t: Tables):
    return patients(t).groupBy("clinic").agg(
        F.countDistinct("student_id").alias("n_students"), F.countDistinct(c("form_id") % 12).alias("n_items"),
        F.avg("n_patients").alias("mean_patients"), F.avg("es").alias("mean_level"), F.count_if(c("is_fta")).alias("n_fta"))


AGE_SQL = """
, ag AS (SELECT form_id, student_id, clinic, unnest([age1, age2]) AS age FROM frm),
bd AS (SELECT *, CASE WHEN age <= 6 THEN '0-6' WHEN age <= 17 THEN '7-17' WHEN age < 140 THEN '18+' END AS band FROM ag)
"""


def ages(t: Tables):
    each = t.forms.unpivot(["form_id", "student_id", "clinic"], ["age1", "age2"], "source", "age")
    return each.withColumn("band", X.age_band(c("age")))


@query("A41_age_bands_per_student", AGE_SQL + """
SELECT student_id, count(*) FILTER (band = '0-6') AS young, count(*) FILTER (band = '7-17') AS school, count(*) FILTER (band = '18+') AS adult FROM bd GROUP BY student_id
""")
def a41(t: Tables):
    return R.counts_by_value(ages(t), ["student_id"], "band", ["0-6", "7-17", "18+"], ["young", "school", "adult"])


@query("A42_average_patients_per_student", AGE_SQL + """
SELECT band, count(*) // count(DISTINCT student_id) AS whole, CAST(count(*) AS DOUBLE) / count(DISTINCT student_id) AS mean FROM bd WHERE band IS NOT NULL GROUP BY band
""")
def a42(t: Tables):
    mean = F.count("*") / F.countDistinct("student_id")
    return ages(t).filter("band is not null").groupBy("band").agg(F.floor(mean).alias("whole"), mean.alias("mean"))


@query("A43_item_by_age_band", AGE_SQL + """
SELECT 'IT' || (form_id % 12) AS item, count(*) FILTER (band = '0-6') AS young, count(*) FILTER (band = '7-17') AS school, count(*) FILTER (band = '18+') AS adult FROM bd GROUP BY ALL
""")
def a43(t: Tables):
    each = ages(t).withColumn("item", F.concat(lit("IT"), s(c("form_id") % 12)))
    return each.groupBy("item").pivot("band", ["0-6", "7-17", "18+"]).count().fillna(0).toDF("item", "young", "school", "adult")


@query("A44_role_counts", """
SELECT student_id, count(*) FILTER (role = 'Operator') AS operator, count(*) FILTER (role = 'Assistant') AS assistant, count(*) FILTER (role = 'Operator,Observer') AS both_roles,
  count(*) FILTER (role = 'Operator') * 100e0 / count(*) AS pct_operator FROM frm GROUP BY student_id
""")
def a44(t: Tables):
    wide = R.counts_by_value(t.forms, ["student_id"], "role", ["Operator", "Assistant", "Operator,Observer"], ["operator", "assistant", "both_roles"])
    return wide.withColumn("pct_operator", c("operator") * lit(100.0) / (c("operator") + c("assistant") + c("both_roles")))


STATUSES = ["signup", "click", "error", "purchase", "view"]


@query("A45_weekly_status", "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in STATUSES) + """,
  count(*) FILTER (event_type IS NULL OR event_type NOT IN (""" + ", ".join(f"'{k}'" for k in STATUSES) + """)) AS other FROM events GROUP BY ALL
""")
def a45(t: Tables):
    """All statuses of a week; one that is not listed counts as other."""
    listed = F.when(c("event_type").isin(STATUSES), c("event_type")).otherwise("other")
    weeks = t["events"].select(s(D.week_start(c("ts"))).alias("week"), listed.alias("event_type"))
    return R.counts_by_value(weeks, ["week"], "event_type", [*STATUSES, "other"], [*STATUSES, "other"])


@query("A46_question_answer_counts", """
SELECT item, qno, count(*) FILTER (outcome = 'Yes') AS n_yes, count(*) FILTER (outcome = 'No') AS n_no, count(*) FILTER (outcome = 'NA') AS n_na, count(outcome) AS total FROM ans GROUP BY ALL ORDER BY total DESC, item, qno LIMIT 15
""")
def a46(t: Tables):
    g = M.outcome_counts(t.answers, ["item", "qno"]).drop("n_blank").withColumn("total", c("n_yes") + c("n_no") + c("n_na"))
    return g.orderBy(F.desc("total"), "item", "qno").limit(15)


@query("A47_patient_audit", """
SELECT form_id, coalesce('block ' || block, 'all') AS block, count(*) FILTER (outcome = 'Yes') AS n_yes, count(*) FILTER (outcome = 'No') AS n_no, count(*) FILTER (outcome IN ('Yes', 'No')) AS total,
  count(*) FILTER (outcome = 'Yes') * 100e0 / nullif(count(*) FILTER (outcome IN ('Yes', 'No')), 0) AS pct, count(*) FILTER (outcome = 'NA' OR outcome IS NULL) AS not_observed
FROM (SELECT form_id, outcome, marker % 3 + 1 AS block FROM ans) GROUP BY GROUPING SETS ((form_id, block), (form_id))
""")
def a47(t: Tables):
    """The patient number of an answer is its block; totals are the outer grouping level."""
    per = M.outcome_counts(t.answers.withColumn("block", c("marker") % 3 + 1), ["form_id", "block"])
    from markloom.functions import outcome as O

    g = per.groupingSets([["form_id", "block"], ["form_id"]], "form_id", "block").agg(F.grouping("block").alias("g"), *O.sum_counts())
    return g.select("form_id", F.when(c("g") == 1, "all").otherwise(F.concat(lit("block "), s(c("block")))).alias("block"), "n_yes", "n_no",
                    (c("n_yes") + c("n_no")).alias("total"), S.percent_yes(c("n_yes"), c("n_no")).alias("pct"), (c("n_na") + c("n_blank")).alias("not_observed"))


@query("A48_age_description", """
SELECT student_id, count(age1) AS n, round(avg(age1), 6) AS mean, round(stddev_samp(age1), 6) AS std, min(age1) AS lowest, max(age1) AS highest FROM frm GROUP BY student_id
""")
def a48(t: Tables):
    d = RP.describe(t.forms, ["student_id"], "age1")
    return d.withColumns({"mean": r6(c("mean")), "std": r6(c("std"))})


@query("A48_age_histogram", "SELECT floor(age1 / 5e0) * 5e0 AS bin, count(*) AS n FROM frm GROUP BY ALL")
def a48b(t: Tables):
    return RP.histogram(t.forms, [], "age1", 5)


@query("A49_bins_mean_median", """
SELECT floor(checklist_score / 0.25e0) * 0.25e0 AS bin, count(*) AS n, round(avg(checklist_score), 6) AS mean, round(median(checklist_score), 6) AS median FROM fs WHERE checklist_score IS NOT NULL GROUP BY ALL
""")
def a49(t: Tables):
    """Scores are few distinct fractions; the exact median keeps one counter per distinct value."""
    bin_ = (F.floor(c("checklist_score") / lit(0.25)) * lit(0.25)).alias("bin")
    g = t.form_scores.filter(c("checklist_score").isNotNull()).groupBy(bin_)
    return g.agg(F.count("*").alias("n"), r6(F.avg("checklist_score")).alias("mean"), r6(F.median("checklist_score")).alias("median"))


@query("A50_best_and_worst_three", """
, q AS (SELECT student_id, qno, CAST(sum(CASE outcome WHEN 'Yes' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS mean FROM mk WHERE outcome IN ('Yes', 'No') GROUP BY ALL)
SELECT student_id, qno, mean, CAST(place AS INTEGER) AS place, 'best' AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY mean DESC, qno) AS place FROM q) WHERE place <= 3
UNION ALL SELECT student_id, qno, mean, CAST(place AS INTEGER), 'worst' FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY mean, qno) AS place FROM q) WHERE place <= 3
""")
def a50(t: Tables):
    per = M.roll_up(t.question_counts.join(t.forms.select("form_id", "student_id"), "form_id"), ["student_id", "qno"])
    mean = F.try_divide(c("n_yes").cast("double"), (c("n_yes") + c("n_no")).cast("double"))
    return RP.ends_per_group(per.select("student_id", "qno", mean.alias("mean")), "student_id", "qno", "mean", 3)


@query("A51_distinct_text_joined", "SELECT item, qno, string_agg(DISTINCT raw, ' | ' ORDER BY raw) AS answers FROM ans WHERE raw <> '' GROUP BY ALL")
def a51(t: Tables):
    return ORD.joined_distinct(t.answers.filter("raw <> ''"), ["item", "qno"], "raw", " | ", "answers")


@query("A52_student_totals", """
, i AS (SELECT student_id, item, count(*) FILTER (outcome = 'Yes') AS y FROM mk GROUP BY ALL)
SELECT student_id, CAST(sum(y) AS BIGINT) AS total, CAST(sum(y) AS DOUBLE) / count(*) AS mean_per_item, count(*) AS n_items FROM i GROUP BY student_id
""")
def a52(t: Tables):
    per = t.answers.groupBy("form_id", "item").agg(F.count_if(c("outcome") == "Yes").alias("y"))
    item = per.join(t.forms.select("form_id", "student_id"), "form_id").groupBy("student_id", "item").agg(F.sum("y").alias("y"))
    return item.groupBy("student_id").agg(F.sum("y").alias("total"), F.avg("y").alias("mean_per_item"), F.count("*").alias("n_items"))


@query("A53_proportions", """
SELECT clinic, count(*) FILTER (incident = 'Yes') AS n_incidents, count(*) FILTER (incident = 'Yes') / CAST(count(*) AS DOUBLE) AS share, count(*) FILTER (form_id % 7 = 0) AS no_patient FROM frm GROUP BY clinic
""")
def a53(t: Tables):
    hit = F.count_if(c("incident") == "Yes")
    return patients(t).groupBy("clinic").agg(hit.alias("n_incidents"), (hit / F.count("*")).alias("share"), F.count_if(c("is_fta")).alias("no_patient"))


@query("A54_student_subject_code", """
, k AS (SELECT student_id, clinic AS subject, item AS code, count(*) AS n FROM mk GROUP BY ALL)
SELECT student_id, coalesce(subject, 'AllSubjects') AS subject, code, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY GROUPING SETS ((student_id, subject, code), (student_id, code))
""")
def a54(t: Tables):
    per = t.answers.groupBy("form_id", c("item").alias("code")).agg(F.count("*").alias("n"))
    keyed = per.join(t.forms.select("form_id", "student_id", c("clinic").alias("subject")), "form_id")
    g = keyed.groupingSets([["student_id", "subject", "code"], ["student_id", "code"]], "student_id", "subject", "code").agg(
        F.grouping("subject").alias("g"), F.sum("n").alias("n"))
    return g.select("student_id", F.when(c("g") == 1, "AllSubjects").otherwise(c("subject")).alias("subject"), "code", "n")


@query("A55_daily_mean", "SELECT strftime(form_date, '%Y-%m-%d') AS day, CAST(sum(cents) AS DOUBLE) / count(*) AS mean_cents FROM frm GROUP BY form_date")
def a55(t: Tables):
    return t.forms.groupBy(s(c("form_date")).alias("day")).agg((F.sum("cents").cast("double") / F.count("*")).alias("mean_cents"))


@query("A56_grades_per_row", """
SELECT form_id, len(list_filter([ps, cs, ts, es], lambda x: x = 3)) AS grade_3, len(list_filter([ps, cs, ts, es], lambda x: x = 2)) AS grade_2, len(list_filter([ps, cs, ts, es], lambda x: x = 1)) AS grade_1,
  CAST(CASE WHEN es IS NULL THEN 1 ELSE 0 END AS BIGINT) AS missing FROM frm
""")
def a56(t: Tables):
    grades = F.array("ps", "cs", "ts", "es")
    equals = lambda v: lambda g: g == v
    n = lambda p: F.size(F.filter(grades, p)).cast("bigint")
    return t.forms.select("form_id", *[n(equals(v)).alias(f"grade_{v}") for v in (3, 2, 1)], n(lambda g: g.isNull()).alias("missing"))


@query("A57_one_form", "SELECT item, count(*) FILTER (outcome = 'Yes') AS n_yes, count(*) FILTER (outcome = 'No') AS n_no FROM ans WHERE form_id = (SELECT max(form_id) FROM ans) GROUP BY item")
def a57(t: Tables):
    """The form chosen here is the latest one."""
    latest = t.answers.agg(F.max("form_id")).scalar()
    return M.outcome_counts(t.answers.filter(c("form_id") == latest), ["item"]).select("item", "n_yes", "n_no")


@query("A58_incidents_per_marker", """
, x AS (SELECT ps AS marker, clinic, count(*) FILTER (incident = 'Yes') AS n FROM frm GROUP BY ALL)
SELECT CAST(marker AS VARCHAR) AS marker, n FROM (SELECT marker, CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY marker) UNION ALL SELECT 'Total', CAST(sum(n) AS BIGINT) FROM x
""")
def a58(t: Tables):
    per = t.forms.groupBy(c("ps").alias("marker")).agg(F.count_if(c("incident") == "Yes").alias("k"))
    return R.column_totals(per, ["marker"], [F.sum("k").alias("n")])


@query("A59_mean_level_by_outcome", "SELECT coalesce(outcome, '(blank)') AS outcome, CAST(sum(level) AS DOUBLE) / count(*) AS mean_level FROM ans GROUP BY ALL")
def a59(t: Tables):
    return t.answers.groupBy(F.coalesce("outcome", lit("(blank)")).alias("outcome")).agg(F.avg("level").alias("mean_level"))


@query("A60_rubric_and_items_per_date", """
, i AS (SELECT day, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM ans GROUP BY day)
SELECT strftime(day, '%Y-%m-%d') AS day, CAST(sum(level) AS DOUBLE) / count(*) AS mean_level, items FROM ans JOIN i USING (day) GROUP BY ALL
""")
def a60(t: Tables):
    items = F.array_join(F.array_sort(F.collect_set("item")), ",").alias("items")
    return t.answers.groupBy("day").agg(F.avg("level").alias("mean_level"), items).withColumn("day", s(c("day")))


@query("A61_own_mark_beside_mean", """
, q AS (SELECT form_id, qno, max(level) AS level FROM ans GROUP BY ALL)
SELECT form_id, q.qno, level, m AS mean_level FROM q JOIN (SELECT qno, CAST(sum(level) AS DOUBLE) / count(*) AS m FROM q GROUP BY qno) z ON q.qno = z.qno
""")
def a61(t: Tables):
    own = t.answers.groupBy("form_id", "qno").agg(F.max("level").alias("level"))
    return RP.against_mean(own, "qno", "level")


@query("A62_mark_sheet", """
, m AS (SELECT item, form_id, count(*) FILTER (outcome = 'Yes') AS n_yes, count(*) FILTER (outcome = 'No') AS n_no, count(*) FILTER (outcome = 'NA') AS n_na, count(DISTINCT marker) AS n_markers FROM ans GROUP BY ALL)
SELECT item, form_id, n_yes, n_no, n_na, n_markers,
  round((n_yes + 0.5e0 * n_na) / nullif(n_yes + n_no + 0.5e0 * n_na, 0) * 0.8e0 + (ps / 4e0 + cs / 4e0 + ts / 4e0 + coalesce(es, 0) / 4e0) / 4 * 0.2e0, 6) AS total FROM m JOIN frm USING (form_id)
""")
def a62(t: Tables):
    per = t.answers.groupBy("item", "form_id").agg(
        F.count_if(c("outcome") == "Yes").alias("n_yes"), F.count_if(c("outcome") == "No").alias("n_no"),
        F.count_if(c("outcome") == "NA").alias("n_na"), F.countDistinct("marker").alias("n_markers"))
    f = per.join(t.forms.select("form_id", "ps", "cs", "ts", "es"), "form_id")
    rub = S.weighted_mean([(c(x) / lit(4.0), 1.0) for x in ("ps", "cs", "ts", "es")])
    total = S.total_score(S.checklist_score(c("n_yes"), c("n_no"), c("n_na")), rub)
    return f.select("item", "form_id", "n_yes", "n_no", "n_na", "n_markers", r6(total).alias("total"))


@query("A63_question_groups", """
SELECT form_id, CASE WHEN qno <= 3 THEN 'preparation' WHEN qno <= 5 THEN 'restoration' ELSE 'finish' END AS part, count(*) FILTER (outcome = 'Yes') AS n_yes, count(*) FILTER (outcome = 'No') AS n_no FROM ans GROUP BY ALL
""")
def a63(t: Tables):
    """The question groups are a table of seven rows."""
    groups = t.spark.sql("""SELECT * FROM VALUES (1L, 'preparation'), (2L, 'preparation'), (3L, 'preparation'),
        (4L, 'restoration'), (5L, 'restoration'), (6L, 'finish'), (7L, 'finish') AS g(qno, part)""")
    joined = t.question_counts.join(groups, "qno")
    return M.roll_up(joined, ["form_id", "part"]).select("form_id", "part", "n_yes", "n_no")


@query("A64_best_of_table", """
SELECT student_id, CAST(sum(cents) AS BIGINT) AS total_cents, round(avg(checklist_score), 6) AS mean_score, arg_min(clinic, form_id) AS first_clinic,
  string_agg(CAST(form_id AS VARCHAR), ';' ORDER BY form_id) AS forms FROM fs GROUP BY student_id
""")
def a64(t: Tables):
    g = t.form_scores.groupBy("student_id").agg(F.sum("cents").alias("total_cents"), r6(F.avg("checklist_score")).alias("mean_score"), F.min_by("clinic", "form_id").alias("first_clinic"))
    forms = t.form_scores.select("student_id", "form_id", s(c("form_id")).alias("x"))
    return g.join(ORD.joined_text(forms, ["student_id"], ["form_id"], F.floor(c("form_id") / 10_000), "x", ";", "forms"), "student_id")


@query("A65_codes_per_student", """
SELECT code, count(*) / CAST((SELECT count(DISTINCT student_id) FROM frm) AS DOUBLE) AS mean_per_student FROM (SELECT unnest(['IT' || (form_id % 12), 'IT' || (cents % 12)]) AS code FROM frm) GROUP BY code
""")
def a65(t: Tables):
    codes = t.forms.select(F.explode(two_codes(t)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    students = t.forms.agg(F.countDistinct("student_id")).scalar()
    return codes.select("code", (c("n") / students).alias("mean_per_student"))


@query("A65_students_per_rotation", "SELECT r_name AS rotation, count(DISTINCT student_id) AS n_students FROM frm JOIN stu USING (student_id) JOIN nation ON home = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def a65b(t: Tables):
    active = t.forms.select("student_id").distinct().join(t.students, "student_id")
    places = t["nation"].join(t["region"], c("n_regionkey") == c("r_regionkey"))
    return active.join(places, c("home") == c("n_nationkey")).groupBy(c("r_name").alias("rotation")).agg(F.count("*").alias("n_students"))


@query("A66_share_of_forms", "SELECT item, count(DISTINCT form_id) || '/' || (SELECT count(DISTINCT form_id) FROM ans) AS share FROM ans GROUP BY item")
def a66(t: Tables):
    once = t.answers.select("item", "form_id").distinct()
    total = once.agg(F.countDistinct("form_id")).scalar()
    return once.groupBy("item").agg(F.count("*").alias("n")).select("item", F.concat_ws("/", s(c("n")), s(total)).alias("share"))


@query("A67_form_summary", """
SELECT form_id, strftime(form_date, '%d/%m/%Y') AS day, role, CASE WHEN 'IT' || (form_id % 12) = 'IT' || (cents % 12) THEN 'IT' || (form_id % 12)
  ELSE least('IT' || (form_id % 12), 'IT' || (cents % 12)) || ', ' || greatest('IT' || (form_id % 12), 'IT' || (cents % 12)) END AS items FROM frm
""")
def a67(t: Tables):
    return t.forms.select("form_id", F.date_format("form_date", "dd/MM/yyyy").alias("day"), "role",
                          F.array_join(F.array_sort(F.array_distinct(two_codes(t))), ", ").alias("items"))


@query("A68_two_markers_beside", """
, k AS (SELECT form_id, min(marker) AS m1, max(marker) AS m2 FROM ans GROUP BY form_id HAVING count(DISTINCT marker) = 2)
SELECT form_id, qno, max(level) FILTER (marker = m1) AS first_marker, max(level) FILTER (marker = m2) AS second_marker FROM ans JOIN k USING (form_id) GROUP BY ALL
""")
def a68(t: Tables):
    per = t.answers.groupBy("form_id", "qno", "marker").agg(F.max("level").alias("level"))
    ends = per.groupBy("form_id").agg(F.min("marker").alias("m1"), F.max("marker").alias("m2"), F.countDistinct("marker").alias("k")).filter("k = 2")
    cell = lambda m: F.max(F.when(c("marker") == c(m), c("level")))
    return per.join(ends, "form_id").groupBy("form_id", "qno").agg(cell("m1").alias("first_marker"), cell("m2").alias("second_marker"))


@query("A69_station_result", "SELECT form_id, CASE WHEN checklist_score * 100 < 50 THEN 'Fail' WHEN checklist_score IS NOT NULL THEN 'Pass' END AS result FROM fs")
def a69(t: Tables):
    pct = c("checklist_score") * lit(100.0)
    return t.form_scores.select("form_id", F.when(pct < 50, "Fail").when(pct.isNotNull(), "Pass").alias("result"))


@query("A70_young_patients", "SELECT clinic, count(*) AS n FROM (SELECT clinic, unnest([age1, age2]) AS age FROM frm) WHERE age < 18 GROUP BY clinic")
def a70(t: Tables):
    pairs = F.arrays_zip(F.array(c("form_id"), -c("form_id")).alias("patient"), F.array("age1", "age2").alias("age"))
    each = t.forms.select("clinic", F.inline(pairs))
    return each.filter("age < 18").groupBy("clinic").agg(F.count("*").alias("n"))


@query("A71_competency_levels", """
, l AS (SELECT student_id, CASE WHEN form_id % 2 = 0 THEN 'student' ELSE 'supervisor' END AS grader, unnest(['ps', 'cs', 'ts', 'es']) AS competency, unnest([ps, cs, ts, es]) AS level FROM frm)
SELECT student_id, grader, coalesce(competency, 'overall') AS competency, count(*) FILTER (level = 4) AS level_4, count(*) FILTER (level = 3) AS level_3, count(*) FILTER (level = 2) AS level_2, count(*) FILTER (level = 1) AS level_1
FROM l GROUP BY GROUPING SETS ((student_id, grader, competency), (student_id, grader))
""")
def a71(t: Tables):
    base = t.forms.withColumn("grader", F.when(c("form_id") % 2 == 0, "student").otherwise("supervisor"))
    long = base.unpivot(["student_id", "grader"], ["ps", "cs", "ts", "es"], "competency", "level")
    cells = [F.count_if(c("level") == i).alias(f"level_{i}") for i in (4, 3, 2, 1)]
    g = long.groupingSets([["student_id", "grader", "competency"], ["student_id", "grader"]], "student_id", "grader", "competency").agg(
        F.grouping("competency").alias("g"), *cells)
    return g.withColumn("competency", F.when(c("g") == 1, "overall").otherwise(c("competency"))).drop("g")


@query("A72_two_form_systems", """
SELECT item, count(*) AS n FROM (SELECT CASE form_id % 12 WHEN 11 THEN '911' ELSE CAST(form_id % 12 AS VARCHAR) END AS item FROM frm
  UNION ALL SELECT CASE part_id % 12 WHEN 11 THEN '911' ELSE CAST(part_id % 12 AS VARCHAR) END FROM ans) GROUP BY item
""")
def a72(t: Tables):
    code = lambda k: F.when(c(k) % 12 == 11, "LA").otherwise(s(c(k) % 12)).alias("item")
    both = t.forms.select(code("form_id")).unionByName(t.answers.select(code("part_id")))
    return both.groupBy(F.when(c("item") == "LA", "911").otherwise(c("item")).alias("item")).agg(F.count("*").alias("n"))


@query("A73_last_form_of_a_date", "SELECT student_id, strftime(form_date, '%Y-%m-%d') AS day, 'IT' || (max(form_id) % 12) AS items FROM frm GROUP BY student_id, form_date")
def a73(t: Tables):
    code = F.concat(lit("IT"), s(c("form_id") % 12))
    return t.forms.withColumn("code", code).groupBy("student_id", s(c("form_date")).alias("day")).agg(F.max_by("code", "form_id").alias("items"))
