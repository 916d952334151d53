"""Scoring: outcomes, checklist and rubric scores, cutoffs, sections, penalties (X ids) and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom import constants as K
from markloom.functions import outcome as O
from markloom.functions import scoring as S
from markloom.functions import text as X
from markloom.operators import marks as M
from markloom.plans.base import Tables, query, r6

c = F.col


@query("flagship_marks", """
, best AS (SELECT student_id, form_date, qno,
             CASE WHEN max(CASE WHEN outcome = 'Yes' THEN 1 ELSE 0 END) = 1 THEN 'Yes'
                  WHEN max(CASE WHEN outcome = 'No' THEN 1 ELSE 0 END) = 1 THEN 'No'
                  WHEN max(CASE WHEN outcome = 'NA' THEN 1 ELSE 0 END) = 1 THEN 'NA' END AS outcome
           FROM mk GROUP BY ALL),
daily AS (SELECT student_id, form_date,
            (count(*) FILTER (outcome = 'Yes') + CAST(0.5 AS DOUBLE) * count(*) FILTER (outcome = 'NA'))
            / nullif(count(*) FILTER (outcome IN ('Yes', 'No')) + CAST(0.5 AS DOUBLE) * count(*) FILTER (outcome = 'NA'), 0) AS s
          FROM best GROUP BY ALL)
SELECT student_id, round(avg(s), 6) AS mean_score, count(*) AS n_days
FROM daily GROUP BY student_id ORDER BY mean_score DESC NULLS LAST, student_id LIMIT 20
""")
def flagship(t: Tables):
    best = M.best_of(t.question_counts, t.forms, "form_id", "student_id", "form_date", ["qno"])
    means = M.student_means(best, "student_id", "form_date").withColumn("mean_score", r6(c("mean_score")))
    return means.orderBy(F.desc_nulls_last("mean_score"), "student_id").limit(20)


@query("X06_outcome_normalisation", """
SELECT raw, coalesce(outcome, '(blank)') AS outcome,
       CAST(CASE WHEN outcome = 'Yes' THEN 1 WHEN outcome = 'No' THEN 0 ELSE -1 END AS BIGINT) AS number, count(*) AS n
FROM ans GROUP BY ALL
""")
def x06(t: Tables):
    o = O.normalise(c("raw"))
    return t.answers.groupBy("raw", F.coalesce(o, F.lit("(blank)")).alias("outcome"),
                             F.coalesce(O.as_number(o), F.lit(-1)).cast("bigint").alias("number")).agg(F.count("*").alias("n"))


@query("X44_fill_policy", """
SELECT form_id, count(*) FILTER (raw IN ('No', 'Not Reviewed')) AS no_if_counted_against,
       count(*) FILTER (raw = 'No') AS no_if_left_open, count(*) FILTER (raw = 'Not Reviewed') AS na_if_left_open
FROM ans GROUP BY form_id
""")
def x44(t: Tables):
    strict, mild = O.normalise(c("raw"), "No"), O.normalise(c("raw"), "NA")
    return t.answers.groupBy("form_id").agg(
        F.count_if(strict == "No").alias("no_if_counted_against"),
        F.count_if(mild == "No").alias("no_if_left_open"), F.count_if(mild == "NA").alias("na_if_left_open"))


@query("X03_rubric_level_or_zero", """
SELECT form_id, es_text, CAST(coalesce(try_cast(nullif(regexp_extract(es_text, 'Lvl (\\d+)', 1), '') AS INTEGER), 0) AS BIGINT) AS level FROM frm
""")
def x03(t: Tables):
    return t.forms.select("form_id", "es_text", X.rubric_level_or_zero(c("es_text")).cast("bigint").alias("level"))


@query("X04_rubric_level", """
SELECT student_id, count(es) AS n_levels, CAST(sum(es) AS DOUBLE) / nullif(count(es), 0) AS mean_level FROM frm GROUP BY student_id
""")
def x04(t: Tables):
    level = X.rubric_level(c("es_text"))
    return t.forms.groupBy("student_id").agg(F.count(level).alias("n_levels"), F.avg(level).alias("mean_level"))


@query("X23_thermometer", """
, s AS (SELECT unnest([1, 2, 3, 4]) AS step)
SELECT step, clinic, count(*) AS n, count(*) FILTER (coalesce(es, 0) >= step) AS reached
FROM frm, s GROUP BY ALL
""")
def x23(t: Tables):
    bits = M.thermometer(t.forms.select("form_id", "clinic", "es"), ["form_id", "clinic"], "es", 4)
    return bits.groupBy("step", "clinic").agg(F.count("*").alias("n"), F.sum("bit").alias("reached"))


@query("X24_checklist_score", "SELECT form_id, n_yes, n_no, n_na, checklist_score FROM fs")
def x24(t: Tables):
    return t.form_scores.select("form_id", "n_yes", "n_no", "n_na", "checklist_score")


RUBRIC_SQL = """
, rub AS (SELECT *, CASE WHEN setting = 'Simulation'
    THEN (CAST(0 AS DOUBLE) + ps * CAST(0.05 AS DOUBLE) / 2e0 + cs * CAST(0.05 AS DOUBLE) / 2e0 + ts * CAST(0.1 AS DOUBLE) / 4e0
          + coalesce(es, 0) * CAST(0.1 AS DOUBLE) / 4e0) / CAST(0.3 AS DOUBLE)
    ELSE (CAST(0 AS DOUBLE) + ps * CAST(0.1 AS DOUBLE) / 4e0 + cs * CAST(0.1 AS DOUBLE) / 4e0 + ts * CAST(0.1 AS DOUBLE) / 4e0
          + coalesce(es, 0) * CAST(0.1 AS DOUBLE) / 4e0) / CAST(0.4 AS DOUBLE) END AS rubric_score
  FROM fs)
"""


def rubric(t: Tables):
    levels = {"PS": c("ps"), "CS": c("cs"), "TS": c("ts"), "ES": c("es")}
    return t.form_scores.withColumn("rubric_score", S.rubric_score(levels, c("setting")))


@query("X25_rubric_score", RUBRIC_SQL + "SELECT form_id, setting, round(rubric_score, 6) AS rubric_score FROM rub")
def x25(t: Tables):
    return rubric(t).select("form_id", "setting", r6(c("rubric_score")).alias("rubric_score"))


@query("X26_total_and_penalties", RUBRIC_SQL + """
, tot AS (SELECT *, checklist_score * 0.8e0 + rubric_score * 0.2e0 AS total FROM rub)
SELECT form_id, round(total, 6) AS total_score,
       round(total * CASE WHEN incident = 'Yes' THEN 0.8e0 ELSE 1e0 END, 6) AS total_less_20,
       round(total * CASE WHEN incident = 'Yes' THEN 0.9e0 ELSE 1e0 END, 6) AS total_less_10
FROM tot
""")
def x26(t: Tables):
    scored = rubric(t).withColumn("total", S.total_score(c("checklist_score"), c("rubric_score")))
    return scored.select(
        "form_id", r6(c("total")).alias("total_score"),
        r6(S.penalised(c("total"), c("incident"), K.PENALTY_20)).alias("total_less_20"),
        r6(S.penalised(c("total"), c("incident"), K.PENALTY_10)).alias("total_less_10"))


@query("X27_weighted_variants", RUBRIC_SQL + """
SELECT form_id,
  round(100 * (coalesce(checklist_score, 0) * 0.8e0 + ts / 4e0 * 0.05e0 + coalesce(es, 0) / 4e0 * 0.05e0 + ps / 4e0 * 0.05e0 + cs / 4e0 * 0.05e0), 6) AS equal_rubrics,
  round(100 * (coalesce(checklist_score, 0) * 0.8e0 + ts / 4e0 * 0.1e0 + coalesce(es, 0) / 4e0 * 0.05e0 + ps / 4e0 * 0.05e0), 6) AS time_heavy,
  round(100 * (coalesce(checklist_score, 0) * 0.7e0 + rubric_score * 0.3e0), 6) AS seventy_thirty,
  round(100 * (coalesce(checklist_score, 0) * 0.95e0 + rubric_score * 0.05e0), 6) AS ninety_five
FROM rub
""")
def x27(t: Tables):
    q = F.lit(4.0)
    mc, ts, es, ps, cs = c("checklist_score"), c("ts") / q, c("es") / q, c("ps") / q, c("cs") / q
    pct = lambda parts: r6(S.weighted_sum(parts) * F.lit(100.0))
    return rubric(t).select(
        "form_id",
        pct([(mc, 0.8), (ts, 0.05), (es, 0.05), (ps, 0.05), (cs, 0.05)]).alias("equal_rubrics"),
        pct([(mc, 0.8), (ts, 0.1), (es, 0.05), (ps, 0.05)]).alias("time_heavy"),
        pct([(mc, 0.7), (c("rubric_score"), 0.3)]).alias("seventy_thirty"),
        pct([(mc, 0.95), (c("rubric_score"), 0.05)]).alias("ninety_five"))


@query("X28_criterion_cutoff", """
SELECT form_id, section, count(*) AS n_reviewed, CAST(sum(weight) AS BIGINT) AS denominator,
       CAST(coalesce(sum(weight) FILTER (outcome = 'Yes'), 0) AS BIGINT) AS weighted_sum,
       round(CAST(sum(tenths) AS DOUBLE) / count(*), 6) AS cutoff,
       round(CAST(sum(tenths * weight) AS DOUBLE) / CAST(sum(weight) AS DOUBLE), 6) AS weighted_cutoff,
       round(CAST(coalesce(sum(weight) FILTER (outcome = 'Yes'), 0) AS DOUBLE) * 100 / CAST(sum(weight) AS DOUBLE), 6) AS weighted_score
FROM ans JOIN itm USING (part_id) WHERE outcome IN ('Yes', 'No') GROUP BY form_id, section
""")
def x28(t: Tables):
    """Pass probabilities are whole tenths here, so their sums are exact."""
    scored = M.criterion_scores(t.answers.join(t.items, "part_id"), ["form_id", "section"], "tenths", "weight")
    for name in ("cutoff", "weighted_cutoff", "weighted_score"):
        scored = scored.withColumn(name, r6(c(name)))
    return scored


@query("X29_section_cutoff", """
, w AS (SELECT form_id, section, count(*) FILTER (outcome = 'Yes') AS n_yes, count(*) FILTER (outcome = 'No') AS n_no,
          CAST(coalesce(sum(weight) FILTER (outcome = 'Yes'), 0) AS BIGINT) AS weight_yes,
          CAST(coalesce(sum(weight) FILTER (outcome IN ('Yes', 'No')), 0) AS BIGINT) AS weight_reviewed
        FROM (SELECT ans.* EXCLUDE (outcome), CASE WHEN raw = 'Not Reviewed' THEN 'No' ELSE outcome END AS outcome FROM ans) a
        JOIN itm USING (part_id) GROUP BY form_id, section)
SELECT *, round(weight_yes * 100e0 / nullif(weight_reviewed, 0), 6) AS score,
       CASE WHEN weight_reviewed > 0 THEN CASE WHEN weight_yes * 100e0 / weight_reviewed >= 60 THEN 'Pass' ELSE 'Fail' END END AS result
FROM w
""")
def x29(t: Tables):
    """Not reviewed counts as No, the published default."""
    strict = t.answers.withColumn("outcome", O.normalise(c("raw"), "No")).join(t.items, "part_id")
    scored = M.weighted_sections(strict, ["form_id", "section"], "weight")
    result = F.when(c("score").isNotNull(), F.when(c("score") >= 60, "Pass").otherwise("Fail"))
    return scored.withColumn("result", result).withColumn("score", r6(c("score")))


@query("X30_importance_bands", """
, b AS (SELECT form_id, outcome, CASE WHEN weight = 10 THEN 'critical' WHEN weight BETWEEN 7 AND 9 THEN 'important'
               WHEN weight BETWEEN 4 AND 6 THEN 'moderate' ELSE 'minor' END AS band
        FROM ans JOIN itm USING (part_id))
SELECT form_id, band, count(*) FILTER (outcome = 'Yes') AS n_yes, count(*) FILTER (outcome = 'No') AS n_no,
       count(*) FILTER (outcome = 'Yes') * 100e0 / nullif(count(*) FILTER (outcome IN ('Yes', 'No')), 0) AS pct_yes
FROM b GROUP BY form_id, band
""")
def x30(t: Tables):
    per = t.answers.join(t.items, "part_id").withColumn("band", S.importance_band(c("weight")))
    out = per.groupBy("form_id", "band").agg(*O.counts(c("outcome")))
    return out.select("form_id", "band", "n_yes", "n_no", S.percent_yes(c("n_yes"), c("n_no")).alias("pct_yes"))


@query("X31_fail_rules", """
, r AS (SELECT form_id,
          count(*) FILTER (outcome = 'No' AND qno IN (1, 2)) AS hard_no,
          count(*) FILTER (outcome = 'No' AND qno > 3) AS soft_no,
          count(*) FILTER (outcome = 'No' AND qno = 3) AS special_no
        FROM ans GROUP BY form_id),
f AS (SELECT r.*, frm.es, frm.ts, frm.incident FROM r JOIN frm USING (form_id))
SELECT form_id,
  (hard_no > 0 OR soft_no > 2 OR (special_no > 0 AND soft_no > 1) OR coalesce(es IN (1, 2), FALSE) OR ts IN (1, 2) OR incident = 'Yes') AS fail,
  concat_ws('  |  ', CASE WHEN hard_no > 0 THEN 'essential x' || hard_no END, CASE WHEN soft_no > 0 THEN 'minor x' || soft_no END,
     CASE WHEN special_no > 0 THEN 'special item' END, CASE WHEN es IN (1, 2) THEN 'entrustment' END,
     CASE WHEN ts IN (1, 2) THEN 'time' END, CASE WHEN incident = 'Yes' THEN 'incident' END) AS reason
FROM f
""")
def x31(t: Tables):
    no = c("outcome") == "No"
    counts = t.answers.groupBy("form_id").agg(
        F.count_if(no & c("qno").isin(1, 2)).alias("hard"), F.count_if(no & (c("qno") > 3)).alias("soft"),
        F.count_if(no & (c("qno") == 3)).alias("special"))
    f = counts.join(t.forms, "form_id")
    low_es, low_ts, ci = F.coalesce(c("es").isin(1, 2), F.lit(False)), c("ts").isin(1, 2), c("incident") == "Yes"
    fail = (c("hard") > 0) | (c("soft") > 2) | ((c("special") > 0) & (c("soft") > 1)) | low_es | low_ts | ci
    reason = F.concat_ws(
        "  |  ", F.when(c("hard") > 0, F.concat(F.lit("essential x"), c("hard"))),
        F.when(c("soft") > 0, F.concat(F.lit("minor x"), c("soft"))), F.when(c("special") > 0, F.lit("special item")),
        F.when(low_es, F.lit("entrustment")), F.when(low_ts, F.lit("time")), F.when(ci, F.lit("incident")))
    return f.select("form_id", fail.alias("fail"), reason.alias("reason"))


@query("X32_section_normalised_total", """
, s AS (SELECT form_id, count(*) FILTER (outcome = 'Yes' AND qno <= 5) AS first_total, count(*) FILTER (outcome = 'Yes' AND qno > 5) AS second_total
        FROM ans GROUP BY form_id)
SELECT form_id, first_total, second_total,
  round(100 * (first_total / 5e0 * 0.5e0 + second_total / 2e0 * 0.15e0
        + ((ps / 2e0 * 0.05e0 + cs / 4e0 * 0.1e0 + coalesce(es, 0) / 4e0 * 0.1e0) / 0.25e0) * 0.35e0), 6) AS total_score
FROM s JOIN frm USING (form_id)
""")
def x32(t: Tables):
    yes = c("outcome") == "Yes"
    s = t.answers.groupBy("form_id").agg(F.count_if(yes & (c("qno") <= 5)).alias("first_total"),
                                         F.count_if(yes & (c("qno") > 5)).alias("second_total"))
    f = s.join(t.forms, "form_id")
    rub = S.weighted_mean([(c("ps") / F.lit(2.0), 0.05), (c("cs") / F.lit(4.0), 0.1), (c("es") / F.lit(4.0), 0.1)])
    total = S.weighted_sum([(c("first_total") / F.lit(5.0), 0.5), (c("second_total") / F.lit(2.0), 0.15), (rub, 0.35)])
    return f.select("form_id", "first_total", "second_total", r6(total * F.lit(100.0)).alias("total_score"))


@query("X33_section_fixed_divisor", """
SELECT form_id, section, count(*) FILTER (outcome = 'Yes') AS n_yes, count(*) FILTER (outcome IS DISTINCT FROM 'Yes') AS n_no,
       count(*) FILTER (outcome = 'Yes') * 100e0 / count(*) AS score
FROM ans JOIN itm USING (part_id) GROUP BY form_id, section
""")
def x33(t: Tables):
    per = t.answers.join(t.items, "part_id")
    yes = F.count_if(c("outcome") == "Yes")
    return per.groupBy("form_id", "section").agg(
        yes.alias("n_yes"), (F.count("*") - yes).alias("n_no"), (yes * F.lit(100.0) / F.count("*")).alias("score"))


@query("X34_tooth_weighted_total", """
, lab AS (SELECT form_id, CASE WHEN form_id % 2 = 0 THEN '11' ELSE '24' END AS tooth,
            CASE part_id % 7 WHEN 0 THEN '415_SIM ACCESS' WHEN 1 THEN '415_SIM WORK LENGTH' WHEN 2 THEN '416_SIM'
              WHEN 3 THEN '417_SIM CONE FIT' WHEN 4 THEN '417_SIM ROOT FLG' WHEN 5 THEN '418_SIM CONE FIT' ELSE '418_SIM ROOT FLG' END AS name,
            outcome FROM ans),
sc AS (SELECT form_id, tooth, name, count(*) FILTER (outcome = 'Yes') AS y, count(*) FILTER (outcome IN ('Yes', 'No')) AS n FROM lab GROUP BY ALL),
w AS (SELECT form_id, tooth, sum(CASE WHEN n > 0 THEN y * 100e0 / n ELSE 0 END *
        CASE WHEN tooth = '11' THEN CASE name WHEN '415_SIM ACCESS' THEN 0.4e0 WHEN '415_SIM WORK LENGTH' THEN 0.2e0
               WHEN '417_SIM CONE FIT' THEN 0.2e0 WHEN '417_SIM ROOT FLG' THEN 0.2e0 ELSE 0e0 END
             ELSE CASE name WHEN '415_SIM ACCESS' THEN 0.4e0 ELSE 0.1e0 END END) AS total
      FROM sc GROUP BY ALL)
SELECT form_id, tooth, round(total, 6) AS checklist_total, round(total * 0.95e0 + ps / 4e0 * 100 * 0.05e0, 6) AS grand_total
FROM w JOIN frm USING (form_id)
""")
def x34(t: Tables):
    names = ["415_SIM ACCESS", "415_SIM WORK LENGTH", "416_SIM", "417_SIM CONE FIT", "417_SIM ROOT FLG",
             "418_SIM CONE FIT", "418_SIM ROOT FLG"]
    lab = t.answers.select("form_id", "outcome", F.when(c("form_id") % 2 == 0, "11").otherwise("24").alias("tooth"),
                           F.element_at(F.array(*map(F.lit, names)), (c("part_id") % 7 + 1).cast("int")).alias("name"))
    scored = M.outcome_counts(lab, ["form_id", "tooth", "name"]).withColumn("score", S.percent_yes(c("n_yes"), c("n_no")))
    weight = F.coalesce(S.tooth_item_weight(c("tooth"), c("name")), F.lit(0.0))
    total = scored.groupBy("form_id", "tooth").agg(F.sum(F.coalesce(c("score"), F.lit(0.0)) * weight).alias("total"))
    f = total.join(t.forms.select("form_id", "ps"), "form_id")
    grand = S.weighted_sum([(c("total"), 0.95), (c("ps") / F.lit(4.0) * F.lit(100.0), 0.05)])
    return f.select("form_id", "tooth", r6(c("total")).alias("checklist_total"), r6(grand).alias("grand_total"))


@query("X35_epsilon_ratio", "SELECT form_id, n_yes / (n_yes + n_no + 0.0001e0) AS score, n_yes / (n_yes + 0.00001e0) AS per_yes FROM fc")
def x35(t: Tables):
    return t.form_counts.select("form_id", S.ratio_with_epsilon(c("n_yes"), c("n_no")).alias("score"),
                                S.ratio_with_epsilon(c("n_yes"), F.lit(0), K.EPSILON_PATIENTS).alias("per_yes"))


@query("X36_normalise_clip", """
SELECT form_id, n_yes / 7e0 AS share, least(1e0, greatest(0e0, (n_yes - n_no) / 3e0)) AS clipped, abs(n_yes - n_no) AS distance FROM fc
""")
def x36(t: Tables):
    return t.form_counts.select(
        "form_id", (c("n_yes") / F.lit(7.0)).alias("share"),
        S.clip01((c("n_yes") - c("n_no")) / F.lit(3.0)).alias("clipped"), F.abs(c("n_yes") - c("n_no")).alias("distance"))


@query("X47_row_totals", """
, a AS (SELECT form_id, CAST(coalesce(sum(CASE outcome WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END), 0) AS BIGINT) AS checklist_total,
               count(*) FILTER (outcome IN ('Yes', 'No')) AS n_answered FROM ans GROUP BY form_id)
SELECT form_id, checklist_total, n_answered, checklist_total + ps + cs + ts + coalesce(es, 0) AS grand_total,
       checklist_total * 100e0 / nullif(n_answered, 0) AS pct_of_possible
FROM a JOIN frm USING (form_id)
""")
def x47(t: Tables):
    v = O.as_number(c("outcome"))
    a = t.answers.groupBy("form_id").agg(F.coalesce(F.sum(v), F.lit(0)).alias("checklist_total"), F.count(v).alias("n_answered"))
    bits = c("ps") + c("cs") + c("ts") + F.coalesce(c("es"), F.lit(0))
    return a.join(t.forms, "form_id").select(
        "form_id", "checklist_total", "n_answered", (c("checklist_total") + bits).alias("grand_total"),
        F.try_divide(c("checklist_total") * F.lit(100.0), c("n_answered").cast("double")).alias("pct_of_possible"))


@query("X48_conditional_overwrite", """
SELECT form_id, CASE WHEN lower(finished) NOT IN ('true', '1') THEN 0e0 WHEN clinic = 'Clinic 5-LOW' THEN ps / 4e0
       ELSE checklist_score END AS total FROM fs
""")
def x48(t: Tables):
    done = F.lower("finished").isin("true", "1")
    total = F.when(~done, F.lit(0.0)).when(c("clinic") == "Clinic 5-LOW", c("ps") / F.lit(4.0)).otherwise(c("checklist_score"))
    return t.form_scores.select("form_id", total.alias("total"))
