"""Projections, filters and scalar rules (P, F and X ids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom.functions import codes as C
from markloom.functions import dates as D
from markloom.functions import headers as H
from markloom.functions import jsonmap as J
from markloom.functions import text as X
from markloom.operators import cleaning as CL
from markloom.operators import marks as M
from markloom.operators import reshape as R
from markloom.operators.ordering import joined_distinct, row_numbers
from markloom.plans.base import Tables, query

c, lit = F.col, F.lit


def s(column):
    return column.cast("string")


def pick(index, options: list[str]):
    """One of a short list of texts by a whole number."""
    return F.element_at(F.array(*map(lit, options)), (index + 1).cast("int"))


# ---------------------------------------------------------------- headers and columns

HEADER_SQL = """
, h AS (SELECT DISTINCT lpad(CAST(part_id % 39 + 500 AS VARCHAR), 3, '0') AS code,
          ['CLINIC', 'SIM', 'Infil', 'CINIC', ''][part_id % 5 + 1] AS tag, CASE grader WHEN 'student' THEN '1' ELSE '2' END AS r, qno FROM ans),
p AS (SELECT code || CASE WHEN tag = '' THEN '' ELSE ' ' || tag END || '#' || r || '_' || qno || CASE WHEN qno = 7 THEN '_TEXT' ELSE '' END AS header,
        code || '_' || CASE WHEN qno = 7 THEN 'Tooth Number' ELSE 'MC' || qno END || '_' || CASE r WHEN '1' THEN 'student' ELSE 'supervisor' END
        || CASE tag WHEN '' THEN '' WHEN 'Infil' THEN ' (INFILTRATION)' WHEN 'CINIC' THEN ' (CLINIC)' ELSE ' (' || tag || ')' END AS name FROM h)
"""


def header_table(t: Tables):
    tag = pick(c("part_id") % 5, ["CLINIC", "SIM", "Infil", "CINIC", ""])
    header = F.concat(
        s(c("part_id") % 39 + 500), F.when(tag == "", "").otherwise(F.concat(lit(" "), tag)), lit("#"),
        F.when(c("grader") == "student", "1").otherwise("2"), lit("_"), s(c("qno")), F.when(c("qno") == 7, "_TEXT").otherwise(""))
    return t.answers.select(header.alias("header")).distinct()


@query("P01_header_parser", HEADER_SQL + "SELECT header, name FROM p")
def p01(t: Tables):
    return H.parse_headers(header_table(t), "header").select("header", "name")


OLD_HEADERS_SQL = """
, o AS (SELECT part_id AS pos, CASE part_id % 4
      WHEN 0 THEN CAST(500 + part_id % 20 AS VARCHAR) || ' SIM Student - q' || part_id
      WHEN 1 THEN CAST(500 + part_id % 20 AS VARCHAR) || ' CLINIC Supervisor - q' || part_id
      WHEN 2 THEN 'Local Anesthesia (Block) - Student q' || part_id
      ELSE 'Sharpening SIM Supervisor q' || part_id END AS header,
    CASE part_id % 4 WHEN 0 THEN CAST(500 + part_id % 20 AS VARCHAR) WHEN 1 THEN CAST(500 + part_id % 20 AS VARCHAR) WHEN 2 THEN 'LA' ELSE 'Sharpening' END AS base,
    CASE part_id % 4 WHEN 0 THEN 'SIM' WHEN 1 THEN 'CLINIC' WHEN 2 THEN 'Block' ELSE 'SIM' END AS tag,
    CASE WHEN part_id % 2 = 0 THEN 'student' ELSE 'supervisor' END AS role FROM itm)
"""


@query("P02_numbered_headers", OLD_HEADERS_SQL + """
SELECT header, base || '_MC' || row_number() OVER (PARTITION BY base, tag, role ORDER BY pos) || '_' || role || ' (' || tag || ')' AS new_name FROM o
""")
def p02(t: Tables):
    k, code = c("part_id"), s(c("part_id") % 20 + 500)
    header = (
        F.when(k % 4 == 0, F.concat(code, lit(" SIM Student - q"), s(k)))
        .when(k % 4 == 1, F.concat(code, lit(" CLINIC Supervisor - q"), s(k)))
        .when(k % 4 == 2, F.concat(lit("Local Anesthesia (Block) - Student q"), s(k)))
        .otherwise(F.concat(lit("Sharpening SIM Supervisor q"), s(k))))
    return H.number_headers(t.items.select(k.alias("pos"), header.alias("header")), "header", "pos").select("header", "new_name")


@query("P03_other_headers", """
, o AS (SELECT part_id AS pos, part_id % 3 AS kind, ['Positioning and Ergonomics Checklist', 'Consent Checklist'][part_id % 2 + 1] AS title,
          ['Professionalism Scale', 'Entrustment Scale'][part_id % 2 + 1] AS scale, CASE WHEN part_id % 5 = 0 THEN 'Student' ELSE 'Supervisor' END AS r FROM itm),
n AS (SELECT *, row_number() OVER (PARTITION BY kind, title, r ORDER BY pos) AS rn FROM o)
SELECT CASE kind WHEN 0 THEN title || ' ' || r || ' q' || pos WHEN 1 THEN scale || ' q' || pos ELSE 'free column ' || pos END AS header,
  CASE kind WHEN 0 THEN CASE title WHEN 'Consent Checklist' THEN 'CC' ELSE 'PEC' END || '_MC' || rn || '_' || lower(r)
    WHEN 1 THEN CASE scale WHEN 'Entrustment Scale' THEN 'ES' ELSE 'PS' END ELSE 'free column ' || pos END AS new_name FROM n
""")
def p03(t: Tables):
    k = c("part_id")
    title = pick(k % 2, ["Positioning and Ergonomics Checklist", "Consent Checklist"])
    scale = pick(k % 2, ["Professionalism Scale", "Entrustment Scale"])
    who = F.when(k % 5 == 0, "Student").otherwise("Supervisor")
    header = (
        F.when(k % 3 == 0, F.concat(title, lit(" "), who, lit(" q"), s(k)))
        .when(k % 3 == 1, F.concat(scale, lit(" q"), s(k))).otherwise(F.concat(lit("free column "), s(k))))
    return H.number_other_headers(t.items.select(k.alias("pos"), header.alias("header")), "header", "pos").select("header", "new_name")


@query("P04_header_collisions", HEADER_SQL + """
, d AS (SELECT DISTINCT name, header FROM p), r AS (SELECT name, header, row_number() OVER (PARTITION BY name ORDER BY header) AS place, count(*) OVER (PARTITION BY name) AS n FROM d)
SELECT name, CASE WHEN place = 1 THEN n END AS n_headers, place, header FROM r WHERE n > 1
""")
def p04(t: Tables):
    parsed = H.parse_headers(header_table(t), "header").select("header", "name")
    return H.collisions(parsed, "header", "name")


@query("P05_question_selection", """
SELECT item, qno, count(*) AS n FROM ans WHERE regexp_matches(item, '^IT1') AND grader = 'supervisor' AND qno <= 5 GROUP BY ALL
""")
def p05(t: Tables):
    chosen = t.answers.filter(c("item").rlike("^IT1") & (c("grader") == "supervisor") & (c("qno") <= 5))
    return chosen.groupBy("item", "qno").agg(F.count("*").alias("n"))


@query("P06_existing_columns", "SELECT o_orderkey, o_orderpriority FROM orders")
def p06(t: Tables):
    return R.existing(t["orders"], ["o_orderkey", "o_clerk", "o_orderpriority", "o_comment"])


@query("P07_empty_columns", "SELECT form_id, es, es AS es_again FROM frm")
def p07(t: Tables):
    wide = t.forms.select("form_id", "es", lit(None).cast("string").alias("never"), "es", c("es").alias("es_again"))
    return R.without_empty_columns(R.without_duplicate_columns(wide))


@query("P07_filled_counts", """
SELECT 'es' AS column_name, count(es) AS n_filled FROM frm UNION ALL SELECT 'form_id', count(form_id) FROM frm UNION ALL SELECT 'never', CAST(0 AS BIGINT)
""")
def p07b(t: Tables):
    return R.filled_counts(t.forms.select("form_id", "es", lit(None).cast("string").alias("never")))


@query("P08_column_order", """
, q AS (SELECT item, qno, count(*) FILTER (outcome = 'Yes') AS total FROM ans GROUP BY ALL)
SELECT item, qno, total, row_number() OVER (ORDER BY total DESC, item, qno) AS place FROM q
""")
def p08(t: Tables):
    q = M.outcome_counts(t.answers, ["item", "qno"]).select("item", "qno", c("n_yes").alias("total"))
    return row_numbers(q, [], [F.desc("total"), "item", "qno"], F.floor(-c("total") / 1000), "place")


@query("P09_order_by_number", """
, l AS (SELECT DISTINCT 'MC' || part_id AS label, part_id FROM itm)
SELECT label, row_number() OVER (ORDER BY part_id) AS place FROM l
""")
def p09(t: Tables):
    labels = t.items.select(F.concat(lit("MC"), s(c("part_id"))).alias("label")).distinct()
    numbered = labels.withColumn("_no", F.regexp_extract("label", r"MC(\d+)", 1).cast("bigint"))
    return row_numbers(numbered, [], ["_no"], F.floor(c("_no") / 10_000), "place").drop("_no")


@query("P10_merged_columns", """
SELECT form_id, trim(CASE WHEN form_id % 3 = 0 THEN '' ELSE '531 CLINIC' END || ', ' || CASE WHEN form_id % 2 = 0 THEN '' ELSE '121 SIM' END, ', ') AS service FROM frm
""")
def p10(t: Tables):
    a = F.when(c("form_id") % 3 != 0, "531 CLINIC")
    b = F.when(c("form_id") % 2 != 0, "121 SIM")
    return t.forms.select("form_id", X.joined_pair(a, b).alias("service"))


@query("P11_other_choice", "SELECT form_id, CASE WHEN ps = 1 THEN 'Marker ' || cs ELSE 'Listed ' || ps END AS marker_name FROM frm")
def p11(t: Tables):
    choice = F.when(c("ps") == 1, "Other").otherwise(F.concat(lit("Listed "), s(c("ps"))))
    return t.forms.select("form_id", X.other_if_other(choice, F.concat(lit("Marker "), s(c("cs")))).alias("marker_name"))


@query("P12_split_label", "SELECT section, sub, count(*) AS n FROM itm GROUP BY ALL")
def p12(t: Tables):
    label = F.split(F.concat_ws("_", "section", "sub"), "_")
    return t.items.groupBy(F.get(label, lit(0)).alias("section"), F.get(label, lit(1)).alias("sub")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- filters


@query("F01_equal_value", "SELECT form_id, clinic FROM frm WHERE clinic = 'Clinic 5-LOW'")
def f01(t: Tables):
    return t.forms.filter(c("clinic") == "Clinic 5-LOW").select("form_id", "clinic")


@query("F02_roster_split", """
, r AS (SELECT student_id FROM stu WHERE cohort = 'BUILDING')
SELECT 'kept' AS part, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM frm WHERE student_id IN (SELECT student_id FROM r)
UNION ALL SELECT 'rejected', count(*), CAST(sum(cents) AS BIGINT) FROM frm WHERE student_id NOT IN (SELECT student_id FROM r)
""")
def f02(t: Tables):
    kept, others = CL.roster_split(t.forms, t.students.filter("cohort = 'BUILDING'"), "student_id")
    both = kept.withColumn("part", lit("kept")).unionByName(others.withColumn("part", lit("rejected")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("F03_test_identities", "SELECT student_id FROM stu WHERE student_id % 3 = 0 AND student_id % 4 <> 0")
def f03(t: Tables):
    k = c("student_id")
    name = F.when(k % 3 == 1, "Test person").when(k % 3 == 2, " ").when(k % 4 == 0, lit(None)).otherwise(c("student_name"))
    return CL.real_names(t.students.withColumn("name", name), "name", ["test", "fake"]).select("student_id")


@query("F04_denied_ids", "SELECT form_id FROM frm WHERE student_id NOT IN (0, 1, 12, 123)")
def f04(t: Tables):
    return t.forms.filter(~c("student_id").isin(0, 1, 12, 123)).select("form_id")


@query("F05_date_range", "SELECT form_id FROM frm WHERE form_date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def f05(t: Tables):
    return t.forms.filter(c("form_date").between("1996-01-01", "1997-06-30")).select("form_id")


@query("F06_listed_dates", "SELECT form_id FROM frm WHERE form_date IN (DATE '1996-01-01', DATE '1997-06-30', DATE '1998-05-05')")
def f06(t: Tables):
    days = [lit(d).cast("date") for d in ("1996-01-01", "1997-06-30", "1998-05-05")]
    return t.forms.filter(c("form_date").isin(*days)).select("form_id")


@query("F07_resit_rule", """
SELECT form_id, student_id FROM frm WHERE NOT (month(form_date) = 8 AND student_id IN (SELECT student_id FROM frm WHERE month(form_date) = 10))
""")
def f07(t: Tables):
    return CL.resit_rule(t.forms, "student_id", "form_date", 8, 10).select("form_id", "student_id")


@query("F08_numeric_range", "SELECT form_id, CAST(age2 AS DOUBLE) AS age FROM frm WHERE form_id % 5 <> 0 AND age2 BETWEEN 0 AND 17.9")
def f08(t: Tables):
    text = F.when(c("form_id") % 5 == 0, "n/a").otherwise(s(c("age2")))
    return t.forms.withColumn("age", X.lenient_number(text)).filter(c("age").between(0, 17.9)).select("form_id", "age")


@query("F09_meaningful_text", "SELECT form_id FROM frm WHERE form_id % 5 IN (3, 4)")
def f09(t: Tables):
    text = F.when(c("form_id") % 5 == 0, lit(None)).when(c("form_id") % 5 == 1, "  ").when(c("form_id") % 5 == 2, " N/A ").otherwise("spilled")
    return t.forms.filter(CL.meaningful(text, ["n/a", "none", "nil"])).select("form_id")


@query("F10_item_in_list", """
SELECT form_id FROM frm WHERE 'IT' || (form_id % 12) = 'IT3' OR 'IT' || (student_id % 12) = 'IT3'
""")
def f10(t: Tables):
    items = F.array(F.concat(lit("IT"), s(c("form_id") % 12)), F.concat(lit("IT"), s(c("student_id") % 12)))
    return t.forms.filter(F.array_contains(items, "IT3")).select("form_id")


@query("F11_any_column", "SELECT form_id FROM frm WHERE (age1 < 18 OR age2 < 18) AND (age1 >= 3 OR age2 >= 3) AND es IS NOT NULL")
def f11(t: Tables):
    ages = F.array("age1", "age2")
    keep = F.exists(ages, lambda a: a < 18) & F.exists(ages, lambda a: a >= 3)
    return t.forms.filter(keep).dropna(how="all", subset=["es"]).select("form_id")


@query("F12_role_finished_clinic", "SELECT form_id FROM frm WHERE role LIKE '%Operator%' AND lower(finished) IN ('true', '1') AND clinic <> 'Clinic 1-URGENT'")
def f12(t: Tables):
    done = F.lower("finished").isin("true", "1")
    return t.forms.filter(c("role").contains("Operator") & done & (c("clinic") != "Clinic 1-URGENT")).select("form_id")


@query("F13_keyword_and_dates", "SELECT form_id FROM frm WHERE lower(clinic) LIKE '%urgent%' AND form_date >= DATE '1997-01-01' AND form_date < DATE '1998-01-01'")
def f13(t: Tables):
    return t.forms.filter(F.lower("clinic").contains("urgent") & (c("form_date") >= "1997-01-01") & (c("form_date") < "1998-01-01")).select("form_id")


ROLE_SQL = """
, ro AS (SELECT form_id, item, qno, max(outcome) FILTER (grader = 'student') AS stu_answer, max(outcome) FILTER (grader = 'supervisor') AS sup_answer
         FROM ans GROUP BY ALL)
"""


def by_role(t: Tables):
    o = c("outcome")
    return t.answers.groupBy("form_id", "item", "qno").agg(
        F.max(F.when(c("grader") == "student", o)).alias("stu_answer"), F.max(F.when(c("grader") == "supervisor", o)).alias("sup_answer"))


@query("F14_answers_differ", ROLE_SQL + "SELECT * FROM ro WHERE stu_answer IS NOT NULL AND stu_answer IS DISTINCT FROM sup_answer")
def f14(t: Tables):
    return by_role(t).filter(c("stu_answer").isNotNull() & ~c("stu_answer").eqNullSafe(c("sup_answer")))


@query("F15_group_size", "SELECT form_id FROM ans GROUP BY form_id HAVING count(*) >= 5")
def f15(t: Tables):
    return CL.large_groups(t.answers.select("form_id"), "form_id", 5).distinct()


@query("F16_numeric_ids", "SELECT page_id, regexp_extract(url, '([^/]+)$', 1) AS last FROM pages WHERE regexp_matches(regexp_extract(url, '([^/]+)$', 1), '^[0-9]+$')")
def f16(t: Tables):
    last = F.regexp_extract("url", r"([^/]+)$", 1)
    return t["pages"].select("page_id", last.alias("last")).filter(c("last").rlike("^[0-9]+$"))


@query("F17_level_in_text", "SELECT form_id FROM frm WHERE es = 2")
def f17(t: Tables):
    return t.forms.filter(F.coalesce(c("es_text").contains("Lvl 2"), lit(False))).select("form_id")


# ---------------------------------------------------------------- scalar rules


@query("X01_lenient_dates", """
SELECT form_id, CASE WHEN form_id % 5 < 4 THEN strftime(form_date, '%d/%m/%Y') END AS day FROM frm
""")
def x01(t: Tables):
    d, k = c("form_date"), c("form_id")
    ordinal = F.concat(F.dayofmonth(d).cast("string"), pick(k % 4, ["st", "nd", "rd", "th"]), F.date_format(d, " MMM yyyy"))
    text = (F.when(k % 5 == 0, F.date_format(d, "dd/MM/yyyy")).when(k % 5 == 1, s(d)).when(k % 5 == 2, ordinal)
            .when(k % 5 == 3, F.date_format(d, "d MMMM yyyy")).otherwise("zz"))
    return t.forms.select("form_id", D.to_day_text(text).alias("day"))


@query("X02_date_parts", """
SELECT form_id, CAST(month(form_date) AS BIGINT) AS month, strftime(form_date, '%d/%m') AS day_month, CAST(day(form_date) AS BIGINT) AS day FROM frm
""")
def x02(t: Tables):
    d = F.to_date(F.try_to_timestamp(F.date_format("form_date", "yyyy-MM-dd"), lit("yyyy-MM-dd")))
    return t.forms.select("form_id", F.month(d).cast("bigint").alias("month"), F.date_format(d, "dd/MM").alias("day_month"),
                          F.get(F.split(s(d), "-"), lit(2)).cast("bigint").alias("day"))


@query("X05_lenient_number", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def x05(t: Tables):
    return t["events"].select("event_id", X.lenient_number(F.get_json_object("props", "$.k")).alias("k"))


PHRASES = ["Able to perform task/s independently", "Competent/Independent", "Dependent/Close supervision required",
           "Not yet able to perform task/s.", "Not observed", "something else"]


@query("X07_phrase_levels", """
SELECT form_id, [4, 4, 2, 1, NULL, NULL][form_id % 6 + 1] AS level FROM frm
""")
def x07(t: Tables):
    return t.forms.select("form_id", X.phrase_level(pick(c("form_id") % 6, PHRASES)).alias("level"))


CODES = ["011", "013", "121", "414", "415", "416", "417", "531", "587", "711", "941", "022", "579", "744"]
WORDS = ["SIM", "CLINIC", "remin", "cariostatic", "Cvek", "Finish", "review", "Paeds Specific", "SIM Access", "SIM Cone fit", "+2", "insert"]
SERVICE_SQL = f"""
, sv AS (SELECT form_id, qno, {CODES}[part_id % 14 + 1] AS code, {WORDS}[marker % 12 + 1] AS word, marker % 2 = 0 AS sim FROM ans),
bt AS (SELECT *, CASE WHEN word LIKE 'SIM%' THEN 'SIM' WHEN word = 'CLINIC' THEN 'CLINIC' WHEN sim THEN 'SIM' ELSE 'CLINIC' END AS base FROM sv WHERE code <> '941'),
tg AS (SELECT form_id, qno, code, CASE
   WHEN code = '011' THEN 'COE' WHEN code = '022' THEN 'I/O RAD'
   WHEN code = '013' THEN CASE WHEN word = 'Paeds Specific' THEN 'PAEDS SPECIFIC' ELSE 'LIMITED OE' END
   WHEN code = '744' AND word = 'insert' THEN 'RELINING INSERT'
   WHEN code = '711' AND word = 'Finish' THEN 'FINISH' WHEN code = '711' AND word = 'review' THEN 'REVIEW'
   WHEN code = '121' AND word = 'remin' THEN base || ' REMIN' WHEN code = '121' AND word = 'cariostatic' THEN base || ' CARIOSTATIC'
   WHEN code = '416' AND word = '+2' THEN base || ' +2' WHEN code = '416' THEN base || ' RCT ADD'
   WHEN code = '414' AND word = 'Cvek' THEN base || ' CVEK'
   WHEN code = '415' AND word = 'SIM Access' THEN 'SIM ACCESS' WHEN code = '417' AND word = 'SIM Cone fit' THEN 'SIM CONE FIT'
   WHEN code = '587' AND base = 'SIM' THEN 'SIM TOOTH PREP' WHEN code = '579' AND base = 'SIM' THEN 'BONDING'
   ELSE base END AS tag FROM bt)
"""


def services(t: Tables):
    text = F.concat(pick(c("part_id") % 14, CODES), lit(" "), pick(c("marker") % 12, WORDS), lit(",7"))
    place = F.when(c("marker") % 2 == 0, "Simulation").otherwise("CLINIC")
    return t.answers.select("form_id", "qno", text.alias("service"), place.alias("place"))


@query("X08_procedure_codes", SERVICE_SQL + "SELECT code, tag, count(*) AS n FROM tg GROUP BY ALL")
def x08(t: Tables):
    """Equal texts are counted first, so each different text is taken apart once."""
    texts = services(t).groupBy("service", "place").agg(F.count("*").alias("n"))
    found = texts.select("n", F.inline(C.procedure_codes(c("service"), c("place"))))
    return found.groupBy("code", "tag").agg(F.sum("n").alias("n"))


@query("X09_general_services", """
SELECT upper(code) AS code, upper(tag) AS tag, count(*) AS n FROM (
  SELECT 'LA' AS code, ['Infiltration', 'Block'][form_id % 2 + 1] AS tag FROM frm
  UNION ALL SELECT 'RUBBER', ['dam one', 'dam two', 'dam three'][form_id % 3 + 1] FROM frm) GROUP BY ALL
""")
def x09(t: Tables):
    text = F.concat(lit("LA given ("), pick(c("form_id") % 2, ["Infiltration", "Block"]), lit("), RUBBER ("),
                    pick(c("form_id") % 3, ["dam one", "dam two", "dam three"]), lit(")"))
    return t.forms.select(F.inline(C.general_services(text))).groupBy("code", "tag").agg(F.count("*").alias("n"))


@query("X10_split_by_code", SERVICE_SQL + """
SELECT code || '_' || tag AS code_key, count(DISTINCT form_id) AS n_forms, count(*) AS n_with_repeats FROM tg GROUP BY ALL
""")
def x10(t: Tables):
    found = services(t).select("form_id", F.inline(C.procedure_codes(c("service"), c("place"))))
    per_form = found.groupBy("form_id", C.code_key(c("code"), c("tag")).alias("code_key")).agg(F.count("*").alias("n"))
    return per_form.groupBy("code_key").agg(F.count("*").alias("n_forms"), F.sum("n").alias("n_with_repeats"))


@query("X11_code_cleaner", """
, e AS (SELECT part_id, 10 + part_id % 90 AS two, 100 + part_id % 900 AS three FROM itm)
SELECT part_id, CASE part_id % 7 WHEN 0 THEN three || ',' || three || ',' || three WHEN 1 THEN '0' || two WHEN 2 THEN three || ',022,' || three
   WHEN 3 THEN 'LA,' || three WHEN 4 THEN '' WHEN 5 THEN '01' || substr(CAST(three AS VARCHAR), 1, 1) ELSE CAST(three AS VARCHAR) END AS codes FROM e
""")
def x11(t: Tables):
    k, two, three = c("part_id"), s(c("part_id") % 90 + 10), s(c("part_id") % 900 + 100)
    entry = (
        F.when(k % 7 == 0, F.concat(three, lit(" x 3"))).when(k % 7 == 1, two).when(k % 7 == 2, F.concat(three, lit("022"), three))
        .when(k % 7 == 3, F.concat(lit("LA, "), three)).when(k % 7 == 4, "n/a").when(k % 7 == 5, F.concat(lit("1"), three))
        .otherwise(F.concat(lit("2 of "), three, lit(" and "), two)))
    return t.items.select("part_id", F.array_join(C.clean_codes(entry), ",").alias("codes"))


@query("X12_short_codes", """
SELECT code, count(*) AS n FROM (SELECT CAST(100 + part_id % 200 AS VARCHAR) || CASE WHEN part_id % 2 = 0 THEN 'A' ELSE '' END AS code FROM ans) GROUP BY code
""")
def x12(t: Tables):
    text = F.concat(lit("did "), s(c("part_id") % 200 + 100), F.when(c("part_id") % 2 == 0, "A").otherwise(""), lit(" on 12 and 4567"))
    return t.answers.select(F.explode(C.short_codes(text)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("X13_readable_codes", """
, e AS (SELECT part_id, 100 + part_id % 900 AS three, part_id % 90 + 10 AS two FROM itm)
SELECT part_id, CASE part_id % 5 WHEN 0 THEN CAST(three AS VARCHAR) WHEN 1 THEN '0' || two WHEN 2 THEN '0' || two || '/011'
   WHEN 3 THEN '12' || three ELSE 'took an extra' END AS readable FROM e
""")
def x13(t: Tables):
    k, two, three = c("part_id"), s(c("part_id") % 90 + 10), s(c("part_id") % 900 + 100)
    raw = (F.when(k % 5 == 0, F.concat(lit("did "), three, lit(" today"))).when(k % 5 == 1, two).when(k % 5 == 2, F.concat(two, lit("-11")))
           .when(k % 5 == 3, F.concat(lit("12"), three)).otherwise("took an extra picture of the jaw"))
    return t.items.select("part_id", C.readable_code(raw).alias("readable"))


@query("X14_patient_count", """
SELECT form_id, CASE form_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN greatest(1, form_id % 4 + 1) ELSE form_id % 3 + 1 END AS n_patients,
       form_id % 7 = 0 AS is_fta, form_id % 7 IN (0, 1) AS is_fta_strict FROM frm
""")
def x14(t: Tables):
    text = c("patients_text")
    return t.forms.select("form_id", X.patient_count(text).alias("n_patients"), X.failed_to_attend(text).alias("is_fta"),
                          X.failed_to_attend(text, strict=True).alias("is_fta_strict"))


@query("X15_tooth_number", """
SELECT part_id, CASE WHEN part_id % 3 < 2 THEN CAST(11 + part_id % 30 AS VARCHAR) END AS tooth,
       CASE part_id % 3 WHEN 0 THEN '24' WHEN 1 THEN '11' ELSE '24' END AS standard FROM itm
""")
def x15(t: Tables):
    k = c("part_id")
    text = F.when(k % 3 < 2, F.concat(lit("CROWN TOOTH "), s(k % 30 + 11), lit(" DONE"))).otherwise("none")
    loose = F.when(k % 3 == 0, " Upper Premolar").when(k % 3 == 1, "central INCISOR").otherwise("tooth 45")
    return t.items.select("part_id", X.tooth_number(text).alias("tooth"), X.standard_tooth(loose).alias("standard"))


@query("X16_age_bands", """
SELECT form_id, CASE WHEN age2 <= 6 THEN '0-6' WHEN age2 <= 17 THEN '7-17' WHEN age2 < 140 THEN '18+' END AS band FROM frm
""")
def x16(t: Tables):
    return t.forms.select("form_id", X.age_band(c("age2")).alias("band"))


@query("X17_absence_reasons", """
SELECT ['Cancellation', 'No Booking', 'Unable to Fill', 'Assigned as Assistant', 'Other', 'Cancellation'][form_id % 6 + 1] AS reason, count(*) AS n
FROM frm GROUP BY ALL
""")
def x17(t: Tables):
    text = pick(c("form_id") % 6, ["Patient Cancelled", "There was no time to book", "could not FILL the chair", "was the assistant", "sick", "FTA again"])
    return t.forms.groupBy(X.absence_reason(text).alias("reason")).agg(F.count("*").alias("n"))


@query("X18_initials", "SELECT part_id, upper(substr(split_part(item_name, ' ', 1), 1, 1)) || upper(substr(split_part(item_name, ' ', 2), 1, 1)) AS initials FROM itm")
def x18(t: Tables):
    return t.items.select("part_id", X.initials(c("item_name")).alias("initials"))


@query("X19_strip_characters", r"""
SELECT doc_id, regexp_replace(text, '[^\x09\x0A\x20-\x7E]', '', 'g') AS ascii_text, length(regexp_replace(text, '[^A-Za-z0-9 .,\-]', '', 'g')) AS n_kept FROM documents
""")
def x19(t: Tables):
    return t["documents"].select("doc_id", X.strip_non_ascii(c("text")).alias("ascii_text"),
                                 F.length(X.keep_word_characters(c("text"))).cast("bigint").alias("n_kept"))


@query("X20_clean_headers", "SELECT part_id, lower(item_name) AS name, upper(substr(item_name, 1, 1)) AS first FROM itm")
def x20(t: Tables):
    raw = F.concat(lit("  "), F.upper("item_name"), lit("  "))
    return t.items.select("part_id", X.clean_header(raw).alias("name"), F.left(F.initcap("item_name"), lit(1)).alias("first"))


@query("X21_short_labels", """
SELECT CASE WHEN clinic = 'Clinic 1-URGENT' THEN 'PC Emergency' ELSE clinic END AS clinic, count(*) AS n FROM frm GROUP BY ALL
""")
def x21(t: Tables):
    raw = F.when(c("clinic") == "Clinic 1-URGENT", F.concat(lit("City EMERGENCY "), s(c("ps")))).otherwise(c("clinic"))
    return t.forms.groupBy(X.site_word(raw).alias("clinic")).agg(F.count("*").alias("n"))


@query("X37_json_flatten", """
SELECT event_id, json_extract_string(props, '$.k') AS k, '{"type":"' || event_type || '","user":"' || user_id || '"}' AS remaining FROM events
""")
def x37(t: Tables):
    whole = F.map_concat(J.parse_map(c("props")), F.create_map(lit("type"), c("event_type"), lit("user"), s(c("user_id"))))
    return t["events"].withColumn("m", whole).select("event_id", c("m")["k"].alias("k"), F.to_json(J.without(c("m"), ["k"])).alias("remaining"))


def answer_map(t: Tables):
    key = lambda role, item: F.concat(lit(role + "_"), item, lit("_MC"), s(c("qno")))
    m = F.create_map(key("assessor", c("item")), c("raw"), key("student", F.concat(lit("X"), c("item"))), lit("Yes"),
                     lit("assessor_PEC_MC1"), lit("No"), lit("student_CC_MC2"), lit("No"))
    return t.answers.withColumn("m", m)


@query("X38_items_in_keys", "SELECT item || ',X' || item AS items, count(*) AS n FROM ans GROUP BY ALL")
def x38(t: Tables):
    return answer_map(t).groupBy(F.array_join(J.items_of(c("m")), ",").alias("items")).agg(F.count("*").alias("n"))


@query("X39_nested_scores", """
SELECT form_id, 'checklist_' || k AS name, v AS value FROM (SELECT form_id, unnest(['Yes', 'No', 'NA']) AS k, unnest([n_yes, n_no, n_na]) AS v FROM fc)
""")
def x39(t: Tables):
    inner = F.create_map(lit("Yes"), c("n_yes"), lit("No"), c("n_no"), lit("NA"), c("n_na"))
    nested = t.form_counts.select("form_id", F.explode(F.create_map(lit("checklist"), inner)).alias("outer", "m"))
    return nested.select("form_id", "outer", F.explode("m").alias("inner", "value")).select(
        "form_id", F.concat_ws("_", "outer", "inner").alias("name"), "value")


@query("X40_lenient_json", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS n_keys FROM events
""")
def x40(t: Tables):
    text = F.when(c("event_id") % 4 == 0, F.concat(lit("{broken "), c("props"))).otherwise(F.replace(c("props"), lit('"'), lit("'")))
    m = J.parse_map(text)
    return t["events"].select("event_id", F.try_element_at(m, lit("k")).alias("k"), F.size(m).alias("n_keys"))


@query("X41_items_present", """
SELECT form_id, CAST(0 AS BIGINT) AS segment, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM ans WHERE outcome IS NOT NULL GROUP BY form_id
""")
def x41(t: Tables):
    items = joined_distinct(t.answers.filter(c("outcome").isNotNull()), ["form_id"], "item", ",", "items")
    return items.select("form_id", lit(0).cast("bigint").alias("segment"), "items")


@query("X42_items_of_services", """
SELECT form_id, concat_ws(', ', CASE WHEN ps > 1 THEN '531, 532' END, CASE WHEN cs > 2 THEN '121' END, CASE WHEN incident = 'Yes' THEN 'LA' END) AS items FROM frm
""")
def x42(t: Tables):
    cols = [F.when(c("ps") > 1, "531 ,532").otherwise("nan"), F.when(c("cs") > 2, "121")]
    return t.forms.select("form_id", F.array_join(C.items_of_services(cols, c("incident")), ", ").alias("items"))


@query("X43_pseudonyms", """
, f AS (SELECT student_id, min(form_id) AS first_seen FROM frm GROUP BY student_id)
SELECT student_id, first_seen, row_number() OVER (ORDER BY first_seen) AS number FROM f
""")
def x43(t: Tables):
    return CL.pseudonyms(t.forms, "student_id", "form_id", F.floor(c("first_seen") / 100_000))


@query("X45_corrections", "SELECT form_id, CASE WHEN incident = 'Yes' AND es IS NULL THEN 'Observer' ELSE role END AS role FROM frm")
def x45(t: Tables):
    wrong = t.forms.filter("incident = 'Yes' AND es IS NULL").select(
        "form_id", lit("role").alias("column"), c("role").alias("old"), lit("Observer").alias("new"))
    return CL.apply_corrections(t.forms, wrong, "form_id", "role").select("form_id", "role")


@query("X46_joined_text_columns", "SELECT form_id, concat_ws(chr(10), CASE WHEN es IS NOT NULL THEN es_text END, clinic, CASE WHEN incident = 'Yes' THEN 'CI' END) AS remarks FROM frm")
def x46(t: Tables):
    return t.forms.select("form_id", F.concat_ws(
        "\n", F.when(c("es").isNotNull(), c("es_text")), "clinic", F.when(c("incident") == "Yes", "CI")).alias("remarks"))


@query("X49_plain_punctuation", """SELECT part_id, '"' || item_name || '" - ' || sub || '''s...' AS label FROM itm""")
def x49(t: Tables):
    raw = F.concat(lit("“"), c("item_name"), lit("” – "), c("sub"), lit("’s…é"))
    return t.items.select("part_id", X.plain_punctuation(raw).alias("label"))


@query("X50_frequent_codes", """
, k AS (SELECT clinic, CASE form_id % 4 WHEN 0 THEN CAST(form_id % 300 + 100 AS VARCHAR) WHEN 1 THEN '022' WHEN 2 THEN NULL ELSE CAST(form_id AS VARCHAR) END AS code FROM frm),
n AS (SELECT clinic, code, count(*) AS n FROM k WHERE code IS NOT NULL AND length(code) <= 5 GROUP BY ALL)
SELECT * FROM n WHERE n >= 2
""")
def x50(t: Tables):
    k = c("form_id")
    code = (F.when(k % 4 == 0, F.concat(s(k % 300 + 100), lit(".,"))).when(k % 4 == 1, " 022").when(k % 4 == 2, "nan").otherwise(s(k)))
    return CL.frequent_codes(t.forms.select("clinic", code.alias("code")), ["clinic"], "code")
