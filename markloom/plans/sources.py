"""Sources and sinks (S and K ids): tables are landed in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom.functions import jsonmap as J
from markloom.operators import marks as M
from markloom.operators import ordering as ORD
from markloom.plans.base import Tables, query
from markloom.plans.cleaning import s
from markloom.session import landing_path
from markloom.sources import readers as RD
from markloom.sources import schemas
from markloom.sources import writers as WR

c, lit = F.col, F.lit


def land(t: Tables, df, name: str, fmt: str = "csv", **options) -> str:
    path = landing_path(t.spark, name)
    WR.write_table(df, path, fmt, **options)
    return path


@query("S01_read_sheet", "SELECT form_id, clinic, es, checklist_score FROM fs")
def s01(t: Tables):
    path = land(t, t.form_scores.select("form_id", "clinic", "es", "checklist_score"), "sheet", header="true")
    return RD.read_sheet(t.spark, path, "form_id bigint, clinic string, es bigint, checklist_score double")


@query("S02_read_all_sheets", "SELECT item, count(*) AS n, CAST(sum(level) AS BIGINT) AS levels FROM ans GROUP BY item")
def s02(t: Tables):
    path = landing_path(t.spark, "sheets")
    WR.write_per_key(t.answers.select("item", "form_id", "level"), path, ["item"])
    return RD.read_all_sheets(t.spark, path).groupBy("item").agg(F.count("*").alias("n"), F.sum("level").alias("levels"))


@query("S03_encodings", "SELECT student_id, 'Größe ' || cohort || ' é' AS label FROM stu")
def s03(t: Tables):
    frame = t.students.select("student_id", F.concat(lit("Größe "), "cohort", lit(" é")).alias("label"))
    path = land(t, frame, "latin", header="true", encoding="ISO-8859-1")
    return RD.read_csv_any_encoding(t.spark, path, "student_id bigint, label string")


@query("S04_two_row_header", """SELECT CAST(form_id AS VARCHAR) AS "Form | id", clinic AS "Form | clinic", CAST(ps AS VARCHAR) AS "Rubric | ps" FROM frm""")
def s04(t: Tables):
    head = t.spark.sql("SELECT * FROM VALUES (0, 'Form', '', 'Rubric'), (1, 'id', 'clinic', 'ps') AS h(o, a, b, d)").orderBy("o").drop("o")
    header = land(t, head.coalesce(1), "header")
    data = land(t, t.forms.select("form_id", "clinic", "ps"), "rows")
    return RD.read_two_row_header(t.spark, header, data)


@query("S05_json_payload", "SELECT event_id, user_id, json_extract_string(props, '$.k') AS k FROM events")
def s05(t: Tables):
    """Pages of at most a thousand records, as an export would send them."""
    e = t["events"].select("event_id", "user_id", J.parse_map(c("props")).alias("answers"))
    page = F.floor(c("event_id") / 1000).alias("page")
    pages = e.groupBy(page).agg(F.collect_list(F.struct("event_id", "user_id", "answers")).alias("result")).select("result")
    path = land(t, pages, "payload", "json")
    records = RD.read_payload(t.spark, path, "event_id: bigint, user_id: bigint, answers: map<string,string>")
    return records.select("event_id", "user_id", c("answers")["k"].alias("k"))


@query("S06_json_lookup", "SELECT n_name AS home_name, count(*) AS n FROM stu JOIN nation ON home = n_nationkey GROUP BY n_name")
def s06(t: Tables):
    """The lookup is one JSON object over the 25 nations; the students it names are counted first."""
    entries = t["nation"].agg(F.map_from_entries(F.collect_list(F.struct(s(c("n_nationkey")), "n_name"))).alias("m"))
    path = land(t, entries.select(F.to_json("m")), "lookup", "text")
    names = RD.read_lookup(t.spark, path).select(c("key").cast("int").alias("home"), c("value").alias("home_name"))
    return t.students.groupBy("home").agg(F.count("*").alias("n")).join(names, "home").select("home_name", "n")


@query("S07_values_in_file_names", "SELECT setting AS rotation, CAST(year(form_date) AS VARCHAR) AS year, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM frm GROUP BY ALL")
def s07(t: Tables):
    path = landing_path(t.spark, "rotations")
    WR.write_per_key(t.forms.select("setting", F.year("form_date").alias("year"), "cents"), path, ["setting", "year"])
    files = RD.read_named_files(t.spark, path, {"rotation": r"setting=([A-Za-z]+)", "year": r"year=(\d+)"})
    return files.groupBy("rotation", "year").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("S08_na_token", "SELECT CAST(form_id AS VARCHAR) AS form_id, CASE WHEN ps = 1 THEN 'NA' WHEN ps = 2 THEN NULL ELSE clinic END AS answer FROM frm")
def s08(t: Tables):
    frame = t.forms.select("form_id", F.when(c("ps") == 1, "NA").when(c("ps") == 2, "").otherwise(c("clinic")).alias("answer"))
    return RD.read_text_columns(t.spark, land(t, frame, "tokens", header="true"))


@query("S09_label_row", "SELECT item AS column_name, 'Question of ' || item AS full_text, count(*) AS n FROM ans GROUP BY item")
def s09(t: Tables):
    """The label row is lifted off each export; its text meets the counted facts."""
    label = {"form_id": "Form number", "item": "Item", "level": "Level of the item"}
    facts = t.answers.select(s(c("form_id")).alias("form_id"), "item", s(c("level")).alias("level"))
    row = t.spark.range(1).select(*[lit(v).alias(k) for k, v in label.items()])
    path = land(t, facts.unionByName(row), "labelled", header="true")
    export = t.spark.read.option("header", "true").csv(path)
    questions, rows = RD.lift_label_row(t.spark, export, label)
    texts = questions.filter("column = 'item'").select(lit("Question of ").alias("full_text"))
    counts = rows.groupBy(c("item").alias("column_name")).agg(F.count("*").alias("n"))
    return counts.withColumn("full_text", F.concat(texts.scalar(), c("column_name")))


@query("S10_declared_form_table", """
SELECT form_id AS assessment_id, student_id AS student_number, strftime(form_date, '%Y-%m-%d') AS day, age1 AS patient_age, incident = 'Yes' AS submitted, CAST(ts AS DOUBLE) AS time_mgmt, clinic AS answer FROM frm
""")
def s10(t: Tables):
    record = F.struct(
        c("form_id").alias("assessment_id"), c("student_id").alias("student_number"), c("form_date").alias("date"), c("age1").alias("patient_age"),
        (c("incident") == "Yes").alias("student_submitted"), c("ts").alias("time_mgmt"), F.create_map(lit("student_IT1_MC1"), c("clinic")).alias("student_data"))
    path = land(t, t.forms.select(F.to_json(record).alias("value")), "forms", "text")
    forms = t.spark.read.schema(schemas.ASSESSMENT_FORM).json(path)
    return forms.select("assessment_id", "student_number", s(c("date")).alias("day"), c("patient_age").cast("bigint").alias("patient_age"),
                        c("student_submitted").alias("submitted"), "time_mgmt", c("student_data")["student_IT1_MC1"].alias("answer"))


@query("S11_roster", "SELECT student_id FROM stu WHERE cohort = 'BUILDING'")
def s11(t: Tables):
    return RD.roster(t.students.withColumn("student_id", s(c("student_id"))), "student_id", "BUILDING")


@query("S12_repaired_headers", "SELECT student_id, student_name AS name, cohort FROM stu")
def s12(t: Tables):
    drifted = t.students.select(c("student_id").alias("Student ID (7 digits)"), c("student_name").alias("Full name "), c("cohort").alias("Your COHORT"))
    return RD.repaired_headers(drifted, [("student id", "student_id"), ("name", "name"), ("cohort", "cohort")])


@query("S13_cohort_lookup", "SELECT student_id, cohort FROM stu WHERE home % 6 = 4")
def s13(t: Tables):
    labelled = t.students.withColumn("label", F.concat_ws(" ", "cohort", s(c("home") % 6 + 2020), lit("intake")))
    return RD.cohort_lookup(labelled, "student_id", "label", "2024")


@query("K01_write_table", "SELECT student_id, cohort FROM stu")
def k01(t: Tables):
    path = land(t, t.students.select("student_id", "cohort"), "table", "parquet")
    return t.spark.read.parquet(path)


@query("K02_write_per_key", "SELECT clinic, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM frm GROUP BY clinic")
def k02(t: Tables):
    path = landing_path(t.spark, "clinics")
    WR.write_per_key(t.forms.select("clinic", "form_id", "cents"), path, ["clinic"])
    return t.spark.read.parquet(path).groupBy("clinic").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("K03_replace_keys", "SELECT setting, count(*) AS n, CAST(sum(CASE setting WHEN 'Clinic' THEN cents ELSE 0 END) AS BIGINT) AS cents FROM frm GROUP BY setting")
def k03(t: Tables):
    path = landing_path(t.spark, "replaced")
    frame = t.forms.select("setting", "form_id", "cents")
    WR.write_per_key(frame, path, ["setting"])
    WR.replace_keys(frame.filter("setting = 'Simulation'").withColumn("cents", lit(0).cast("bigint")), path, ["setting"])
    return t.spark.read.parquet(path).groupBy("setting").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("K04_incremental_rerun", "SELECT item, count(*) FILTER (outcome = 'Yes') AS n_yes, count(*) FILTER (outcome = 'No') AS n_no FROM ans GROUP BY item")
def k04(t: Tables):
    """The first run knows some items only; the second adds the missing ones and leaves the rest alone."""
    path = landing_path(t.spark, "items")
    work = lambda a: M.outcome_counts(a, ["item"]).select("n_yes", "n_no", "item")
    WR.rerun_missing(t.answers.filter(c("item").isin("IT0", "IT3", "IT7")), path, "item", work)
    WR.rerun_missing(t.answers, path, "item", work)
    return t.spark.read.parquet(path)


@query("K05_json_text", """SELECT form_id, '{"ps":' || ps || ',"clinic":"' || clinic || '"}' AS detail FROM frm""")
def k05(t: Tables):
    nested = t.forms.select("form_id", F.struct("ps", "clinic").alias("detail"))
    return t.spark.read.parquet(land(t, WR.with_json_text(nested, ["detail"]), "json-text", "parquet"))


@query("K06_flat_and_nested", """
SELECT event_id, json_extract_string(props, '$.k') AS k, '{"k":"' || json_extract_string(props, '$.k') || '"}' AS props FROM events
""")
def k06(t: Tables):
    path = landing_path(t.spark, "export")
    WR.write_flat_and_nested(t["events"].select("event_id", J.parse_map(c("props")).alias("props")), path, "props", ["k"])
    return t.spark.read.parquet(f"{path}/flat").join(t.spark.read.parquet(f"{path}/nested"), "event_id")


@query("K07_cluster_listing", """
SELECT label AS cluster, string_agg('- ' || vec_id, chr(10) ORDER BY vec_id) AS listing FROM embeddings GROUP BY label
""")
def k07(t: Tables):
    rows = t["embeddings"].select(c("label").alias("cluster"), "vec_id", F.concat(lit("- "), s(c("vec_id"))).alias("x"))
    listing = ORD.joined_text(rows, ["cluster"], ["vec_id"], F.floor(c("vec_id") / 10_000), "x", "\n", "listing")
    return t.spark.read.parquet(land(t, listing, "listing", "parquet"))
