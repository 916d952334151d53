"""How the given tables read as assessment data, and the query registry."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.functions import outcome as O
from markloom.functions import scoring as S
from markloom.operators import marks as M
from markloom.session import bound_tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy frames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        bound_tasks(spark)

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def answers(self) -> DataFrame:
        """One row per marked question. (form, question) repeats: markings are repeated."""
        c = F.col
        raw = (
            F.when(c("l_discount") < 0.005, "").when(c("l_returnflag") == "A", "Yes")
            .when(c("l_returnflag") == "R", "No").otherwise("Not Reviewed")
        )
        return self["lineitem"].select(
            c("l_orderkey").alias("form_id"), c("l_linenumber").cast("bigint").alias("qno"),
            F.concat(F.lit("IT"), (c("l_partkey") % 12).cast("string")).alias("item"),
            c("l_partkey").alias("part_id"), c("l_suppkey").alias("marker"),
            F.when(c("l_linestatus") == "F", "supervisor").otherwise("student").alias("grader"),
            raw.alias("raw"), O.normalise(raw).alias("outcome"),
            (c("l_quantity").cast("bigint") % 4 + 1).alias("level"),
            S.cents(c("l_extendedprice")).alias("cents"), F.to_date("l_shipdate").alias("day"),
        )

    @cached_property
    def forms(self) -> DataFrame:
        """One row per submitted form."""
        c = F.col
        key, cents = c("o_orderkey"), S.cents(c("o_totalprice"))
        return self["orders"].select(
            key.alias("form_id"), c("o_custkey").alias("student_id"), F.to_date("o_orderdate").alias("form_date"),
            F.when(c("o_orderpriority") == "1-URGENT", "Yes").otherwise("No").alias("incident"),
            F.concat(F.lit("Clinic "), "o_orderpriority").alias("clinic"),
            F.when(c("o_orderstatus") == "F", "Simulation").otherwise("Clinic").alias("setting"),
            F.when(key % 3 == 0, "Operator").when(key % 3 == 1, "Assistant").otherwise("Operator,Observer").alias("role"),
            (key % 4 + 1).alias("ps"), (c("o_custkey") % 4 + 1).alias("cs"),
            (F.dayofmonth("o_orderdate") % 4 + 1).cast("bigint").alias("ts"),
            F.when(cents % 5 > 0, cents % 5).alias("es"),
            F.when(cents % 5 > 0, F.concat(F.lit("Lvl "), (cents % 5).cast("string"), F.lit(" - supervised")))
            .otherwise("not assessed").alias("es_text"),
            F.when(key % 7 == 0, "Patient FTA").when(key % 7 == 1, "")
            .when(key % 7 == 2, F.concat(F.lit("Patient 1-"), (key % 4 + 1).cast("string")))
            .otherwise(F.concat(F.lit("Patient "), (key % 3 + 1).cast("string"))).alias("patients_text"),
            (key % 90).alias("age1"), (cents % 160).alias("age2"), cents.alias("cents"),
            F.when(key % 4 == 0, "True").when(key % 4 == 1, "true").when(key % 4 == 2, "0")
            .otherwise("False").alias("finished"),
        )

    @cached_property
    def students(self) -> DataFrame:
        c = F.col
        return self["customer"].select(
            c("c_custkey").alias("student_id"), c("c_name").alias("student_name"),
            c("c_mktsegment").alias("cohort"), c("c_nationkey").alias("home"),
        )

    @cached_property
    def items(self) -> DataFrame:
        """Question bank: section, sub-section, importance weight and pass probability of an item."""
        c = F.col
        return self["part"].select(
            c("p_partkey").alias("part_id"), c("p_type").alias("section"), c("p_brand").alias("sub"),
            (c("p_size") % 10 + 1).cast("bigint").alias("weight"), (c("p_size") % 5 + 1).cast("bigint").alias("tenths"),
            c("p_name").alias("item_name"),
        )

    @cached_property
    def form_counts(self) -> DataFrame:
        return M.outcome_counts(self.answers, ["form_id"])

    @cached_property
    def form_scores(self) -> DataFrame:
        """Forms with counts and checklist score; answers are counted before they meet the forms."""
        return M.checklist_scores(self.form_counts).join(self.forms, "form_id")

    @cached_property
    def question_counts(self) -> DataFrame:
        return M.outcome_counts(self.answers, ["form_id", "qno"])

    @cached_property
    def part_counts(self) -> DataFrame:
        return M.outcome_counts(self.answers, ["form_id", "part_id"])


BASE_SQL = """
WITH ans AS (
  SELECT l_orderkey AS form_id, CAST(l_linenumber AS BIGINT) AS qno, 'IT' || (l_partkey % 12) AS item,
         l_partkey AS part_id, l_suppkey AS marker,
         CASE WHEN l_linestatus = 'F' THEN 'supervisor' ELSE 'student' END AS grader,
         CASE WHEN l_discount < 0.005 THEN '' WHEN l_returnflag = 'A' THEN 'Yes'
              WHEN l_returnflag = 'R' THEN 'No' ELSE 'Not Reviewed' END AS raw,
         CASE WHEN l_discount < 0.005 THEN NULL WHEN l_returnflag = 'A' THEN 'Yes'
              WHEN l_returnflag = 'R' THEN 'No' ELSE 'NA' END AS outcome,
         CAST(l_quantity AS BIGINT) % 4 + 1 AS level,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_shipdate AS DATE) AS day
  FROM lineitem),
ord0 AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
frm AS (
  SELECT o_orderkey AS form_id, o_custkey AS student_id, CAST(o_orderdate AS DATE) AS form_date,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'Yes' ELSE 'No' END AS incident,
         'Clinic ' || o_orderpriority AS clinic,
         CASE WHEN o_orderstatus = 'F' THEN 'Simulation' ELSE 'Clinic' END AS setting,
         CASE o_orderkey % 3 WHEN 0 THEN 'Operator' WHEN 1 THEN 'Assistant' ELSE 'Operator,Observer' END AS role,
         o_orderkey % 4 + 1 AS ps, o_custkey % 4 + 1 AS cs,
         CAST(day(o_orderdate) % 4 + 1 AS BIGINT) AS ts,
         CASE WHEN cents % 5 > 0 THEN cents % 5 END AS es,
         CASE WHEN cents % 5 > 0 THEN 'Lvl ' || (cents % 5) || ' - supervised' ELSE 'not assessed' END AS es_text,
         CASE o_orderkey % 7 WHEN 0 THEN 'Patient FTA' WHEN 1 THEN ''
              WHEN 2 THEN 'Patient 1-' || (o_orderkey % 4 + 1)
              ELSE 'Patient ' || (o_orderkey % 3 + 1) END AS patients_text,
         o_orderkey % 90 AS age1, cents % 160 AS age2, cents,
         CASE o_orderkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'true' WHEN 2 THEN '0' ELSE 'False' END AS finished
  FROM ord0),
stu AS (SELECT c_custkey AS student_id, c_name AS student_name, c_mktsegment AS cohort, c_nationkey AS home FROM customer),
itm AS (SELECT p_partkey AS part_id, p_type AS section, p_brand AS sub, CAST(p_size % 10 + 1 AS BIGINT) AS weight,
               CAST(p_size % 5 + 1 AS BIGINT) AS tenths, p_name AS item_name FROM part),
fc AS (SELECT form_id, count(*) FILTER (outcome = 'Yes') AS n_yes, count(*) FILTER (outcome = 'No') AS n_no,
              count(*) FILTER (outcome = 'NA') AS n_na, count(*) FILTER (outcome IS NULL) AS n_blank
       FROM ans GROUP BY form_id),
fs AS (SELECT fc.*, CASE WHEN n_yes + n_no + n_na > 0
              THEN (n_yes + CAST(0.5 AS DOUBLE) * n_na) / (n_yes + n_no + CAST(0.5 AS DOUBLE) * n_na) END AS checklist_score,
              frm.* EXCLUDE (form_id)
       FROM fc JOIN frm USING (form_id)),
mk AS (SELECT ans.*, frm.student_id, frm.form_date, frm.clinic, frm.incident, frm.setting FROM ans JOIN frm USING (form_id))
"""


def query(name: str, sql: str | None = None):
    """Register a query under its inventory name, with the SQL it must equal."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            body = sql.strip()
            ORACLES[name] = BASE_SQL + (body if body.startswith(",") else "\n" + body)
        return fn

    return add


def r6(column):
    """Six decimals: sums of fractions may differ in the last bits with the order of rows."""
    return F.round(column, 6)
