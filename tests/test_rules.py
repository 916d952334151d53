"""Small frames that pin each rule."""

import pytest
from pyspark.sql import functions as F

from markloom.functions import codes as C
from markloom.functions import dates as D
from markloom.functions import headers as H
from markloom.functions import jsonmap as J
from markloom.functions import outcome as O
from markloom.functions import scoring as S
from markloom.functions import text as X
from markloom.operators import cleaning as CL
from markloom.operators import marks as M
from markloom.operators import reshape as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def text_of(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_outcomes(spark):
    raw = ["Yes", "Completed", "No", "Not completed", "Not Reviewed", "Not observed or not recorded",
           "Not observed or recorded", "Not Assessed", "", "None", None]
    want = ["Yes", "Yes", "No", "No", "NA", "NA", "NA", "NA", None, None, None]
    assert text_of(spark, O.normalise, raw) == want
    assert text_of(spark, lambda v: O.normalise(v, "No"), ["Not Reviewed", "Not Assessed"]) == ["No", "NA"]


@pytest.mark.parametrize("marks, best", [
    (["Yes", "Yes"], "Yes"), (["No"], "No"), (["NA", None], "NA"), ([None, None], None), (["No", "Yes", "NA"], "Yes"), (["NA", "No"], "No")])
def test_merge_of_repeated_markings(spark, marks, best):
    df = spark.createDataFrame([(m,) for m in marks], "o string")
    assert df.agg(O.merged(F.col("o")).alias("x")).first()["x"] == best
    counted = df.agg(*O.counts(F.col("o")))
    assert counted.select(O.merged_from_counts(F.col("n_yes"), F.col("n_no"), F.col("n_na")).alias("x")).first()["x"] == best


@pytest.mark.parametrize("service, place, want", [
    ("531 CLINIC", "Simulation", [("531", "CLINIC")]),
    ("531", "Simulation day", [("531", "SIM")]),
    ("531", None, [("531", "CLINIC")]),
    ("121 remin", None, [("121", "CLINIC REMIN")]),
    ("121 cariostatic", None, [("121", "CLINIC CARIOSTATIC")]),
    ("414 Cvek", None, [("414", "CLINIC CVEK")]),
    ("414 Deciduous", "Simulation", [("414", "SIM DECIDUOUS")]),
    ("013 Paeds Specific", None, [("013", "PAEDS SPECIFIC")]),
    ("013 other", None, [("013", "LIMITED OE")]),
    ("941", None, []),
    ("12 5", None, []),
    ("011,012", None, [("011", "COE"), ("012", "POE")]),
    ("711 Finish,712 Try-in,713 review,714 plain", None,
     [("711", "FINISH"), ("712", "TRY-IN"), ("713", "REVIEW"), ("714", "CLINIC")]),
    ("415 SIM Access,415 SIM Working length,415 CLINIC Access", None,
     [("415", "SIM ACCESS"), ("415", "SIM WORK LENGTH"), ("415", "CLINIC")]),
    ("416 SIM +2,416 +3,416", None, [("416", "SIM +2"), ("416", "CLINIC +3"), ("416", "CLINIC RCT ADD")]),
    ("417 SIM Cone fit,418 SIM Root filling", None, [("417", "SIM CONE FIT"), ("418", "SIM ROOT FLG")]),
    ("579 SIM,587 SIM [Separators],586 SIM,586 CLINIC", None,
     [("579", "BONDING"), ("587", "SIM SEPARATORS"), ("586", "SIM TOOTH PREP"), ("586", "CLINIC")]),
    ("744 insert,744 impression,743,741,737", None,
     [("744", "RELINING INSERT"), ("744", "RELINING PARTIAL"), ("743", "RELINING"), ("741", "ADJUSTMENT"), ("737", "RESILIENT LINING")]),
    ("022 then 531", None, [("022", "I/O RAD"), ("531", "I/O RAD")]),
    (None, None, []),
])
def test_procedure_codes(spark, service, place, want):
    got = one(spark, C.procedure_codes(F.lit(service).cast("string"), F.lit(place).cast("string")))
    assert [(r["code"], r["tag"]) for r in got] == want


def test_limited_examination_as_written(spark):
    got = one(spark, C.procedure_codes(F.lit("013 Paeds Specific"), F.lit("Clinic"), paeds_as_limited=True))
    assert [(r["code"], r["tag"]) for r in got] == [("013", "LIMITED OE")]


def test_general_services(spark):
    got = one(spark, C.general_services(F.lit("LA given (Infiltration), RD (two clamps)")))
    assert [(r["code"], r["tag"]) for r in got] == [("LA", "INFILTRATION"), ("RD", "TWO CLAMPS")]


def test_code_cleaner(spark):
    raw = ["022 x 4", "13", "013022024", "LA, 022", "n/a", "1022", "5 and 13", "022, 13", "10222", "22X2", None]
    want = [["022"] * 4, ["013"], ["013", "022", "024"], ["LA", "022"], [], ["010"], ["013"], ["022"], ["010", "222"], ["022"] * 2, []]
    assert text_of(spark, C.clean_codes, raw) == want


def test_readable_codes(spark):
    raw = ["did 531 today", "13", "7/22", "11-12", "5312", "one two three four", "one two"]
    assert text_of(spark, C.readable_code, raw) == ["531", "013", "007/022", "011/012", "5312", "one two three", "one two"]


def test_patients(spark):
    raw = ["2", "1-3", "FTA", "", None, "Patient 1 FTA"]
    assert text_of(spark, X.patient_count, raw) == [2, 3, 0, 0, 0, 1]
    assert text_of(spark, X.failed_to_attend, raw) == [False, False, True, False, False, False]
    assert text_of(spark, lambda v: X.failed_to_attend(v, True), raw) == [False, False, True, True, False, True]


def test_dates(spark):
    raw = ["31/12/2024", "3rd Mar 2024", "zz", "2024-02-01", "1st March 2024", None]
    assert text_of(spark, D.to_day_text, raw) == ["31/12/2024", "03/03/2024", None, "01/02/2024", "01/03/2024", None]


def test_levels_ages_teeth_reasons(spark):
    assert text_of(spark, X.rubric_level, ["Lvl 3 good", "none", None]) == [3, None, None]
    assert text_of(spark, X.rubric_level_or_zero, ["Lvl 3 good", "none", None]) == [3, 0, 0]
    assert text_of(spark, lambda v: X.age_band(v.cast("int")), ["6", "7", "17", "18", "139", "140", None]) == [
        "0-6", "7-17", "7-17", "18+", "18+", None, None]
    assert text_of(spark, X.standard_tooth, ["Premolar 11", "Incisor", "tooth 21", "45", "x"]) == ["24", "11", "11", "24", None]
    assert text_of(spark, X.tooth_number, ["A TOOTH 24 B", "24"]) == ["24", None]
    assert text_of(spark, X.absence_reason, ["FTA", "no one to book", "Unfilled", "assistant", "x", None]) == [
        "Cancellation", "No Booking", "Unable to Fill", "Assigned as Assistant", "Other", None]
    assert text_of(spark, X.initials, ["Marker One two"]) == ["MOT"]
    assert text_of(spark, X.phrase_level, ["Competent/Independent", "Not observed", "x"]) == [4, None, None]


def test_punctuation(spark):
    assert text_of(spark, X.plain_punctuation, ["‘a’ “b” – … é"]) == ["'a' \"b\" - ... "]
    assert text_of(spark, X.strip_non_ascii, ["a\r\né\tb"]) == ["a\n\tb"]


def test_headers(spark):
    rows = ["531 CLINIC#2_4", "531 Infil#1_1", "114 CINIC#2_3", "022#1_2", "Consent#2_1", "531 SIM#2_9_TEXT", "022#2_9_TEXT", "Date"]
    df = H.parse_headers(spark.createDataFrame([(r,) for r in rows], "h string"), "h")
    got = {r["h"]: r["name"] for r in df.collect()}
    assert got == {
        "531 CLINIC#2_4": "531_MC4_supervisor (CLINIC)", "531 Infil#1_1": "531_MC1_student (INFILTRATION)",
        "114 CINIC#2_3": "114_MC3_supervisor (CLINIC)", "022#1_2": "022_MC2_student", "Consent#2_1": "CC_MC1_supervisor",
        "531 SIM#2_9_TEXT": "531_Tooth Number_supervisor (SIM)", "022#2_9_TEXT": "022_Tooth Number_supervisor"}


def test_header_collisions(spark):
    df = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y"), ("a", "X")], "old string, new string")
    assert sorted((r["new"], r["place"], r["n_headers"], r["header"]) for r in H.collisions(df, "old", "new").collect()) == [("X", 1, 2, "a"), ("X", 2, None, "b")]


def test_score_formulas(spark):
    lit = lambda v: F.lit(v)
    assert one(spark, S.checklist_score(lit(3), lit(1), lit(2), 2)) == 0.8
    assert one(spark, S.checklist_score(lit(0), lit(0), lit(0))) is None
    assert one(spark, S.ratio_with_epsilon(lit(7), lit(1))) == 7 / (7 + 1 + 0.0001)
    assert 0.7 * 15 == 10.5 and 0.5 * 24.625 == 12.3125
    clinic = one(spark, S.rubric_score({k: lit(4) for k in ("PS", "CS", "TS", "ES")}, lit("Clinic")))
    assert clinic == pytest.approx(1.0)
    sim = one(spark, S.rubric_score({"PS": lit(2), "TS": lit(2)}, lit("Simulation")))
    assert sim == pytest.approx((2 * 0.05 / 2 + 2 * 0.1 / 4) / 0.15)
    assert one(spark, S.penalised(lit(0.5), lit("Yes"), 0.8)) == pytest.approx(0.4)
    assert one(spark, S.half_even(lit(0.125), 2)) == 0.12


def test_section_without_answers_has_no_flag(spark):
    df = spark.createDataFrame([(1, "A", "x", 0, 0, 3), (1, "A", "y", 1, 3, 0)], "p int, s string, b string, n_yes int, n_no int, n_na int")
    got = {r["b"]: (r["pct_yes"], r["below_threshold"]) for r in M.section_table(df, "p", "s", "b").collect()}
    assert got == {"x": (None, None), "y": (25.0, "Yes"), "All": (25.0, "Yes")}


def test_counts_add_up_and_order_is_free(spark):
    rows = [(i % 7, ["Yes", "No", "NA", None][(i * 5) % 4]) for i in range(200)]
    a = M.outcome_counts(spark.createDataFrame(rows, "f int, outcome string"), ["f"])
    b = M.outcome_counts(spark.createDataFrame(rows[::-1], "f int, outcome string"), ["f"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.agg(F.sum(F.expr("n_yes + n_no + n_na + n_blank"))).first()[0] == 200


def test_map_helpers(spark):
    m = J.parse_map(F.lit("{'assessor_531_MC1': 'Yes', 'student_012_MC2': 'No', 'assessor_PEC_MC1': 'Yes'}"))
    assert one(spark, J.items_of(m)) == ["012", "531"]
    assert one(spark, J.answers_of(m, "531")) == {"assessor_531_MC1": "Yes"}
    assert one(spark, J.parse_map(F.lit("nonsense"))) == {}


def test_cleaning_steps(spark):
    df = spark.createDataFrame([("x", "022"), ("x", " 022."), ("x", "531"), ("y", "1"), ("y", "toolong")], "g string, c string")
    assert sorted((r["g"], r["c"], r["n"]) for r in CL.frequent_codes(df, ["g"], "c").collect()) == [("x", "022", 2), ("y", "1", 1)]
    forms = spark.createDataFrame([(1, "2024-08-01"), (1, "2024-10-01"), (2, "2024-08-01"), (2, "2024-03-01")], "id int, d string")
    left = CL.resit_rule(forms.withColumn("d", F.to_date("d")), "id", "d", 8, 10)
    assert sorted((r["id"], str(r["d"])) for r in left.collect()) == [(1, "2024-10-01"), (2, "2024-03-01"), (2, "2024-08-01")]


def test_wide_export_goes_long(spark):
    wide = spark.range(3).select("id", *[F.lit(str(i)).alias(f"q {i}") for i in range(300)])
    long = R.wide_to_long(wide, ["id"], wide.columns[1:])
    assert long.count() == 900 and long.filter("position = 7 and header = 'q 7' and value = '7'").count() == 3


def test_json_maps_keep_apostrophes(spark):
    from markloom.functions.jsonmap import parse_map

    texts = ['{"k": "don\'t"}', "{'k': 'v'}", "{'k': None, 'ok': True}", "broken", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", parse_map(F.col("t")).alias("m")).collect()
    assert {r.i: r.m for r in rows} == {0: {"k": "don't"}, 1: {"k": "v"}, 2: {"k": None, "ok": "true"}, 3: {}, 4: {}}


def test_resit_rule_keeps_rows_without_date(spark):
    from markloom.operators.cleaning import resit_rule

    df = spark.createDataFrame([(1, "2025-06-01"), (1, "2025-08-01"), (2, "2025-06-02"), (1, None), (3, None)], "k int, d string").withColumn("d", F.to_date("d"))
    got = sorted((r.k, str(r.d)) for r in resit_rule(df, "k", "d", 6, 8).collect())
    assert got == [(1, "2025-08-01"), (1, "None"), (2, "2025-06-02"), (3, "None")]


def test_csv_cells_with_quotes_and_line_breaks(spark, tmp_path):
    from markloom.sources.readers import read_sheet, read_text_columns

    (tmp_path / "a.csv").write_text('id,said\n1,"said ""no, later"" twice"\n2,"two\nlines"\n')
    want = [("1", 'said "no, later" twice'), ("2", "two\nlines")]
    assert [tuple(r) for r in read_sheet(spark, str(tmp_path), "id string, said string", multi_line=True).collect()] == want
    assert [tuple(r) for r in read_text_columns(spark, str(tmp_path), multi_line=True).collect()] == want
