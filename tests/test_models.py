"""The model queries fit what the source material fits: every pass, tree and number of clusters."""

import os
import threading

import pytest

import __spark_entry__ as entry
from markloom.operators import models as MD

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")


@pytest.fixture
def fitted(monkeypatch):
    """Parameters of the estimators as they are made."""
    seen = []
    for name in ("LDA", "RandomForestRegressor"):
        made = getattr(MD, name)
        monkeypatch.setattr(MD, name, lambda made=made, name=name, **a: seen.append((name, a)) or made(**a))
    return seen


@needs_tables
def test_elbow_tries_all_numbers(spark):
    rows = {r.k: r.cost for r in entry.queries()["M17_elbow"](spark, FOLDER).collect()}
    assert sorted(rows) == list(range(1, 21)) and min(rows, key=rows.get) > 10 and max(rows, key=rows.get) == 1


def test_elbow_fits_side_by_side(spark, monkeypatch):
    """Two fits at least are under way at a time, and each gives what it gives alone."""
    df = spark.range(200).selectExpr("array(cast(id % 7 as double), cast(id % 11 as double)) AS v")
    alone = {k: MD.elbow(df, "v", [k]).first().cost for k in (2, 3, 4, 5)}
    both = threading.Barrier(2, timeout=60)

    class Waiting(MD.KMeans):
        def fit(self, x):
            both.wait()
            return super().fit(x)

    monkeypatch.setattr(MD, "KMeans", Waiting)
    assert {r.k: r.cost for r in MD.elbow(df, "v", [2, 3, 4, 5]).collect()} == pytest.approx(alone)


@needs_tables
def test_topics_make_fifty_passes(spark, fitted):
    assert entry.queries()["M18_topics"](spark, FOLDER).count() == 100
    assert [a["maxIter"] for n, a in fitted if n == "LDA"] == [50]


@needs_tables
def test_importance_by_hundred_trees_of_forms_with_six_answers(spark, fitted, monkeypatch):
    rows = []
    forest = MD.forest_importance
    monkeypatch.setattr(MD, "forest_importance", lambda wide, *a, **k: rows.append(wide) or forest(wide, *a, **k))
    assert entry.queries()["M08_item_importance"](spark, FOLDER).count() == 7
    assert [a["numTrees"] for n, a in fitted if n == "RandomForestRegressor"] == [100]
    answers = spark.read.parquet(f"{FOLDER}/lineitem.parquet").where("l_discount >= 0.005 AND l_returnflag IN ('A', 'R')")
    want = {r[0] for r in answers.groupBy("l_orderkey").count().where("count > 5").select("l_orderkey").collect()}
    assert want and {r.form_id for r in rows[0].collect()} == want
