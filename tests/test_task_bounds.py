"""What one task takes at most does not grow with the tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from markloom.operators import textstats as TX
from markloom.session import TASK_BOUNDS, bound_tasks

FOLDER = "/root/testdata/sf0.001"


def test_bounds_are_set_only_where_open(spark):
    own = spark.newSession()
    read, parts = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    own.conf.unset(read)
    own.conf.set(parts, "5m")
    bound_tasks(own)
    assert own.conf.get(read) == TASK_BOUNDS[read] and own.conf.get(parts) == "5m"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")
def test_a_query_has_bounded_tasks(spark):
    own = spark.newSession()
    entry.queries()["A34_marker_pair_difference"](own, FOLDER)
    assert {k: own.conf.get(k) for k in TASK_BOUNDS} == TASK_BOUNDS


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")
def test_a_pivot_holds_its_forms_once(spark):
    plan = entry.queries()["A29_unique_pivot"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange") == 1


def test_tf_idf_moves_terms_twice(spark):
    """To their term, and back to their text; the lengths of the texts meet the terms without a join."""
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (3, None), (4, "x")], "k int, t string")
    out = TX.tf_idf(df, "k", "t")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1
    got = {(r.k, r.term): r.weight for r in out.collect()}
    assert set(got) == {(1, "aa"), (1, "bb"), (2, "bb"), (2, "cc")}
    assert all(abs(sum(w * w for (k, _), w in got.items() if k == key) - 1) < 1e-9 for key in (1, 2))


def test_collocations_cut_the_texts_once(spark):
    """The counts of words and of pairs come from one landed table."""
    df = spark.createDataFrame([("a b a b",), ("a b c",), (None,), ("",)], "t string")
    out = TX.collocations(df, "t", at_least=2, k=3)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.phrase, r.n, round(r.pmi, 6)) for r in out.collect()] == [("a b", 3, round(math.log2(3 * 7 / (3 * 3)), 6))]
