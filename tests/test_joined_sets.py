"""Sorted distinct values in one cell, on tables in which some values are missing."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from markloom.operators import ordering as ORD

FOLDER = "/root/testdata/sf0.001"
#: query, its table, the column that is emptied for keys that 5 divides, the key
CASES = [("X41_items_present", "lineitem", "l_partkey", "l_orderkey"), ("A13_sorted_distinct_join", "orders", "o_orderpriority", "o_custkey")]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")
@pytest.mark.parametrize("name,table,column,key", CASES)
def test_keys_without_values_are_null(spark, tmp_path, name, table, column, key):
    for t in ("orders", "lineitem", "customer", "part"):
        rows = spark.read.parquet(f"{FOLDER}/{t}.parquet")
        if t == table:
            rows = rows.withColumn(column, F.when(F.col(key) % 5 != 0, F.col(column)))
        rows.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, str(tmp_path))
    assert got.columns == want.columns and got.columns[1] == "segment"
    rows = {tuple(r) for r in got.collect()}
    assert rows == set(want.fetchall()) and any(r[2] is None for r in rows)


def test_joined_distinct_keeps_a_group_without_texts(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, None), (2, None), (None, "n"), (3, "")], "g int, t string")
    assert {r.g: r.x for r in ORD.joined_distinct(df, ["g"], "t", "|", "x").collect()} == {1: "a|b", 2: None, None: "n", 3: ""}
