"""Joined texts: one row for each key and every entry in its cell, at every size."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from markloom.operators import ordering as ORD

FOLDER = "/root/testdata/sf0.001"


def test_joined_text_of_a_large_group(spark):
    big = spark.range(25_000).select(F.lit(1).alias("g"), F.col("id").alias("o"), F.col("id").cast("string").alias("t"))
    small = spark.createDataFrame([(2, 0, ""), (2, 1, ""), (3, 0, None), (3, 1, "a"), (3, 10_001, "b"), (3, 10_002, ""), (4, 0, None), (None, 5, "n")], "g int, o bigint, t string")
    rows = big.unionByName(small).repartition(7)
    got = {r.g: r.text for r in ORD.joined_text(rows, ["g"], ["o"], F.floor(F.col("o") / 1000), "t", ", ", strip=", ").collect()}
    assert got == {1: ", ".join(map(str, range(25_000))), 2: "", 3: "a, b", 4: None, None: "n"}


#: query, its key columns, the key in the given table
CASES = [
    ("A12_ordered_join", ["student_id"], "o_custkey", "orders"),
    ("A28_pivot_joined_text", ["student_id"], "o_custkey", "orders"),
    ("A51_distinct_text_joined", ["item", "qno"], "struct(l_partkey % 12, l_linenumber)", "lineitem"),
    ("A64_best_of_table", ["student_id"], "o_custkey", "orders"),
    ("K07_cluster_listing", ["cluster"], "label", "embeddings"),
]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")
@pytest.mark.parametrize("name,keys,source,table", CASES)
def test_a_row_for_each_key(spark, name, keys, source, table):
    got = [tuple(r[k] for k in keys) for r in entry.queries()[name](spark, FOLDER).collect()]
    assert len(got) == len(set(got)) == spark.read.parquet(f"{FOLDER}/{table}.parquet").selectExpr(source).distinct().count()
