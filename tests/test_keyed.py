import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from workfeed.keyed import KeyedTable
from workfeed.sources.legacy import upserted

ROW = "source string, id long, at timestamp, value string"


@pytest.fixture
def table(spark, tmp_path):
    schema = spark.createDataFrame([], ROW).schema
    return KeyedTable(str(tmp_path / "t"), schema, ("source", "id"), "at", buckets=16)


def rows(spark, n, day, value, step=1):
    at = F.lit(datetime(2026, 1, day)).cast("timestamp")
    return spark.range(0, n, step).select(F.when(F.col("id") % 2 == 0, "a").alias("source"), "id", at.alias("at"), F.lit(value).alias("value"))


def files(table):
    out = {}
    for folder, _, names in os.walk(f"{table.root}/data"):
        out |= {f"{folder}/{n}": os.stat(f"{folder}/{n}").st_mtime_ns for n in names if n.endswith(".parquet")}
    return out


def same(df, other):
    return sorted(map(str, df.collect())) == sorted(map(str, other.select(df.columns).collect()))


def test_a_merge_rewrites_the_buckets_of_its_keys_alone(spark, table):
    first, second = rows(spark, 500, 2, "one"), rows(spark, 3, 3, "two")
    assert table.read(spark).count() == 0
    assert (table.merge(first), table.merge(second)) == (1, 2)
    before = files(table)
    one, two = (table.manifest(spark, v)["folders"] for v in (1, 2))
    touched = table._touched(second, 16)
    assert {b for b in one if one[b] != two[b]} == {str(b) for b in touched} and len(touched) <= 3
    want = upserted(first, second, ("source", "id"), "at")
    assert same(table.read(spark), want)
    # Once more, and with rows that are older: nothing changes but the buckets' files.
    table.merge(second)
    table.merge(rows(spark, 500, 1, "old", 50))
    assert same(table.read(spark), want)
    assert before.items() <= files(table).items()
    table.forget(spark, keep=1)
    assert same(table.read(spark), want) and len(files(table)) < len(before)
    assert table.manifests(spark) == [4]


def test_order_ties_nulls_and_empty_merges(spark, table):
    at = datetime(2026, 1, 1)
    table.merge(spark.createDataFrame([("a", 1, at, "x"), ("a", 2, None, "x"), (None, None, at, "x")], ROW))
    assert table.merge(spark.createDataFrame([], ROW)) == 1
    table.merge(spark.createDataFrame([("a", 1, at, "y"), ("a", 1, None, "z"), ("a", 2, None, "y"), (None, None, at, "y")], ROW))
    assert sorted((str(r.id), r.value) for r in table.read(spark).collect()) == [("1", "y"), ("2", "y"), ("None", "y")]


def test_lookup_reads_the_keys_buckets(spark, table):
    table.merge(rows(spark, 100, 2, "one"))
    wanted = spark.createDataFrame([("a", 4, "extra"), ("a", 4, "again"), ("a", 5, "none")], "source string, id long, other string")
    found = table.lookup(wanted)
    assert [(r.source, r.id, r.value) for r in found.collect()] == [("a", 4, "one")]
    assert len(found.inputFiles()) < len(table.read(spark).inputFiles()) / 3


def test_what_a_merge_that_died_left_is_not_read(spark, table):
    table.merge(rows(spark, 10, 2, "one"))
    rows(spark, 10, 3, "lost").write.parquet(f"{table.root}/data/0000000002/_bucket=1")
    assert {r.value for r in table.read(spark).collect()} == {"one"}
    assert table.merge(rows(spark, 10, 4, "two")) == 2
    assert {r.value for r in table.read(spark).collect()} == {"two"}
