"""A hot key of the left side is split over tasks, whatever reduced the right side."""

from contextlib import contextmanager

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark.functions.names import fold_names
from tidemark.operators.lookups import lookup


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def sides(spark):
    """A third of the left rows have one key."""
    left = spark.range(0, 60_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string"))).alias("k"),
        F.col("id").alias("n"),
    )
    return left, left.filter("n % 2 = 0").groupBy("k").agg(F.max("n").alias("m"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_same_rows_as_a_plain_join(sides, how):
    left, right = sides
    got, want = lookup(left, right, ["k"], how), left.join(right, "k", how)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_hot_key_is_split(spark, sides, how):
    left, right = sides
    with settings(
        spark,
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
    ):
        df = lookup(left, right, ["k"], how)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan


def test_folded_names_join_by_collation(spark):
    left = fold_names(spark.createDataFrame([("A ", 1)], "k string, n int"), ["k"], False)
    right = fold_names(spark.createDataFrame([("a", 2)], "k string, m int"), ["k"], False)
    assert rows(lookup(left, right, ["k"], "inner"), "n", "m") == [(1, 2)]


def test_keys_of_different_width_meet(spark):
    left = spark.createDataFrame([(1, "x")], "k int, n string")
    right = spark.createDataFrame([(1, "y")], "k long, m string")
    assert rows(lookup(left, right, ["k"]), "n", "m") == [("x", "y")]


def test_a_side_that_grows_is_not_broadcast_for_its_small_files(spark, tmp_path):
    """200,000 rows with decimals fit in small files of repeated values, yet take many times that in the driver."""
    path = str(tmp_path / "side")
    spark.range(200_000).select(
        F.lit("s1").alias("k"), (F.col("id") % 7).cast("decimal(38,0)").alias("v"), F.lit("x" * 100).alias("m")
    ).write.parquet(path)
    left, right = spark.read.parquet(path).withColumnRenamed("m", "n"), spark.read.parquet(path).distinct()
    plan = {grows: lookup(left, right, ["k", "v"], "inner", grows=grows) for grows in (False, True)}
    text = {grows: df._jdf.queryExecution().executedPlan().toString() for grows, df in plan.items()}
    assert "BroadcastExchange" in text[False] and "BroadcastExchange" not in text[True]
    assert plan[True].count() == 200_000
