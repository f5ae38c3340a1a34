"""The ordered helpers against plain folds; every run cuts groups into ranges."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark.operators.ordered import history, latest_value, previous_value, row_numbers, running_total


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows; NULL is a key too."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        rows.append((key, rng.randint(0, 40), i, rng.randint(0, 5), rng.choice([None, 1, 2, 3])))
    return spark.createDataFrame(rows, "k string, o int, id int, w int, v int")


def ORDER():
    return [F.col("o").desc(), F.col("id")]



def _expected(df, keyed, fold):
    groups = {}
    for r in df.collect():
        groups.setdefault(r["k"] if keyed else None, []).append(r)
    out = {}
    for members in groups.values():
        fold(sorted(members, key=lambda r: (-r["o"], r["id"])), out)
    return out


@pytest.mark.parametrize("keyed", [True, False])
def test_running_total(skewed, keyed):
    keys = ["k"] if keyed else []

    def fold(members, out):
        total = 0
        for r in members:
            out[r["id"]] = total
            total += r["w"]

    got = running_total(skewed, keys, ORDER(), "t", F.col("w"), inclusive=False)
    assert got.columns == [*skewed.columns, "t"]
    assert {r["id"]: r["t"] for r in got.collect()} == _expected(skewed, keyed, fold)


def test_row_numbers(skewed):
    def fold(members, out):
        for n, r in enumerate(members, 1):
            out[r["id"]] = n

    got = row_numbers(skewed, ["k"], ORDER(), "n")
    assert {r["id"]: r["n"] for r in got.collect()} == _expected(skewed, True, fold)


def test_previous_value(skewed):
    """A NULL that precedes a row is its previous value, across chunk borders too."""

    def fold(members, out):
        before = None
        for r in members:
            out[r["id"]] = before
            before = r["v"]

    got = previous_value(skewed, ["k"], ORDER(), F.col("v"), "p")
    assert got.columns == [*skewed.columns, "p"]
    assert {r["id"]: r["p"] for r in got.collect()} == _expected(skewed, True, fold)


def test_latest_value(skewed):
    """A NULL takes over what came before it, across chunk borders too."""

    def fold(members, out):
        latest = None
        for r in members:
            latest = r["v"] if r["v"] is not None else latest
            out[r["id"]] = latest

    got = latest_value(skewed, ["k"], ORDER(), F.col("v"), "l")
    assert got.columns == [*skewed.columns, "l"]
    assert {r["id"]: r["l"] for r in got.collect()} == _expected(skewed, True, fold)


def test_rows_that_tie_are_cut_too(spark):
    """One order value holds all rows; their columns tell them apart."""
    tied = spark.range(400).select(F.lit("same").alias("message"), "id")
    got = row_numbers(tied, [], [F.col("message")], "n")
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 401))
    from tidemark.operators import ordered

    chunks = ordered._chunked(tied, [], [F.col("message")])
    assert chunks.select(ordered._CHUNK).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_no_task_sorts_more_than_a_chunk(skewed):
    """Windows over rows are partitioned by chunk; only the summary is not."""
    for keys in (["k"], []):
        plan = row_numbers(skewed, keys, ORDER(), "n")._jdf.queryExecution().executedPlan().toString()
        assert "row_number() windowspecdefinition(__ordered_chunk" in plan
        for line in plan.splitlines():
            assert "SinglePartition" not in line or "__ordered_total" in plan


def test_names_that_clash_are_refused(skewed):
    with pytest.raises(ValueError):
        row_numbers(skewed.withColumn("__ordered_before", F.lit(1)), ["k"], ORDER(), "n")
    # Any other name may be used, for input and output alike.
    got = running_total(skewed.withColumn("_chunk", F.lit(1)), ["k"], ORDER(), "_before", F.col("w"))
    assert got.columns[-2:] == ["_chunk", "_before"]


def test_empty_input(skewed):
    assert running_total(skewed.limit(0), ["k"], ORDER(), "t", F.col("w")).count() == 0
    assert row_numbers(skewed.limit(0), [], ORDER(), "n").count() == 0


def test_history(skewed):
    """Previous value, lowest and highest measure before each row, in one cut."""

    def fold(members, out):
        seen = []
        for r in members:
            out[r["id"]] = (seen[-1]["id"] if seen else None, *[f((x["w"] for x in seen), default=None) for f in (min, max)])
            seen.append(r)

    got = history(skewed, ["k"], ORDER(), F.col("id"), F.col("w"), "p", "low", "high")
    assert got.columns == [*skewed.columns, "p", "low", "high"]
    assert {r["id"]: (r["p"], r["low"], r["high"]) for r in got.collect()} == _expected(skewed, True, fold)


def test_rows_are_not_shuffled_again_for_what_comes_before_their_range(spark, skewed):
    """Of the summary only groups that began in an earlier range are sent, however large it is."""
    for keys in (["k"], []):
        expected = rows(row_numbers(skewed, keys, ORDER(), "n"))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            numbered = row_numbers(skewed, keys, ORDER(), "n")
            assert "SortMergeJoin" not in numbered._jdf.queryExecution().executedPlan().toString()
            assert rows(numbered) == expected
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
