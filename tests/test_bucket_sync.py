"""Reconcile by digests of buckets: the rows of a plain reconcile, from the buckets that differ."""

import os

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark.operators.digests import bucket_digests, differing_buckets
from tidemark.operators.reconcile import change_report, reconcile
from tidemark.plans.bucket_sync import keep_table, sync_table
from tidemark.sources.state import StateStore

SCHEMA = "id long, a string, b string"


def _store(spark, tmp_path, df, **more):
    store = StateStore(spark, str(tmp_path / "state"), buckets=32)
    keep_table(store, "t", df, ["id"], **more)
    return store


def test_digests_tell_contents_apart(spark):
    one = spark.createDataFrame([(1, "x", None), (1, "x", None), (2, "p", "q"), (3, "s", "t")], SCHEMA)
    digest = lambda df: bucket_digests(df, F.col("id"), ["a", "b"])
    assert digest(one.filter("false")).count() == 0
    assert rows(differing_buckets(digest(one), digest(one.repartition(3)))) == []
    # A NULL moved to the other column, a copy less, values of two rows swapped, a row gone.
    for other, expected in (
        ([(1, None, "x"), (1, "x", None), (2, "p", "q"), (3, "s", "t")], [(1,)]),
        ([(1, "x", None), (2, "p", "q"), (3, "s", "t")], [(1,)]),
        ([(1, "x", None), (1, "x", None), (2, "q", "p"), (3, "s", "t")], [(2,)]),
        ([(1, "x", None), (1, "x", None), (4, "s", "t")], [(2,), (3,), (4,)]),
    ):
        assert rows(differing_buckets(digest(one), digest(spark.createDataFrame(other, SCHEMA)))) == expected


def test_few_changes_move_few_buckets(spark, tmp_path):
    df = spark.range(2000).select("id", F.concat(F.lit("a"), "id").alias("a"), F.lit(None).cast("string").alias("b"))
    store = _store(spark, tmp_path, df)
    src = df.filter("id <> 11").withColumn("b", F.when(F.col("id") == 12, "new")).unionByName(
        spark.createDataFrame([(5000, "more", None)], SCHEMA)
    )
    plain = rows(change_report(df, src, ["id"], df.columns, "t"))
    after = rows(reconcile(df, src, ["id"], df.columns))
    synced = sync_table(store, "t", src, str(tmp_path / "report"))
    assert len(synced.touched) <= 3 and rows(synced.report) == plain and rows(store.read("t")) == after
    written = [d for d in os.listdir(tmp_path / "state" / "t") if d.startswith("v=2-")]
    assert sorted(int(b.split("=")[1]) for b in os.listdir(tmp_path / "state" / "t" / written[0]) if "=" in b) == synced.touched
    # Rows read: those of the touched buckets, of about 63 each.
    assert store.read("t", synced.touched).count() < 400
    again = sync_table(store, "t", src, str(tmp_path / "none"))
    assert again.run is None and again.touched == [] and again.report.count() == 0 and not os.path.exists(tmp_path / "none")


def test_nulls_copies_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(None, "n", None), (1, "x", None), (2, "y", "z"), (2, "yy", None)], SCHEMA)
    store = _store(spark, tmp_path, df)
    src = spark.createDataFrame([(None, "n", None), (1, None, "x"), (7, "p", None), (7, "p", None)], SCHEMA)
    plain = rows(reconcile(df, src, ["id"], df.columns))
    sync_table(store, "t", src, str(tmp_path / "r1"))
    assert rows(store.read("t")) == plain == rows(src)
    sync_table(store, "t", src.limit(0), str(tmp_path / "r2"))
    assert store.read("t").count() == 0
    sync_table(store, "t", src, str(tmp_path / "r3"))
    assert rows(store.read("t")) == plain


def test_insert_only_columns_stay(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "mine"), (2, "y", "mine")], SCHEMA)
    store = _store(spark, tmp_path, df, insert_only=("b",))
    src = spark.createDataFrame([(1, "x", "other"), (2, "new", "other"), (3, "z", "other")], SCHEMA)
    sync_table(store, "t", src, str(tmp_path / "r1"), insert_only=("b",))
    assert rows(store.read("t")) == [(1, "x", "mine"), (2, "new", "mine"), (3, "z", "other")]
    assert sync_table(store, "t", src, str(tmp_path / "r2"), insert_only=("b",)).run is None
    # Other compared columns than the kept digests: computed from the rows.
    sync_table(store, "t", src, str(tmp_path / "r3"))
    assert rows(store.read("t")) == rows(src)


def test_rows_changed_without_digests(spark, tmp_path):
    df = spark.createDataFrame([(i, "x", None) for i in range(9)], SCHEMA)
    store = _store(spark, tmp_path, df)
    store.commit({"t": df.withColumn("a", F.lit("moved"))})
    synced = sync_table(store, "t", df, str(tmp_path / "r"))
    assert synced.report.count() == 9 and rows(store.read("t")) == rows(df)


def test_another_writer_comes_first(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, "x", None) for i in range(9)], SCHEMA)
    store, src = _store(spark, tmp_path, df), df.withColumn("a", F.lit("y"))
    real, raced = store.commit, []

    def late(*args, **kwargs):
        if not raced:
            raced.append(1)
            sync_table(StateStore(spark, store.root, buckets=32), "t", df.withColumn("a", F.lit("other")), str(tmp_path / "first"))
        return real(*args, **kwargs)

    monkeypatch.setattr(store, "commit", late)
    synced = sync_table(store, "t", src, str(tmp_path / "second"))
    assert rows(store.read("t")) == rows(src)
    assert rows(synced.report.select("previous_a").distinct()) == [("other",)]


def test_refusals(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None)], SCHEMA)
    store = _store(spark, tmp_path, df)
    with pytest.raises(TypeError, match="type of id"):
        sync_table(store, "t", df.withColumn("id", F.col("id").cast("int")), str(tmp_path / "r"))
    with pytest.raises(ValueError, match="lacks"):
        sync_table(store, "t", df.drop("b"), str(tmp_path / "r"))
    store.commit({"whole": df})
    with pytest.raises(ValueError, match="not kept in buckets"):
        sync_table(store, "whole", df, str(tmp_path / "r"))
