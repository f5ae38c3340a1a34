import datetime as dt
import pathlib
from decimal import Decimal as D

import pytest
from helpers import rows
from pyspark.sql import functions as F
from scenario import scenario_steps, versions_frame

from tidemark.operators.replay import replay_changes, replay_final_state
from tidemark.schemas import STEP
from tidemark.sources.state import StateConflict, StateStore
from tidemark.streaming import version_changes
from tidemark.streaming.audit import stream_audit
from tidemark.streaming.version_changes import KEYS, apply_requests, stream_version_changes

REQUEST = "request_id long, ts timestamp, schema_name string, application_name string, to_version decimal(38,0)"
START = dt.datetime(2024, 1, 1)


def test_micro_batches_equal_one_replay(spark, tmp_path):
    log = [20001, 10001, 10002, 10002, 10003, 10000]
    requests = [(i, START + dt.timedelta(minutes=i), "dbo", "test_app", D(v)) for i, v in enumerate(log)]
    source = tmp_path / "requests"
    for part in (requests[:2], requests[2:5], requests[5:]):
        spark.createDataFrame(part, REQUEST).coalesce(1).write.mode("append").parquet(str(source))
    store = StateStore(spark, str(tmp_path / "state"))
    steps, versions = scenario_steps(spark), versions_frame(spark)
    store.commit({"step": steps, "version": versions}, keys=KEYS)
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(str(source))

    def run():
        stream_version_changes(stream, store, str(tmp_path / "executed"), str(tmp_path / "check")).awaitTermination()

    run()
    whole = spark.createDataFrame(requests, REQUEST)
    columns = ["request_id", "step_id", "from_version", "to_version"]
    assert rows(spark.read.parquet(str(tmp_path / "executed")), *columns) == rows(replay_changes(steps, versions, whole), *columns)
    assert store.pointer()["run"] == 4
    final = replay_final_state(steps, versions, whole)
    assert rows(store.read("step"), "id", "completed") == rows(final.steps, "id", "completed")
    assert rows(store.read("version")) == rows(final.versions)
    run()
    assert store.pointer()["run"] == 4


def test_repeated_micro_batch_changes_nothing(spark, tmp_path):
    """A lost checkpoint makes the source start over; the store knows what it applied."""
    source = str(tmp_path / "requests")
    spark.createDataFrame([(1, START, "dbo", "test_app", D(20001))], REQUEST).write.parquet(source)
    store = StateStore(spark, str(tmp_path / "state"))
    store.commit({"step": scenario_steps(spark), "version": versions_frame(spark)}, keys=KEYS)
    for check in ("one", "two"):
        stream = spark.readStream.schema(REQUEST).parquet(source)
        stream_version_changes(stream, store, str(tmp_path / "executed"), str(tmp_path / check)).awaitTermination()
    assert store.pointer()["run"] == 2
    assert spark.read.parquet(str(tmp_path / "executed")).count() == 26


def test_audit_stream_drops_repeats(spark, tmp_path):
    schema = "event_id int, when timestamp, message string"
    source = str(tmp_path / "events")
    for part in ([(1, START, "a"), (2, START, "b"), (1, START, "a")], [(2, START, "b"), (3, START, "c")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    path = str(tmp_path / "log")
    stream_audit(stream, path, str(tmp_path / "check"), ["event_id"]).awaitTermination()
    assert rows(spark.read.parquet(path), "event_id", "message") == [(1, "a"), (2, "b"), (3, "c")]


def test_new_requests_under_a_new_checkpoint_are_applied(spark, tmp_path):
    source = str(tmp_path / "requests")
    store = StateStore(spark, str(tmp_path / "state"))
    store.commit({"step": scenario_steps(spark), "version": versions_frame(spark)}, keys=KEYS)
    asked = [(1, START, "dbo", "test_app", D(10001)), (2, START + dt.timedelta(minutes=1), "dbo", "test_app", D(20001))]
    for check, request in zip(("one", "two"), asked):
        spark.createDataFrame([request], REQUEST).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(REQUEST).parquet(source)
        stream_version_changes(stream, store, str(tmp_path / "executed"), str(tmp_path / check)).awaitTermination()
    final = replay_final_state(scenario_steps(spark), versions_frame(spark), spark.createDataFrame(asked, REQUEST))
    assert rows(store.read("step"), "id", "completed") == rows(final.steps, "id", "completed")
    assert rows(store.read("version")) == rows(final.versions)
    assert rows(store.read_log("request"), "request_id") == [(1,), (2,)]


def test_audit_stream_keeps_late_rows_and_rows_without_time(spark, tmp_path):
    schema = "event_id int, when timestamp, message string"
    source, path = str(tmp_path / "events"), str(tmp_path / "log")
    late = START - dt.timedelta(days=3)
    parts = ([(1, START, "a")], [(2, late, "late"), (3, None, "untimed")], [(3, None, "untimed"), (2, late, "late"), (1, late, "c")])
    for check, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        # A checkpoint of its own each time: the source starts over.
        stream_audit(stream, path, str(tmp_path / f"check{check}"), ["event_id"]).awaitTermination()
    assert rows(spark.read.parquet(path), "event_id", "message") == [(1, "a"), (1, "c"), (2, "late"), (3, "untimed")]


def _files(store, table):
    """Data files of a table by (run folder, bucket)."""
    root = pathlib.Path(store.root) / table
    return {(p.parts[-3], p.parts[-2]): p for p in root.glob("v=*/_bucket=*/*.parquet")}


def _fleet(spark, n=40):
    steps = [(k * 10 + v, "dbo", f"app{k}", D(v), 1, 0, "d", "p", 0) for k in range(n) for v in (1, 2, 3)]
    return spark.createDataFrame(steps, STEP), versions_frame(spark)


def test_a_micro_batch_of_one_key_writes_one_bucket(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"), buckets=16, keep=2)
    steps, versions = _fleet(spark)
    store.commit({"step": steps, "version": versions}, keys=KEYS)
    first = set(_files(store, "step"))
    assert len({b for _, b in first}) > 8
    for i in range(1, 5):
        one = spark.createDataFrame([(i, START + dt.timedelta(minutes=i), "dbo", "app7", D(i % 3 + 1))], REQUEST)
        before = set(_files(store, "step"))
        apply_requests(one, store, str(tmp_path / "executed"))
        new = set(_files(store, "step")) - before
        assert len(new) == 1 and len({folder for folder, _ in new}) == 1
    # Of the bucket's snapshots only those of the last two runs are left, the others keep their first.
    bucket = next(iter(new))[1]
    left = [folder for folder, b in _files(store, "step") if b == bucket]
    assert len(left) == 2 and len(set(_files(store, "step")) & first) == len(first) - 1
    whole = spark.createDataFrame([(i, START + dt.timedelta(minutes=i), "dbo", "app7", D(i % 3 + 1)) for i in range(1, 5)], REQUEST)
    final = replay_final_state(steps, versions, whole)
    assert rows(store.read("step"), "id", "completed") == rows(final.steps, "id", "completed")
    # A request that is known again reads its id's part of the log alone, and changes nothing.
    assert apply_requests(whole, store, str(tmp_path / "executed")) is None
    assert store.pointer()["run"] == 5


def test_requests_without_id_are_applied_each_time(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"), buckets=4)
    steps, versions = _fleet(spark, 2)
    store.commit({"step": steps, "version": versions}, keys=KEYS)
    for to, ran in ((2, 2), (2, 2), (3, 3)):
        one = spark.createDataFrame([(None, None, "dbo", "app1", D(to))], REQUEST)
        assert apply_requests(one, store, str(tmp_path / "executed")) is not None
        got = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "executed"))
        assert got.count() == ran
    assert rows(store.read("version"), "application_name", "version") == [("app1", D(3))]


def test_a_publish_between_reading_and_writing_makes_the_batch_start_anew(spark, tmp_path, monkeypatch):
    store, other = (StateStore(spark, str(tmp_path / "state"), buckets=4) for _ in range(2))
    steps, versions = _fleet(spark, 2)
    store.commit({"step": steps, "version": versions}, keys=KEYS)
    real, raced = version_changes.plan_replay, []

    def plan_replay(*given):
        plan = real(*given)
        if not raced:
            raced.append(True)
            done = versions_frame(spark, ("dbo", "app1", 2))
            other.commit({"version": done, "step": steps.withColumn("completed", (F.col("version") <= 2).cast("int"))})
        return plan

    monkeypatch.setattr(version_changes, "plan_replay", plan_replay)
    one = spark.createDataFrame([(1, START, "dbo", "app1", D(3))], REQUEST)
    with pytest.raises(StateConflict):
        apply_requests(one, store, str(tmp_path / "executed"))
    assert store.read_log("request") is None and not (tmp_path / "executed").exists()
    source = str(tmp_path / "requests")
    one.write.parquet(source)
    raced.clear()
    stream = spark.readStream.schema(REQUEST).parquet(source)
    stream_version_changes(stream, store, str(tmp_path / "executed"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "executed"))
    # From version 2, which the publish left, only the step to 3 is run, and once.
    assert rows(got, "from_version", "step_id") == [(D(2), 13)]
    assert rows(store.read("version"), "version") == [(D(3),)]
