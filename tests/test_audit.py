from decimal import Decimal as D

import pytest
from helpers import rows
from pyspark.sql import functions as F
from scenario import KEYED, scenario_steps, versions_frame

from tidemark.functions import messages as M
from tidemark.operators import audit as A
from tidemark.plans.deploy import change_trace, version_change


def _targets(spark, *given):
    return spark.createDataFrame([(s, a, D(v)) for s, a, v in given], KEYED.replace("version", "to_version"))


@pytest.fixture(scope="module")
def trace(spark):
    targets = _targets(spark, ("dbo", "test_app", 10000), ("x", "none", 5), ("x", "same", 3))
    versions = versions_frame(spark, ("x", "same", 3))
    return change_trace(version_change(scenario_steps(spark), versions, targets))


def _lines(trace, application):
    return [r["message"] for r in trace.filter(F.col("application_name") == application).orderBy("position").collect()]


def test_trace_of_a_run(trace):
    lines = _lines(trace, "test_app")
    assert lines[0] == M.RULE == "=" * 117
    assert lines[1] == "BEGIN: Change version from 0 to 10000 via 5 steps."
    assert lines[2] == 'START: (Upgrade=1/Downgrade=0) step for test_app(10000)+0 via "up_10000_0".'
    assert lines[3] == "EXEC: step_id=1, test_app(10000)+0 via dbo.[up_10000_0]()"
    assert lines[4] == "SUCCESS: step_id=1 completed = 1."
    assert lines[5] == "FINISH: step procedure for test_app(10000)+0"
    assert lines[-3] == 'INFO: Setting "dbo" schema\'s version to "10000" registered by application "test_app".'
    assert lines[-2] == "CEASE: Change version from 0 to 10000"
    assert len(lines) == 2 + 5 * 4 + 3


def test_positions_are_dense(trace):
    for r in trace.groupBy("application_name").agg(F.max("position").alias("m"), F.count("*").alias("n")).collect():
        assert r["m"] == r["n"]


def test_warnings(trace):
    none = _lines(trace, "none")
    assert none[2:4] == [
        "WARN: There are no change(s) detected between 0 and 5",
        "WARN: There are no change steps registered between 0 and 5",
    ]
    assert [line[:4] for line in _lines(trace, "same")[2:4]] == ["WARN", "INFO"]


def test_failure_ends_the_trace_and_runs_read_back(spark):
    targets = _targets(spark, ("dbo", "test_app", 20001), ("x", "none", 5))
    change = version_change(scenario_steps(spark), versions_frame(spark), targets, F.col("step_id") == 3)
    named = change._replace(outcomes=change.outcomes.withColumn("error_message", F.lit("boom")))
    trace = change_trace(named)
    lines = _lines(trace, "test_app")
    assert lines[-1] == "ERROR: boom(Severity=16) from step_id=3, test_app(10000)+2 via dbo.[up_10000_2]()"
    log = trace.withColumns(
        {
            "session_id": F.lit(1),
            "when": F.timestamp_seconds(F.col("position")),
            # One session runs both keys, the failing one first.
            "id": F.col("position") + F.when(F.col("application_name") == "none", 1000).otherwise(0),
        }
    ).drop("schema_name", "application_name", "position")
    got = rows(
        A.audit_runs(log), "schema_name", "application_name", "from_version", "to_version",
        "planned_steps", "steps_run", "warnings", "outcome",
    )
    assert got == [("dbo", "test_app", D(0), D(20001), 26, 2, 0, "failed"), ("x", "none", D(0), D(5), 0, 0, 2, "completed")]


def test_append_goes_on_from_the_largest_id(spark, tmp_path):
    path = str(tmp_path / "audit")
    events = spark.createDataFrame([("r", "b"), ("r", "a")], "from string, message string")
    A.append_audit(events, path, ["message"], session_id=4)
    A.append_audit(events.withColumn("message", F.lit("c")).limit(1), path, ["message"], session_id=5)
    log = spark.read.parquet(path)
    assert rows(log, "id", "session_id", "message") == [(0, 4, "a"), (1, 4, "b"), (2, 5, "c")]
    assert log.filter("when is null or user_login is null or user_identity is null").count() == 0


def test_two_writers_get_ids_of_their_own(spark, tmp_path, monkeypatch):
    """Both start from one base; the second starts while the first is about to reserve."""
    path = str(tmp_path / "log")
    events = spark.createDataFrame([("here", c) for c in "abc"], "from string, message string")
    A.append_audit(events, path, ["message"])
    real, raced = A.audit_rows, []

    def audit_rows(*given):
        if not raced:
            raced.append(True)
            A.append_audit(events.limit(2), path, ["message"], session_id=2)
        return real(*given)

    monkeypatch.setattr(A, "audit_rows", audit_rows)
    A.append_audit(events, path, ["message"], session_id=1)
    got = spark.read.parquet(path)
    assert sorted(r["id"] for r in got.collect()) == list(range(8))
    assert rows(got.filter("session_id = 2"), "id") == [(3,), (4,)]
