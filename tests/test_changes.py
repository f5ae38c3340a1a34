import threading
from decimal import Decimal
from decimal import Decimal as D

import pytest
from helpers import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from scenario import KEYED, Simulation, scenario_steps, versions_frame

from tidemark.operators import changes as C
from tidemark.plans.deploy import version_change

# Steps run by the six changes of the scenario, one after the other.
EXPECTED = [(20001, 26), (10001, 16), (10002, 5), (10002, 0), (10003, 0), (10000, 10)]


def _targets(spark, to):
    return spark.createDataFrame([("dbo", "test_app", Decimal(to))], KEYED.replace("version", "to_version"))


def test_scenario_change_by_change(spark):
    steps, versions = scenario_steps(spark), versions_frame(spark, ("other", "app", 1))
    simulation = Simulation([r.asDict() for r in steps.collect()], 0)
    for to, count in EXPECTED:
        change = version_change(steps, versions, _targets(spark, to))
        ran = [r["step_id"] for r in change.outcomes.orderBy("run_order").collect()]
        assert ran == simulation.request(to)
        assert len(ran) == count
        # Cut the plan: each change starts from written state, as it does in use.
        steps = spark.createDataFrame(change.steps.collect(), change.steps.schema)
        versions = spark.createDataFrame(change.versions.collect(), change.versions.schema)
    assert rows(versions.filter("schema_name = 'dbo'"), "version") == [(Decimal(10000),)]
    flags = rows(steps, "upgrade", "version", "completed")
    assert all(done == (v == 10000) if up else done == (v != 10000) for up, v, done in flags)


def test_two_targets_of_a_key_are_refused(spark):
    targets = _targets(spark, 20001).union(_targets(spark, 10001))
    with pytest.raises(PySparkException, match="more than one target"):
        C.change_requests(versions_frame(spark, ("dbo", "test_app", 1)), targets).collect()


def test_direction(spark):
    given = spark.createDataFrame(
        [(D(1), D(2)), (D(2), D(1)), (D(2), D(2)), (None, D(1)), (D(1), None)], "from_version decimal(38,0), to_version decimal(38,0)"
    )
    got = [tuple(r)[2:] for r in C.change_direction(given).collect()]
    assert got == [(1, 0), (0, 1), (0, 1), (0, 0), (0, 0)]


def test_summary_warnings(spark):
    steps = scenario_steps(spark)
    given = spark.createDataFrame(
        [("dbo", "test_app", Decimal(0), Decimal(20001)), ("x", "a", Decimal(1), Decimal(1)), ("x", "b", Decimal(1), Decimal(2))],
        "schema_name string, application_name string, from_version decimal(38,0), to_version decimal(38,0)",
    )
    got = rows(C.change_summary(given, C.get_steps(steps, given)), "application_name", "step_count", "warning_count")
    assert got == [("a", 0, 1), ("b", 0, 2), ("test_app", 26, 0)]


def test_failure_stops_its_key_only(spark):
    ordered = spark.createDataFrame(
        [("s", "a", i, i == 2) for i in (1, 2, 3)] + [("s", "b", i, False) for i in (1, 2)],
        "schema_name string, application_name string, run_order int, failed boolean",
    )
    got = rows(C.cut_after_failure(ordered), "application_name", "run_order", "outcome")
    assert got == [("a", 1, "run"), ("a", 2, "failed"), ("a", 3, "skipped"), ("b", 1, "run"), ("b", 2, "run")]


def test_failed_key_keeps_version_and_open_steps(spark):
    steps, versions = scenario_steps(spark), versions_frame(spark)
    change = version_change(steps, versions, _targets(spark, 20001), F.col("step_version") >= 20000)
    assert change.versions.count() == 0
    done = change.steps.filter("completed = 1")
    assert done.count() == 15 and done.filter("version >= 20000").count() == 0


def test_key_without_steps_still_advances(spark):
    change = version_change(scenario_steps(spark).limit(0), versions_frame(spark), _targets(spark, 7))
    assert rows(change.versions, "version") == [(Decimal(7),)]


def test_up_then_down_restores_open_upgrades(spark):
    steps, versions = scenario_steps(spark), versions_frame(spark)
    up = version_change(steps, versions, _targets(spark, 20001))
    down = version_change(up.steps, up.versions, _targets(spark, 0))
    assert down.steps.filter("upgrade = 1 and completed = 1").count() == 0
    assert down.steps.filter("upgrade = 0 and completed = 0").count() == 0


def test_partner_reset_ignores_procedure(spark):
    steps = scenario_steps(spark).withColumn("completed", F.lit(1))
    twin = steps.filter("upgrade = 0 and version = 10000 and sequence = 0").withColumns(
        {"id": F.lit(99).cast("long"), "procedure_name": F.lit("twin")}
    )
    executed = spark.createDataFrame(
        [("dbo", "test_app", 1, Decimal(10000), 0, 1)],
        "schema_name string, application_name string, step_id long, step_version decimal(38,0), step_sequence int, is_upgrade_direction int",
    )
    after = C.apply_change(steps.unionByName(twin), executed)
    assert rows(after.filter("completed = 0"), "id") == [(27,), (99,)]


def test_case_blind_selection(spark):
    steps = scenario_steps(spark)
    asked = spark.createDataFrame(
        [("DBO", "Test_App", Decimal(0), Decimal(10000))],
        "schema_name string, application_name string, from_version decimal(38,0), to_version decimal(38,0)",
    )
    assert C.get_steps(steps, asked).count() == 0
    assert C.get_steps(steps, asked, case_sensitive=False).count() == 5


def test_hot_key_is_ordered_in_chunks(spark):
    asked = spark.createDataFrame(
        [("dbo", "test_app", Decimal(20001), Decimal(0))],
        "schema_name string, application_name string, from_version decimal(38,0), to_version decimal(38,0)",
    )
    selected = C.get_steps(scenario_steps(spark), asked)
    columns = ["step_id", "run_order"]
    assert rows(C.order_steps(selected.repartition(3)), *columns) == rows(C.order_steps(selected), *columns)


def test_run_steps_runs_bodies_in_order(spark):
    seen, lock = [], threading.Lock()

    def body(name):
        def run(_):
            with lock:
                seen.append(name)
            if name == "b2":
                raise RuntimeError("broken")

        return run

    ordered = spark.createDataFrame(
        [("s", "a", 1, 1, "a1"), ("s", "a", 2, 2, "sql"), ("s", "b", 1, 3, "b1"), ("s", "b", 2, 4, "b2"),
         ("s", "b", 3, 5, "b3"), ("s", "c", 1, 6, "gone")],
        "schema_name string, application_name string, run_order int, step_id long, step_procedure string",
    )
    registry = {("s", n): body(n) for n in ("a1", "b1", "b2", "b3")} | {("s", "sql"): "select 1 as one"}
    got = rows(C.run_steps(ordered, registry, concurrency=3), "step_id", "outcome", "error_message")
    assert [g[:2] for g in got] == [(1, "run"), (2, "run"), (3, "run"), (4, "failed"), (5, "skipped"), (6, "failed")]
    assert got[3][2] == "broken" and "gone" in got[5][2]
    assert [n for n in seen if n[0] == "b"] == ["b1", "b2"]


def test_case_blind_change(spark):
    """One key spelled three ways is one key from end to end."""
    steps = scenario_steps(spark).withColumn(
        "schema_name", F.when(F.col("id") % 2 == 0, "DBO").otherwise(F.col("schema_name"))
    )
    target = spark.createDataFrame([("Dbo ", "TEST_APP", D(20001))], KEYED.replace("version", "to_version"))
    change = version_change(steps, versions_frame(spark, ("dbo", "Test_App", 10000)), target, case_sensitive=False)
    assert [r["step_version"] for r in change.outcomes.orderBy("run_order").collect()][0] == 10001
    assert change.outcomes.count() == 21 and change.outcomes.agg(F.max("run_order")).first()[0] == 21
    assert rows(change.versions, "version") == [(D(20001),)]
    assert change.steps.filter("completed = 1").count() == 21
    assert change.steps.schema["schema_name"].dataType.simpleString() == "string"
