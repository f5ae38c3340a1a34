"""Set-based replay against a step-by-step simulation."""

import datetime as dt
import random
from decimal import Decimal
from itertools import product

import pytest
from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T
from scenario import KEYED, Simulation, scenario_steps, versions_frame

from tidemark.operators import replay as R
from tidemark.schemas import STEP

REQUEST = "request_id long, ts timestamp, schema_name string, application_name string, to_version decimal(38,0)"
START = dt.datetime(2024, 1, 1)


def _cases(fresh, seed, keys=120):
    """Random registries: missing partners, several procedures per slot, any flags."""
    rng = random.Random(seed)
    steps, versions, requests = [], [], []
    for k in range(keys):
        key = ("s", f"k{k}")
        for version in range(1, rng.randint(2, 6)):
            for sequence in range(rng.randint(1, 2)):
                for upgrade in (0, 1):
                    for copy in range(rng.choice([0, 1, 1, 2])):
                        done = 0 if fresh else rng.randint(0, 1)
                        steps.append((len(steps) + 1, *key, Decimal(version), upgrade, sequence, "d", f"p{copy}", done))
        if rng.random() < 0.7:
            versions.append((*key, rng.randint(0, 6)))
        for _ in range(rng.randint(0, 9)):
            to = None if rng.random() < 0.05 else Decimal(rng.randint(0, 6))
            requests.append((len(requests), START + dt.timedelta(seconds=rng.randint(0, 5)), *key, to))
    return steps, versions, requests


def _simulate(steps, versions, requests):
    names = STEP.fieldNames()
    start = {(s, a): v for s, a, v in versions}
    ran, flags, ends = [], {}, dict(start)
    for key in {s[1:3] for s in steps} | {r[2:4] for r in requests}:
        machine = Simulation([dict(zip(names, s)) for s in steps if s[1:3] == key], start.get(key, 0))
        for request in sorted((r for r in requests if r[2:4] == key), key=lambda r: (r[1], r[0])):
            if request[4] is None:
                continue
            ran += [(request[0], step) for step in machine.request(int(request[4]))]
            ends[key] = int(request[4])
        flags |= {i: s["completed"] for i, s in machine.steps.items()}
    return sorted(ran), flags, ends


@pytest.mark.parametrize("fresh,seed", [(True, 1), (False, 2), (False, 3)])
def test_replay_equals_simulation(spark, fresh, seed):
    steps, versions, requests = _cases(fresh, seed)
    s = spark.createDataFrame(steps, STEP)
    v = versions_frame(spark, *versions)
    r = spark.createDataFrame(requests, REQUEST)
    ran, flags, ends = _simulate(steps, versions, requests)
    plan = R.plan_replay(s, v, r)
    assert rows(R.executed_steps(plan), "request_id", "step_id") == sorted(ran, key=repr)
    final = R.final_steps(plan)
    assert {x["id"]: x["completed"] for x in final.collect()} == flags
    got = {(x["schema_name"], x["application_name"]): int(x["version"]) for x in R.final_versions(v, r).collect()}
    assert got == ends


def test_scenario_log(spark):
    log = [20001, 10001, 10002, 10002, 10003, 10000]
    r = spark.createDataFrame(
        [(i, START, "dbo", "test_app", Decimal(to)) for i, to in enumerate(log)], REQUEST
    )
    ran = R.replay_changes(scenario_steps(spark), versions_frame(spark), r)
    assert rows(ran.groupBy("request_id").count()) == [(0, 26), (1, 16), (2, 5), (5, 10)]
    state = R.replay_final_state(scenario_steps(spark), versions_frame(spark), r)
    assert rows(state.versions, "version") == [(Decimal(10000),)]
    assert rows(state.steps.filter("upgrade = 1 and completed = 1").select("version").distinct()) == [(Decimal(10000),)]
    assert state.steps.filter("upgrade = 0 and completed = 0").count() == 5


def test_replay_forms_no_pair_join(spark):
    """Every join of the run stage has equality keys, and ranges became level numbers."""
    r = spark.createDataFrame([(1, START, "dbo", "test_app", Decimal(20001))], REQUEST)
    plan = R.replay_changes(scenario_steps(spark), versions_frame(spark), r)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_replay_sends_no_side_that_grows_to_the_driver(spark):
    """Written steps, levels and first crossings are small files of many rows; none of them is broadcast."""
    r = spark.createDataFrame([(1, START, "dbo", "test_app", Decimal(20001))], REQUEST)
    made = R.plan_replay(scenario_steps(spark), versions_frame(spark), r)
    for df in (R.executed_steps(made), R.final_steps(made)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        # What `running_total` adds from its summary, one row per range and key, may be broadcast.
        assert all("__ordered_" in line for line in plan.splitlines() if "BroadcastHashJoin" in line)


def test_case_blind_replay(spark):
    log = spark.createDataFrame(
        [(i, START, name, "test_app", Decimal(to)) for i, (name, to) in enumerate([("dbo", 20001), ("DBO ", 10001)])], REQUEST
    )
    steps, versions = scenario_steps(spark), versions_frame(spark)
    ran = R.replay_changes(steps, versions, log, case_sensitive=False)
    assert rows(ran.groupBy("request_id").count()) == [(0, 26), (1, 16)]
    state = R.replay_final_state(steps, versions, log, case_sensitive=False)
    assert rows(state.versions, "version") == [(Decimal(10001),)]
    assert state.steps.filter("completed = 1").count() == 26


def test_requests_without_id_or_time_run_their_steps(spark):
    """Steps, flags and versions tell one story, and requests that tie are taken by version."""
    later = START + dt.timedelta(minutes=1)
    log = [(None, None, 10), (None, START, 30), (None, START, 20), (7, START, 40), (None, later, 25), (None, later, 25)]
    requests = [(i, ts, "s", "k", Decimal(to)) for i, ts, to in log]
    steps = [
        (n + 1, "s", "k", Decimal(v), up, 0, "d", "p", 0) for n, (v, up) in enumerate((v, up) for v in (10, 20, 25, 30, 40) for up in (1, 0))
    ]
    s, v, r = spark.createDataFrame(steps, STEP), versions_frame(spark), spark.createDataFrame(requests, REQUEST)
    machine = Simulation([dict(zip(STEP.fieldNames(), x)) for x in steps], 0)
    oldest = START - dt.timedelta(days=1)
    ran = []
    for i, ts, to in sorted(log, key=lambda x: (x[1] or oldest, -1 if x[0] is None else x[0], x[2])):
        ran += [(i, ts, to, step) for step in machine.request(to)]
    state = R.replay_final_state(s, v, r)
    got = [(x["request_id"], x["ts"], int(x["to_version"]), x["step_id"]) for x in R.replay_changes(s, v, r).collect()]
    assert sorted(got, key=repr) == sorted(ran, key=repr) and len(ran) > 5
    assert {x["id"]: x["completed"] for x in state.steps.collect()} == {i: x["completed"] for i, x in machine.steps.items()}
    assert rows(state.versions, "version") == [(Decimal(25),)]


def test_swings_over_upgrade_steps_form_no_more_rows_than_steps_run(spark):
    """1,000 swings over 1,000 levels cross a million levels, and run each step once."""
    n = 1000
    steps = spark.range(1, n + 1).select(
        "id", F.lit("s").alias("schema_name"), F.lit("k").alias("application_name"), F.col("id").cast("decimal(38,0)").alias("version"),
        F.lit(1).alias("upgrade"), F.lit(0).alias("sequence"), F.lit("d").alias("description"), F.lit("p").alias("procedure_name"), F.lit(0).alias("completed"),
    )
    up = F.when(F.col("id") % 2 == 0, F.least(F.lit(n), F.col("id") + 2)).otherwise(0)
    requests = spark.range(n).select(
        F.col("id").alias("request_id"), F.lit(START).alias("ts"), F.lit("s").alias("schema_name"), F.lit("k").alias("application_name"),
        up.cast("decimal(38,0)").alias("to_version"),
    )
    plan = R.plan_replay(steps, versions_frame(spark), requests)
    ran = R.executed_steps(plan).count()
    assert ran == n
    assert R.crossings(plan.moves).count() == 0
    assert R.records(plan.moves).count() == ran


def _shuffled(df):
    """Rows that went through the shuffles of a query."""
    df.collect()

    def below(node):
        name = node.getClass().getSimpleName()
        if name == "ReusedExchangeExec":
            return 0
        if name == "AdaptiveSparkPlanExec":
            return below(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return below(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        children = node.children()
        return own + sum(below(children.apply(i)) for i in range(children.size()))

    return below(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("done", [0, 1])
def test_steps_run_again_are_not_shuffled_crossing_by_crossing(spark, done):
    """60 swings over 400 levels: 24,000 runs or nearly, from 800 steps and 60 requests; flags end without a shuffle of steps."""
    n, swings = 400, 60
    steps = [(2 * v + up, "s", "k", Decimal(v), up, 0, "d", "p", done * up) for v in range(1, n + 1) for up in (0, 1)]
    requests = [(i, START + dt.timedelta(seconds=i), "s", "k", Decimal(n if i % 2 == 0 else 0)) for i in range(swings)]
    s, v, r = spark.createDataFrame(steps, STEP), versions_frame(spark), spark.createDataFrame(requests, REQUEST)
    ran, flags, _ = _simulate(steps, [], requests)
    plan = R.plan_replay(s, v, r)
    executed, final = R.executed_steps(plan), R.final_steps(plan)
    assert _shuffled(executed) < n * swings / 3
    assert _shuffled(final) < n
    assert rows(executed, "request_id", "step_id") == sorted(ran, key=repr) and len(ran) >= n * (swings - 1)
    assert {x["id"]: x["completed"] for x in final.collect()} == flags


def test_steps_without_version_or_sequence_stay_if_their_key_was_not_asked(spark):
    """As before: of a requested key they are left out, whatever the other steps meet."""
    steps = [(i, "s", key, version, 1, sequence, "d", "p", 0) for i, (key, version, sequence) in enumerate(
        [("k", Decimal(1), 0), ("k", None, 0), ("k", Decimal(1), None), ("other", None, 0), ("other", Decimal(1), None), (None, Decimal(1), 0), (None, None, 0)]
    )]
    requests = spark.createDataFrame([(1, START, "s", "k", Decimal(1))], REQUEST)
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in STEP.fields])
    plan = R.plan_replay(spark.createDataFrame(steps, nullable), versions_frame(spark), requests)
    assert rows(R.final_steps(plan), "id", "completed") == [(0, 1), (3, 0), (4, 0), (5, 0), (6, 0)]


@pytest.mark.parametrize("above", [0, 10**30])
def test_slots_and_requests_are_placed_in_one_cut(spark, monkeypatch, above):
    """Several slots of one version, copies of requests, negative versions, and versions that no 64-bit integer holds."""
    written, write = [], R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, label: written.append(label) or write(df, label))
    pick = random.Random(4)
    wide = lambda v: Decimal(above + v)
    steps = [
        (i, "s", "k" + str(i % 2), wide(v), up, n, "d", "p", pick.randint(0, 1))
        for i, (v, n, up, _) in enumerate(product((-20, -10, 10, 20, 30), (1, 2, 3), (0, 1), (0, 1)))
        if pick.random() < 0.8
    ]
    requests = [(i, START + dt.timedelta(seconds=i), "s", "k" + str(pick.randint(0, 1)), wide(pick.randint(-4, 4) * 10)) for i in range(40)]
    versions = [("s", "k0", above + 10), ("s", "k1", above - 10)]
    ran, flags, _ = _simulate(steps, versions, requests)
    s, r = spark.createDataFrame(steps, STEP), spark.createDataFrame([*requests, (None, None, None, None, wide(10))], REQUEST)
    plan = R.plan_replay(s, versions_frame(spark, *versions), r)
    assert written == ["levels", "located", "moves"]
    assert plan.compact == (above == 0)
    executed, final = R.executed_steps(plan), R.final_steps(plan)
    assert rows(executed, "request_id", "step_id") == sorted(ran, key=repr) and len(ran) > 50
    assert {x["id"]: x["completed"] for x in final.collect()} == flags
    assert final.schema["version"].dataType == executed.schema["to_version"].dataType == STEP["version"].dataType
    by_request = {i: v for i, _, _, _, v in requests}
    assert all(x["to_version"] == by_request[x["request_id"]] for x in executed.collect())
