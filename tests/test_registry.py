from decimal import Decimal as D

import pytest
from helpers import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import registry as G
from tidemark.schemas import STEP, STEP_BATCH

BATCH = "schema_name string, application_name string, version decimal(38,0), sequence int, description string, procedure_name string"


def _steps(spark, *given):
    return spark.createDataFrame([(i, s, a, D(v), up, 1, text, name, done) for i, s, a, v, up, text, name, done in given], STEP)


def _batch(spark, *given):
    return spark.createDataFrame([(s, a, D(v), 1, text, name) for s, a, v, text, name in given], BATCH)


@pytest.fixture(scope="module")
def registered(spark):
    return _steps(
        spark,
        (1, "[dbo]", "a", 1, 1, "old", "p1", 1),
        (2, "[dbo]", "a", 2, 1, "old", "p2", 0),
        (3, "[dbo]", "b", 1, 1, "old", "p1", 0),
        (4, "[dbo]", "a", 1, 0, "old", "p1", 1),
    )


@pytest.mark.parametrize("direction,word", [("up", "upgrade"), ("down", "downgrade")])
@pytest.mark.parametrize("schema,application,empty,name", [
    (None, "tests", False, "schema_name"), ("[dbo]", None, False, "application_name"), ("[dbo]", "myapp", True, "step"),
])
def test_argument_errors(spark, direction, word, schema, application, empty, name):
    steps = spark.createDataFrame([] if empty else [(D(1), 1, "description", "procedure_name")], STEP_BATCH)
    with pytest.raises(G.RegistrationError) as caught:
        G.validate_step_batch(schema, application, steps, direction)
    text = str(caught.value)
    assert f"null argument value at @{name} is not expected" in text
    assert text.startswith(f"Error while registering {word} step in register_{word}_step for ")


def test_valid_arguments_pass(spark):
    G.validate_step_batch("[dbo]", "app", spark.createDataFrame([(D(1), 1, "d", "p")], STEP_BATCH))


def test_fleet_checks(spark):
    G.validate_fleet_batch(_batch(spark, ("s", "a", 1, "t", "p")))
    for bad, text in ((_batch(spark), "@step"), (_batch(spark, (None, "a", 1, "t", "p")), "@schema_name")):
        with pytest.raises(G.RegistrationError, match=text):
            G.validate_fleet_batch(bad)


@pytest.mark.parametrize("direction,flag", [("up", 1), ("down", 0)])
def test_valid_call_registers(spark, direction, flag):
    after = G.register_steps(_steps(spark), _batch(spark, ("[dbo]", "app", 1, "description", "procedure_name")), direction)
    assert rows(after.next_steps) == [(1, "[dbo]", "app", D(1), flag, 1, "description", "procedure_name", 0)]


def test_merge_arms_by_key(spark, registered):
    batch = _batch(spark, ("[dbo]", "a", 1, "new", "p1"), ("[dbo]", "a", 3, "new", "p3"))
    after = G.register_steps(registered, batch, "up")
    assert rows(after.next_steps, "id", "description", "completed") == [
        (1, "new", 1), (3, "old", 0), (4, "old", 1), (5, "new", 0)
    ]
    assert rows(after.report, "action", "id") == [("DELETE", 2), ("INSERT", 5), ("UPDATE", 1)]


def test_delete_scope_all_reaches_other_keys(spark, registered):
    after = G.register_steps(registered, _batch(spark, ("[dbo]", "a", 1, "new", "p1")), "up", delete_scope="all")
    assert rows(after.next_steps, "id") == [(1,), (4,)]


def test_duplicate_of_a_registered_step_fails(spark, registered):
    batch = _batch(spark, ("[dbo]", "a", 1, "x", "p1"), ("[dbo]", "a", 1, "y", "p1"))
    with pytest.raises(PySparkException, match="more than one row"):
        G.register_steps(registered, batch, "up").next_steps.collect()
    assert rows(G.merge_source_duplicates(batch, G.MERGE_KEY, registered), "procedure_name", "copies") == [("p1", 2)]


def test_unmatched_duplicates_are_both_inserted(spark, registered):
    batch = _batch(spark, ("[dbo]", "c", 1, "x", "p1"), ("[dbo]", "c", 1, "y", "p1"))
    after = G.register_steps(registered, batch, "up")
    assert rows(after.next_steps.filter("application_name = 'c'"), "id", "description") == [(5, "x"), (6, "y")]
    assert G.merge_source_duplicates(batch, G.MERGE_KEY, registered).count() == 0


def test_case_blind_registration(spark, registered):
    batch = _batch(spark, ("[DBO]", "A", 1, "new", "P1"))
    blind = G.register_steps(registered, batch, "up", case_sensitive=False).next_steps
    assert rows(blind.filter("upgrade = 1"), "id", "description") == [(1, "new"), (3, "old")]
    assert G.register_steps(registered, batch, "up").next_steps.count() == 5


def test_missing_procedures(spark, registered):
    catalog = spark.createDataFrame([("[dbo]", "P1")], "schema_name string, procedure_name string")
    assert rows(G.missing_procedures(registered, catalog), "id") == [(1,), (2,), (3,), (4,)]
    assert rows(G.missing_procedures(registered, catalog, case_sensitive=False), "id") == [(2,)]
    with pytest.raises(G.RegistrationError, match=r"specified procedure \[dbo\].p2 does not exists in the schema"):
        G.require_procedures(registered, catalog, case_sensitive=False)


def test_identity_goes_on_after_existing(spark):
    new = spark.range(100).withColumnRenamed("id", "n")
    got = G.assign_identity(new, [F.col("n").desc()], seed=1, existing=spark.createDataFrame([(7,)], "id long"))
    assert {r["n"]: r["id"] for r in got.collect()} == {n: 8 + 99 - n for n in range(100)}
    fresh = G.assign_identity(new, ["n"], seed=0, existing=spark.range(0))
    assert {r["n"]: r["id"] for r in fresh.collect()} == {n: n for n in range(100)}


def test_defaults_fill_absent_columns_only(spark):
    df = spark.createDataFrame([(1, None)], "id int, completed int")
    assert rows(G.fill_defaults(df, G.STEP_DEFAULTS)) == [(1, None, 1)]
