"""A registration that refuses key by key."""

from decimal import Decimal as D

from helpers import rows

from tidemark.operators.audit import audit_rows
from tidemark.operators.registry import register_batch, register_steps
from tidemark.schemas import STEP

BATCH = "schema_name string, application_name string, version decimal(38,0), sequence int, description string, procedure_name string"


def test_each_key_is_accepted_or_refused_for_its_first_reason(spark):
    held = [(1, "s", "good", D(1), 1, 0, "old", "p1", 1), (2, "s", "good", D(2), 1, 0, "old", "p2", 1), (3, "s", "twice", D(1), 1, 0, "old", "p1", 0),
            (4, "s", "none", D(1), 1, 0, "old", "p1", 0), (5, "s", "good", D(1), 0, 0, "down", "p1", 0)]
    given = [
        ("s", "good", D(1), 0, "new", "p1"), ("s", "good", D(3), 0, "new", "p2"),
        ("s", "twice", D(1), 0, "a", "p1"), ("s", "twice", D(1), 0, "b", "p1"),
        ("s", "lacks", D(1), 0, "a", "p9"), ("s", "lacks", None, 0, "a", "p8"),
        ("s", "nulls", None, 0, "a", "p1"), ("s", "long", D(1), 0, "x" * 129, "p1"),
        (None, "app", D(1), 0, "a", "p1"), ("s", None, D(1), 0, "a", "p9"),
        ("s", "fresh twice", D(1), 0, "a", "p1"), ("s", "fresh twice", D(1), 0, "b", "p1"),
    ]
    steps, batch = spark.createDataFrame(held, STEP), spark.createDataFrame(given, BATCH)
    catalog = spark.createDataFrame([("s", "p1"), ("s", "p2")], "schema_name string, procedure_name string")
    asked = spark.createDataFrame([("s", "none"), ("s", "good")], "schema_name string, application_name string")
    made = register_batch(steps, batch, catalog, "up", asked)
    got = {(r["schema_name"], r["application_name"]): r for r in made.outcomes.collect()}
    reasons = {k[1] if k[0] else k: (r["message"] or "accepted").split("(severity=16): ")[-1] for k, r in got.items()}
    assert reasons == {
        "good": "accepted",
        "fresh twice": "accepted",
        "twice": "the source holds more than one row for a matched merge key",
        "lacks": "specified procedure s.p8 does not exists in the schema",
        "nulls": "null argument value at @step.version is not expected",
        "long": "String or binary data would be truncated in column 'description' of 128 characters.",
        "none": "null argument value at @step is not expected",
        None: "null argument value at @application_name is not expected",
        (None, "app"): "null argument value at @schema_name is not expected",
    }
    assert got["s", "lacks"]["message"].startswith(
        'Error while registering upgrade step in register_upgrade_step for "lacks" application within [s] schema. '
    )
    assert tuple(got["s", "good"])[4:] == (1, 1, 1) and tuple(got["s", "fresh twice"])[4:] == (2, 0, 0)
    # Accepted keys end as a registration of them alone would leave them; refused keys are as they were.
    alone = register_steps(steps, batch.filter("application_name in ('good', 'fresh twice')"), "up").next_steps
    assert rows(made.next_steps) == rows(alone)
    assert {3, 4} <= {r["id"] for r in made.next_steps.collect()}
    audit = audit_rows(made.refusals, ["message"]).collect()
    assert len(audit) == 7 and {a["from"] for a in audit} == {"register_upgrade_step"}


def test_nothing_given(spark):
    steps, batch = spark.createDataFrame([], STEP), spark.createDataFrame([], BATCH)
    made = register_batch(steps, batch, None, "down")
    assert made.outcomes.count() == 0 and made.next_steps.count() == 0 and made.refusals.count() == 0


def test_case_blind_keys(spark):
    steps = spark.createDataFrame([(1, "S", "App", D(1), 1, 0, "old", "P1", 0)], STEP)
    batch = spark.createDataFrame([("s", "app ", D(1), 0, "new", "p1")], BATCH)
    catalog = spark.createDataFrame([("S", "P1")], "schema_name string, procedure_name string")
    made = register_batch(steps, batch, catalog, case_sensitive=False)
    assert rows(made.outcomes, "outcome", "updated") == [("accepted", 1)]
    assert rows(made.next_steps, "id", "description") == [(1, "new")]
    assert rows(register_batch(steps, batch, catalog).outcomes, "outcome") == [("refused",)]
