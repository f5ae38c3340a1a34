import pytest
from helpers import rows
from pyspark.errors import PySparkException

from tidemark.operators import reconcile as R

USER = ["id", "login", "givename", "surname"]
SCHEMA = "id int, login string, givename string, surname string"
# The system users of the worked example.
SYSTEM = [
    (0, "localsystem", "localsystem", "localsystem"),
    (1, "sysDevApp01", "Development", "Application 1"),
    (2, "sysDevApp02", "Development", "Application 2"),
]


@pytest.fixture(scope="module")
def src(spark):
    return spark.createDataFrame(SYSTEM, SCHEMA)


@pytest.fixture(scope="module")
def dest(spark):
    return spark.createDataFrame([SYSTEM[0], (1, "sysDevApp01", "Dev", None), (9, "gone", "g", "s")], SCHEMA)


def test_full_sync(dest, src):
    assert rows(R.reconcile(dest, src, ["id"], USER)) == SYSTEM


def test_twice_reports_nothing(dest, src):
    after = R.reconcile(dest, src, ["id"], USER)
    assert R.change_report(after, src, ["id"], USER, "user").count() == 0


def test_report(dest, src):
    got = rows(R.change_report(dest, src, ["id"], USER, "[template].[user]"))
    assert got == [
        ("DELETE", "[template].[user]", None, 9, None, "gone", None, "g", None, "s"),
        ("INSERT", "[template].[user]", 2, None, "sysDevApp02", None, "Development", None, "Application 2", None),
        ("UPDATE", "[template].[user]", 1, 1, "sysDevApp01", "sysDevApp01", "Development", "Dev", "Application 1", None),
    ]


def test_literal_deletes_have_no_values(dest, src):
    got = R.change_report(dest, src, ["id"], USER, "user", delete_values=False).filter("action = 'DELETE'")
    assert rows(got) == [("DELETE", "user", *[None] * 8)]


def test_null_changes_count(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, None)], "id int, v string")
    assert rows(R.change_report(a, b, ["id"], ["id", "v"], "t"), "previous_id") == [(1,), (2,)]


def test_natural_key_keeps_target_id(spark, src):
    dest = spark.createDataFrame([(50, "sysDevApp01", "old", "old")], SCHEMA)
    after = R.reconcile(dest, src, ["login"], USER, insert_only=("id",))
    assert rows(after, "id", "login", "givename") == [
        (0, "localsystem", "localsystem"), (2, "sysDevApp02", "Development"), (50, "sysDevApp01", "Development")
    ]
    # A differing id alone is no change.
    assert R.change_report(after, src, ["login"], USER, "t", insert_only=("id",)).count() == 0


def test_case_blind_key(spark, src):
    dest = spark.createDataFrame([(50, "LOCALSYSTEM ", "localsystem", "localsystem")], SCHEMA)
    after = R.reconcile(dest, src, ["login"], USER, insert_only=("id",), case_sensitive=False)
    assert after.count() == 3 and after.filter("id = 50").count() == 1


def test_repeated_source_key(spark, dest):
    double = spark.createDataFrame([SYSTEM[0], SYSTEM[0]], SCHEMA)
    with pytest.raises(PySparkException, match="more than one row"):
        R.reconcile(dest, double, ["id"], USER).collect()
    # Nothing in the target answers, so both copies are added.
    assert R.reconcile(dest.limit(0), double, ["id"], USER).count() == 2


def test_many_units_in_order(spark, dest, src):
    groups = spark.createDataFrame([(0, "system"), (1, "apps")], "id int, name string")
    states, report = R.reconcile_many(
        [
            R.Unit("user", dest, src, ["id"], USER),
            R.Unit("group", groups.limit(0), groups, ["id"], ["id", "name"]),
            # A later unit of the same table starts from the earlier one's result.
            R.Unit("user", dest, src, ["id"], USER),
        ]
    )
    assert rows(states["user"]) == SYSTEM
    assert rows(report.groupBy("unit_no").count()) == [(1, 3), (2, 2)]
    assert rows(report.filter("unit_no = 2"), "name", "login") == [("apps", None), ("system", None)]


def test_small_source_does_not_shuffle_target(spark):
    """A broadcast source leaves the large side of the left join where it is."""
    big = spark.range(100_000).selectExpr("id", "cast(id as string) as v")
    small = spark.range(10).selectExpr("id", "'x' as v")
    df = R.reconcile(big, small, ["id"], ["id", "v"])
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "FullOuter" not in plan
