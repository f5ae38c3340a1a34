from helpers import rows

from tidemark.operators import access as A
from tidemark.operators import integrity as I
from tidemark.operators.reconcile import change_report


def test_unique(spark):
    df = spark.createDataFrame([("a", 1), ("A ", 1), ("b", 1), ("b", 1)], "k string, n int")
    assert rows(I.unique_violations(df, ["k", "n"])) == [("b", 1, 2)]
    assert [r[2] for r in rows(I.unique_violations(df, ["k", "n"], case_sensitive=False))] == [2, 2]


def test_foreign_key(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id int, ref int")
    parent = spark.createDataFrame([(1,)], "id int")
    assert rows(I.foreign_key_violations(child, parent, ["ref"], ["id"])) == [(2, 9)]


def test_delete_guard(spark):
    dest = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    report = change_report(dest, dest.filter("id = 1"), ["id"], ["id", "v"], "t")
    child = spark.createDataFrame([(10, 1), (11, 2)], "c int, ref int")
    assert rows(I.delete_guard(child, report, "ref", "id")) == [(11, 2)]


def test_columns(spark):
    df = spark.createDataFrame([("abc",), (None,), ("a",)], "v string")
    rules = [I.Rule("v"), I.Rule("v", 2)]
    assert rows(I.column_violations(df, rules)) == [("v", "max_length(2)", 1), ("v", "not_null", 1)]


def test_permissions(spark):
    members = spark.createDataFrame(
        [("test_user_reader", "reader"), ("test_user_writer", "reader"), ("test_user_writer", "writer"),
         ("test_user_owner", "reader"), ("test_user_owner", "writer"), ("test_user_owner", "owner")],
        "user_id string, role_name string",
    )
    held = A.effective_permissions(members)
    assert rows(held.groupBy("user_id").count()) == [
        ("test_user_owner", 26), ("test_user_reader", 11), ("test_user_writer", 26)
    ]
    users = ["test_user_reader", "test_user_writer", "test_user_owner", "stranger"]
    asked = spark.createDataFrame([(u, "invoke_version_change", "EXECUTE") for u in users], "user_id string, object_name string, privilege string")
    denial = "permission was denied on the object 'invoke_version_change'"
    assert rows(A.check_permission(asked, members), "user_id", "allowed", "message") == [
        ("stranger", 0, denial), ("test_user_owner", 1, None), ("test_user_reader", 0, denial), ("test_user_writer", 1, None)
    ]
    grants = spark.createDataFrame([("reader", "o", "p")], "role_name string, object_name string, privilege string")
    assert A.effective_permissions(members, grants).count() == 3
