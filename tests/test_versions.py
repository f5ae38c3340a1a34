from decimal import Decimal

import pytest
from helpers import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import versions as V

KEYED = "schema_name string, application_name string, version decimal(38,0)"


def _texts(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string")


@pytest.mark.parametrize(
    "text,base,number",
    [
        ("2020.1.1340", 10000, 202000011340),
        ("20201.15894.1340", 100000, 202011589401340),
        ("2.1", 10000, 20001),
        ("1.3", 10000, 10003),
        ("1.0", 10000, 10000),
        ("1.0.0", 1000, 1000000),
        ("0.0.0", 1000, 0),
        ("3", 10000, 3),
        ("1.10000", 10000, 20000),
        ("-1.5", 10000, -9995),
        ("99999999999999999.1.1.1.1", 10000, 999999999999999990001000100010001),
    ],
)
def test_numbers(spark, text, base, number):
    got = V.parse_version(_texts(spark, text), "t", base).first()["version"]
    assert got == Decimal(number)
    checked = V.parse_version_checked(_texts(spark, text), "t", base).first()
    assert (checked["version"], checked["error"]) == (Decimal(number), None)


@pytest.mark.parametrize(
    "text,reason",
    [
        (None, "null argument value at @version_text is not expected"),
        ("", "Error converting data type varchar to numeric."),
        ("1..2", "Error converting data type varchar to numeric."),
        ("1e3", "Error converting data type varchar to numeric."),
        ("1234567890123456789", "Arithmetic overflow error converting varchar to data type numeric."),
        (".".join(["999999999999999999"] * 9), "Arithmetic overflow error converting expression to data type numeric."),
    ],
)
def test_bad_text(spark, text, reason):
    row = V.parse_version_checked(_texts(spark, text), "t").first()
    assert row["version"] is None
    assert row["error"] == f'Error while parsing version text "{text or ""}". Error (severity=16): {reason}'
    with pytest.raises(PySparkException):
        V.parse_version(_texts(spark, text), "t").collect()


def test_leading_zeros_do_not_count_as_digits(spark):
    row = V.parse_version_checked(_texts(spark, "000000000000000000000007.1"), "t").first()
    assert (row["version"], row["error"]) == (Decimal(70001), None)


def test_padding_aligns_item_counts(spark):
    got = [r["version"] for r in V.parse_version(_texts(spark, "2.1", "2.1.0", "3"), "t", pad_to=3).collect()]
    assert got == [200010000, 200010000, 300000000]


def test_carry_warns(spark):
    row = V.parse_version_checked(_texts(spark, "1.10000"), "t").first()
    assert "10000" in row["warning"]
    # The first item carries into nothing.
    assert V.parse_version_checked(_texts(spark, "20201.1"), "t").first()["warning"] is None


def test_split_keeps_empty_items(spark):
    got = rows(V.split_items(_texts(spark, ".a..b."), "t", "."), "item_number", "item")
    assert got == [(1, ""), (2, "a"), (3, ""), (4, "b"), (5, "")]
    assert rows(V.split_items(_texts(spark, ""), "t", "|"), "item_number", "item") == [(1, "")]
    assert rows(V.split_items(_texts(spark, "a*b"), "t", "*"), "item") == [("a",), ("b",)]
    with pytest.raises(ValueError):
        V.split_items(_texts(spark, "a"), "t", "ab")


def _versions(spark, *given):
    return spark.createDataFrame([(s, a, Decimal(v) if v is not None else None) for s, a, v in given], KEYED)


def test_get_version_defaults(spark):
    known = _versions(spark, ("dbo", "app", 5))
    keys = spark.createDataFrame([("dbo", "app"), ("dbo", "new")], "schema_name string, application_name string")
    assert rows(V.get_version(known, keys)) == [("dbo", "app", Decimal(5)), ("dbo", "new", Decimal(0))]


def test_get_version_refuses_two_rows_of_a_key(spark):
    keys = spark.createDataFrame([("dbo", "app")], "schema_name string, application_name string")
    with pytest.raises(PySparkException, match="more than one version"):
        V.get_version(_versions(spark, ("dbo", "app", 5), ("dbo", "app", 6)), keys).collect()
    with pytest.raises(PySparkException, match="more than one version"):
        V.get_version(_versions(spark, ("dbo", "app", 5), ("DBO", "app", 5)), keys, case_sensitive=False).collect()


def test_names_can_ignore_case_and_trailing_blanks(spark):
    known = _versions(spark, ("dbo", "App", 5))
    keys = spark.createDataFrame([("DBO ", "app")], "schema_name string, application_name string")
    assert V.get_version(known, keys).first()["version"] == 0
    blind = V.get_version(known, keys, case_sensitive=False)
    assert blind.first()["version"] == 5
    assert blind.schema["schema_name"].dataType.simpleString() == "string"
    after = V.set_version(known, _versions(spark, ("DBO", "APP", 9)), case_sensitive=False)
    assert rows(after, "version") == [(Decimal(9),)]


def test_set_version_updates_and_inserts(spark):
    after = V.set_version(_versions(spark, ("a", "x", 1), ("b", "x", 2)), _versions(spark, ("b", "x", 7), ("c", "x", 3)))
    assert rows(after) == [("a", "x", Decimal(1)), ("b", "x", Decimal(7)), ("c", "x", Decimal(3))]


@pytest.mark.parametrize("updates,text", [
    ([("a", "x", None)], "null argument value at @version"),
    ([("a", "x", 1), ("a", "x", 2)], "more than one version"),
])
def test_set_version_refuses(spark, updates, text):
    with pytest.raises(PySparkException, match=text):
        V.set_version(_versions(spark, ("a", "x", 1)), _versions(spark, *updates)).collect()
