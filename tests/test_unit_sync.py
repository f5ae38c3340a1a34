"""Unit files to targets: one reconcile over all units against one merge per unit."""

import datetime as dt
import json
from decimal import Decimal as D

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark.operators.reconcile import Unit, reconcile_many
from tidemark.operators.unit_sync import reconcile_units
from tidemark.sources.unit_data import UnitFile, read_unit_rows, write_manifest

PEOPLE = UnitFile("1.data.sql", "people", ("id",), ("id", "name", "pay"))
NAMED = UnitFile("2.DATA.SQL", "people", ("name",), ("id", "name"), ("id",))
TYPES = UnitFile("sub 3+.data.sql", "types", ("k",), ("k", "d", "t", "x", "b"))
PEOPLE_SCHEMA = "id int, name string, pay decimal(10,2)"
TYPES_SCHEMA = "k string, d date, t timestamp, x double, b boolean, other long"


def _files(spark, folder, contents):
    for unit, lines in contents.items():
        (folder / unit.file_name).write_text("".join(x if isinstance(x, str) else json.dumps(x) + "\n" for x in lines))
    write_manifest(spark, str(folder), list(contents))
    return read_unit_rows(spark, str(folder))


@pytest.fixture
def people(spark):
    given = [(1, "a", D("1.50")), (2, "b", None), (3, None, D(3)), (None, "n", D(1)), (4, "d", D(4)), (4, "dd", D(4))]
    return spark.createDataFrame(given, PEOPLE_SCHEMA)


def test_as_one_merge_per_unit(spark, tmp_path, people):
    first = [{"id": 1, "name": "a", "pay": 1.5}, {"id": "2", "name": "B", "pay": None}, "\n", {"id": 3, "pay": "3.00"},
             {"id": None, "name": "n", "pay": 1}, {"id": 8, "name": "x", "pay": 8}, {"id": 8, "name": "y", "pay": 8},
             {"id": 4, "name": "d", "pay": 4}]
    second = [{"id": 77, "name": "a"}, {"id": 78, "name": "new"}, {"id": 79, "name": "B"}]
    units, lines = _files(spark, tmp_path, {PEOPLE: first, NAMED: second})
    got = reconcile_units({"people": people}, units, lines)
    src = spark.createDataFrame(
        [(1, "a", D("1.5")), (2, "B", None), (3, None, D(3)), (None, "n", D(1)), (8, "x", D(8)), (8, "y", D(8)), (4, "d", D(4))],
        PEOPLE_SCHEMA,
    )
    # The second unit does not list `pay`: a plain merge on its two columns, as `pay` stays.
    states, report = reconcile_many([Unit("people", people, src, ["id"], ["id", "name", "pay"])])
    named = spark.createDataFrame([(77, "a"), (78, "new"), (79, "B")], "id int, name string")
    after, later = reconcile_many([Unit("people", states["people"].select("id", "name"), named, ["name"], ["id", "name"], ("id",))])
    assert rows(got.states["people"], "id", "name") == rows(after["people"])
    assert rows(got.states["people"].filter("name in ('a', 'new')")) == [(1, "a", D("1.50")), (78, "new", None)]
    assert got.states["people"].schema.simpleString() == people.schema.simpleString()
    seen = got.report.groupBy("unit_no", "action").count()
    plain = report.unionByName(later.withColumn("unit_no", F.lit(2)), allowMissingColumns=True).groupBy("unit_no", "action").count()
    assert rows(seen) == rows(plain)
    row = got.report.filter("action = 'UPDATE' and unit_no = 1 and row_key[0] = '2'").first()
    assert row["file_name"] == "1.data.sql" and row["new"] == {"id": "2", "name": "B", "pay": None}
    assert row["previous"] == {"id": "2", "name": "b", "pay": None}


def test_equal_values_are_no_change(spark, tmp_path):
    when = dt.datetime(2024, 2, 29, 1, 2, 3, 456)
    target = spark.createDataFrame(
        [("a", dt.date(2024, 2, 29), when, -0.0, True, 5), ("b", None, None, None, None, 6), ("", None, None, float("nan"), False, 7)], TYPES_SCHEMA
    )
    lines = [{"k": "a", "d": "2024-02-29", "t": str(when), "x": 0, "b": True}, {"k": "b"}, {"k": "", "x": "NaN", "b": "false"}]
    units, text = _files(spark, tmp_path, {TYPES: lines})
    got = reconcile_units({"types": target}, units, text)
    assert got.report.count() == 0
    assert rows(got.states["types"], "k", "d", "t", "b", "other") == rows(target, "k", "d", "t", "b", "other")


def test_empty_units_and_targets(spark, tmp_path, people):
    units, lines = _files(spark, tmp_path, {PEOPLE: [], TYPES: [{"k": "new"}]})
    got = reconcile_units({"people": people, "types": spark.createDataFrame([], TYPES_SCHEMA)}, units, lines, delete_values=False)
    assert got.states["people"].count() == 0 and got.states["types"].count() == 1
    assert rows(got.report.groupBy("action", "table_name").count()) == [("DELETE", "people", 6), ("INSERT", "types", 1)]
    assert got.report.filter("action = 'DELETE' and (new is not null or previous is not null)").count() == 0


@pytest.mark.parametrize(
    "line, message",
    [('{"id": 1, "nme": "a"}\n', "not a column of the unit: nme"), ('{"id": "one"}\n', "id cannot hold one"), ("id=1\n", "MALFORMED"),
     ('{"id": 1}\n{"id": 1}\n', "more than one row for a matched merge key")],
)
def test_bad_lines_fail(spark, tmp_path, people, line, message):
    units, lines = _files(spark, tmp_path, {PEOPLE: [line]})
    with pytest.raises(Exception, match=message):
        reconcile_units({"people": people}, units, lines).report.collect()


def test_manifest_and_files_agree(spark, tmp_path, people):
    _files(spark, tmp_path, {PEOPLE: []})
    (tmp_path / "extra.data.sql").write_text("")
    with pytest.raises(ValueError, match="not in the manifest: extra.data.sql"):
        read_unit_rows(spark, str(tmp_path))
    write_manifest(spark, str(tmp_path), [PEOPLE, UnitFile("extra.data.sql", "people", ("id",), ("id",)), NAMED])
    with pytest.raises(ValueError, match="no such unit: 2.DATA.SQL"):
        read_unit_rows(spark, str(tmp_path))
    for wrong in (PEOPLE._replace(key=()), PEOPLE._replace(key=("no",)), PEOPLE._replace(file_name="a.sql")):
        with pytest.raises(ValueError):
            write_manifest(spark, str(tmp_path), [wrong])
    with pytest.raises(LookupError):
        reconcile_units({}, [PEOPLE], people)
