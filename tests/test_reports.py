from xml.etree import ElementTree

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark.functions.names import qualified_name
from tidemark.operators import reports as R
from tidemark.sources.sinks import write_plan_reports, write_statistics_xml


@pytest.fixture(scope="module")
def elements(spark):
    return spark.createDataFrame([("View",), ("Table",), ("View",), ("subtotal",)], "kind string")


def test_summary(elements):
    assert rows(R.summarize(elements, "kind", "c"), "key", "value") == [
        ("Table", 1), ("View", 2), ("subtotal", 1), ("subtotal", 4), ("total items", 3)
    ]


def test_summary_of_nothing(elements):
    assert rows(R.summarize(elements.limit(0), "kind", "c"), "key", "value") == [("subtotal", 0), ("total items", 0)]


def test_sort_modes(elements):
    def keys(mode):
        return [r["key"] for r in R.summarize_sorted(elements, "kind", "c", mode).orderBy("position").collect()]

    totals = ["subtotal", "total items"]
    assert keys("NAME") == ["Table", "View", "subtotal", *totals]
    assert keys("value") == ["Table", "subtotal", "View", *totals]
    assert sorted(keys(" ")) == sorted(keys("name"))
    with pytest.raises(ValueError, match="was not valid"):
        keys("size")


def test_survey(spark):
    edges = spark.createDataFrame([("Peer",), ("Peer",), ("Odd",)], "relationship_type string")
    assert rows(R.survey_relationships(edges), "key", "value") == [("Composing", 0), ("Hierarchical", 0), ("Peer", 2), ("subtotal", 3)]


def test_model_info(spark):
    options = spark.createDataFrame([(2, "b"), (1, "a")], "n int, collation string")
    assert rows(R.model_info(options, "Sql130", "n"), "key", "value") == [("Collation", "a"), ("Version", "Sql130")]
    assert rows(R.model_info(options.limit(0), "Sql130", "n"), "key") == [("Version",)]


def test_text_report(elements):
    report = R.statistics_report(R.summarize(elements.filter("kind <> 'subtotal'"), "kind", "My Elements"))
    assert {r["line"] for r in report.collect()} == {
        "        Table: 1", "         View: 2", "     subtotal: 3", "  total items: 2"
    }
    assert rows(report.select("xml_category").distinct()) == [("MyElements",)]
    assert ("total_items",) in rows(report, "xml_key")
    text = [r["line"] for r in R.report_lines(report, F.lit(1), F.col("key")).collect()]
    assert text[:2] == ["My Elements", "-----------------"] and text[-1] == " " and len(text) == 7


def _plan(spark):
    return spark.createDataFrame(
        [
            (1, "SqlRenameStep", None, ["a", "b"], "Table", "old", "new", "sch", "x"),
            (2, "SqlMoveSchemaStep", None, ["a", "b"], "Table", "old", "new", "sch", ""),
            (3, "CreateElementStep", ["srv"], ["a", "b"], "View", "old", "new", "sch", "body"),
            (4, "SqlPrintStep", None, ["a"], "View", "old", "new", "sch", None),
        ],
        "step_no long, step_type string, external_parts array<string>, name_parts array<string>, category string,"
        "old_name string, new_name string, new_schema string, script string",
    )


def test_plan_report(spark):
    assert rows(R.plan_report(_plan(spark))) == [
        (1, "SqlRenameStep", None, "Table", "old", "new", None, None),
        (2, "SqlMoveSchemaStep", None, "Table", "old", None, "sch", None),
        (3, "CreateElementStep", "[srv].[a].[b]", "View", None, None, None, None),
        (4, "SqlPrintStep", None, None, None, None, None, None),
    ]
    assert rows(R.plan_report(_plan(spark), True), "script") == [("body",), ("x",), (None,), (None,)]


def test_report_names():
    assert R.report_names("given", "db") == ("given.summary.xml", "given.details.xml")
    assert R.report_names(None, "db")[0] == "db.summary.xml"


def test_qualified_name(spark):
    df = spark.createDataFrame([(["x"], ["a", "b"]), (None, ["a"])], "e array<string>, p array<string>")
    assert rows(df.select(qualified_name(F.col("e"), F.col("p")))) == [("[a]",), ("[x].[a].[b]",)]


def test_xml_sinks(spark, tmp_path, elements):
    path = str(tmp_path / "stats")
    write_statistics_xml(R.statistics_report(R.summarize(elements, "kind", "My Elements")), path)
    back = spark.read.format("xml").option("rowTag", "MyElements").load(path)
    assert (3, 1, 2) in rows(back, "total_items", "Table", "View")
    document = spark.read.text(path, wholetext=True).first()[0]
    assert [x.tag for x in ElementTree.fromstring(document.split("?>")[1])] == ["MyElements"]
    summary, details = str(tmp_path / "s"), str(tmp_path / "d")
    write_plan_reports(_plan(spark), summary, details)
    back = spark.read.format("xml").option("rowTag", "Operation").load(details)
    assert rows(back.filter("_StepNo = 3"), "_Name", "_Category", "_VALUE") == [("[srv].[a].[b]", "View", "body")]
    assert "_VALUE" not in spark.read.format("xml").option("rowTag", "Operation").load(summary).columns
