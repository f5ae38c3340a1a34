import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark.operators import events as E
from tidemark.sources import event_files
from tidemark.sources.event_files import export_events, read_event_files

DEADLOCK = '<event name="xml_deadlock_report" timestamp="{0}"><data name="xml_report">{1}</data></event>'


@pytest.fixture(scope="module")
def recorded(spark):
    given = [
        (1, DEADLOCK.format("2024-01-01T01:02:03Z", "<value><deadlock id='a'/></value>"), E.DEADLOCK_EVENT),
        (2, DEADLOCK.format("2024-01-01T13:02:03Z", "<value><deadlock id='b'/></value>"), E.DEADLOCK_EVENT),
        (3, DEADLOCK.format("2024-01-01T13:02:03.5Z", "<value><deadlock id='c'/></value>"), E.DEADLOCK_EVENT),
        (4, '<event name="login" timestamp="2024-01-01T00:00:00Z"/>', "login"),
        (5, DEADLOCK.format("2024-01-02T00:00:00Z", "<value><a>1</a><b/></value><text>t</text>"), E.DEADLOCK_EVENT),
    ]
    return spark.createDataFrame(given, "event_id int, event_data string, object_name string")


def test_extraction(recorded):
    got = rows(E.extract_events(recorded), "event_id", "fragment", "event_time")
    assert [g[0] for g in got] == [1, 2, 3, 5]
    assert got[0][1:] == ("<deadlock id='a'/>", dt.datetime(2024, 1, 1, 1, 2, 3))
    assert got[3][1] == "<a>1</a><b/>"


def test_other_kind_has_its_own_time(recorded):
    assert rows(E.extract_events(recorded, "login"), "event_id", "event_time") == [(4, dt.datetime(2024, 1, 1))]
    with pytest.raises(ValueError):
        E.extract_events(recorded, 'x"]')


def test_names(recorded):
    named = E.event_file_names(E.extract_events(recorded), "(localdb)\\ProjectsV13")
    stem = "localdb-ProjectsV13-deadlock-"
    assert rows(named, "event_id", "file_name") == [
        (1, f"{stem}20240101-010203.xdl"), (2, f"{stem}20240101-130203.xdl"), (3, f"{stem}20240101-130203-2.xdl"),
        (5, f"{stem}20240102-000000.xdl"),
    ]


def test_export_replaces_files_of_the_same_name(spark, recorded, tmp_path):
    path = str(tmp_path / "out")
    named = E.event_file_names(E.extract_events(recorded), "srv", literal_clock=True)
    export_events(named.filter("event_id in (1, 5)"), path)
    export_events(named.filter("event_id <> 5"), path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".xdl") == [
        "srv-deadlock-20240101-010203.xdl", "srv-deadlock-20240102-120000.xdl"
    ]
    kept = read_event_files(spark, path)
    assert rows(kept, "file_name", "fragment") == [
        ("srv-deadlock-20240101-010203.xdl", "<deadlock id='c'/>"), ("srv-deadlock-20240102-120000.xdl", "<a>1</a><b/>")
    ]


def test_events_without_time_keep_a_file_each(spark, tmp_path):
    path = str(tmp_path / "out")
    given = [(1, None, "a"), (2, None, "b"), (3, dt.datetime(2024, 1, 1), "c")]
    frame = spark.createDataFrame(given, "event_id int, event_time timestamp, fragment string")
    for naming in ({}, {"literal_clock": True}, {"with_id": True}):
        assert E.event_file_names(frame, "srv", **naming).select("file_name").distinct().count() == 3
    export_events(E.event_file_names(frame, "srv", with_id=True), path)
    # Another event of the same second, exported later.
    later = spark.createDataFrame([(9, dt.datetime(2024, 1, 1), "d")], frame.schema)
    export_events(E.event_file_names(later, "srv", with_id=True), path)
    assert rows(read_event_files(spark, path), "fragment") == [("a",), ("b",), ("c",), ("d",)]
    with pytest.raises(Exception, match="no file name"):
        export_events(frame.withColumn("file_name", F.lit(None).cast("string")), path)


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    """Some tasks write their files before another fails; none of them shows, old files stay."""
    path = tmp_path / "out"
    schema = "event_id int, event_time timestamp, fragment string, file_name string"
    good = [(i, dt.datetime(2024, 1, 1), f"<e{i}/>", f"e{i}.xdl") for i in range(40)]
    export_events(spark.createDataFrame(good[:1], schema), str(path))
    with pytest.raises(Exception, match="no file can be called"):
        export_events(spark.createDataFrame([*[(i, t, "new", n) for i, t, _, n in good], (99, None, "", "a/b.xdl")], schema), str(path))
    assert [p.name for p in path.iterdir() if not p.name.startswith(".")] == ["e0.xdl"]
    assert (path / "e0.xdl").read_text() == "<e0/>" and not list(path.glob(".staged-*"))
    export_events(spark.createDataFrame([(1, None, "", "empty.xdl"), (2, None, "é\n", "a b.xdl")], schema), str(path))
    assert rows(read_event_files(spark, str(path))) == [("a b.xdl", "é\n"), ("e0.xdl", "<e0/>")]
    assert (path / "empty.xdl").read_bytes() == b""


def test_many_small_files_share_tasks(spark, tmp_path):
    """5,000 files of some bytes: written by every partition of a shuffle, read by a few tasks, whole."""
    path = tmp_path / "out"
    frame = spark.range(5000).select(
        F.col("id").alias("event_id"), F.lit(None).cast("timestamp").alias("event_time"),
        F.concat(F.lit("<é"), F.col("id").cast("string"), F.lit("/>")).alias("fragment"),
        F.concat(F.lit("a+b%20 "), F.col("id").cast("string"), F.lit(".xdl")).alias("file_name"),
    )
    export_events(frame, str(path))
    for hidden in ("_x.xdl", ".x.xdl", "x.txt"):
        (path / hidden).write_text("no event")
    kept = read_event_files(spark, str(path))
    assert kept.rdd.getNumPartitions() <= 4
    assert rows(kept, "file_name", "fragment") == rows(frame, "file_name", "fragment")
    (tmp_path / "none").mkdir()
    assert rows(read_event_files(spark, str(tmp_path / "none"))) == []


def test_files_are_listed_and_moved_by_tasks(spark, tmp_path, monkeypatch):
    """The driver holds no name: what it plans a read with does not grow with the files."""
    path = tmp_path / "out"
    kept = read_event_files(spark, str(path))
    monkeypatch.setattr(event_files, "NAMES_AT_A_TIME", 30, raising=False)
    monkeypatch.setattr(event_files, "READ_AT_A_TIME", 10, raising=False)
    schema = "event_id int, event_time timestamp, fragment string, file_name string"
    given = [(i, dt.datetime(2024, 1, 1), "" if i == 7 else f"<e{i}/>", f"{'e' * 200}{i}.xdl") for i in range(500)]
    for _ in range(2):
        export_events(spark.createDataFrame(given, schema), str(path))
    assert {p.name for p in path.iterdir()} == {name for *_, name in given}
    wanted = sorted((name, text) for _, _, text, name in given if text)
    assert rows(kept) == wanted and rows(read_event_files(spark, str(path))) == wanted
    partitions = kept._jdf.queryExecution().toRdd().partitions()
    assert spark._jvm.org.apache.spark.util.SizeEstimator.estimate(partitions) < 10000


def test_a_move_done_again_finds_what_is_left(tmp_path):
    staged, target = tmp_path / "staged", tmp_path / "target"
    for folder in (staged, target):
        folder.mkdir()
    (target / "moved.xdl").write_text("moved")
    (staged / "left.xdl").write_text("left")
    for _ in range(2):
        event_files._mover(str(target))(str(staged))
    assert {p.name: p.read_text() for p in target.iterdir()} == {"moved.xdl": "moved", "left.xdl": "left"}
