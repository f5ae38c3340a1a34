import pytest
from helpers import rows

from tidemark.operators import batches as B
from tidemark.sources import sinks
from tidemark.sources.sinks import BatchLedger

SCHEMA = "step_no long, step_type string, external_parts array<string>, name_parts array<string>, category string, batch_count int"


def _plan(spark, *steps):
    return spark.createDataFrame([(n, kind, None, ["s", f"t{n}"], category, count) for n, kind, category, count in steps], SCHEMA)


@pytest.fixture(scope="module")
def plan(spark):
    return _plan(
        spark,
        (1, "CreateElementStep", "View", 1),
        (2, B.BEGIN_PRE, None, 0),
        (3, "CreateElementStep", "View", 2),
        (4, "SqlPrintStep", None, 1),
        (5, "AlterElementStep", "Table", 0),
        (6, "SqlRenameStep", "View", 1),
        (7, "DropElementStep", "Table", 1),
        (8, B.BEGIN_POST, None, 0),
        (9, "CreateElementStep", "View", 1),
    )


def test_numbering(plan):
    assert rows(B.number_batches(plan), "batch_id", "step_no", "description", "dynamic") == [
        (0, 3, "CreateElementStep [s].[t3] batch 0", 1),
        (1, 3, "CreateElementStep [s].[t3] batch 1", 1),
        (2, 6, "SqlRenameStep batch 0", 0),
        (3, 7, "DropElementStep [s].[t7] batch 0", 0),
    ]
    assert rows(B.total_batches(B.number_batches(plan))) == [(4,)]


def test_no_marker_no_batch(spark):
    assert B.number_batches(_plan(spark, (1, "CreateElementStep", "View", 1))).count() == 0
    open_end = _plan(spark, (1, B.BEGIN_PRE, None, 0), (2, "CreateElementStep", "View", 1))
    assert B.number_batches(open_end).count() == 1


def test_interrupted_run_resumes(spark, plan, tmp_path):
    batches = B.number_batches(plan)
    ledger = BatchLedger(spark, str(tmp_path), "db", "r1")
    assert B.pending_batches(batches, ledger.read()).count() == 4
    ledger.record(batches.filter("batch_id < 2"))
    ledger.record(batches.filter("batch_id < 3"))
    assert rows(ledger.read(), "batch_id") == [(0,), (1,), (2,)]
    assert rows(B.pending_batches(batches, ledger.read()), "batch_id") == [(3,)]
    # Another run of the same target has a ledger of its own.
    assert BatchLedger(spark, str(tmp_path), "db", "r2").read().count() == 0
    ledger.drop()
    assert not (tmp_path / "__completedBatches_db_r1").exists()


def test_two_writers_record_a_batch_once(spark, plan, tmp_path, monkeypatch):
    batches = B.number_batches(plan)
    one, two = (BatchLedger(spark, str(tmp_path), "db", "r1") for _ in range(2))
    real, raced = sinks.record_batches, []

    def record_batches(*given):
        if not raced:
            raced.append(True)
            two.record(batches.filter("batch_id in (1, 2)"))
        return real(*given)

    monkeypatch.setattr(sinks, "record_batches", record_batches)
    one.record(batches.filter("batch_id < 2"))
    assert rows(one.read(), "batch_id") == [(0,), (1,), (2,)]


def test_lookups(plan):
    assert rows(B.steps_of_type(plan, "CreateElementStep"), "step_no") == [(1,), (3,), (9,)]
    assert rows(B.first_of_type(plan, "CreateElementStep"), "step_no") == [(1,)]
    assert rows(B.last_of_type(plan, "CreateElementStep"), "step_no") == [(9,)]
    assert B.first_of_type(plan, "gone").count() == 0
    assert B.has_type(plan, "SqlPrintStep") and not B.has_type(plan, "gone")
    assert rows(B.first_last_of_type(plan, ["DropElementStep", "gone"])) == [("DropElementStep", 7, 7, 1), ("gone", None, None, 0)]


def _order(plan, **options):
    return [(r["step_type"], r["phase"]) for r in B.plan_phases(plan, **options).orderBy("final_order").collect()]


PRE, BODY, POST = (B.END_PRE, "pre-deployment"), ("CreateElementStep", "body"), (B.BEGIN_POST, "post-deployment")
DOWN, DATA, UP = (B.VERSION_STEP, "downgrade"), (B.STATIC_DATA_STEP, "static data"), (B.VERSION_STEP, "upgrade")


def _marked(spark, *extra):
    return _plan(
        spark, (1, B.END_PRE, None, 0), (5, "CreateElementStep", "View", 1), (9, B.BEGIN_POST, None, 0), *extra
    )


def test_bracket_is_added(spark):
    begin, end = (B.ADDED_BEGIN, "begin"), (B.ADDED_END, "end")
    assert _order(_marked(spark)) == [PRE, begin, DOWN, BODY, DATA, UP, end, POST]
    assert _order(_marked(spark)) == _order(_marked(spark))


def test_own_bracket_is_used(spark):
    plan = _marked(spark, (3, B.BEGIN_TRANSACTION, None, 0), (7, B.END_TRANSACTION, None, 0))
    begin, end = (B.BEGIN_TRANSACTION, "begin"), (B.END_TRANSACTION, "end")
    assert _order(plan) == [PRE, begin, DOWN, BODY, DATA, UP, end, POST]


def test_without_transaction_markers_are_anchors(spark):
    assert _order(_marked(spark), transactional=False) == [PRE, DOWN, BODY, DATA, UP, POST]
    assert DATA not in _order(_marked(spark), static_data=False)


def test_without_markers_the_head_is_the_anchor(spark):
    kinds = [k for k, _ in _order(_plan(spark, (1, "CreateElementStep", "View", 1)))]
    assert kinds == [B.STATIC_DATA_STEP, B.VERSION_STEP, "CreateElementStep", B.VERSION_STEP]
