"""Deployment plans: batches that can be resumed, step lookups, final order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import qualified_name
from tidemark.operators.ordered import row_numbers, running_total

# Plan markers and step kinds.
BEGIN_PRE = "BeginPreDeploymentScriptStep"
END_PRE = "EndPreDeploymentScriptStep"
BEGIN_POST = "BeginPostDeploymentScriptStep"
PRINT_STEP = "SqlPrintStep"
ELEMENT_STEPS = ("CreateElementStep", "AlterElementStep", "DropElementStep")
BEGIN_TRANSACTION = "SqlBeginTransactionStep"
END_TRANSACTION = "SqlEndTransactionStep"
ADDED_BEGIN = "CustomSqlBeginTransactionStep"
ADDED_END = "CustomSqlEndTransactionStep"
VERSION_STEP = "DeploySchemaVersionStep"
STATIC_DATA_STEP = "DeployStaticDataModelStep"

# Object kinds whose statements must run as dynamic text.
DYNAMIC_KINDS = (
    "Schema",
    "Procedure",
    "View",
    "TableValuedFunction",
    "ScalarFunction",
    "DatabaseDdlTrigger",
    "DmlTrigger",
    "ServerDdlTrigger",
)


def _position(plan: DataFrame, kind: str, last: bool = False):
    """Step number of the first (or last) step of a kind, NULL when there is none."""
    pick = F.max if last else F.min
    return plan.agg(pick(F.when(F.col("step_type") == kind, F.col("step_no"))).alias("p")).scalar()


def number_batches(plan: DataFrame) -> DataFrame:
    """Dense ids from 0 for the batches between the pre- and post-deployment markers.

    Ids are running totals of batch counts, so steps are numbered before they
    are spread into batches.
    """
    start, stop = _position(plan, BEGIN_PRE), _position(plan, BEGIN_POST)
    body = plan.filter(
        (F.col("step_no") > start)
        & (stop.isNull() | (F.col("step_no") < stop))
        & (F.col("step_type") != PRINT_STEP)
        & (F.col("batch_count") > 0)
    )
    counted = running_total(
        body, [], [F.col("step_no")], "_first", F.col("batch_count"), inclusive=False
    )
    spread = counted.select("*", F.explode(F.sequence(F.lit(0), F.col("batch_count") - 1)).alias("batch_index"))
    has_element = F.col("step_type").isin(*ELEMENT_STEPS)
    name = qualified_name(F.col("external_parts"), F.col("name_parts"))
    what = F.when(has_element, F.concat("step_type", F.lit(" "), name)).otherwise(F.col("step_type"))
    return spread.select(
        "step_no",
        (F.col("_first") + F.col("batch_index")).alias("batch_id"),
        F.concat(what, F.lit(" batch "), F.col("batch_index").cast("string")).alias("description"),
        F.when(has_element & F.col("category").isin(*DYNAMIC_KINDS), 1).otherwise(0).alias("dynamic"),
    )


def total_batches(batches: DataFrame) -> DataFrame:
    """The number of batches a plan has, as one row."""
    return batches.agg(F.count(F.lit(1)).alias("total_batch_count"))


def pending_batches(batches: DataFrame, ledger: DataFrame) -> DataFrame:
    """Batches whose id the ledger does not hold."""
    return batches.join(ledger.select("batch_id"), "batch_id", "left_anti")


def record_batches(ledger: DataFrame, done: DataFrame) -> DataFrame:
    """The ledger with finished batches added; an id is held once."""
    fresh = done.select("batch_id", "description").join(ledger.select("batch_id"), "batch_id", "left_anti")
    single = fresh.groupBy("batch_id").agg(F.max("description").alias("description"))
    return ledger.select("batch_id", "description").unionByName(single)


def steps_of_type(plan: DataFrame, step_type: str) -> DataFrame:
    """Plan steps of one kind; the order is in `step_no`."""
    return plan.filter(F.col("step_type") == step_type)


def first_last_of_type(plan: DataFrame, step_types: list[str]) -> DataFrame:
    """Per asked kind: its first and last step, and whether it occurs at all."""
    asked = plan.sparkSession.createDataFrame([(t,) for t in step_types], "step_type string")
    found = (
        plan.filter(F.col("step_type").isin(*step_types))
        .groupBy("step_type")
        .agg(F.min("step_no").alias("first_step_no"), F.max("step_no").alias("last_step_no"))
    )
    return asked.join(found, "step_type", "left").withColumn(
        "has_type", F.when(F.col("first_step_no").isNotNull(), 1).otherwise(0)
    )


def first_of_type(plan: DataFrame, step_type: str) -> DataFrame:
    """The first step of a kind, as at most one row."""
    return plan.filter((F.col("step_type") == step_type) & (F.col("step_no") == _position(plan, step_type)))


def last_of_type(plan: DataFrame, step_type: str) -> DataFrame:
    """The last step of a kind, as at most one row."""
    return plan.filter((F.col("step_type") == step_type) & (F.col("step_no") == _position(plan, step_type, last=True)))


def has_type(plan: DataFrame, step_type: str) -> bool:
    """Whether a kind occurs in the plan."""
    return not steps_of_type(plan, step_type).isEmpty()


def plan_phases(
    plan: DataFrame, transactional: bool = True, static_data: bool = True
) -> DataFrame:
    """The final order of a publish, with the steps it adds.

    Pre-deployment, begin, downgrade, body, static data, upgrade, end,
    post-deployment. Begin and end are added only to a transactional plan that
    has no begin; without them the pre/post markers (or the head) are anchors.
    """
    def at(pick, kind):
        return pick(F.when(F.col("step_type") == kind, F.col("step_no")))

    # One row of positions, from one pass, whatever the plan's length.
    anchors = plan.agg(
        F.min("step_no").alias("head"),
        at(F.min, END_PRE).alias("end_pre"),
        at(F.min, BEGIN_POST).alias("begin_post"),
        F.coalesce(at(F.max, BEGIN_TRANSACTION), at(F.max, ADDED_BEGIN)).alias("begin"),
        F.coalesce(at(F.max, END_TRANSACTION), at(F.max, ADDED_END)).alias("end"),
        at(F.max, ADDED_END).alias("custom_end"),
    )
    col = F.col
    missing = F.lit(transactional) & col("begin").isNull()
    adds_begin = missing & col("end_pre").isNotNull()
    adds_end = missing & col("custom_end").isNull() & col("begin_post").isNotNull()
    fallback_begin = F.coalesce("end_pre", "head")
    fallback_end = F.coalesce("begin_post", "head")
    opens = F.when(F.lit(transactional), F.coalesce("begin", fallback_begin)).otherwise(fallback_begin)
    # An end the plan already has is the anchor; an added one stands right before
    # the post-deployment marker, which is the fallback anchor anyway.
    closes = F.when(F.lit(transactional), F.coalesce("end", fallback_end)).otherwise(fallback_end)
    anchors = anchors.withColumns({"adds_begin": adds_begin, "adds_end": adds_end, "opens": opens, "closes": closes})

    def added(shown, place, side, rank, kind, phase):
        return F.when(
            shown,
            F.struct(
                place.cast("long").alias("place"), F.lit(side).alias("side"), F.lit(rank).alias("rank"),
                F.lit(kind).alias("step_type"), F.lit(phase).alias("phase"),
            ),
        )

    extra = anchors.select(
        F.explode(
            F.array_compact(
                F.array(
                    added(col("adds_begin"), col("end_pre"), 1, 1, ADDED_BEGIN, "begin"),
                    added(F.lit(True), col("opens"), 1, 2, VERSION_STEP, "downgrade"),
                    added(F.lit(static_data), col("closes"), -1, 1, STATIC_DATA_STEP, "static data"),
                    added(F.lit(True), col("closes"), -1, 2, VERSION_STEP, "upgrade"),
                    added(col("adds_end"), col("begin_post"), -1, 3, ADDED_END, "end"),
                )
            )
        ).alias("s")
    ).select("s.*", F.lit(None).cast("long").alias("step_no"))

    opened, closed = anchors.select("opens").scalar(), anchors.select("closes").scalar()
    is_begin = col("step_type").isin(BEGIN_TRANSACTION, ADDED_BEGIN)
    is_end = col("step_type").isin(END_TRANSACTION, ADDED_END)
    phase = (
        F.when(is_begin, "begin")
        .when(is_end, "end")
        .when(col("step_no") <= opened, "pre-deployment")
        .when(col("step_no") >= closed, "post-deployment")
        .otherwise("body")
    )
    own = plan.select(
        col("step_no").cast("long").alias("place"), F.lit(0).alias("side"), F.lit(0).alias("rank"), "step_type",
        phase.alias("phase"), col("step_no").cast("long").alias("step_no"),
    )
    order = [col("place"), col("side"), col("rank")]
    return row_numbers(own.unionByName(extra), [], order, "final_order").select(
        "final_order", "phase", "step_type", "step_no"
    )
