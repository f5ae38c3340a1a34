"""The audit trail: writing what a change does, and reading runs back from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import messages as M
from tidemark.operators.changes import change_summary
from tidemark.operators.ordered import running_total
from tidemark.operators.registry import assign_identity, fill_defaults
from tidemark.schemas import AUDIT_EVENT, AUDIT_SEED, KEY
from tidemark.sources.files import exists
from tidemark.sources.scratch import materialize
from tidemark.sources.state import StateStore


def audit_rows(
    events: DataFrame,
    order: list[str],
    session_id: int = 0,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Complete audit rows for `from`, `message`: context columns and ids added.

    Context columns the input already has are kept as given.
    """
    context = {
        "session_id": F.lit(session_id),
        "when": F.current_timestamp(),
        "user_login": F.session_user(),
        "user_identity": F.current_user(),
        "user_session": F.current_user(),
    }
    numbered = assign_identity(fill_defaults(events, context), order, AUDIT_SEED, 1, existing)
    return numbered.select(*[F.col(f.name).cast(f.dataType) for f in AUDIT_EVENT.fields])


def append_audit(
    events: DataFrame, path: str, order: list[str], session_id: int = 0
) -> None:
    """Appends events to the audit log at `path`, ids going on from its largest.

    The log is its own sink: rows of a failed change stay. The ids are reserved first,
    by a commit that one of several writers wins, so writers that append at the same
    time get blocks of their own; a block that a failed append reserved is not used again.
    """
    spark = events.sparkSession
    largest = None
    if exists(spark, path):
        largest = spark.read.schema(AUDIT_EVENT).parquet(path).agg(F.max("id")).first()[0]
    rows = materialize(audit_rows(events, order, session_id), "audit")
    counter = StateStore(spark, f"{path.rstrip('/')}/_reserved", keep=2)
    first = counter.reserve("id", rows.count(), AUDIT_SEED if largest is None else largest + 1)
    rows.withColumn("id", (F.col("id") - AUDIT_SEED + first).cast("long")).write.mode("append").parquet(path)


def _line(position: Column, routine: str, message: Column) -> Column:
    return F.struct(position.cast("long").alias("position"), F.lit(routine).alias("from"), message.alias("message"))


def audit_trace(changes: DataFrame, outcomes: DataFrame, default_error: str = "step failed") -> DataFrame:
    """All messages a run writes per key, numbered in the order it writes them.

    `outcomes` is the ordered selection with `run_order` and `outcome`, and
    `error_message` where known. Positions follow from counts (two lines open a
    run, up to two warn, four belong to a step), so nothing has to be sorted.
    A failed step ends its key's trace at its ERROR line.
    """
    asked = changes.filter(F.col("from_version").isNotNull() & F.col("to_version").isNotNull())
    failed = (
        outcomes.groupBy(*KEY)
        .agg(F.count_if(F.col("outcome") == "failed").alias("failures"))
    )
    summary = change_summary(asked, outcomes).join(failed, KEY, "left")
    start, end, steps = F.col("from_version"), F.col("to_version"), F.col("step_count")
    rule = F.lit(M.RULE)
    tail = 2 + F.col("warning_count") + 4 * steps
    opening = [
        _line(F.lit(1), M.CHANGE_ROUTINE, rule),
        _line(F.lit(2), M.CHANGE_ROUTINE, M.begin(start, end, steps)),
    ]
    first_warning = _line(F.lit(3), M.CHANGE_ROUTINE, M.warn_no_change(start, end))
    second_warning = _line(F.lit(4), M.CHANGE_ROUTINE, M.warn_no_steps(start, end))
    closing = [
        _line(tail + 1, M.VERSION_ROUTINE, M.info(F.col("schema_name"), end, F.col("application_name"))),
        _line(tail + 2, M.CHANGE_ROUTINE, M.cease(start, end)),
        _line(tail + 3, M.CHANGE_ROUTINE, rule),
    ]
    nothing = F.array().cast("array<struct<position:bigint,from:string,message:string>>")
    frame = F.concat(
        F.array(*opening),
        F.when(F.col("warning_count") >= 1, F.array(first_warning)).otherwise(nothing),
        F.when(F.col("warning_count") == 2, F.array(second_warning)).otherwise(nothing),
        F.when(F.coalesce("failures", F.lit(0)) == 0, F.array(*closing)).otherwise(nothing),
    )
    framed = summary.select(*KEY, F.explode(frame).alias("line"))

    given = F.col("error_message") if "error_message" in outcomes.columns else F.lit(None).cast("string")
    application, version, sequence = F.col("application_name"), F.col("step_version"), F.col("step_sequence")
    base = M.step_base(F.col("step_id"), application, version, sequence, F.col("schema_name"), F.col("step_procedure"))
    at = 2 + 4 * (F.col("run_order") - 1)
    common = [
        _line(at + 1, M.CHANGE_ROUTINE, M.start(
            F.col("is_upgrade_direction"), F.col("is_downgrade_direction"),
            application, version, sequence, F.col("step_description"),
        )),
        _line(at + 2, M.STEP_ROUTINE, M.execute(base)),
    ]
    good = F.array(
        *common,
        _line(at + 3, M.STEP_ROUTINE, M.success(F.col("step_id"))),
        _line(at + 4, M.CHANGE_ROUTINE, M.finish(application, version, sequence)),
    )
    bad = F.array(*common, _line(at + 3, M.STEP_ROUTINE, M.error(F.coalesce(given, F.lit(default_error)), base)))
    stepped = outcomes.filter(F.col("outcome") != "skipped").select(
        *KEY, F.explode(F.when(F.col("outcome") == "failed", bad).otherwise(good)).alias("line")
    )
    return framed.unionByName(stepped).select(*KEY, "line.*")


def audit_runs(audit: DataFrame) -> DataFrame:
    """One row per run read back from an audit log, whatever wrote it.

    A run is what a session writes from one BEGIN line to the next.
    """
    message = F.col("message")
    kind = F.regexp_extract(message, r"^([A-Z]+): ", 1)
    marked = audit.filter(message != M.RULE).withColumn("kind", kind)
    numbered = running_total(
        marked, ["session_id"], [F.col("id")], "run_no", (F.col("kind") == "BEGIN").cast("long")
    ).filter("run_no > 0")

    def only(wanted: str, pattern: str, group: int) -> Column:
        return F.max(F.when(F.col("kind") == wanted, F.regexp_extract(message, pattern, group)))

    moved = r"^BEGIN: Change version from (-?\d+) to (-?\d+) via (\d+) steps\.$"
    named = r"(?s)^INFO: Setting \"(.*)\" schema's version to \"-?\d+\" registered by application \"(.*)\"\.$"
    called = r"(?s)^EXEC: step_id=\d+, (.*)\(-?\d+\)\+-?\d+ via (.*)\.\[.*\]\(\)$"
    runs = numbered.groupBy("session_id", "run_no").agg(
        F.coalesce(only("INFO", named, 1), only("EXEC", called, 2)).alias("schema_name"),
        F.coalesce(only("INFO", named, 2), only("EXEC", called, 1)).alias("application_name"),
        only("BEGIN", moved, 1).cast("decimal(38,0)").alias("from_version"),
        only("BEGIN", moved, 2).cast("decimal(38,0)").alias("to_version"),
        only("BEGIN", moved, 3).cast("long").alias("planned_steps"),
        F.count_if(F.col("kind") == "SUCCESS").alias("steps_run"),
        F.count_if(F.col("kind") == "WARN").alias("warnings"),
        F.count_if(F.col("kind") == "ERROR").alias("_errors"),
        F.count_if(F.col("kind") == "CEASE").alias("_ends"),
        F.min("when").alias("started"),
        F.max("when").alias("ended"),
    )
    outcome = F.when(F.col("_errors") > 0, "failed").when(F.col("_ends") > 0, "completed").otherwise("open")
    return runs.withColumn("outcome", outcome).drop("_errors", "_ends")
