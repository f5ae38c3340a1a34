"""Selecting, ordering and applying version changes, for all keys at once."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.names import fold_names, unfold_names
from tidemark.operators.lookups import lookup
from tidemark.operators.ordered import row_numbers
from tidemark.operators.versions import get_version, one_per_key, set_version
from tidemark.schemas import KEY
from tidemark.sources.scratch import new_path

STEP_COLUMNS = ["step_id", "step_version", "step_sequence", "step_description", "step_procedure"]
FLAGS = ["is_upgrade_direction", "is_downgrade_direction"]


def change_requests(versions: DataFrame, targets: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """(key, from_version, to_version); a key without a version starts at 0.

    Two targets of one key fail the job: each would select the key's steps again.
    """
    single = one_per_key(fold_names(targets, KEY, case_sensitive), "to_version", "target")
    current = get_version(versions, unfold_names(single, KEY, case_sensitive), case_sensitive=case_sensitive)
    return current.withColumnRenamed("version", "from_version")


def change_direction(changes: DataFrame) -> DataFrame:
    """Adds the two direction flags; equal versions count as down, NULL as neither."""
    start, end = F.col("from_version"), F.col("to_version")
    known = start.isNotNull() & end.isNotNull()
    return changes.withColumn(
        "is_upgrade_direction", F.when(known & (start < end), 1).otherwise(0)
    ).withColumn("is_downgrade_direction", F.when(known & (start >= end), 1).otherwise(0))


def get_steps(steps: DataFrame, changes: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """Incomplete steps of the chosen direction between the two versions.

    Both directions take the versions above the lower and up to the higher end.
    The side with one row per key is broadcast only if it proves small at run
    time; otherwise a hot key's steps are split over tasks by the skew join.
    """
    directed = change_direction(changes).filter((F.col("is_upgrade_direction") + F.col("is_downgrade_direction")) > 0)
    bounds = fold_names(directed, KEY, case_sensitive).select(
        *KEY,
        F.col("is_upgrade_direction").alias("upgrade"),
        F.least("from_version", "to_version").alias("_low"),
        F.greatest("from_version", "to_version").alias("_high"),
        *FLAGS,
    ).filter("_low < _high")
    open_steps = fold_names(steps.filter(F.col("completed") == 0), KEY, case_sensitive)
    picked = open_steps.join(bounds, [*KEY, "upgrade"]).filter(
        (F.col("version") > F.col("_low")) & (F.col("version") <= F.col("_high"))
    )
    shaped = picked.select(
        *KEY,
        F.col("id").alias("step_id"),
        F.col("version").alias("step_version"),
        F.col("sequence").alias("step_sequence"),
        F.col("description").alias("step_description"),
        F.col("procedure_name").alias("step_procedure"),
        *FLAGS,
    )
    return unfold_names(shaped, KEY, case_sensitive)


def order_steps(selected: DataFrame) -> DataFrame:
    """Adds `run_order` per key: ascending going up, descending going down."""
    up = F.col("is_upgrade_direction") == 1
    order = [
        F.when(up, F.col("step_version")).otherwise(-F.col("step_version")),
        F.when(up, F.col("step_sequence")).otherwise(-F.col("step_sequence")),
        F.col("step_id"),
    ]
    return row_numbers(selected, KEY, order, "run_order")


def change_summary(changes: DataFrame, selected: DataFrame) -> DataFrame:
    """Steps and warnings per change: none selected warns, twice if the version moves."""
    counts = selected.groupBy(*KEY).agg(F.count(F.lit(1)).alias("step_count"))
    joined = changes.select(*KEY, "from_version", "to_version").join(counts, KEY, "left")
    none = F.col("step_count") == 0
    moves = F.col("from_version") != F.col("to_version")
    return joined.withColumn("step_count", F.coalesce("step_count", F.lit(0).cast("long"))).withColumn(
        "warning_count", F.when(none & moves, 2).when(none, 1).otherwise(0)
    )


def apply_change(steps: DataFrame, executed: DataFrame) -> DataFrame:
    """Next `steps` once the `executed` ones succeeded.

    An executed step is completed; every step of the other direction at the
    same version and sequence, whatever its procedure, is open again.
    """
    done = executed.select(F.col("step_id").alias("id")).distinct().withColumn("_done", F.lit(True))
    partner = (
        executed.select(
            *KEY,
            F.col("step_version").alias("version"),
            F.col("step_sequence").alias("sequence"),
            (1 - F.col("is_upgrade_direction")).alias("upgrade"),
        )
        .distinct()
        .withColumn("_reopened", F.lit(True))
    )
    flagged = lookup(steps.join(done, "id", "left"), partner, [*KEY, "version", "sequence", "upgrade"])
    return flagged.withColumn(
        "completed",
        F.when(F.col("_done").isNotNull(), F.lit(1)).when(F.col("_reopened").isNotNull(), F.lit(0)).otherwise(F.col("completed")),
    ).select(*steps.columns)


def cut_after_failure(ordered: DataFrame, failed: str = "failed") -> DataFrame:
    """Adds `outcome`: 'run' before a key's first failure, 'failed' at it, 'skipped' after.

    Only the first failure of each key counts, and that is one row per key.
    """
    fails = F.coalesce(F.col(failed), F.lit(False))
    first = ordered.filter(fails).groupBy(*KEY).agg(F.min("run_order").alias("_first_failure"))
    place, end = F.col("run_order"), F.col("_first_failure")
    outcome = F.when(place > end, "skipped").when(place == end, "failed").otherwise("run")
    return lookup(ordered, first, KEY).withColumn("outcome", outcome).drop("_first_failure")


def advance_version(versions: DataFrame, changes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Next `versions`: keys with a failed step keep theirs, all others reach `to_version`."""
    failed = outcomes.filter(F.col("outcome") == "failed").select(*KEY).distinct()
    reached = changes.filter(F.col("to_version").isNotNull()).join(failed, KEY, "left_anti")
    return set_version(versions, reached.select(*KEY, F.col("to_version").alias("version")))


OUTCOME = T.StructType(
    [
        T.StructField("schema_name", T.StringType()),
        T.StructField("application_name", T.StringType()),
        T.StructField("step_id", T.LongType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ]
)

# Outcomes held on the driver before they are written.
OUTCOME_BATCH = 10_000

StepBody = Callable[[SparkSession], object] | str


def _run_body(spark: SparkSession, body: StepBody | None, name: str) -> str | None:
    """Runs one step; the error text, or None when it succeeded."""
    try:
        if body is None:
            raise LookupError(f"Could not find stored procedure '{name}'.")
        if callable(body):
            body(spark)
        else:
            spark.sql(body).write.format("noop").mode("overwrite").save()
    except Exception as error:  # a failing body is an outcome, whatever it raised
        return str(error)
    return None


def run_steps(ordered: DataFrame, registry: Mapping[tuple[str, str], StepBody], concurrency: int = 4) -> DataFrame:
    """Runs the body behind each (schema, procedure), in order within a key.

    Bodies are Spark jobs, so they are launched from the driver. Keys are hashed
    to `concurrency` lanes; a lane reads its rows one partition at a time and
    writes outcomes in batches, so neither is ever held whole. A failure skips
    the rest of its key and leaves other keys alone.
    """
    spark = ordered.sparkSession
    path = new_path(spark, "outcomes")
    # Lanes write side by side, so each has a folder of its own.
    spark.createDataFrame([], OUTCOME).write.parquet(f"{path}/empty")
    lane_of = F.pmod(F.xxhash64(*KEY), F.lit(concurrency))

    def run_lane(lane: int) -> None:
        rows = (
            ordered.filter(lane_of == lane)
            .select(*KEY, "run_order", "step_id", "step_procedure")
            .orderBy(*KEY, "run_order")
        )
        batch: list[tuple] = []
        failed_key = None
        for row in rows.toLocalIterator(prefetchPartitions=True):
            key = (row["schema_name"], row["application_name"])
            if key == failed_key:
                batch.append((*key, row["step_id"], "skipped", None))
            else:
                body = registry.get((row["schema_name"], row["step_procedure"]))
                error = _run_body(spark, body, f"{row['schema_name']}.[{row['step_procedure']}]")
                failed_key = key if error is not None else None
                batch.append((*key, row["step_id"], "run" if error is None else "failed", error))
            if len(batch) == OUTCOME_BATCH:
                _save(spark, batch, f"{path}/lane-{lane}")
                batch = []
        if batch:
            _save(spark, batch, f"{path}/lane-{lane}")

    with ThreadPoolExecutor(max_workers=concurrency) as pool:
        list(pool.map(run_lane, range(concurrency)))
    return spark.read.schema(OUTCOME).option("recursiveFileLookup", "true").parquet(path)


def _save(spark: SparkSession, batch: list[tuple], path: str) -> None:
    spark.createDataFrame(batch, OUTCOME).coalesce(1).write.mode("append").parquet(path)
