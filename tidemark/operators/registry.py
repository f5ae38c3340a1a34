"""The step registry: checking, registering and numbering steps."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import messages as M
from tidemark.functions.names import fold_names, unfold_names
from tidemark.operators.lookups import lookup
from tidemark.operators.merging import DUPLICATE_SOURCE, answered, unanswered
from tidemark.operators.ordered import row_numbers
from tidemark.schemas import KEY, STEP, STEP_BATCH, STEP_DEFAULTS, STEP_LENGTHS, STEP_SEED, require_columns
from tidemark.sources.scratch import materialize

MERGE_KEY = [*KEY, "version", "sequence", "procedure_name"]
_FLAG = {"up": 1, "down": 0}


class RegistrationError(ValueError):
    """A batch that must not be registered; the text is the audit message too."""


class Registration(NamedTuple):
    next_steps: DataFrame
    report: DataFrame


def _direction_flag(direction: str) -> int:
    if direction not in _FLAG:
        raise ValueError("direction is 'up' or 'down'")
    return _FLAG[direction]


def fill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Adds declared defaults for absent columns; an explicit NULL stays NULL."""
    absent = {
        name: value if isinstance(value, Column) else F.lit(value)
        for name, value in defaults.items()
        if name not in df.columns
    }
    return df.withColumns(absent) if absent else df


def validate_step_batch(schema: str | None, application: str | None, steps: DataFrame | None, direction: str = "up") -> None:
    """Raises for a NULL schema, a NULL application or a batch without rows."""
    if schema is None:
        raise RegistrationError(M.register_error(direction, schema, application, M.null_argument("schema_name")))
    if application is None:
        raise RegistrationError(M.register_error(direction, schema, application, M.null_argument("application_name")))
    if steps is None or steps.isEmpty():
        raise RegistrationError(M.register_error(direction, schema, application, M.null_argument("step")))


def validate_fleet_batch(batch: DataFrame, direction: str = "up") -> None:
    """The same three checks for a batch that carries its keys as columns."""
    require_columns(batch, [*KEY, *STEP_BATCH.fieldNames()], "batch")
    row = batch.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("schema_name").isNull()).alias("schemas"),
        F.count_if(F.col("application_name").isNull()).alias("applications"),
    ).first()
    for count, name in ((row["schemas"], "schema_name"), (row["applications"], "application_name")):
        if count:
            raise RegistrationError(M.register_error(direction, None, None, M.null_argument(name)))
    if row["rows"] == 0:
        raise RegistrationError(M.register_error(direction, None, None, M.null_argument("step")))


def missing_procedures(steps: DataFrame, catalog: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """Steps whose (schema, procedure) the catalog does not list."""
    keys = ["schema_name", "procedure_name"]
    known = fold_names(catalog.select(*keys), keys, case_sensitive)
    left = fold_names(steps, keys, case_sensitive)
    return unfold_names(left.join(known, keys, "left_anti"), keys, case_sensitive)


def require_procedures(steps: DataFrame, catalog: DataFrame, direction: str = "up", case_sensitive: bool = True) -> None:
    """Raises for the first missing procedure, in name order."""
    first = (
        missing_procedures(steps, catalog, case_sensitive)
        .select("schema_name", "procedure_name", "application_name")
        .orderBy("schema_name", "procedure_name")
        .limit(1)
        .collect()
    )
    if first:
        row = first[0]
        text = M.missing_procedure(f"{row['schema_name']}.{row['procedure_name']}")
        raise RegistrationError(M.register_error(direction, row["schema_name"], row["application_name"], text))


def merge_source_duplicates(
    src: DataFrame, keys: list[str], dest: DataFrame | None = None, case_sensitive: bool = True
) -> DataFrame:
    """Merge keys that occur more than once in the source and match the target.

    These make a merge fail. Without `dest`, every repeated source key is listed.
    """
    repeated = (
        fold_names(src, keys, case_sensitive).groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    )
    if dest is not None:
        held = fold_names(dest.select(*keys), keys, case_sensitive).distinct()
        repeated = repeated.join(held, keys, "left_semi")
    return unfold_names(repeated, keys, case_sensitive)


def assign_identity(
    df: DataFrame,
    order: list[str | Column],
    seed: int = 1,
    step: int = 1,
    existing: DataFrame | None = None,
    id_column: str = "id",
) -> DataFrame:
    """Dense new ids in `order`, after the largest id of `existing`."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    numbered = row_numbers(df, [], columns, "_row")
    first = F.lit(seed).cast("long")
    if existing is not None:
        largest = existing.agg(F.max(id_column).cast("long").alias("m")).scalar()
        first = F.coalesce(largest + F.lit(step), first)
    return numbered.withColumn(id_column, first + (F.col("_row") - 1) * step).drop("_row")


def register_steps(
    steps: DataFrame,
    batch: DataFrame,
    direction: str = "up",
    delete_scope: str = "key",
    case_sensitive: bool = True,
) -> Registration:
    """Merge a batch of steps for any number of keys into the registry.

    A step the registry already has keeps its id and flag and takes the new
    description; a new one is added with `completed` = 0; one the batch no
    longer names is deleted. `delete_scope='key'` deletes only under the keys
    the batch mentions; 'all' deletes under every key of that direction.
    """
    flag = _direction_flag(direction)
    if delete_scope not in ("key", "all"):
        raise ValueError("delete_scope is 'key' or 'all'")
    require_columns(batch, [*KEY, *STEP_BATCH.fieldNames()], "batch")
    columns = STEP.fieldNames()
    names = [*KEY, "procedure_name"]

    other = steps.filter(F.col("upgrade") != flag).select(*columns)
    mine = fold_names(steps.filter(F.col("upgrade") == flag).select(*columns), names, case_sensitive)
    src = fold_names(batch.select(*KEY, *STEP_BATCH.fieldNames()), names, case_sensitive)

    sides = answered(mine, src, MERGE_KEY, ["description"])
    here = F.col("_src").isNotNull()
    if delete_scope == "key":
        mentioned = src.select(*KEY).distinct().withColumn("_mentioned", F.lit(True))
        sides = lookup(sides, mentioned, KEY)
        gone = ~here & F.col("_mentioned").isNotNull()
    else:
        gone = ~here

    kept = sides.filter(~gone).withColumn("description", F.when(here, F.col("_src.description")).otherwise(F.col("description")))
    fresh = assign_identity(
        fill_defaults(unanswered(mine, src, MERGE_KEY), {**STEP_DEFAULTS, "upgrade": flag}),
        [*MERGE_KEY, "description"],
        seed=STEP_SEED,
        existing=steps,
        # New steps are a part of the batch, which is counted without the joins.
    )
    next_steps = other.unionByName(
        unfold_names(kept.select(*columns), names, case_sensitive)
    ).unionByName(unfold_names(fresh.select(*columns), names, case_sensitive))

    action = F.when(here, F.lit("UPDATE")).when(gone, F.lit("DELETE"))
    touched = sides.withColumn("action", action).filter(F.col("action").isNotNull())
    report = touched.select("action", "id", *MERGE_KEY).unionByName(
        fresh.withColumn("action", F.lit("INSERT")).select("action", "id", *MERGE_KEY)
    )
    return Registration(next_steps, unfold_names(report, names, case_sensitive))


class BatchRegistration(NamedTuple):
    """A fleet's batch: what was registered, and which keys were refused and why."""

    next_steps: DataFrame
    report: DataFrame
    outcomes: DataFrame  # key, outcome, message, inserted, updated, deleted
    refusals: DataFrame  # from, message: rows for the audit log


def _column_breaches(batch: DataFrame) -> dict[str, Column]:
    """Per broken rule of the step columns: its text -> how many rows of a key break it."""
    breaches = {}
    for name in STEP_BATCH.fieldNames():
        breaches[M.null_argument(f"step.{name}")] = F.count_if(F.col(name).isNull())
    for name, longest in STEP_LENGTHS.items():
        breaches[M.too_long(name, longest)] = F.count_if(F.length(name) > longest)
    return breaches


def batch_refusals(
    steps: DataFrame,
    batch: DataFrame,
    catalog: DataFrame | None = None,
    direction: str = "up",
    asked: DataFrame | None = None,
    case_sensitive: bool = True,
) -> DataFrame:
    """(key, message) of every key whose steps must not be registered, with the first reason.

    Reasons in order: a NULL schema or application, a key of `asked` without steps, a
    procedure that `catalog` lacks (the first by name), a NULL or too long column, and a
    step named twice that the registry holds. All are counted in one aggregate per key.
    """
    flag = _direction_flag(direction)
    names = [*KEY, "procedure_name"]
    src = fold_names(batch.select(*KEY, *STEP_BATCH.fieldNames()), names, case_sensitive)
    mine = fold_names(steps.filter(F.col("upgrade") == flag).select(*MERGE_KEY), names, case_sensitive)

    named = ["schema_name", "procedure_name"]
    missing = F.lit(None).cast("string")
    if catalog is not None:
        known = fold_names(catalog.select(*named), named, case_sensitive).distinct().withColumn("_known", F.lit(True))
        src = lookup(src, known, named)
        missing = F.when(F.col("_known").isNull(), F.concat_ws(".", *[F.col(c).cast("string") for c in named]))
    copies = src.groupBy(*MERGE_KEY).agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    doubled = lookup(copies, mine.distinct(), MERGE_KEY, "left_semi").withColumn("_doubled", F.lit(True))
    checked = lookup(src, doubled.drop("_copies"), MERGE_KEY)

    breaches = _column_breaches(batch)
    counted = [count.alias(f"_breach{i}") for i, count in enumerate(breaches.values())]
    given = checked.groupBy(*KEY).agg(
        F.min(missing).alias("_missing"), F.count("_doubled").alias("_doubles"), F.count(F.lit(1)).alias("_rows"), *counted
    )
    if asked is not None:
        wanted = fold_names(asked.select(*KEY), KEY, case_sensitive).distinct()
        same = [wanted[k].eqNullSafe(given[k]) for k in KEY]
        empty = wanted.join(given, same, "left_anti").withColumn("_rows", F.lit(0).cast("long"))
        given = given.unionByName(empty, allowMissingColumns=True)

    def when(condition: Column, text: Column | str) -> Column:
        return F.when(condition, text if isinstance(text, Column) else F.lit(text))

    reason = F.coalesce(
        when(F.col("schema_name").isNull(), M.null_argument("schema_name")),
        when(F.col("application_name").isNull(), M.null_argument("application_name")),
        when(F.col("_rows") == 0, M.null_argument("step")),
        when(F.col("_missing").isNotNull(), M.missing_procedure_of(F.col("_missing"))),
        *[when(F.col(f"_breach{i}") > 0, text) for i, text in enumerate(breaches)],
        when(F.col("_doubles") > 0, DUPLICATE_SOURCE),
    )
    plain = unfold_names(given.withColumn("_reason", reason), KEY, case_sensitive)
    return plain.filter(F.col("_reason").isNotNull()).select(
        *KEY, M.register_error_of(direction, F.col("schema_name"), F.col("application_name"), F.col("_reason")).alias("message")
    )


def register_batch(
    steps: DataFrame,
    batch: DataFrame,
    catalog: DataFrame | None = None,
    direction: str = "up",
    asked: DataFrame | None = None,
    case_sensitive: bool = True,
) -> BatchRegistration:
    """Register the steps of all keys that pass their checks; the others stay as they are.

    `asked` names the keys the caller wants registered (those of the batch by default);
    one without steps is refused. Deletes reach the accepted keys only. The refusals are
    the messages of a registration that failed, ready for the audit log.
    """
    refused = materialize(batch_refusals(steps, batch, catalog, direction, asked, case_sensitive), "refusals")
    held = fold_names(refused.select(*KEY).dropna(), KEY, case_sensitive)
    kept = fold_names(batch.dropna(subset=KEY), KEY, case_sensitive).join(held, KEY, "left_anti")
    kept = unfold_names(kept, KEY, case_sensitive)
    done = register_steps(steps, kept, direction, "key", case_sensitive)
    report = materialize(done.report, "registration")
    folded = fold_names(report, KEY, case_sensitive)
    acts = folded.groupBy(*KEY).agg(
        *[F.count_if(F.col("action") == a).alias(c) for a, c in (("INSERT", "inserted"), ("UPDATE", "updated"), ("DELETE", "deleted"))]
    )
    accepted = lookup(fold_names(kept.select(*KEY), KEY, case_sensitive).distinct(), acts, KEY)
    counts = ["inserted", "updated", "deleted"]
    zero = F.lit(0).cast("long")
    outcomes = unfold_names(
        accepted.select(*KEY, F.lit("accepted").alias("outcome"), F.lit(None).cast("string").alias("message"), *[F.coalesce(c, zero).alias(c) for c in counts]),
        KEY, case_sensitive,
    ).unionByName(refused.select(*KEY, F.lit("refused").alias("outcome"), "message", *[zero.alias(c) for c in counts]))
    events = refused.select(F.lit(M.REGISTER_ROUTINE[direction]).alias("from"), "message")
    return BatchRegistration(done.next_steps, report, outcomes, events)
