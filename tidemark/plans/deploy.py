"""Whole changes and whole publishes, composed from the operators."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import versions as V
from tidemark.functions.names import fold_names, unfold_names
from tidemark.operators.audit import append_audit, audit_trace
from tidemark.operators.changes import (
    advance_version,
    apply_change,
    change_requests,
    cut_after_failure,
    get_steps,
    order_steps,
)
from tidemark.operators.reconcile import Unit, reconcile_many
from tidemark.operators.versions import parse_version
from tidemark.schemas import KEY
from tidemark.sources.scratch import materialize
from tidemark.sources.state import StateStore

# Fixed value: a target text that skips its part of a publish.
SKIP = "NULL"


class PublishError(RuntimeError):
    """A publish with a failed step; no state was switched."""


class Change(NamedTuple):
    """What one version change did, and the states after it."""

    steps: DataFrame
    versions: DataFrame
    outcomes: DataFrame
    changes: DataFrame


def version_change(
    steps: DataFrame,
    versions: DataFrame,
    targets: DataFrame,
    failed=None,
    case_sensitive: bool = True,
) -> Change:
    """Bring every key of `targets` (`to_version`) to its version.

    `failed` is a condition over the ordered steps that marks the ones that
    fail; none do by default. The ordered selection feeds the flags, the
    versions and the trace, so it is written once. Case-blind keys carry their
    collation through every operator and leave as plain strings.
    """
    steps, versions, targets = (fold_names(df, KEY, case_sensitive) for df in (steps, versions, targets))
    changes = change_requests(versions, targets.filter(F.col("to_version").isNotNull()))
    ordered = order_steps(get_steps(steps, changes))
    ordered = ordered.withColumn("failed", F.lit(False) if failed is None else failed)
    outcomes = materialize(cut_after_failure(ordered, "failed"), "outcomes")
    done = outcomes.filter(F.col("outcome") == "run")
    results = (apply_change(steps, done), advance_version(versions, changes, outcomes), outcomes, changes)
    return Change(*[unfold_names(df, KEY, case_sensitive) for df in results])


def change_trace(change: Change) -> DataFrame:
    """The audit messages of a change."""
    return audit_trace(change.changes, change.outcomes)


def targets_from_text(targets: DataFrame, weight_base: int = V.PUBLISH_BASE) -> DataFrame:
    """Targets given as version texts; rows whose text is the skip word are left out."""
    wanted = targets.filter(F.col("version_text") != SKIP)
    return parse_version(wanted, "version_text", weight_base, out="to_version").select(*KEY, "to_version")


class Publish(NamedTuple):
    steps: DataFrame
    versions: DataFrame
    tables: dict[str, DataFrame]
    report: DataFrame | None
    downgrade: Change
    upgrade: Change


def deploy_run(
    steps: DataFrame,
    versions: DataFrame,
    downgrade_targets: DataFrame,
    upgrade_targets: DataFrame,
    units: list[Unit] | None = None,
    weight_base: int = V.PUBLISH_BASE,
    failed=None,
) -> Publish:
    """One publish: the downgrade part, static data, then the upgrade part.

    Targets are (key, `version_text`). The part names a slot, not a direction:
    the direction follows from each key's versions.
    """
    down = version_change(steps, versions, targets_from_text(downgrade_targets, weight_base), failed)
    tables, report = reconcile_many(units) if units else ({}, None)
    # The second half reads the state between the halves several times.
    down = down._replace(
        steps=materialize(down.steps, "steps"), versions=materialize(down.versions, "versions")
    )
    up = version_change(down.steps, down.versions, targets_from_text(upgrade_targets, weight_base), failed)
    return Publish(up.steps, up.versions, tables, report, down, up)


def require_success(publish: Publish) -> None:
    """Raises when a step of the publish failed."""
    failures = publish.downgrade.outcomes.unionByName(publish.upgrade.outcomes).filter(F.col("outcome") == "failed")
    first = failures.select(*KEY, "step_id").orderBy(*KEY, "step_id").limit(1).collect()
    if first:
        row = first[0]
        raise PublishError(
            f"invoke_version_change failed for {row['schema_name']}/{row['application_name']} at step {row['step_id']}"
        )


def commit_publish(store: StateStore, publish: Publish, audit_path: str | None = None, session_id: int = 0) -> int:
    """Switch every table of a successful publish at once.

    The trace goes to the audit log first and stays when the publish is refused, by a
    failed step or because another writer changed the tables meanwhile. Runs of one log
    are told apart by `session_id`.
    """
    if audit_path is not None:
        traces = [
            change_trace(change).withColumn("_part", F.lit(part)) for part, change in enumerate((publish.downgrade, publish.upgrade))
        ]
        append_audit(traces[0].unionByName(traces[1]), audit_path, ["_part", *KEY, "position"], session_id)
    require_success(publish)
    return store.commit({"step": publish.steps, "version": publish.versions, **publish.tables})
