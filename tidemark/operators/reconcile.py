"""Keyed reconciliation of a target table with its source, and the change report."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import fold_names, unfold_names
from tidemark.operators.merging import answered, unanswered
from tidemark.schemas import require_columns

ACTIONS = ("INSERT", "UPDATE", "DELETE")


class Unit(NamedTuple):
    """One target of `reconcile_many`."""

    table_name: str
    dest: DataFrame
    src: DataFrame
    key: list[str]
    columns: list[str]
    insert_only: tuple[str, ...] = ()


class _Halves(NamedTuple):
    target: DataFrame  # target rows with _src and action (NULL when nothing changes)
    fresh: DataFrame  # source rows to insert


def _halves(dest, src, key, columns, insert_only, case_sensitive) -> _Halves:
    values = [c for c in columns if c not in key]
    require_columns(dest, [*key, *values], "target")
    require_columns(src, [*key, *values], "source")
    left = fold_names(dest.select(*columns), key, case_sensitive)
    right = fold_names(src.select(*columns), key, case_sensitive)
    sides = answered(left, right, key, values)
    compared = [c for c in values if c not in insert_only]
    differs = F.lit(False)
    for c in compared:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_src.{c}"))
    action = F.when(F.col("_src").isNull(), F.lit("DELETE")).when(differs, F.lit("UPDATE"))
    return _Halves(sides.withColumn("action", action), unanswered(left, right, key))


def _next_state(halves: _Halves, key, columns, insert_only, case_sensitive) -> DataFrame:
    kept = halves.target.filter(F.col("action").isNull() | (F.col("action") != "DELETE"))
    changed = F.col("action") == "UPDATE"
    shaped = kept.select(
        *[
            F.col(c)
            if c in key or c in insert_only
            else F.when(changed, F.col(f"_src.{c}")).otherwise(F.col(c)).alias(c)
            for c in columns
        ]
    )
    return unfold_names(shaped.unionByName(halves.fresh.select(*columns)), key, case_sensitive)


def _report(halves: _Halves, key, columns, insert_only, table_name, delete_values, case_sensitive) -> DataFrame:
    touched = halves.target.filter(F.col("action").isNotNull())
    update = F.col("action") == "UPDATE"
    shows_old = update if not delete_values else F.lit(True)
    pairs = []
    for c in columns:
        new = F.col(c) if c in key or c in insert_only else F.col(f"_src.{c}")
        pairs.append(F.when(update, new).alias(c))
        pairs.append(F.when(shows_old, F.col(c)).alias(f"previous_{c}"))
    table = F.lit(table_name).alias("table_name")
    fresh = halves.fresh
    inserted = []
    for c in columns:
        inserted.append(F.col(c))
        inserted.append(F.lit(None).cast(fresh.schema[c].dataType).alias(f"previous_{c}"))
    report = touched.select("action", table, *pairs).unionByName(
        fresh.select(F.lit("INSERT").alias("action"), table, *inserted)
    )
    return unfold_names(report, [*key, *[f"previous_{k}" for k in key]], case_sensitive)


def reconcile(
    dest: DataFrame,
    src: DataFrame,
    key: list[str],
    columns: list[str],
    insert_only: tuple[str, ...] = (),
    case_sensitive: bool = True,
) -> DataFrame:
    """Next `dest`: new rows added, differing rows updated, rows without a source deleted.

    `columns` lists every column in order, keys included. On update a row keeps
    its own `insert_only` columns; on insert the source's are used. Rows are
    compared with NULL equal to NULL, so a change to or from NULL counts.
    """
    halves = _halves(dest, src, key, columns, insert_only, case_sensitive)
    return _next_state(halves, key, columns, insert_only, case_sensitive)


def change_report(
    dest: DataFrame,
    src: DataFrame,
    key: list[str],
    columns: list[str],
    table_name: str,
    delete_values: bool = True,
    insert_only: tuple[str, ...] = (),
    case_sensitive: bool = True,
) -> DataFrame:
    """One row per changed row: action, table, then each column with its previous value.

    `delete_values=False` leaves all values of a delete row NULL.
    """
    halves = _halves(dest, src, key, columns, insert_only, case_sensitive)
    return _report(halves, key, columns, insert_only, table_name, delete_values, case_sensitive)


def reconcile_many(units: list[Unit], delete_values: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """Several targets in unit order: next states by table, and one report.

    The report carries `unit_no`; columns a unit lacks are NULL in its rows.
    """
    if not units:
        raise ValueError("no units given")
    states: dict[str, DataFrame] = {}
    report: DataFrame | None = None
    for number, unit in enumerate(units, start=1):
        dest = states.get(unit.table_name, unit.dest)
        halves = _halves(dest, unit.src, unit.key, unit.columns, unit.insert_only, True)
        states[unit.table_name] = _next_state(halves, unit.key, unit.columns, unit.insert_only, True)
        rows = _report(halves, unit.key, unit.columns, unit.insert_only, unit.table_name, delete_values, True)
        rows = rows.withColumn("unit_no", F.lit(number))
        report = rows if report is None else report.unionByName(rows, allowMissingColumns=True)
    return states, report
