"""One reconcile over the rows of all static data units.

Rows of all targets are put into one shape, the target's name and the texts of its
columns in order, so that one left join and one anti join on (target, key) serve every
target at once. Several units of one target build on each other; each such round is
one plan, whatever the number of targets in it.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.merging import answered, unanswered
from tidemark.schemas import require_columns
from tidemark.sources.scratch import materialize
from tidemark.sources.unit_data import UnitFile

_TEXTS = "array<string>"
_KEY = ["table_name", "row_key"]
_PLAIN = (
    T.StringType, T.IntegralType, T.DecimalType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampType,
    T.TimestampNTZType,
)


class UnitChanges(NamedTuple):
    states: dict[str, DataFrame]  # next state of every target a unit names
    report: DataFrame  # unit_no, file_name, action, table_name, row_key, new, previous


def _text(column: Column, kind: T.DataType) -> Column:
    """Equal values have equal texts."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        column = column + F.lit(0.0).cast(kind)  # no negative zero
    return column.cast("string")


def _chosen(column: str, cases: dict[str, Column]) -> Column:
    """The case that `column` names; NULL for others."""
    return reduce(lambda chain, name: chain.when(F.col(column) == name, cases[name]), cases, F).otherwise(F.lit(None))


def _positions(schema: T.StructType, names) -> list[int]:
    return [schema.names.index(n) for n in names]


def _row_key(cells: Column, at: list[int]) -> Column:
    """Texts of the key columns; NULL if one is, which matches nothing."""
    parts = [cells[i] for i in at]
    whole = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    return F.when(whole, F.array(*parts))


def _cells(unit: UnitFile, schema: T.StructType) -> Column:
    """A unit's line as the texts of the target's columns; the job fails on a bad line."""
    names = F.array(*[F.lit(c) for c in unit.columns])
    stray = F.array_except(F.json_object_keys("line"), names)
    line = F.when(
        F.size(stray) > 0, F.raise_error(F.concat(F.lit(f"{unit.file_name}: not a column of the unit: "), F.array_join(stray, ", ")))
    ).otherwise(F.col("line"))
    texts = T.StructType([T.StructField(c, T.StringType()) for c in unit.columns])
    parsed = F.from_json(line, texts, {"mode": "FAILFAST"})
    cells = []
    for field in schema.fields:
        if field.name not in unit.columns:
            cells.append(F.lit(None).cast("string"))
            continue
        given = parsed[field.name]
        typed = _text(given.try_cast(field.dataType), field.dataType)
        wrong = F.concat(F.lit(f"{unit.file_name}: {field.name} cannot hold "), given)
        cells.append(F.when(given.isNotNull() & typed.isNull(), F.raise_error(wrong)).otherwise(typed))
    return F.array(*cells)


def _flags(schema: T.StructType, names) -> Column:
    return F.array(*[F.lit(c in names) for c in schema.names])


def _shown(cells: Column, given: Column, names: Column) -> Column:
    """Texts by column name, of the unit's columns only."""
    kept = F.filter(F.arrays_zip(names.alias("name"), cells.alias("cell"), given.alias("given")), lambda x: x["given"])
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["name"], x["cell"])))


def _round(state: DataFrame, lines: DataFrame, units: list[tuple[int, UnitFile]], schemas, delete_values: bool):
    """(next state, report) after at most one unit of each target."""
    at = {u.table_name: _positions(schemas[u.table_name], u.key) for _, u in units}
    both = lambda make: _chosen("table_name", {u.table_name: make(number, u) for number, u in units})
    src = lines.withColumn("table_name", _chosen("file_name", {u.file_name: F.lit(u.table_name) for _, u in units}))
    src = src.filter(F.col("table_name").isNotNull()).select(
        "table_name", both(lambda _, u: _cells(u, schemas[u.table_name])).alias("cells")
    )
    keyed = lambda df: df.withColumn("row_key", both(lambda _, u: _row_key(F.col("cells"), at[u.table_name])))
    touched = F.col("table_name").isin(*at)
    # Read by both halves of the merge, by the report and by the next state.
    left, right = keyed(state.filter(touched)), materialize(keyed(src), "unit-rows")
    sides = answered(left, right, _KEY, ["cells"])

    compared = both(lambda _, u: _flags(schemas[u.table_name], set(u.columns) - set(u.key) - set(u.insert_only)))
    given = both(lambda _, u: _flags(schemas[u.table_name], u.columns))
    names = both(lambda _, u: F.array(*[F.lit(c) for c in schemas[u.table_name].names]))
    old, new = F.col("cells"), F.col("_src.cells")
    apart = F.zip_with(old, new, lambda a, b: ~a.eqNullSafe(b))
    differs = F.exists(F.zip_with(apart, compared, lambda d, c: d & c), lambda x: x)
    sides = sides.withColumn(
        "action", F.when(F.col("_src").isNull(), "DELETE").when(differs, "UPDATE")
    ).withColumn("compared", compared)
    after = F.transform(old, lambda cell, i: F.when(F.get("compared", i), F.get(new, i)).otherwise(cell))
    changed = F.col("action") == "UPDATE"
    fresh = unanswered(left, right, _KEY).select("table_name", "row_key", "cells")

    kept = sides.filter(F.col("action").isNull() | changed)
    following = (
        kept.select("table_name", F.when(changed, after).otherwise(old).alias("cells"))
        .unionByName(fresh.select("table_name", "cells"))
        .unionByName(state.filter(~touched))
    )
    nothing = F.lit(None).cast("map<string,string>")
    number = both(lambda n, _: F.lit(n)).alias("unit_no")
    file = both(lambda _, u: F.lit(u.file_name)).alias("file_name")
    shows_old = F.lit(True) if delete_values else changed
    report = sides.filter(F.col("action").isNotNull()).select(
        number, file, "action", "table_name", "row_key",
        F.when(changed, _shown(after, given, names)).alias("new"),
        F.when(shows_old, _shown(old, given, names)).alias("previous"),
    ).unionByName(
        fresh.select(
            number, file, F.lit("INSERT").alias("action"), "table_name", "row_key",
            _shown(old, given, names).alias("new"), nothing.alias("previous"),
        )
    )
    return following, report


def reconcile_units(
    targets: dict[str, DataFrame], units: list[UnitFile], lines: DataFrame, delete_values: bool = True
) -> UnitChanges:
    """Bring every target in line with its units, as `reconcile_many` would one by one.

    `units` and `lines(file_name, line)` come from `read_unit_rows`. A column that a line
    lacks is NULL; columns a unit does not list stay as they are on update and are NULL
    on insert. NULL equals NULL when rows are compared; a row with a NULL in its key
    matches none. A unit without lines deletes all rows of its target. A line that is no
    JSON object, has other columns, or a value its column cannot hold fails the job, as do
    two lines that match one row. Values in the report are texts by column name.
    """
    if not units:
        raise ValueError("no units given")
    schemas: dict[str, T.StructType] = {}
    for unit in units:
        if unit.table_name not in targets:
            raise LookupError(f"{unit.file_name}: no target {unit.table_name}")
        target = targets[unit.table_name]
        require_columns(target, unit.columns, unit.table_name)
        schemas[unit.table_name] = target.schema
    for name, schema in schemas.items():
        odd = [f.name for f in schema.fields if not isinstance(f.dataType, _PLAIN)]
        if odd:
            raise TypeError(f"{name}: columns without a plain text form: {', '.join(odd)}")

    state = reduce(
        DataFrame.unionByName,
        [
            targets[name].select(
                F.lit(name).alias("table_name"),
                F.array(*[_text(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields]).cast(_TEXTS).alias("cells"),
            )
            for name, schema in schemas.items()
        ],
    )
    waiting = list(enumerate(units, start=1))
    reports = []
    while waiting:
        first = {unit.table_name: (number, unit) for number, unit in reversed(waiting)}
        batch = sorted(first.values(), key=lambda entry: entry[0])
        state, report = _round(state, lines, batch, schemas, delete_values)
        reports.append(report)
        waiting = [entry for entry in waiting if entry not in batch]
        if waiting:
            state = materialize(state, "unit-state")
    states = {
        name: state.filter(F.col("table_name") == name).select(
            *[F.get("cells", F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)]
        )
        for name, schema in schemas.items()
    }
    return UnitChanges(states, reduce(DataFrame.unionByName, reports))
