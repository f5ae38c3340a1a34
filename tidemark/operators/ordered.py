"""Running totals, row numbers, previous and latest values for groups of any size.

A window function sorts each group inside one task, which fails when one group
holds a large share of all rows. Here rows are cut by (keys, order) into as many
ranges as the session has shuffle partitions, each range is worked on alone, and
what comes before a range is added from a summary with one row per (range, group), of
which only those of groups that began in an earlier range are sent to the rows: one a
range at most. That is the one plan at every size: the number of ranges grows with the
setting the cluster is run with, and a summary holds no more rows than there are groups
and ranges.

Ranges are written to the shared folder before use, so both readings of them see
the same cut even when tasks are retried. Rows that tie in (keys, order) are told
apart by a hash of all their columns, so a common value can be cut too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.scratch import materialize

# Helper columns; no input may have one of these names.
_CHUNK = "__ordered_chunk"
_TIE = "__ordered_tie"
_BEFORE = "__ordered_before"
_VALUE = "__ordered_value"
_EDGE = "__ordered_edge"


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _chunked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    clash = [c for c in df.columns if c.startswith("__ordered_") and c != _VALUE]
    if clash:
        raise ValueError(f"columns {clash} have names that the ordered helpers use")
    cuts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = [F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)]
    tied = df.withColumn(_TIE, F.xxhash64(*told))
    ranged = tied.repartitionByRange(cuts, *[F.col(k) for k in keys], *order, F.col(_TIE))
    return materialize(ranged.withColumn(_CHUNK, F.spark_partition_id()), "chunks")


def _inside(keys: list[str], order: list[Column]):
    return W.partitionBy(_CHUNK, *keys).orderBy(*order, F.col(_TIE))


def _join_summary(chunks: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the one summary row of each (chunk, group) that has rows in earlier chunks; NULL keys match too.

    Ranges are cut by the keys first, so only the first group of a chunk can have begun
    before it: these are no more rows than chunks, and the chunks stay where they are.
    """
    begun = summary.withColumn(_EDGE, F.lag(_CHUNK).over(W.partitionBy(*keys).orderBy(_CHUNK))).filter(F.col(_EDGE).isNotNull())
    renamed = begun.select(
        F.col(_CHUNK).alias("__ordered_s"),
        *[F.col(k).alias(f"__ordered_s{i}") for i, k in enumerate(keys)],
        _BEFORE,
    )
    on = F.col(_CHUNK) == F.col("__ordered_s")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__ordered_s{i}"))
    return chunks.join(F.broadcast(renamed), on, "left").drop("__ordered_s", *[f"__ordered_s{i}" for i in range(len(keys))])


def _last_of_each(chunks: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """The value of the last row of every (chunk, group)."""
    return (
        chunks.withColumn(_EDGE, F.lead(F.lit(1)).over(_inside(keys, order)))
        .filter(F.col(_EDGE).isNull())
        .select(_CHUNK, *keys, value)
    )


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    out: str,
    weight: Column | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Sum of `weight` (1 by default) over the rows of a group up to each row."""
    one = weight is None
    worth = F.lit(1).cast("long") if one else weight.cast("long")
    chunks = _chunked(df, keys, order)
    totals = chunks.groupBy(_CHUNK, *keys).agg(F.sum(worth).alias("__ordered_total"))
    earlier = W.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    summary = totals.withColumn(_BEFORE, F.sum("__ordered_total").over(earlier))
    inside = _inside(keys, order)
    if one:
        upto = F.row_number().over(inside).cast("long")
    else:
        upto = F.sum(worth).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    local = chunks.withColumn(out, upto if inclusive else upto - worth)
    return (
        _join_summary(local, summary, keys)
        .withColumn(out, F.col(out) + F.coalesce(F.col(_BEFORE), F.lit(0)))
        .drop(_CHUNK, _TIE, _BEFORE)
    )


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """Dense numbers from 1 within each group; no `keys` numbers the whole table."""
    return running_total(df, keys, order, out)


def previous_value(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """`value` of the row before each row of its group, NULL for the first."""
    chunks = _chunked(df.withColumn(_VALUE, value), keys, order)
    inside = _inside(keys, order)
    local = chunks.withColumn(out, F.lag(_VALUE).over(inside)).withColumn(_EDGE, F.row_number().over(inside) == 1)
    summary = _last_of_each(chunks, keys, order, _VALUE).withColumn(
        _BEFORE, F.lag(_VALUE).over(W.partitionBy(*keys).orderBy(_CHUNK))
    )
    return (
        _join_summary(local, summary, keys)
        .withColumn(out, F.when(F.col(_EDGE), F.col(_BEFORE)).otherwise(F.col(out)))
        .drop(_CHUNK, _TIE, _BEFORE, _EDGE, _VALUE)
    )


def history(
    df: DataFrame, keys: list[str], order: list[Column], value: Column, measure: Column, out: str, low: str, high: str
) -> DataFrame:
    """`value` of the row before each row of its group, and the smallest and largest
    `measure` among all rows before it; NULL for the first. One cut serves all three."""
    chunks = _chunked(df.withColumn(_VALUE, F.struct(value.alias("value"), measure.alias("measure"))), keys, order)
    inside = _inside(keys, order)
    earlier = inside.rowsBetween(W.unboundedPreceding, -1)
    measured = F.col(f"{_VALUE}.measure")
    local = chunks.withColumns(
        {
            out: F.lag(F.col(f"{_VALUE}.value")).over(inside),
            low: F.min(measured).over(earlier),
            high: F.max(measured).over(earlier),
            _EDGE: F.row_number().over(inside) == 1,
        }
    )
    bounds = chunks.groupBy(_CHUNK, *keys).agg(F.min(measured).alias("__ordered_low"), F.max(measured).alias("__ordered_high"))
    ends = _last_of_each(chunks, keys, order, _VALUE)
    by_chunk = W.partitionBy(*keys).orderBy(_CHUNK)
    before = by_chunk.rowsBetween(W.unboundedPreceding, -1)
    same = [ends[_CHUNK] == bounds[_CHUNK], *[ends[k].eqNullSafe(bounds[k]) for k in keys]]
    summary = ends.join(bounds, same).select(ends[_CHUNK], *[ends[k] for k in keys], _VALUE, "__ordered_low", "__ordered_high")
    summary = summary.withColumn(
        _BEFORE,
        F.struct(
            F.lag(F.col(f"{_VALUE}.value")).over(by_chunk).alias("value"),
            F.min("__ordered_low").over(before).alias("low"),
            F.max("__ordered_high").over(before).alias("high"),
        ),
    )
    return (
        _join_summary(local, summary, keys)
        .withColumns(
            {
                out: F.when(F.col(_EDGE), F.col(f"{_BEFORE}.value")).otherwise(F.col(out)),
                low: F.least(low, f"{_BEFORE}.low"),
                high: F.greatest(high, f"{_BEFORE}.high"),
            }
        )
        .drop(_CHUNK, _TIE, _BEFORE, _EDGE, _VALUE)
    )


def latest_value(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """The last `value` that is not NULL among the rows of a group up to each row, its own included."""
    chunks = _chunked(df.withColumn(_VALUE, value), keys, order)
    inside = _inside(keys, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = chunks.withColumn(out, F.last(_VALUE, ignorenulls=True).over(inside))
    earlier = W.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    summary = _last_of_each(local, keys, order, out).withColumn(
        _BEFORE, F.last(out, ignorenulls=True).over(earlier)
    )
    return (
        _join_summary(local, summary, keys)
        .withColumn(out, F.coalesce(out, _BEFORE))
        .drop(_CHUNK, _TIE, _BEFORE, _VALUE)
    )
