"""The two halves of a keyed three-arm merge.

A full outer join can neither broadcast a side nor split a hot key, so the
merge is written as a left join (every target row and what the source says
about it) and an anti join (source rows no target row answers to). Both follow
run-time sizes: a small source is broadcast and the target is not shuffled at
all, a hot key is split, and copies of a key on the side that is looked up are
reduced on the map side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lookups import lookup

DUPLICATE_SOURCE = "the source holds more than one row for a matched merge key"


def answered(dest: DataFrame, src: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Every target row, with `_src` (the source values, NULL when absent).

    Source rows are first reduced to one per key, so copies of one key meet on
    the map side; a target row that more than one copy matches fails the job.
    """
    values = F.struct(F.lit(True).alias("_here"), *[F.col(c) for c in cols])
    single = src.groupBy(*keys).agg(F.max(values).alias("_src"), F.count(F.lit(1)).alias("_copies"))
    return lookup(dest, single, keys).withColumn(
        "_src",
        F.when(F.col("_copies") > 1, F.raise_error(F.lit(DUPLICATE_SOURCE))).otherwise(F.col("_src")),
    ).drop("_copies")


def unanswered(dest: DataFrame, src: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows whose key no target row has, copies included."""
    taken = lookup(dest.select(*keys), src.select(*keys).distinct(), keys, "left_semi")
    return lookup(src, taken.distinct(), keys, "left_anti")
