"""Joins of many rows with a reduced side, open to splitting a hot key.

Adaptive execution splits the hot partition of a join only when both inputs
arrive from a shuffle of their own. The output of an aggregate or of another
join on the same keys does not: its shuffle is reused, and a key with a large
share of the left rows then meets it in one task. `lookup` joins on the keys and
a value computed from them. That changes no match, but it asks for a shuffle of
both inputs (the reduced one is the cheap one), and so lets the skew join work;
a side that proves small at run time is broadcast as ever.

Before anything has run, a written table counts as its files, and files of repeated
keys and decimals can be a twentieth of their rows in memory. A side that grows with
the tables is therefore named as such and merged: else the driver collects and builds
all of it while its files are still below the threshold for a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROUTE = "_route"


def _exact(df: DataFrame, keys: list[str]) -> bool:
    """Hashes follow bytes, so keys that compare case-blind cannot be routed by one."""
    kinds = [df.schema[k].dataType for k in keys]
    return all(kind == T.StringType() for kind in kinds if isinstance(kind, T.StringType))


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", grows: bool = False) -> DataFrame:
    """`left.join(right, keys, how)` for a `right` that was reduced by the same keys.

    With `grows` neither side is ever broadcast.
    """
    if grows:
        right = right.hint("merge")
    if not (_exact(left, keys) and _exact(right, keys)):
        return left.join(right, keys, how)
    # Both sides hash the same types, or equal keys would part ways.
    types = {k: left.schema[k].dataType for k in keys}
    route = F.pmod(F.xxhash64(*[F.col(k).cast(types[k]) for k in keys]), F.lit(2))
    joined = left.withColumn(_ROUTE, route).join(right.withColumn(_ROUTE, route), [*keys, _ROUTE], how)
    return joined.drop(_ROUTE)
