"""Names: case folding for keys, and bracketed multi-part names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ignores letter case and trailing blanks, in joins, grouping and windows alike.
FOLDED = "UTF8_LCASE_RTRIM"
EXACT = "UTF8_BINARY"


def fold_names(df: DataFrame, columns: Iterable[str], case_sensitive: bool) -> DataFrame:
    """Give string key columns the case-blind collation unless names are exact."""
    if case_sensitive:
        return df
    strings = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    return df.withColumns({c: F.collate(c, FOLDED) for c in columns if c in strings})


def unfold_names(df: DataFrame, columns: Iterable[str], case_sensitive: bool) -> DataFrame:
    """Back to plain strings, so results write and union like any other column."""
    if case_sensitive:
        return df
    strings = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    return df.withColumns({c: F.collate(c, EXACT) for c in columns if c in strings})


def qualified_name(external_parts: Column | None, parts: Column) -> Column:
    """Parts in square brackets joined by dots, external parts first."""
    every = parts if external_parts is None else F.concat(
        F.coalesce(external_parts, F.array().cast("array<string>")), parts
    )
    return F.concat_ws(".", F.transform(every, lambda p: F.concat(F.lit("["), p, F.lit("]"))))
