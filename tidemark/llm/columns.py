"""Names for helper columns that no column of the caller has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(df: DataFrame, base: str) -> str:
    """`base`, with underscores put before it until no column is called that, in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def set_aside(df: DataFrame, used: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """`df` with all columns but `used` under numbered names, and how to name them back."""
    back = {f"__kept_{i}": c for i, c in enumerate(df.columns) if c not in used}
    return df.withColumnsRenamed({c: k for k, c in back.items()}), back
