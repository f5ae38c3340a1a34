"""Constraint checks: what a database would refuse, found as rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import fold_names, unfold_names
from tidemark.operators.lookups import lookup


class Rule(NamedTuple):
    """NOT NULL when `max_length` is None, else the longest text allowed."""

    column: str
    max_length: int | None = None

    @property
    def label(self) -> str:
        return "not_null" if self.max_length is None else f"max_length({self.max_length})"


def unique_violations(df: DataFrame, columns: list[str], case_sensitive: bool = True) -> DataFrame:
    """Key values that occur more than once, with how often."""
    repeated = (
        fold_names(df, columns, case_sensitive)
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter("occurrences > 1")
    )
    return unfold_names(repeated, columns, case_sensitive)


def foreign_key_violations(child: DataFrame, parent: DataFrame, child_columns: list[str], parent_columns: list[str]) -> DataFrame:
    """Child rows without a parent; a NULL in the child's key refers to nothing."""
    targets = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(parent_columns)])
    on = [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(child_columns)]
    return child.dropna(subset=child_columns).join(targets, on, "left_anti")


def delete_guard(child: DataFrame, report: DataFrame, child_column: str, key_column: str) -> DataFrame:
    """Child rows that the deletes of a change report would leave without a parent."""
    deleted = report.filter(F.col("action") == "DELETE").select(F.col(f"previous_{key_column}").alias(child_column))
    return lookup(child, deleted, [child_column], "left_semi").select(*child.columns)


def column_violations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Violations per rule, all rules counted in one pass over the rows."""
    counts = []
    for i, rule in enumerate(rules):
        column = F.col(rule.column)
        bad = column.isNull() if rule.max_length is None else F.length(column) > rule.max_length
        counts.append(F.count_if(bad).alias(f"_r{i}"))
    lines = [
        F.struct(
            F.lit(rule.column).alias("column_name"), F.lit(rule.label).alias("rule"), F.col(f"_r{i}").alias("violations")
        )
        for i, rule in enumerate(rules)
    ]
    return df.agg(*counts).select(F.explode(F.array(*lines)).alias("line")).select("line.*")
