"""Model statistics and plan reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import qualified_name
from tidemark.operators.ordered import row_numbers

SORT_MODES = ("none", "name", "value")
# Labels of the statistics and buckets of the relationship survey.
SUBTOTAL = "subtotal"
TOTAL_ITEMS = "total items"
BUCKETS = ("Composing", "Hierarchical", "Peer")
CATEGORY_RULE = "-----------------"

# Plan step kinds that carry attributes, and what they show.
NAMED_STEPS = ("SqlTableMigrationStep", "CreateElementStep", "AlterElementStep", "DropElementStep")
RENAME_STEP = "SqlRenameStep"
MOVE_STEP = "SqlMoveSchemaStep"


def sort_mode(text: str | None) -> str:
    """The sort mode a text names, in any letter case; blank means 'none'."""
    if text is None or not text.strip():
        return "none"
    if text.lower() not in SORT_MODES:
        raise ValueError(f"SortModelStatisticsBy={text} was not valid.  It can be none, name, or value")
    return text.lower()


def _summary(df: DataFrame, group_column: str, category: str) -> DataFrame:
    """Summary lines with `place`: 0 for groups, 1 and 2 for the two totals."""
    groups = df.groupBy(F.col(group_column).alias("key")).agg(F.count(F.lit(1)).alias("value"))
    totals = groups.agg(F.coalesce(F.sum("value"), F.lit(0).cast("long")).alias("rows"), F.count(F.lit(1)).alias("items"))
    extra = totals.select(
        F.explode(
            F.array(
                F.struct(F.lit(SUBTOTAL).alias("key"), F.col("rows").alias("value"), F.lit(1).alias("place")),
                F.struct(F.lit(TOTAL_ITEMS).alias("key"), F.col("items").alias("value"), F.lit(2).alias("place")),
            )
        ).alias("line")
    ).select("line.*")
    return groups.withColumn("place", F.lit(0)).unionByName(extra).select(
        F.lit(category).alias("category"), "key", "value", "place"
    )


def summarize(df: DataFrame, group_column: str, category: str) -> DataFrame:
    """Count per group, then `subtotal` (all rows) and `total items` (all groups)."""
    return _summary(df, group_column, category).drop("place")


def summarize_sorted(
    df: DataFrame, group_column: str, category: str, sort: str | None = "none"
) -> DataFrame:
    """`summarize` with `position`: groups in the asked order, the totals after them.

    'none' promises no order of the groups; it is then the same as 'name'.
    """
    order = [F.col("place"), F.col("key")]
    if sort_mode(sort) == "value":
        order.insert(1, F.col("value"))
    return row_numbers(_summary(df, group_column, category), [], order, "position").drop("place")


def survey_relationships(edges: DataFrame, type_column: str = "relationship_type") -> DataFrame:
    """Relationships per known kind, zero when absent; other kinds only in `subtotal`."""
    counts = edges.agg(
        *[F.count_if(F.col(type_column) == b).alias(b) for b in BUCKETS], F.count(F.lit(1)).alias(SUBTOTAL)
    )
    lines = [F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in (*BUCKETS, SUBTOTAL)]
    return counts.select(F.explode(F.array(*lines)).alias("line")).select(
        F.lit("Relationships").alias("category"), "line.*"
    )


def model_info(options: DataFrame, version: str, order_column: str) -> DataFrame:
    """`Version` always, `Collation` of the first options row when there is one."""
    found = options.agg(F.count(F.lit(1)).alias("n"), F.min_by("collation", order_column).alias("collation"))
    rows = found.select(
        F.explode(
            F.array(
                F.struct(F.lit("Version").alias("key"), F.lit(version).alias("value"), F.lit(True).alias("shown")),
                F.struct(F.lit("Collation").alias("key"), F.col("collation").alias("value"), (F.col("n") > 0).alias("shown")),
            )
        ).alias("line")
    ).select("line.*")
    return rows.filter("shown").select(F.lit("Basic model info").alias("category"), "key", "value")


def statistics_report(stats: DataFrame) -> DataFrame:
    """Statistics with the text line and the XML element names of each row.

    Keys are right-aligned to the longest of their category plus two.
    """
    widths = stats.groupBy("category").agg((F.max(F.length("key")) + 2).alias("_width"))
    line = F.concat(F.lpad(F.col("key"), F.col("_width"), F.lit(" ")), F.lit(": "), F.col("value").cast("string"))
    return stats.join(widths, "category").select(
        *stats.columns,
        line.alias("line"),
        F.replace(F.col("category"), F.lit(" "), F.lit("")).alias("xml_category"),
        F.replace(F.col("key"), F.lit(" "), F.lit("_")).alias("xml_key"),
    )


def report_lines(report: DataFrame, category_order: Column, key_order: Column) -> DataFrame:
    """The whole text: heading and rule per category, its lines, a blank line."""
    body = report.select("category", category_order.alias("_c"), F.lit(1).alias("_part"), key_order.alias("_k"), "line")
    heads = report.select("category", category_order.alias("_c")).distinct()
    nothing = F.lit(None).cast(body.schema["_k"].dataType)
    frame = heads.select(
        "category",
        "_c",
        F.explode(
            F.array(
                F.struct(F.lit(-1).alias("_part"), F.col("category").alias("line")),
                F.struct(F.lit(0).alias("_part"), F.lit(CATEGORY_RULE).alias("line")),
                F.struct(F.lit(2).alias("_part"), F.lit(" ").alias("line")),
            )
        ).alias("s"),
    ).select("category", "_c", "s._part", nothing.alias("_k"), "s.line")
    return body.unionByName(frame).orderBy("_c", "_part", "_k").select("category", "line")


def plan_report(plan: DataFrame, include_scripts: bool = False) -> DataFrame:
    """One row per plan step with the attributes its kind reports."""
    kind = F.col("step_type")
    renamed, moved, named = kind == RENAME_STEP, kind == MOVE_STEP, kind.isin(*NAMED_STEPS)
    script = F.when(F.length("script") > 0, F.col("script")) if include_scripts else F.lit(None).cast("string")
    return plan.select(
        "step_no",
        "step_type",
        F.when(named, qualified_name(F.col("external_parts"), F.col("name_parts"))).alias("name"),
        F.when(renamed | moved | named, F.col("category")).alias("category"),
        F.when(renamed | moved, F.col("old_name")).alias("original_name"),
        F.when(renamed, F.col("new_name")).alias("new_name"),
        F.when(moved, F.col("new_schema")).alias("new_schema"),
        script.alias("script"),
    )


def report_names(given: str | None, database: str) -> tuple[str, str]:
    """File names of the summary and the details: the given name, else the database's."""
    stem = given or database
    return f"{stem}.summary.xml", f"{stem}.details.xml"
