"""Splitting and parsing version texts; reading and writing current versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import messages as M
from tidemark.functions import versions as V
from tidemark.functions.names import fold_names, unfold_names
from tidemark.schemas import KEY, VERSION_TYPE, require_columns


def split_items(df: DataFrame, column: str, delimiter: str) -> DataFrame:
    """One row per item, numbered from 1; N delimiters give N + 1 rows."""
    items = F.posexplode(V.items_of(F.col(column), delimiter)).alias("_position", "item")
    return df.select("*", items).withColumn("item_number", F.col("_position") + 1).drop("_position")


def parse_version(
    df: DataFrame, column: str, weight_base: int = V.DEFAULT_BASE, out: str = "version", pad_to: int | None = None
) -> DataFrame:
    """Adds the version number; bad text fails the job with the parse message."""
    return df.withColumn(out, V.version_number(F.col(column), weight_base, pad_to))


def parse_version_checked(
    df: DataFrame, column: str, weight_base: int = V.DEFAULT_BASE, pad_to: int | None = None
) -> DataFrame:
    """Adds `version`, `error` and `warning`; bad text gets a message, not a failure."""
    text = F.col(column)
    return (
        df.withColumn("error", V.version_error(text, weight_base, pad_to))
        .withColumn("version", F.when(F.col("error").isNull(), V.version_number_or_null(text, weight_base, pad_to)))
        .withColumn("warning", F.when(F.col("error").isNull(), V.version_warning(text, weight_base)))
    )


def one_per_key(df: DataFrame, value: str, what: str) -> DataFrame:
    """`df` as it is if no key has two rows; `value` of a key that has more fails the job."""
    rest = [c for c in df.columns if c not in KEY]
    single = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in rest])
    refused = F.raise_error(F.lit(f"more than one {what} given for one key"))
    checked = F.when(F.col("_rows") > 1, refused).otherwise(F.col(value)).cast(df.schema[value].dataType)
    return single.withColumn(value, checked).select(*df.columns)


def get_version(
    versions: DataFrame, keys: DataFrame, default: int = 0, case_sensitive: bool = True
) -> DataFrame:
    """Current version of each requested key; a key never set reads as `default`.

    Two rows of one requested key in `versions` fail the job.
    """
    wanted = fold_names(keys, KEY, case_sensitive)
    known = one_per_key(fold_names(versions.select(*KEY, "version"), KEY, case_sensitive), "version", "version")
    joined = wanted.drop("version").join(known, KEY, "left")
    filled = joined.withColumn("version", F.coalesce("version", F.lit(default).cast(VERSION_TYPE)))
    return unfold_names(filled, KEY, case_sensitive)


def set_version(versions: DataFrame, updates: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """Next `versions`: an update replaces the row of its key or adds one.

    A NULL version, or two updates of one key, fail the job.
    """
    require_columns(updates, [*KEY, "version"], "updates")
    # One row per key after this aggregate, which is what makes the checks cheap:
    # copies of a hot key meet on the map side.
    single = (
        fold_names(updates, KEY, case_sensitive)
        .groupBy(*KEY)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.count("version").alias("_given"),
            F.max("version").alias("_version"),
        )
        .withColumn(
            "version",
            F.when(F.col("_given") < F.col("_rows"), F.raise_error(F.lit(M.null_argument("version"))))
            .when(F.col("_rows") > 1, F.raise_error(F.lit("more than one version given for one key")))
            .otherwise(F.col("_version"))
            .cast(VERSION_TYPE),
        )
        .select(*KEY, "version")
    )
    current = fold_names(versions.select(*KEY, "version"), KEY, case_sensitive)
    kept = current.join(single.select(*KEY), KEY, "left_anti")
    return unfold_names(kept.unionByName(single), KEY, case_sensitive)
