"""Static data units: files found by name, and bundles of them as XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import row_numbers

# The unit suffix (any letter case) and the bundle's elements.
UNIT_SUFFIX = ".data.sql"
BUNDLE_ROOT = "StaticDataModel"
BUNDLE_ROW = "StaticData"

_BUNDLE_SCHEMA = T.StructType(
    [
        T.StructField("_position", T.LongType()),
        T.StructField("_fileName", T.StringType()),
        T.StructField("_encoding", T.StringType()),
        T.StructField("_VALUE", T.StringType()),
    ]
)

# Text an XML document would lose or refuse: blanks only, carriage returns, and
# control characters. It is carried as base64.
_FRAGILE = r"(?s)^\s+$|[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]"
_BASE64, _PLAIN = "base64", "plain"


def is_static_unit(name):
    """Whether a file-name column names a static data unit."""
    return F.lower(name).endswith(UNIT_SUFFIX)


def read_static_units(spark: SparkSession, path: str) -> DataFrame:
    """Unit files below `path`: `position` (by path), `file_name`, whole `content`."""
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("value").alias("content"),
        )
        .filter(is_static_unit(F.col("file_name")))
    )
    return row_numbers(files, [], [F.col("file_path")], "position").select(
        "position", "file_path", "file_name", "content"
    )


def write_bundle(units: DataFrame, path: str) -> None:
    """Units (`position`, `file_name`, `content`) as one XML document set."""
    content = F.col("content")
    fragile = content.rlike(_FRAGILE)
    rows = units.select(
        F.col("position").cast("long").alias("_position"),
        F.col("file_name").alias("_fileName"),
        F.when(fragile, _BASE64).otherwise(_PLAIN).alias("_encoding"),
        F.when(fragile, F.base64(F.encode(content, "UTF-8"))).otherwise(content).alias("_VALUE"),
    )
    (
        rows.write.format("xml")
        .option("rootTag", BUNDLE_ROOT)
        .option("rowTag", BUNDLE_ROW)
        .option("nullValue", "\u0000")
        .mode("overwrite")
        .save(path)
    )


def require_bundle_root(spark: SparkSession, path: str) -> None:
    """Raises when a file of the bundle does not open with the bundle's root."""
    opening = F.regexp_extract(F.col("value"), r"<([A-Za-z_][\w.:-]*)", 1)
    firsts = (
        spark.read.text(path)
        .select(F.col("_metadata.file_path").alias("file"), opening.alias("tag"), F.col("_metadata.file_block_start").alias("start"))
        .filter((F.col("tag") != "") & (F.col("start") == 0))
        .withColumn("row", F.monotonically_increasing_id())
        .groupBy("file")
        .agg(F.min_by("tag", "row").alias("root"))
    )
    wrong = firsts.filter(F.col("root") != BUNDLE_ROOT).limit(1).collect()
    if wrong:
        raise ValueError(f"Unexpected root element {wrong[0]['root']} where expecting {BUNDLE_ROOT}")


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Units of a bundle; the kept order is in `position`."""
    require_bundle_root(spark, path)
    rows = (
        spark.read.format("xml")
        .schema(_BUNDLE_SCHEMA)
        .option("rowTag", BUNDLE_ROW)
        .option("ignoreSurroundingSpaces", "false")
        .option("nullValue", "\u0000")
        .option("mode", "FAILFAST")
        .load(path)
    )
    text = F.coalesce("_VALUE", F.lit(""))
    content = F.when(F.col("_encoding") == _BASE64, F.decode(F.unbase64(text), "UTF-8")).otherwise(text)
    return rows.select(
        F.col("_position").alias("position"), F.col("_fileName").alias("file_name"), content.alias("content")
    )
