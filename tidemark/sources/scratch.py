"""Tables written to the cluster's shared folder, to cut lineage or share work.

A written table survives the loss of any executor, which a local checkpoint or
a cached block does not.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.files import delete

SETTING = "spark.checkpoint.dir"
_local_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one only for local masters."""
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder every executor can reach")
    key = context.applicationId
    if key not in _local_folder:
        _local_folder[key] = tempfile.mkdtemp(prefix="tidemark-")
    return _local_folder[key]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove this application's work tables; DataFrames built on them end with it."""
    delete(spark, _own_folder(spark))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and go on from the written columns."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
