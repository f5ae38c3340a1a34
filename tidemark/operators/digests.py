"""Digests of hash buckets: which parts of two tables differ, without a join of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = "bucket"
_SUMS = ["n_rows", "sum_a", "sum_b"]


def row_hash(columns: list[str], seed: int) -> Column:
    """64 bits of a row; a hash passes over NULLs, so each column says whether it is one."""
    parts = [part for c in columns for part in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(seed), *parts)


def bucket_digests(rows: DataFrame, bucket: Column, columns: list[str]) -> DataFrame:
    """(bucket, n_rows, sum_a, sum_b): at most one row per bucket, none for an empty one.

    The sums of two row hashes, which no order of the rows changes, and the count; two
    contents of a bucket share a digest with a chance of about 2 ** -128. Sums are exact
    decimals, so copies of a row count as often as they occur.
    """
    sums = [F.sum(row_hash(columns, seed).cast("decimal(20,0)")).alias(name) for seed, name in ((1, "sum_a"), (2, "sum_b"))]
    return rows.groupBy(bucket.alias(BUCKET)).agg(F.count(F.lit(1)).alias("n_rows"), *sums)


def differing_buckets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Buckets whose digests differ, or that only one side has."""
    both = left.select(BUCKET, *_SUMS).withColumn("side", F.lit(1)).unionByName(
        right.select(BUCKET, *_SUMS).withColumn("side", F.lit(2))
    )
    # A digest that both sides have makes a pair; what stays alone differs.
    return both.groupBy(BUCKET, *_SUMS).agg(F.countDistinct("side").alias("n")).filter("n = 1").select(BUCKET).distinct()
