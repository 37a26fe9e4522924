"""Hash partitioning with the engine's rules for absent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_keys(columns: list[str], keys: list[str] | None = None) -> list[str]:
    """The named keys that exist, else the column ``key``, else the first column; none of a table without columns."""
    found = [k for k in keys or [] if k in columns]
    if found or not columns:
        return found
    return ["key"] if "key" in columns else [columns[0]]


def hash_partition(df: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """Rows with equal keys in one of n partitions."""
    names = resolve_keys(df.columns, keys)
    return df.repartition(n, *(F.col(f"`{k}`") for k in names)) if names else df.repartition(n)


def salted_sum(df: DataFrame, keys: list[str], measure: str, salts: int = 16) -> DataFrame:
    """Sums by key in two steps, hot keys spread over ``salts`` partial groups."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    partial = df.withColumn("__salt", salt).groupBy(*keys, "__salt").agg(F.sum(measure).alias("__part"))
    return partial.groupBy(*keys).agg(F.sum("__part").alias(f"sum_{measure}"))


def partition_sizes(df: DataFrame) -> DataFrame:
    """partition, n_rows."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n_rows"))
