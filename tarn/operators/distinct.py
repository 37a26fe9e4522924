"""Distinct counts beside other aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted_apart(df: DataFrame, keys: list[str], column: str, name: str, *others: Column) -> DataFrame:
    """The keys, ``others`` and the exact number of distinct values of ``column`` in each group.

    In one statement Spark keeps a buffer of every other aggregate for each
    (key, value), which sketches and exact percentiles make large and slow to
    merge.  Here they are taken over the groups alone, the values are counted
    by themselves, and the two are joined by the keys (a null key is a group).
    """
    rest = df.groupBy(*keys).agg(*others)
    counted = df.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.count_distinct(F.col(column)).alias(name))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return rest.join(counted, same).drop(*(f"__{k}" for k in keys))
