"""Pruning of facts by a filtered dimension, as a left semi join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matching_keys(dim: DataFrame, filter_column: str, value: str, key: str) -> DataFrame:
    """Keys of the dimension's rows whose filter column reads as the value, whatever case and surrounding space."""
    names = {c.lower(): c for c in dim.columns}
    for c in (filter_column, key):
        if c.lower() not in names:
            raise ValueError(f"the dimension has no column {c}")
    return dim.where(F.lower(F.trim(F.col(names[filter_column.lower()]).cast("string"))) == value.strip().lower()).select(F.col(names[key.lower()]).alias("__key"))


def prune(fact: DataFrame, dim: DataFrame, filter_column: str, value: str, key: str, fact_key: str | None = None) -> DataFrame:
    """The fact rows whose key the filtered dimension has.

    A semi join keeps types and needs no list of keys: Spark broadcasts the
    dimension where its size allows, prunes partitions of a fact partitioned by
    the key, and sends a bloom filter to the scan of a large one.
    """
    keys = matching_keys(dim, filter_column, value, key)
    return fact.join(keys, fact[fact_key or key] == keys["__key"], "left_semi")
