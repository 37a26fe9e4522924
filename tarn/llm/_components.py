"""Connected components by alternating large-star and small-star steps.

Every step's edges are a written table, so no step depends on an executor that
may be lost, and no step collects a node's neighbours in one task: a node's
least neighbour comes from partial minima, and the join that hands it on is one
that Spark can split at a node with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import _store


def _least(edges: DataFrame, name: str) -> DataFrame:
    """Each u's least v, or u itself."""
    return _store.written(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("m")), name)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node of the edges (columns u, v: long), but roots themselves."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = _store.written(edges, "cc")
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above a node go to its least neighbour
        least = _least(both, "cc-least")
        large = both.join(least, F.col("u") == F.col("node")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _store.written(large.where("u <> v").distinct(), "cc")
        _store.forget(edges, least)
        # small star: neighbours below a node, and the node, go to the least of them
        least = _least(large, "cc-least")
        small = large.join(least, F.col("u") == F.col("node")).select(F.col("u"), F.col("v"), F.col("m"))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("node <> m").select(F.col("node").alias("u"), F.col("m").alias("v")))
        edges = _store.written(small.where("u <> v").distinct(), "cc")
        _store.forget(large, least)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
