"""SQL jobs: one statement, or a map and a reduce statement, over the whole ``input``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: How a partial aggregate is combined.
COMBINED_BY = {"sum": "sum", "count": "sum", "min": "min", "max": "max"}


def run_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """One statement, once, with global semantics; Catalyst splits its aggregates into partial and final ones."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def run_map_reduce(spark: SparkSession, map_sql: str, reduce_sql: str, num_partitions: int | None = None, keys: list[str] | None = None, **tables: DataFrame) -> DataFrame:
    """``reduce_sql`` over the rows of ``map_sql``, which it knows as ``input`` and ``merged_shuffle``.

    Rows are dealt out by ``keys`` only where the caller names them; otherwise
    Spark's own exchange for the reduce statement is the only one.
    """
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    mapped = spark.sql(map_sql)
    if num_partitions is not None and keys:
        mapped = mapped.repartition(num_partitions, *keys)
    # the reduce statement's names must not hide the map statement's input
    reduced = re.sub(r"\b(input|merged_shuffle)\b(?=(?:[^']*'[^']*')*[^']*$)", "__mapped", reduce_sql, flags=re.I)
    mapped.createOrReplaceTempView("__mapped")
    return spark.sql(reduced)


@dataclass(frozen=True)
class Split:
    """What a grouped statement computes before and after the exchange."""

    keys: tuple[str, ...]
    partial: tuple[str, ...]
    final: tuple[str, ...]
    splittable: bool


def explain_split(spark: SparkSession, sql: str) -> Split:
    """Keys and aggregates of a statement's aggregation, from Catalyst's own physical plan.

    ``splittable`` says whether each aggregate is combined by itself or a sum
    (sum, count, min, max without distinct); the others also run as partial and
    final aggregates in Spark, with richer buffers.
    """
    plan = spark.sql(sql)._jdf.queryExecution().sparkPlan().toString()
    found = re.findall(r"(?:Hash|Sort|ObjectHash)Aggregate\(keys=\[(.*?)\], functions=\[(.*?)\], output", plan)
    if not found:
        return Split((), (), (), False)
    clean = lambda text: tuple(re.sub(r"#\d+L?", "", x).strip() for x in re.split(r",\s*(?![^()]*\))", text) if x.strip())
    keys, final = clean(found[0][0]), clean(found[0][1])
    partial = next((clean(f) for _, f in found[1:] if "partial_" in f), ())
    simple = all(re.match(r"(sum|count|min|max)\((?!distinct)", f) for f in final)
    return Split(keys, partial, final, bool(final) and simple and len(found) == 2)
