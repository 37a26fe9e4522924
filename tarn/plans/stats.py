"""Exact table and column statistics, a catalog of them, and advice that follows from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def analyze(df: DataFrame, columns: list[str] | None = None, approximate: float | None = None) -> DataFrame:
    """column_name, row_count, null_count, distinct_count, min, max of every column, in one pass.

    Distinct counts are exact, or with ``approximate`` (a relative error) come
    from sketches, which shuffle no values.  Otherwise columns are unpivoted to (column, value) rows
    and pre-aggregated by value, so no wide row is expanded once per column and
    a hot value is counted before it is shuffled.  Minima and maxima are those
    of the columns' own types.
    """
    columns = columns or df.columns
    if approximate is not None:
        return _approximate(df, columns, approximate)
    basic = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)),
        *(F.min(F.col(f"`{c}`")).cast("string").alias(f"lo{i}") for i, c in enumerate(columns)),
        *(F.max(F.col(f"`{c}`")).cast("string").alias(f"hi{i}") for i, c in enumerate(columns)),
    )
    facts = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("column_name"), F.col("rows").alias("row_count"), (F.col("rows") - F.col(f"n{i}")).alias("null_count"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max")) for i, c in enumerate(columns)))
    basic = basic.select(F.inline(facts))
    values = F.array(*(F.struct(F.lit(i).alias("at"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(columns)))
    distinct = df.select(F.inline(values)).where("v IS NOT NULL").groupBy("at", "v").agg(F.lit(1).alias("one")).groupBy("at").agg(F.count(F.lit(1)).alias("d"))
    joined = basic.join(F.broadcast(distinct), F.col("i") == F.col("at"), "left")  # one row per column
    return joined.select("column_name", "row_count", "null_count", F.coalesce("d", F.lit(0)).cast("long").alias("distinct_count"), "min", "max")


def _approximate(df: DataFrame, columns: list[str], error: float) -> DataFrame:
    each = [(F.count(c), F.approx_count_distinct(c, error), F.min(c).cast("string"), F.max(c).cast("string")) for c in (F.col(f"`{n}`") for n in columns)]
    facts = F.array(*(F.struct(F.lit(n).alias("column_name"), F.count(F.lit(1)).alias("row_count"), (F.count(F.lit(1)) - k).alias("null_count"), d.alias("distinct_count"), lo.alias("min"), hi.alias("max")) for n, (k, d, lo, hi) in zip(columns, each)))
    return df.agg(facts.alias("facts")).select(F.inline("facts"))


@dataclass
class TableEntry:
    name: str
    schema: str
    row_count: int | None = None
    size_bytes: int | None = None
    columns: dict[str, dict] = field(default_factory=dict)


class Catalog:
    """Tables and their statistics, kept by the driver."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tables = spark, {}

    def add(self, name: str, df: DataFrame) -> TableEntry:
        df.createOrReplaceTempView(name)
        self.tables[name] = TableEntry(name, df.schema.simpleString(), size_bytes=size_of(df))
        return self.tables[name]

    def analyze(self, name: str) -> TableEntry:
        """ANALYZE TABLE: fills in the entry's statistics."""
        entry = self.tables.get(name) or self.add(name, self.spark.table(name))
        for row in analyze(self.spark.table(name)).collect():  # one row per column
            entry.row_count = row["row_count"]
            entry.columns[row["column_name"]] = {k: row[k] for k in ("null_count", "distinct_count", "min", "max")}
        if entry.row_count is None:
            entry.row_count = 0
        return entry

    def get(self, name: str) -> TableEntry | None:
        return self.tables.get(name)


def size_of(df: DataFrame) -> int:
    """Catalyst's estimate of a relation's bytes: for files, their size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcastable(df: DataFrame, limit: int) -> bool:
    """Whether a side is small enough to broadcast, by its real size."""
    return size_of(df) <= limit


def join_sides(fact: DataFrame, dim: DataFrame, on, how: str = "inner", limit: int = 10 << 20) -> DataFrame:
    """A join whose dimension is broadcast only where its checked size allows it; otherwise Spark chooses."""
    return fact.join(F.broadcast(dim) if broadcastable(dim, limit) else dim, on, how)
