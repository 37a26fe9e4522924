"""Input files as tables: format by suffix, views by stem, ``input`` as the union of the main files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.sources import sqlite

SQLITE_SUFFIXES = (".db", ".sqlite", ".sqlite3")


def stem(path: str) -> str:
    """The view name of a file: its name without suffix, as an identifier."""
    name = os.path.basename(path.rstrip("/"))
    return re.sub(r"\W", "_", re.sub(r"\.(csv|parquet|json|orc)$", "", name, flags=re.I))


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV, Parquet, JSON or ORC file or folder as a DataFrame; other suffixes are an error."""
    low = path.lower().rstrip("/")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if low.endswith(".parquet"):
        return reader.parquet(path)
    if low.endswith(".csv") or ".csv" in os.path.basename(low):
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    if low.endswith(".json"):
        return reader.json(path)
    if low.endswith(".orc"):
        return reader.orc(path)
    raise ValueError(f"unsupported input format: {path}")


def is_sqlite(path: str) -> bool:
    return path.lower().endswith(SQLITE_SUFFIXES)


class SchemaError(ValueError):
    """Shards of one input whose columns do not go together."""


#: Types from narrow to wide; shards that differ within a row meet at the wider one, all others as strings.
_WIDER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType), (T.DateType, T.TimestampType)


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that both types' values have."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    for row in _WIDER:
        if type(a) in row and type(b) in row:
            wide = max(row.index(type(a)), row.index(type(b)))
            if {type(a), type(b)} == {T.LongType, T.FloatType}:
                wide = row.index(T.DoubleType)
            return row[wide]()
    if isinstance(a, (T.StructType, T.ArrayType, T.MapType)) or isinstance(b, (T.StructType, T.ArrayType, T.MapType)):
        raise SchemaError(f"{a.simpleString()} and {b.simpleString()} do not go together")
    return T.StringType()


def _family(path: str) -> str:
    """What the names of an input's shards have in common: a stem without the digits at its end."""
    return re.sub(r"[-_.]?\d+$", "", stem(path).lower())


def union(shards: list[DataFrame]) -> DataFrame:
    """All rows of shards with the same column names; types that differ are widened, columns without any value take the others' type."""
    names = shards[0].columns
    for df in shards[1:]:
        if sorted(df.columns) != sorted(names):
            raise SchemaError(f"columns {sorted(df.columns)} are not {sorted(names)}")
    kinds = {n: reduce(common_type, _kinds(shards, n)) for n in names}
    cast = [df.select(*(F.col(f"`{n}`").cast(kinds[n]).alias(n) for n in names)) for df in shards]
    return reduce(DataFrame.unionByName, cast)


def _kinds(shards: list[DataFrame], name: str) -> list[T.DataType]:
    """A column's type in each shard.  Where some read strings and others do not, shards without any value have no say."""
    kinds = [df.schema[name].dataType for df in shards]
    is_string = [isinstance(k, T.StringType) for k in kinds]
    if any(is_string) and not all(is_string):
        kinds = [k for k, s, df in zip(kinds, is_string, shards) if not s or not df.where(F.col(f"`{name}`").isNotNull()).isEmpty()]
    return kinds


def register(spark: SparkSession, paths: Iterable[str], broadcasts: dict[str, str] | None = None, schema: str | None = None) -> DataFrame | None:
    """Views over all inputs; returns ``input``.

    Every file is a view under its stem, every SQLite table under its own name.
    ``input`` is the union of the first file with all files of its column names,
    whatever types were read (``schema`` names them and spares the inference).
    A file of the first one's family (part-0, part-1) with other columns is an
    error; any other file is a table of its own.  ``broadcasts`` maps names to
    files of dimensions, whose joins Spark turns into broadcasts where their
    size allows it.
    """
    main: list[DataFrame] = []
    family = ""
    for path in paths:
        if is_sqlite(path):
            for table in sqlite.tables(path):
                sqlite.read(spark, path, table).createOrReplaceTempView(table)
            continue
        own = not main or _family(path) == family
        df = read(spark, path, schema if own else None)
        df.createOrReplaceTempView(stem(path))
        if not main:
            family = _family(path)
            main.append(df)
        elif sorted(df.columns) == sorted(main[0].columns):
            main.append(df)
        elif own:
            raise SchemaError(f"{path} has the columns {df.columns}, not {main[0].columns}")
    for name, path in (broadcasts or {}).items():
        read(spark, path).createOrReplaceTempView(name)
    if not main:
        return None
    whole = union(main)
    whole.createOrReplaceTempView("input")
    return whole


def _in_order(df: DataFrame) -> bool:
    """Whether a result is sorted as a whole, so that its partitions must stay as they are."""
    top = df._jdf.queryExecution().optimizedPlan().nodeName()
    return top in ("Sort", "GlobalLimit", "LocalLimit")


def write_csv(df: DataFrame, directory: str, files: int | None = None) -> None:
    """CSV with a header, what was there replaced; in so many files, unless the rows are in an order."""
    spread = df if files is None or _in_order(df) else df.repartition(files)
    spread.write.mode("overwrite").option("header", True).csv(directory)


def write_parquet(df: DataFrame, directory: str, partition_by: list[str] | None = None) -> None:
    """Parquet, what was there replaced."""
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(directory)
