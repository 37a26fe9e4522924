"""SQLite tables as a Spark data source (format ``sqlite``), by row ranges."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def tables(path: str) -> list[str]:
    """The names of a database's tables."""
    with _connect(path) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def schema(path: str, table: str) -> StructType:
    """A table's columns: integers as long, other numbers as double, the rest as string."""
    with _connect(path) as db:
        columns = db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
    if not columns:
        raise ValueError(f"no table {table} in {path}")
    fields = []
    for _, name, declared, *_ in columns:
        kind = (declared or "").upper()
        if "INT" in kind or "BIT" in kind:
            fields.append(StructField(name, LongType()))
        elif any(x in kind for x in ("REAL", "DOUBLE", "FLOAT", "NUM")):
            fields.append(StructField(name, DoubleType()))
        else:
            fields.append(StructField(name, StringType()))
    return StructType(fields)


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, kinds: StructType, pieces: int) -> None:
        self.path, self.table, self.kinds, self.pieces = path, table, kinds, pieces

    def partitions(self) -> list[_Range]:
        with _connect(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a table without rowid is read whole
                return [_Range(None, None)]
        if low is None:
            return [_Range(None, None)]
        step = max(1, -(-(high - low + 1) // self.pieces))
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        convert = [int if isinstance(f.dataType, LongType) else float if isinstance(f.dataType, DoubleType) else str for f in self.kinds]
        names = ", ".join(_quoted(f.name) for f in self.kinds)
        where = "" if partition.low is None else f" WHERE rowid >= {partition.low} AND rowid < {partition.high}"
        with _connect(self.path) as db:
            for row in db.execute(f"SELECT {names} FROM {_quoted(self.table)}{where}"):
                yield tuple(None if v is None else c(v) for c, v in zip(convert, row))


class SQLiteSource(DataSource):
    """Options: path, dbtable, numPartitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        return schema(self.options["path"], self.options["dbtable"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["dbtable"], schema, int(self.options.get("numPartitions", "8")))


def read(spark: SparkSession, path: str, table: str, pieces: int = 8) -> DataFrame:
    """A table of a database; the file must be readable where tasks run."""
    spark.dataSource.register(SQLiteSource)
    return spark.read.format("sqlite").option("path", path).option("dbtable", table).option("numPartitions", str(pieces)).load()
