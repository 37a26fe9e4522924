"""Row-wise operators over a text column that pass every other column through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm import _store, _text

#: Spark's defaults of rows and bytes of an Arrow batch and of rows that a Parquet reader holds, and what they are here: texts are long.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "2m"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"),
}


#: Bytes of a row group in what a session writes; Parquet's default of 128 MB is held by each task that writes a result.
BLOCK_SIZE = "parquet.block.size"


def small_batches(docs: DataFrame) -> None:
    """Texts are read, reach Python and are written in smaller batches than by default, unless the session has set others."""
    spark = docs.sparkSession
    conf = spark.conf
    for name, (default, own) in BATCHES.items():
        if conf.get(name) == default:
            conf.set(name, own)
    # whoever writes what an operator returns does it with the session's settings
    if conf.get(BLOCK_SIZE, None) is None and spark.sparkContext._jsc.hadoopConfiguration().get(BLOCK_SIZE) is None:
        conf.set(BLOCK_SIZE, str(_store.ROW_GROUP))


def texts(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id and the text, under the names doc_id and text."""
    small_batches(docs)
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"))


def id_type(docs: DataFrame, id_column: str = "doc_id") -> str:
    return docs.schema[id_column].dataType.simpleString()


def long_ids(docs: DataFrame, id_column: str = "doc_id") -> Column:
    """The id as a long; operators that order or join by it take integer columns alone."""
    if not isinstance(docs.schema[id_column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"{id_column} must be an integer column, not {id_type(docs, id_column)}")
    return F.col(id_column).cast("long")


def keep_where(docs: DataFrame, decide: Callable[[pa.Array], np.ndarray], text: str = "text") -> DataFrame:
    """The rows whose text decide() marks, with all their columns whatever their names."""
    small_batches(docs)
    at = docs.columns.index(text)
    inner = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema)])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _text.pieces(batch.column(at)):
                part = batch.slice(a, b - a)
                if len(part := part.filter(pa.array(decide(part.column(at))))):
                    yield part

    return docs.toDF(*inner.names).mapInArrow(kept, inner).toDF(*docs.columns)


def with_measures(docs: DataFrame, measure: Callable[[pa.Array], dict[str, np.ndarray]], names: tuple[str, ...], text: str = "text") -> DataFrame:
    """Every row as the struct column ``row`` beside the long measurements of its text."""
    small_batches(docs)
    at = docs.columns.index(text)
    row = T.StructType([T.StructField("row", docs.schema, False)])
    schema = T.StructType([*row, *(T.StructField(n, T.LongType(), False) for n in names)])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).field(at)
            for a, b in _text.pieces(column):
                found = measure(column.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(found[n]) for n in names)], ["row", *names])

    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).mapInArrow(measured, schema)
