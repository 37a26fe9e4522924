"""Intermediate tables and files in the folder that all executors share.

The folder is the one that the cluster names in ``spark.checkpoint.dir``; only
a local session may do without, and uses a temporary folder of its machine.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group: a task that writes or reads a table holds one of them.
ROW_GROUP = 8 << 20

_own: dict[str, str] = {}
_made: list[str] = []


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; wherever tasks run, the same."""
    for scheme in ("s3a://", "s3n://"):
        uri = uri.replace(scheme, "s3://", 1) if uri.startswith(scheme) else uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def shared(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = _own.setdefault("top", tempfile.mkdtemp(prefix="tarn-"))
    here = spark._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/tarn-{name}-{uuid.uuid4().hex}")
    # a path without scheme lies where Hadoop's configuration says
    path = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(here).toString()
    _made.append(path)
    return path


@atexit.register
def _clean() -> None:
    for path in _made + list(_own.values()):
        with contextlib.suppress(Exception):
            where, at = opened(path)
            where.delete_dir(at)


def drop(path: str) -> None:
    """Removes a path that nothing reads any more."""
    with contextlib.suppress(OSError):
        where, at = opened(path)
        where.delete_dir(at)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: its lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def forget(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "_written_to", None):
            drop(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
