"""Micro-batches with a late-data filter and cumulative state by key."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def late_filter(batch: DataFrame, column: str, delay: float) -> DataFrame:
    """Rows no more than ``delay`` behind the batch's own latest; rows without a time are dropped.

    A number is an epoch (delay in its unit, seconds; a thousand times as much
    for milliseconds), a timestamp takes seconds.  The latest value is a
    one-row aggregate that joins back as a broadcast.
    """
    kind = dict(batch.dtypes)[column]
    at = F.unix_micros(F.col(column).cast("timestamp")) / 1e6 if kind.startswith("timestamp") else F.col(column).cast("double")
    latest = batch.agg(F.max(at).alias("__latest"))
    scale = F.lit(1.0) if kind.startswith("timestamp") else F.when(F.col("__latest") > 1e12, 1000.0).otherwise(1.0)
    return batch.join(F.broadcast(latest), at >= F.col("__latest") - delay * scale).select(*batch.columns)


class CumulativeState:
    """Sums by key over all batches, as Parquet in buckets by the keys' hash.

    A batch rewrites only the buckets that its keys fall into, and then writes
    a manifest of its own that names each bucket's folder.  Nothing is renamed
    or replaced, so an object store will do: the state is the latest whole
    manifest.  A batch that is replayed starts from the manifest that its first
    run started from, so nothing counts twice.  Folders and manifests that
    neither the latest manifest nor the one before it names are removed.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], measures: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.measures, self.buckets = spark, path.rstrip("/"), keys, measures, buckets
        self.where, self.at = fs.FileSystem.from_uri(self.path)

    def _manifests(self) -> list[dict]:
        """Whole manifests, the latest first."""
        found = self.where.get_file_info(fs.FileSelector(self.at, allow_not_found=True))
        out = []
        for name in sorted((f.base_name for f in found if f.base_name.startswith("manifest-")), reverse=True):
            with self.where.open_input_stream(f"{self.at}/{name}") as f:
                try:
                    out.append({**json.loads(f.read()), "name": name})
                except ValueError:  # a writer was lost
                    continue
        return out

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame | None:
        paths = [f"{self.path}/{p}" for b, p in sorted(manifest["buckets"].items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        return self.spark.read.parquet(*paths) if paths else None

    def current(self) -> DataFrame | None:
        """The whole state."""
        manifests = self._manifests()
        return self._read(manifests[0]) if manifests else None

    def batch(self) -> int:
        """The latest batch that counts; -1 before the first."""
        manifests = self._manifests()
        return manifests[0]["batch"] if manifests else -1

    def merge(self, batch_id: int, rows: DataFrame) -> DataFrame | None:
        """Adds a batch's measures to the state; the full state afterwards."""
        manifests = self._manifests()
        base = next((m for m in manifests if m["batch"] < batch_id), {"batch": -1, "buckets": {}})
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = rows.select(*self.keys, *self.measures).withColumn("__bucket", bucket)
        rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            touched = sorted(r[0] for r in rows.select("__bucket").distinct().collect())  # no more than there are buckets
            old = self._read(base, touched)
            both = rows if old is None else old.withColumn("__bucket", bucket).unionByName(rows)
            merged = both.repartition("__bucket").groupBy("__bucket", *self.keys).agg(*(F.sum(m).alias(m) for m in self.measures))
            version = f"batch-{batch_id:09d}-{uuid.uuid4().hex[:8]}"
            merged.write.partitionBy("__bucket").parquet(f"{self.path}/{version}")
        finally:
            rows.unpersist()
        now = {**base["buckets"], **{str(b): f"{version}/__bucket={b}" for b in touched}}
        nth = 1 + max((int(m["name"][:-5].rpartition("-")[2]) for m in manifests), default=0)
        with self.where.open_output_stream(f"{self.at}/manifest-{batch_id:09d}-{nth:09d}.json") as f:
            f.write(json.dumps({"batch": batch_id, "buckets": now}).encode())
        self._clean(base)
        return self._read({"buckets": now})

    def _clean(self, base: dict) -> None:
        """Removes what neither the latest manifest nor the one that it started from names."""
        manifests = self._manifests()
        kept = [m for m in manifests if m is manifests[0] or m.get("name") == base.get("name")]
        used = {p.split("/")[0] for m in kept for p in m["buckets"].values()}
        for m in manifests:
            if m not in kept:
                self.where.delete_file(f"{self.at}/{m['name']}")
        for f in self.where.get_file_info(fs.FileSelector(self.at)):
            if f.base_name.startswith("batch-") and f.base_name not in used:
                self.where.delete_dir(f"{self.at}/{f.base_name}")


def start(
    source: DataFrame, state: CumulativeState, aggregate: Callable[[DataFrame], DataFrame], checkpoint: str, time_column: str | None = None,
    delay: float = 5, sink: Callable[[DataFrame, int], None] | None = None, every: str | None = "2 seconds",
) -> StreamingQuery:
    """Runs ``aggregate`` over each micro-batch without its late rows and merges the result; without ``every``, what is there now, then ends."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)  # its latest time, then its rows
        try:
            rows = late_filter(batch, time_column, delay) if time_column else batch
            merged = state.merge(batch_id, aggregate(rows))
            if sink and merged is not None:
                sink(merged, batch_id)
        finally:
            batch.unpersist()

    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def csv_source(spark: SparkSession, directory: str, schema: str, files_per_batch: int | None = None, pattern: str = "*.csv") -> DataFrame:
    """New CSV files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("header", True).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(directory)


def windowed(source: DataFrame, time_column: str, keys: list[str], measure: str, length: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window and key, late rows dropped by Spark's own watermark."""
    window = F.window(time_column, length, slide) if slide else F.window(time_column, length)
    grouped = source.withWatermark(time_column, delay).groupBy(window, *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(measure).alias(f"sum_{measure}")).select("window.start", "window.end", *keys, "n", f"sum_{measure}")
