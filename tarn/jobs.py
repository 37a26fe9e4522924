"""Jobs in the background: submit, streams, status, tasks, workers, cancel, counters."""

from __future__ import annotations

import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tarn.operators import pagerank, regression
from tarn.plans import pruning, query, stats
from tarn.sources import files
from tarn.streaming import cumulative

PENDING, RUNNING, COMPLETED, FAILED, CANCELLED = "PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCELLED"
ENDED = (COMPLETED, FAILED, CANCELLED)


@dataclass
class Job:
    id: str
    kind: str
    state: str = PENDING
    error: str | None = None
    submitted: float = field(default_factory=time.time)
    started: float | None = None
    ended: float | None = None
    output: str | None = None


class Engine:
    """Runs jobs side by side, each in a scheduler pool and under a tag of its own."""

    def __init__(self, spark: SparkSession, slots: int = 8) -> None:
        self.spark, self.jobs, self.counts = spark, {}, Counter()
        self.catalog = stats.Catalog(spark)
        self._lock = threading.Lock()
        self._pool = ThreadPoolExecutor(slots, thread_name_prefix="tarn-job")
        self._futures: dict[str, Future] = {}
        self._views = threading.Lock()
        self._streams: dict[str, StreamingQuery] = {}

    def _start(self, kind: str, work: Callable[[Job], None], output: str | None = None) -> str:
        job = Job(uuid.uuid4().hex[:12], kind, output=output)

        def run() -> None:
            with self._lock:
                if job.state != PENDING:
                    return
                job.state, job.started = RUNNING, time.time()
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"job-{job.id}")
            self.spark.sparkContext.setJobGroup(job.id, kind, interruptOnCancel=True)
            self.spark.addTag(f"job-{job.id}")
            try:
                work(job)
                end, error = COMPLETED, None
            except Exception as e:  # a job's failure is its state
                end, error = FAILED, str(e)
            finally:
                self.spark.removeTag(f"job-{job.id}")
                self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
            with self._lock:
                if job.state == RUNNING:  # a cancelled job stays cancelled
                    job.state, job.error = end, error
                job.ended = time.time()
                self.counts[job.state] += 1

        with self._lock:
            self.jobs[job.id] = job
            self.counts["SUBMITTED"] += 1
        self._futures[job.id] = self._pool.submit(inheritable_thread_target(self.spark)(run))
        return job.id

    def _planned(self, build: Callable[[], DataFrame]) -> DataFrame:
        """Views are the session's: one job's names are set and resolved before the next one's."""
        with self._views:
            df = build()
            df.schema  # resolved now
            return df

    def submit(
        self, sql: str | None = None, map_sql: str | None = None, reduce_sql: str | None = None, input_files: list[str] | None = None, num_partitions: int = 8,
        output_dir: str | None = None, broadcasts: dict[str, str] | None = None, prune: dict | None = None,
    ) -> str:
        """A SQL job; a map and a reduce statement go before a single one. Results are CSV in output_dir."""
        if not (sql or map_sql and reduce_sql) or not input_files or not output_dir or num_partitions <= 0:
            raise ValueError("a job needs sql, or map_sql and reduce_sql, and input_files, output_dir and num_partitions > 0")

        def build() -> DataFrame:
            rows = files.register(self.spark, input_files, broadcasts)
            if prune and rows is not None:
                dim = files.read(self.spark, prune["file"])
                pruning.prune(rows, dim, prune["filter_column"], prune["value"], prune["key"], prune.get("fact_key")).createOrReplaceTempView("input")
            if map_sql and reduce_sql:
                return query.run_map_reduce(self.spark, map_sql, reduce_sql)
            words = sql.split()
            if [w.upper() for w in words[:2]] == ["ANALYZE", "TABLE"]:
                name = words[2].strip(";")
                entry = self.catalog.add(name, rows if rows is not None and name not in [t.name for t in self.spark.catalog.listTables()] else self.spark.table(name))
                self.catalog.analyze(entry.name)
                return stats.analyze(self.spark.table(name))
            return query.run_sql(self.spark, sql)

        return self._start("sql", lambda _: files.write_csv(self._planned(build), output_dir, num_partitions), output_dir)

    def submit_lr(self, input_file: str, output_dir: str, iterations: int = 2) -> str:
        return self._start("lr", lambda _: files.write_csv(regression.fit(files.read(self.spark, input_file), iterations=iterations), output_dir, 1), output_dir)

    def submit_pagerank(self, input_file: str, output_dir: str, iterations: int = 2, mode: str = "step") -> str:
        """mode ``step``: one step over (target, rank, out_degree); ``iterate``: iterations over edges (src, dst)."""

        def work(_: Job) -> None:
            df = files.read(self.spark, input_file)
            files.write_csv(pagerank.step(df) if mode == "step" else pagerank.iterate(df, iterations), output_dir)

        return self._start("pagerank", work, output_dir)

    def submit_streaming(
        self, input_dir: str, checkpoint_dir: str, map_sql: str, reduce_sql: str, output_dir: str, num_partitions: int = 8, schema: str | None = None, keys: list[str] | None = None,
        measures: list[str] | None = None, broadcasts: dict[str, str] | None = None, time_column: str | None = "timestamp", delay: float = 5, pattern: str = "*.csv", every: str | None = "2 seconds",
    ) -> str:
        """A stream of CSV files: each micro-batch goes through both statements and adds to the state; output_dir holds the full state.

        ``keys`` and ``measures`` name the state's columns; by default the
        reduce statement's strings, dates and times are keys, its numbers
        measures.  ``schema`` is that of the files; without it, of those there
        now.  The job runs until ``stop``; without ``every`` it takes what is
        there now and ends.
        """
        if not (input_dir and checkpoint_dir and map_sql and reduce_sql and output_dir) or num_partitions <= 0:
            raise ValueError("a stream needs input_dir, checkpoint_dir, map_sql, reduce_sql, output_dir and num_partitions > 0")

        def aggregate(batch: DataFrame) -> DataFrame:
            own = batch.sparkSession  # a micro-batch has a session of its own
            for name, path in (broadcasts or {}).items():
                files.read(own, path).createOrReplaceTempView(name)
            return query.run_map_reduce(own, map_sql, reduce_sql, input=batch)

        def work(job: Job) -> None:
            kind = schema or files.read(self.spark, f"{input_dir.rstrip('/')}/{pattern}").schema.simpleString()[len("struct<") : -1].replace(":", " ")
            stream = cumulative.csv_source(self.spark, input_dir, kind, pattern=pattern)
            with self._views:
                shape = aggregate(self.spark.createDataFrame([], stream.schema)).schema
            numbers = [f.name for f in shape if isinstance(f.dataType, T.NumericType)]
            names = keys or [f.name for f in shape if f.name not in (measures or numbers)]
            state = cumulative.CumulativeState(self.spark, _uri(self.spark, f"{checkpoint_dir.rstrip('/')}/state"), names, measures or [n for n in numbers if n not in names])
            found = time_column if time_column in stream.columns else None
            running = cumulative.start(stream, state, aggregate, f"{checkpoint_dir.rstrip('/')}/offsets", found, delay, lambda df, _: files.write_csv(df, output_dir, num_partitions), every)
            self._streams[job.id] = running
            if job.state == CANCELLED:
                running.stop()
            running.awaitTermination()

        return self._start("stream", work, output_dir)

    def stop(self, job_id: str, timeout: float = 60) -> Job:
        """Ends a stream after the batch at hand; the job is completed."""
        until = time.time() + timeout
        while job_id not in self._streams and self.jobs[job_id].state not in ENDED and time.time() < until:
            time.sleep(0.05)
        if job_id in self._streams:
            self._streams[job_id].stop()
        return self.wait(job_id, timeout)

    def status(self, job_id: str) -> Job:
        return self.jobs[job_id]

    def list_jobs(self) -> list[Job]:
        return sorted(self.jobs.values(), key=lambda j: j.submitted)

    def wait(self, job_id: str, timeout: float | None = None) -> Job:
        self._futures[job_id].result(timeout)
        return self.jobs[job_id]

    def cancel(self, job_id: str) -> Job:
        """Ends a job that has not ended; the state CANCELLED is final."""
        job = self.jobs[job_id]
        with self._lock:
            if job.state in ENDED:
                return job
            job.state, job.ended = CANCELLED, time.time()
        self.spark.interruptTag(f"job-{job_id}")
        self.spark.sparkContext.cancelJobGroup(job_id)
        if job_id in self._streams:
            self._streams[job_id].stop()
        return job

    def tasks(self, job_id: str | None = None) -> list[dict]:
        """The stages of a job that Spark still knows, or of all that run now, with their tasks."""
        tracker = self.spark.sparkContext.statusTracker()
        if job_id is None:
            stages = list(tracker.getActiveStageIds())
        else:
            groups = [job_id, *([str(self._streams[job_id].runId)] if job_id in self._streams else [])]
            infos = [tracker.getJobInfo(j) for g in groups for j in tracker.getJobIdsForGroup(g)]
            stages = sorted({s for i in infos if i for s in i.stageIds})
        return [{"stage": i.stageId, "name": i.name, "tasks": i.numTasks, "active": i.numActiveTasks, "completed": i.numCompletedTasks, "failed": i.numFailedTasks} for s in stages if (i := tracker.getStageInfo(s))]

    def workers(self) -> list[dict]:
        """Executors with their running tasks (the driver alone in local mode)."""
        infos = self.spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()
        return [{"host": i.host(), "port": i.port(), "running_tasks": i.numRunningTasks()} for i in infos]

    def health(self) -> dict[str, str]:
        return {"status": "stopped" if self.spark.sparkContext._jsc.sc().isStopped() else "ok"}

    def queue_depth(self) -> int:
        return sum(j.state == PENDING for j in self.jobs.values())

    def metrics(self) -> dict[str, float]:
        ended = [j.ended - j.started for j in self.jobs.values() if j.ended and j.started]
        return {
            "jobs_submitted": self.counts["SUBMITTED"], "jobs_completed": self.counts[COMPLETED], "jobs_failed": self.counts[FAILED], "jobs_cancelled": self.counts[CANCELLED],
            "jobs_running": sum(j.state == RUNNING for j in self.jobs.values()), "queue_depth": self.queue_depth(), "job_seconds_total": sum(ended),
        }

    def prometheus(self) -> str:
        return "".join(f"tarn_{k} {v}\n" for k, v in self.metrics().items())


def _uri(spark: SparkSession, path: str) -> str:
    """A path with the scheme that Hadoop's configuration gives it."""
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(here).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def load_spec(path: str) -> dict:
    """A job specification of flat ``key: value`` lines and ``- item`` lists."""
    out: dict = {}
    key = None
    with open(path) as f:
        for line in f:
            text = line.split(" #")[0].strip()
            if not text or text.startswith("#"):
                continue
            if text.startswith("- ") and key:
                out[key] = [*(out[key] or []), text[2:].strip().strip("\"'")]
            else:
                key, _, value = text.partition(":")
                value = value.strip().strip("\"'")
                out[key.strip()] = int(value) if value.isdigit() else value or None
                key = key.strip()
    return out
