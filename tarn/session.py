"""The engine's settings as Spark configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConfig:
    """What a deployment tunes; everything else is Spark's default.

    ``broadcast_bytes`` bounds sides that are broadcast, by their real size;
    ``coalesce_bytes`` is what small shuffle partitions are joined up to;
    ``skew_factor`` times the median makes a partition skewed.
    """

    app_name: str = "tarn"
    master: str | None = None
    shuffle_partitions: int = 200
    broadcast_bytes: int = 10 << 20
    coalesce_bytes: int = 64 << 20
    skew_factor: float = 3.0
    skew_bytes: int = 256 << 20
    scan_partition_bytes: int = 128 << 20
    fair: bool = True
    speculation: bool = True
    speculation_multiplier: float = 1.5
    push_shuffle: bool = False
    external_shuffle: bool = False
    max_failures: int = 4
    extra: tuple[tuple[str, str], ...] = ()

    def confs(self) -> dict[str, str]:
        flag = lambda x: str(x).lower()
        return {
            "spark.app.name": self.app_name,
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.shuffle.partitions": str(self.shuffle_partitions),
            "spark.sql.autoBroadcastJoinThreshold": str(self.broadcast_bytes),
            "spark.sql.files.maxPartitionBytes": str(self.scan_partition_bytes),
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.coalescePartitions.enabled": "true",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(self.coalesce_bytes),
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": str(self.skew_factor),
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(self.skew_bytes),
            "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
            "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
            "spark.sql.cbo.enabled": "true",
            "spark.sql.cbo.joinReorder.enabled": "true",
            "spark.scheduler.mode": "FAIR" if self.fair else "FIFO",
            "spark.speculation": flag(self.speculation),
            "spark.speculation.multiplier": str(self.speculation_multiplier),
            "spark.task.maxFailures": str(self.max_failures),
            "spark.shuffle.push.enabled": flag(self.push_shuffle),
            "spark.shuffle.service.enabled": flag(self.external_shuffle),
            **dict(self.extra),
        }


def build(config: EngineConfig = EngineConfig()) -> SparkSession:
    """A session with the configuration."""
    builder = SparkSession.builder
    if config.master:
        builder = builder.master(config.master)
    return builder.config(map=config.confs()).getOrCreate()
