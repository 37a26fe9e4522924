"""PageRank: the single step over ranked edges, and iterations over an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAMPING = 0.85


def step(df: DataFrame, damping: float = DAMPING) -> DataFrame:
    """target, rank after one step over rows (target, rank, out_degree)."""
    return df.groupBy("target").agg((F.lit(1 - damping) + damping * F.sum(F.col("rank") / F.col("out_degree"))).alias("rank"))


def iterate(edges: DataFrame, iterations: int = 3, damping: float = DAMPING, src: str = "src", dst: str = "dst", checkpoint_every: int = 4) -> DataFrame:
    """node, rank after some iterations; every node of the edges has a rank, from 1.0 on.

    Edges are counted and joined with their out-degree once; each iteration is
    one join on the source, and one aggregate with partial sums on the target.
    Lineage is cut by checkpoints in the shared folder.
    """
    links = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    degree = links.groupBy(F.col("src").alias("of")).agg(F.sum("weight").alias("out_degree"))
    links = links.join(degree, F.col("src") == F.col("of")).select("src", "dst", (F.col("weight") / F.col("out_degree")).alias("share"))
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    ranks = nodes.withColumn("rank", F.lit(1.0))
    for i in range(iterations):
        given = links.join(ranks, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        ranks = nodes.join(given, F.col("node") == F.col("to"), "left").select("node", (F.lit(1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if (i + 1) % checkpoint_every == 0 and i + 1 < iterations:
            ranks = ranks.checkpoint()
    return ranks
