"""Connected components of a graph given as a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoints

#: Large-star and small-star rounds converge in about log(nodes) rounds; beyond this the graph is broken.
MAX_ROUNDS = 100


def _large(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    return hung.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (two long columns a and b); root is the smallest node
    of the component. No links give no rows; nulls and links from a node to itself are left out.

    Stars are joined and grouped on their nodes, so no task holds a component: ``min`` combines
    before the shuffle and a hub's rows are an ordinary skewed join. Each round is checkpointed.
    """
    ensure_checkpoints(links.sparkSession)
    state = links.where("a is not null and b is not null and a <> b").select("a", "b").distinct().checkpoint()
    before = None
    for _ in range(MAX_ROUNDS):
        state = _small(_large(state)).checkpoint()
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            roots = state.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        before = now
    raise RuntimeError("components did not converge")
