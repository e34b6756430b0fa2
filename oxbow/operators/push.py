"""Personalised PageRank by forward push, all active nodes of a round at once.

A node is active while its residual reaches `epsilon` times its degree: it keeps `alpha` of it and passes
the rest evenly to its neighbours; a node without neighbours keeps all. Only the active nodes meet the
edges in a round, so the work follows the mass, at most 1 / (alpha * epsilon) pushes, not the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxbow.operators.graph import steps
from oxbow.session import checkpointed


def forward_push(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst", alpha: float = 0.15, epsilon: float = 1e-5, direction: str = "forward", rounds: int = 1000) -> DataFrame:
    """(node, score) of the nodes with mass, for the seeds (one column); seeds without edges are sinks. No seed, no row."""
    alpha = min(1.0, max(alpha, 1e-12))
    hops = checkpointed(steps(edges, src, dst, direction).distinct())
    degrees = checkpointed(hops.groupBy("u").agg(F.count("*").alias("degree")))
    start = seeds.toDF("node").where("node is not null").distinct()
    share = 1.0 / max(1, start.count())
    zero = F.lit(0.0)
    state = start.join(degrees, F.col("node") == F.col("u"), "left").select("node", zero.alias("p"), F.lit(share).alias("r"), F.coalesce("degree", F.lit(0)).alias("degree"))
    gone = (F.col("r") > 0) & ((F.col("degree") == 0) | (F.col("r") >= epsilon * F.col("degree")))
    for k in range(rounds):
        # a round without active nodes changes nothing, so only every third one looks
        if k % 3 == 0:
            state = checkpointed(state)
            if state.where(gone).isEmpty():
                break
        active = state.where(gone)
        kept = F.when(~gone, zero).when(F.col("degree") == 0, F.col("r")).otherwise(alpha * F.col("r"))
        rest = state.select("node", (F.col("p") + kept).alias("p"), F.when(gone, zero).otherwise(F.col("r")).alias("r"))
        passed = active.where("degree > 0").join(hops, F.col("node") == F.col("u")).select(F.col("v").alias("node"), zero.alias("p"), ((1 - alpha) * F.col("r") / F.col("degree")).alias("r"))
        sums = rest.unionAll(passed).groupBy("node").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
        state = sums.join(degrees, F.col("node") == F.col("u"), "left").select("node", "p", "r", F.coalesce("degree", F.lit(0)).alias("degree"))
    return state.where("p > 0").select("node", F.col("p").alias("score"))
