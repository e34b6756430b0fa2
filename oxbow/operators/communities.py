"""Communities by modularity: rounds of local moves as joins and aggregates, then contraction to the next level.

The nodes of one half move at once to the neighbouring community of largest gain, then those of the other
half; the halves, by a hash, change every two rounds, which keeps two nodes from swapping for ever. It ends
when neither half moves. Every round costs the edges once; hubs are pre-aggregated per community; no edges
reach the driver. What nodes and communities are is broadcast while they are MOST_BROADCAST at most (counted),
and joined by shuffles beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxbow.session import checkpointed

#: Rows of (node, community, degree) that a broadcast may hold, some 60 MB.
MOST_BROADCAST = 1_000_000


def undirected(edges: DataFrame, src: str, dst: str, weight: str | None) -> DataFrame:
    """(u, v, w) both ways, parallel edges summed; a self loop once, with twice its weight."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    one = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"), w.alias("w")).where("u is not null and v is not null")
    turned = one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")
    return one.unionAll(turned).groupBy("u", "v").agg(F.sum("w").alias("w"))


def local_moves(both: DataFrame, rounds: int) -> DataFrame:
    """(node, community) after moves until nobody gains, or `rounds`. Ties go to the smaller community."""
    state = checkpointed(both.groupBy("u").agg(F.sum("w").alias("degree")).select(F.col("u").alias("node"), F.col("u").alias("community"), "degree"))
    total, size = state.agg(F.sum("degree"), F.count("*")).first()
    total = total or 0.0
    small = F.broadcast if size <= MOST_BROADCAST else lambda df: df
    apart = both.where("u <> v")
    still = 0
    for k in range(rounds):
        sums = state.groupBy("community").agg(F.sum("degree").alias("inside"))
        half = F.pmod(F.xxhash64("node", F.lit(k // 2)), F.lit(2)) == k % 2
        mine = state.where(half).select(F.col("node").alias("u"), F.col("community").alias("at"), "degree")
        near = apart.join(small(mine), "u").join(small(state.select(F.col("node").alias("v"), "community")), "v").groupBy("u", "at", "degree", "community").agg(F.sum("w").alias("w"))
        home = mine.select("u", "at", "degree", F.col("at").alias("community"), F.lit(0.0).alias("w"))
        scored = near.unionByName(home).join(small(sums), "community").withColumn("others", F.col("inside") - F.when(F.col("community") == F.col("at"), F.col("degree")).otherwise(0.0))
        gain = F.round(F.col("w") - F.col("others") * F.col("degree") / F.lit(total), 9)
        stay = F.max(F.when(F.col("community") == F.col("at"), F.col("gain")))
        best = scored.withColumn("gain", gain).groupBy("u").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "community")).alias("best"), stay.alias("stay"))  # its own community may come twice, without and with its edges: the larger gain counts
        moves = best.where(-F.col("best.loss") > F.col("stay")).select(F.col("u").alias("node"), F.col("best.community").alias("moved"))
        moves = checkpointed(moves)
        if moves.isEmpty():
            still += 1
            if still >= 2 and k % 2:
                break
            continue
        still = 0
        state = checkpointed(state.join(small(moves), "node", "left").select("node", F.coalesce("moved", "community").alias("community"), "degree"))
    return state.select("node", "community")


def detect_communities(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None, levels: int = 1, rounds: int = 24) -> DataFrame:
    """(node, community) of the nodes that an edge touches; a community is named by its smallest node.

    `levels` above 1 contracts communities to nodes and goes on, until nothing merges. Direction is ignored;
    edges with a null end are dropped; an empty table gives no rows.
    """
    both = checkpointed(undirected(edges, src, dst, weight))
    found = both.select(F.col("u").alias("node"), F.col("u").alias("community")).distinct()
    for _ in range(levels):
        moved = local_moves(both, rounds).withColumnsRenamed({"node": "old", "community": "new"})
        found = checkpointed(found.join(moved, found["community"] == moved["old"]).select("node", F.col("new").alias("community")))
        ends = both.join(moved.select(F.col("old").alias("u"), F.col("new").alias("cu")), "u").join(moved.select(F.col("old").alias("v"), F.col("new").alias("cv")), "v")
        smaller = checkpointed(ends.groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
        if smaller.select("u").distinct().count() == both.select("u").distinct().count():
            break
        both = smaller
    least = found.groupBy("community").agg(F.min("node").alias("least"))
    return found.join(least, "community").select("node", F.col("least").alias("community"))
