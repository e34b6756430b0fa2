"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxbow.session import checkpointed


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40, after_round: Callable[[], None] | None = None) -> DataFrame:
    """(node, component) for every node that an edge touches; component is its smallest node.

    Each round re-hangs every neighbour below the smallest one (large star, then small star), so
    the edge table shrinks to one star per component in O(log^2 n) rounds. Only minima are
    aggregated, with partial sums before the shuffle, so a hub costs no more than its edges; the
    edges never reach the driver. Self loops, nulls, repeated edges and an empty table are fine:
    nulls and loops are dropped. `after_round` is called after each round.
    """
    a, b = F.col(src), F.col(dst)
    stars = checkpointed(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), a.isNotNull().alias("x"), b.isNotNull().alias("y"))
        .where("x and y and hi <> lo").select("hi", "lo").distinct()
    )
    seen = None
    for _ in range(max_rounds):
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(stars.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(smallest, "hi").select(
            F.explode(F.array(F.struct(F.col("hi").alias("a"), F.col("m").alias("b")), F.struct(F.col("lo").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        stars = checkpointed(small.where("e.a <> e.b").select(F.col("e.a").alias("hi"), F.col("e.b").alias("lo")).distinct())
        sums = stars.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.sum((F.col("hi") == F.col("lo")).cast("int"))).first()
        if after_round:
            after_round()
        if seen == sums:
            break
        seen = sums
    else:
        raise RuntimeError("star contraction did not settle")
    roots = stars.select(F.col("lo").alias("node")).distinct()
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
