"""Graph operators over an edge table: breadth-first by frontier joins, with a visited set.

Every hop is one join of the frontier with the edges and one anti join with what was visited, so
cycles and dense graphs cost their edges once per hop, not their walks. Each hop is checkpointed.
A frontier, and what was visited, is broadcast while it has MOST_BROADCAST rows at most (counted), so
that the edges are scanned and not shuffled; beyond that all is joined by shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oxbow.operators.components import star_components
from oxbow.session import checkpointed

#: Rows of (source, node, distance) that a broadcast may hold, some 60 MB.
MOST_BROADCAST = 1_000_000


def steps(edges: DataFrame, src: str, dst: str, direction: str = "forward", edge_type: str | None = None, type_col: str = "type") -> DataFrame:
    """(u, v) that one hop may take, both ways if `direction` is neither forward nor backward; parallel edges repeat."""
    if edge_type is not None:
        edges = edges.where(F.col(type_col) == edge_type)
    forth = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    back = forth.select(F.col("v").alias("u"), F.col("u").alias("v"))
    found = {"forward": forth, "backward": back}.get(direction, forth.unionAll(back))
    return found.where("u is not null and v is not null")


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df` of so many rows (counted), to be broadcast if that is few enough."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def k_hop(hops: DataFrame, sources: DataFrame, k: int, target: str | None = None) -> DataFrame:
    """(source, node, dist) of the nodes within k steps of each row of `sources` (one column), at their shortest distance, source included.

    With a `target` (as text) it ends with the hop that reaches it from any source.
    """
    seen = frontier = checkpointed(sources.distinct().toDF("source").select("source", F.col("source").alias("node"), F.lit(0).alias("dist")))
    met = F.coalesce(F.max(F.col("node").cast("string") == F.lit(target)), F.lit(False))
    size, reached = frontier.agg(F.count("*"), met).first()
    total = size
    for dist in range(1, k + 1):
        if reached or not size:
            break
        new = hops.join(small(frontier, size), F.col("node") == F.col("u")).select("source", F.col("v").alias("node")).distinct()
        frontier = checkpointed(new.join(small(seen, total), ["source", "node"], "left_anti").withColumn("dist", F.lit(dist)))
        size, reached = frontier.agg(F.count("*"), met).first()
        seen, total = seen.unionAll(frontier), total + size
    return seen


def seeds(edges: DataFrame, values: list, like: str) -> DataFrame:
    kind = edges.schema[like].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(str(v),) for v in values], "s string").select(F.col("s").cast(kind).alias("source"))


def traverse(edges: DataFrame, sources: list, src: str, dst: str, max_hops: int, direction: str = "forward", edge_type: str | None = None, type_col: str = "type") -> DataFrame:
    """The edges walked from the sources, each with the depth at which it is first taken (1 from a source)."""
    reach = k_hop(steps(edges, src, dst, direction, edge_type, type_col), seeds(edges, sources, src), max_hops - 1)
    near = reach.groupBy("node").agg((F.min("dist") + 1).alias("depth"))
    rows = edges.where(F.col(type_col) == edge_type) if edge_type is not None else edges
    ends: list[Column] = {"forward": [F.col(src)], "backward": [F.col(dst)]}.get(direction, [F.col(src), F.col(dst)])
    out = None
    for end in ends:
        one = rows.join(near, end == near["node"]).select(*edges.columns, "depth")
        out = one if out is None else out.unionAll(one)
    return out.groupBy(*edges.columns).agg(F.min("depth").alias("depth"))


def var_length(edges: DataFrame, sources: list, src: str, dst: str, least: int, most: int, direction: str = "forward", edge_type: str | None = None, type_col: str = "type") -> DataFrame:
    """(src, dst, depth): nodes whose shortest distance from a source is between least and most."""
    reach = k_hop(steps(edges, src, dst, direction, edge_type, type_col), seeds(edges, sources, src), most)
    return reach.where(F.col("dist").between(max(least, 1), most)).select(F.col("source").alias("src"), F.col("node").alias("dst"), F.col("dist").alias("depth"))


def shortest_path(edges: DataFrame, source: object, target: object, src: str, dst: str, max_hops: int, direction: str = "forward") -> DataFrame:
    """One row (depth, found); depth is null if the target is not reached."""
    reach = k_hop(steps(edges, src, dst, direction), seeds(edges, [source], src), max_hops, str(target))
    return reach.where(F.col("node").cast("string") == str(target)).agg(F.min("dist").alias("depth")).select("depth", F.col("depth").isNotNull().alias("found"))


def match(nodes: DataFrame, edges: DataFrame, path: list[str], edge_types: list[str | None], id_col: str = "id", src: str = "src", dst: str = "dst", type_col: str = "type") -> DataFrame:
    """A chain (a)-[e1]->(b)-[e2]->(c): columns `<var>_<column>` of the nodes named in `path`, `e<k>_<column>` of the edges."""
    named = lambda df, prefix: df.select([F.col(c).alias(f"{prefix}_{c}") for c in df.columns])
    out = named(nodes, path[0])
    for k, (a, b, kind) in enumerate(zip(path[:-1], path[1:], edge_types, strict=True), 1):
        e = named(edges.where(F.col(type_col) == kind) if kind else edges, f"e{k}")
        out = out.join(e, F.col(f"{a}_{id_col}") == F.col(f"e{k}_{src}"))
        out = out.join(named(nodes, b), F.col(f"e{k}_{dst}") == F.col(f"{b}_{id_col}"))
    return out


def connected_components(nodes: DataFrame, edges: DataFrame, id_col: str = "id", src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): the smallest id reachable, for every node, isolated ones too."""
    found = star_components(edges, src, dst)
    return nodes.join(found, nodes[id_col] == found["node"], "left").select(id_col, F.coalesce("component", id_col).alias("component"))


def pagerank(edges: DataFrame, src: str, dst: str, seeds_df: DataFrame | None = None, alpha: float = 0.15, rounds: int = 100, settled: float = 1e-7) -> DataFrame:
    """(node, score): personalised to the seeds (one column), or to all nodes; what a sink holds returns to the seeds.

    It ends when a round changes all scores by less than `settled` together (looked at every five rounds), or after `rounds`.
    """
    hops = steps(edges, src, dst).distinct()
    nodes = hops.select(F.col("u").alias("node")).unionAll(hops.select("v")).distinct()
    start = (seeds_df.toDF("node") if seeds_df is not None else nodes).distinct()
    n = start.count()
    home = start.withColumn("home", F.lit(1.0 / max(1, n)))
    out_degree = hops.groupBy("u").agg(F.count("*").alias("degree"))
    moves = checkpointed(hops.join(out_degree, "u"))
    base = checkpointed(nodes.join(home, "node", "left").join(out_degree, nodes["node"] == out_degree["u"], "left").select("node", F.coalesce("home", F.lit(0.0)).alias("home"), F.coalesce("degree", F.lit(0)).alias("degree")))
    score = base.select("node", F.col("home").alias("score"))
    for k in range(rounds):
        passed = moves.join(score, moves["u"] == score["node"]).groupBy("v").agg(F.sum(F.col("score") / F.col("degree")).alias("got"))
        lost = base.join(score, "node").where("degree = 0").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))  # one row
        before = score
        score = base.join(passed, base["node"] == passed["v"], "left").crossJoin(F.broadcast(lost)).select("node", (F.col("home") * (alpha + (1 - alpha) * F.col("lost")) + (1 - alpha) * F.coalesce("got", F.lit(0.0))).alias("score"))
        if k % 5 == 4:
            score = checkpointed(score)
            gap = score.join(before.withColumnRenamed("score", "old"), "node").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
            if (gap or 0.0) < settled:
                break
    return score


def modularity(edges: DataFrame, communities: DataFrame, src: str, dst: str) -> DataFrame:
    """One row (modularity) of the undirected edges under `communities` (node, community)."""
    total = edges.agg(F.count("*").alias("m"))
    a = communities.select(F.col("node").alias("x"), F.col("community").alias("cx"))
    b = communities.select(F.col("node").alias("y"), F.col("community").alias("cy"))
    both = edges.join(a, F.col(src) == F.col("x")).join(b, F.col(dst) == F.col("y"))
    inside = both.where("cx = cy").agg(F.count("*").alias("inside"))
    degree = both.select(F.explode(F.array("cx", "cy")).alias("c")).groupBy("c").agg(F.count("*").alias("d"))
    squares = degree.agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("squares"))
    return total.crossJoin(inside).crossJoin(squares).select((F.col("inside") / F.col("m") - F.col("squares") / (4 * F.col("m") * F.col("m"))).alias("modularity"))
