"""Views of a stored graph: overview, statistics, node, neighbours, subgraph, search; and the graph of a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oxbow.operators.graph import k_hop, seeds, steps
from oxbow.operators.patterns import Graph


def built(graph: Graph) -> Graph:
    """One row per node id; edges whose ends are nodes, parallel ones kept."""
    nodes = graph.nodes.where(F.col(graph.id_col).isNotNull()).dropDuplicates([graph.id_col])
    ids = nodes.select(F.col(graph.id_col).alias("_id"))
    edges = graph.edges.join(ids, F.col(graph.src) == F.col("_id"), "left_semi").join(ids, F.col(graph.dst) == F.col("_id"), "left_semi")
    return Graph(nodes, edges, graph.id_col, graph.src, graph.dst, graph.type_col, graph.label_col)


def stats(graph: Graph) -> DataFrame:
    """(kind, name, n): nodes by label and edges by type."""
    labels = graph.nodes.groupBy(F.col(graph.label_col).alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    types = graph.edges.groupBy(F.col(graph.type_col).alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "name", "n")
    return labels.unionAll(types)


def degrees(graph: Graph) -> DataFrame:
    """(id, outgoing, incoming) of every node, isolated ones too."""
    ends = graph.edges.select(F.col(graph.src).alias("k"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(graph.edges.select(graph.dst, F.lit(0), F.lit(1)))
    sums = ends.groupBy("k").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    found = graph.nodes.join(sums, F.col(graph.id_col) == F.col("k"), "left")
    return found.select(F.col(graph.id_col).alias("id"), F.coalesce("o", F.lit(0)).alias("outgoing"), F.coalesce("i", F.lit(0)).alias("incoming"))


def neighbors(graph: Graph, node: object, direction: str = "both", edge_type: str | None = None) -> DataFrame:
    """The nodes one step from `node`."""
    hops = steps(graph.edges, graph.src, graph.dst, direction, edge_type, graph.type_col)
    near = hops.where(F.col("u").cast("string") == str(node)).select(F.col("v").alias(graph.id_col)).distinct()
    return graph.nodes.join(near, graph.id_col, "left_semi")


def subgraph(graph: Graph, roots: list, depth: int) -> Graph:
    """The nodes within `depth` undirected steps of the roots, and the edges among them."""
    reach = k_hop(steps(graph.edges, graph.src, graph.dst, "both"), seeds(graph.edges, roots, graph.src), depth)
    ids = reach.select(F.col("node").alias("_id")).distinct()
    nodes = graph.nodes.join(ids, F.col(graph.id_col) == F.col("_id"), "left_semi")
    edges = graph.edges.join(ids, F.col(graph.src) == F.col("_id"), "left_semi").join(ids, F.col(graph.dst) == F.col("_id"), "left_semi")
    return Graph(nodes, edges, graph.id_col, graph.src, graph.dst, graph.type_col, graph.label_col)


def search_nodes(graph: Graph, text: str, offset: int = 0, n: int = 50) -> DataFrame:
    """A page of the nodes whose id or label contains the text, without case, by id."""
    held = lambda c: F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower()))
    return graph.nodes.where(held(graph.id_col) | held(graph.label_col)).orderBy(graph.id_col).offset(offset).limit(n)


def schema_graph(spark: SparkSession, tables: dict[str, DataFrame]) -> Graph:
    """A node per table, with its columns; `<base>_id` columns refer to table `base` or `bases`. Pairs x_nodes, x_edges are hidden."""
    hidden = {n for base in tables for n in (f"{base.removesuffix('_nodes')}_nodes", f"{base.removesuffix('_nodes')}_edges") if base.endswith("_nodes") and f"{base.removesuffix('_nodes')}_edges" in tables}
    shown = {n: df for n, df in sorted(tables.items()) if n not in hidden}
    nodes = [(n, "table", df.columns) for n, df in shown.items()]
    edges = []
    for name, df in shown.items():
        for c in df.columns:
            base = c.removesuffix("_id")
            target = next((t for t in (base, base + "s") if t in shown and t != name), None) if c.endswith("_id") else None
            if target:
                edges.append((name, target, "REFERENCES", c))
    return Graph(spark.createDataFrame(nodes, "id string, label string, columns array<string>"), spark.createDataFrame(edges, "src string, dst string, type string, column string"))


def described(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, type) of all columns."""
    return [(n, f.name, f.dataType.simpleString()) for n, df in sorted(tables.items()) for f in df.schema]


def explored(df: DataFrame, most: int = 10) -> dict[str, list]:
    """Up to `most` (10 at most) values of each plain column, in one pass; a sample, not statistics."""
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    rows = df.select(*plain).limit(1000).collect()
    return {c: sorted({r[c] for r in rows if r[c] is not None})[: min(most, 10)] for c in plain}
