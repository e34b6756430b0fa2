"""Graph patterns over node and edge tables: each hop of a pattern is a join on the variables bound so far."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxbow.operators.graph import k_hop, steps


@dataclass(frozen=True)
class Graph:
    """Node and edge tables and the names of the columns that play a role."""

    nodes: DataFrame
    edges: DataFrame
    id_col: str = "id"
    src: str = "src"
    dst: str = "dst"
    type_col: str = "type"
    label_col: str = "label"


@dataclass(frozen=True)
class Hop:
    """(a)-[var:kind*least..most]->(b); `direction` is forward, backward or both."""

    a: str
    b: str
    var: str
    kind: str | None = None
    direction: str = "forward"
    least: int | None = None
    most: int = 1
    optional: bool = False


@dataclass
class Pattern:
    """Hops, and for every node variable a Spark SQL condition on the node table (or None)."""

    hops: list[Hop] = field(default_factory=list)
    nodes: dict[str, str | None] = field(default_factory=dict)
    alone: list[str] = field(default_factory=list)  # required nodes given without a hop

    def node(self, var: str, condition: str | None) -> str:
        known = self.nodes.get(var)
        self.nodes[var] = " AND ".join(c for c in (known, condition) if c) or None
        return var


def prefixed(df: DataFrame, var: str) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(f"{var}_{c}") for c in df.columns])


def legs(graph: Graph, hop: Hop, starts: DataFrame) -> DataFrame:
    """(_from, _to, columns of the edge): what the hop may walk, `_from` at its variable a.

    A hop of variable length gives the shortest distance as `<var>_depth`, found by breadth-first search
    from `starts` (one column) only.
    """
    if hop.least is not None:
        hops = steps(graph.edges, graph.src, graph.dst, hop.direction, hop.kind, graph.type_col)
        reach = k_hop(hops, starts, hop.most).where(F.col("dist").between(max(hop.least, 1), hop.most))
        return reach.select(F.col("source").alias("_from"), F.col("node").alias("_to"), F.col("dist").alias(f"{hop.var}_depth"))
    edges = graph.edges if hop.kind is None else graph.edges.where(F.col(graph.type_col) == hop.kind)
    named = prefixed(edges, hop.var)
    src, dst = F.col(f"{hop.var}_{graph.src}"), F.col(f"{hop.var}_{graph.dst}")
    forth = named.select(src.alias("_from"), dst.alias("_to"), "*")
    back = named.select(dst.alias("_from"), src.alias("_to"), "*")
    if hop.direction == "both":
        return forth.unionAll(back.where(src != dst))
    return forth if hop.direction == "forward" else back


def ordered(hops: list[Hop]) -> list[Hop]:
    """Required hops first, each next to a bound variable where there is one; optional hops after them."""
    waiting, out, bound = [h for h in hops if not h.optional], [], set()
    while waiting:
        hop = next((h for h in waiting if h.a in bound or h.b in bound), waiting[0])
        waiting.remove(hop)
        out.append(hop)
        bound |= {hop.a, hop.b}
    return out + [h for h in hops if h.optional]


def match_pattern(graph: Graph, pattern: Pattern) -> DataFrame:
    """One row per match: columns `<var>_<column>` of nodes and edges.

    A variable met twice is one node. Parts that share no variable form a product, as the pattern says.
    Optional hops keep rows without a match, with nulls.
    """
    key = lambda var: F.col(f"{var}_{graph.id_col}")
    tables = {v: prefixed(graph.nodes.where(c) if c else graph.nodes, v) for v, c in pattern.nodes.items()}
    out, bound = None, set()
    hops = ordered(pattern.hops)
    needed = {v for h in hops if not h.optional for v in (h.a, h.b)}
    for var in dict.fromkeys(pattern.alone):
        if var not in needed:
            out = tables[var] if out is None else out.crossJoin(tables[var])
            bound.add(var)
    for hop in hops:
        if hop.b in bound and hop.a not in bound:  # walk from the bound end
            turned = {"forward": "backward", "backward": "forward"}.get(hop.direction, "both")
            hop = Hop(hop.b, hop.a, hop.var, hop.kind, turned, hop.least, hop.most, hop.optional)
        starts = (out if hop.a in bound else tables[hop.a]).select(key(hop.a)).where(key(hop.a).isNotNull()).distinct()
        walk = legs(graph, hop, starts)
        how = "left" if hop.optional else "inner"
        if hop.a in bound and hop.b in bound:
            out = out.join(walk, (key(hop.a) == F.col("_from")) & (key(hop.b) == F.col("_to")), how)
        elif hop.a in bound:
            out = out.join(walk.join(tables[hop.b], F.col("_to") == key(hop.b)), key(hop.a) == F.col("_from"), how)
        else:
            if hop.optional:
                raise ValueError("an optional hop needs a bound variable")
            part = tables[hop.a].join(walk, key(hop.a) == F.col("_from"))
            part = part.where(key(hop.a) == F.col("_to")) if hop.a == hop.b else part.join(tables[hop.b], F.col("_to") == key(hop.b))
            out = part if out is None else out.crossJoin(part)
        out = out.drop("_from", "_to")
        bound |= {hop.a, hop.b}
    if set(pattern.nodes) - bound:
        raise ValueError("an optional node needs a hop from a bound one")
    return out
