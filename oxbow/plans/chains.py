"""Reads graph chains such as (a:L)-[r:T*1..3]->(b)<-[s]-(c) into patterns."""

from __future__ import annotations

from oxbow.operators.patterns import Graph, Hop, Pattern
from oxbow.plans.reader import Reader, literal, quoted

#: Fixed value: an open bound of a hop of variable length.
MOST_HOPS = 10


class ChainReader:
    """Gathers a pattern from chains; unnamed nodes and edges get names of their own."""

    def __init__(self, reader: Reader, graph: Graph) -> None:
        self.r, self.graph, self.pattern, self.unnamed = reader, graph, Pattern(), 0
        self.edge_vars: set[str] = set()
        self.pins: dict[str, dict[str, object]] = {}

    def fresh(self, what: str) -> str:
        self.unnamed += 1
        return f"_{what}{self.unnamed}"

    def properties(self) -> dict[str, object]:
        found: dict[str, object] = {}
        if self.r.maybe("{"):
            while not self.r.maybe("}"):
                name = self.r.take(kind="name")
                self.r.take(":")
                found[name] = self.r.value()
                self.r.maybe(",")
        return found

    def node(self) -> str:
        self.r.take("(")
        var = self.r.take(kind="name") if self.r.peek(kind="name") else self.fresh("n")
        wanted = {self.graph.label_col: self.r.take(kind="name")} if self.r.maybe(":") else {}
        self.pins.setdefault(var, {}).update(props := self.properties())
        self.r.take(")")
        conditions = [f"{quoted(c)} = {literal(v)}" for c, v in (wanted | props).items()]
        return self.pattern.node(var, " AND ".join(conditions) or None)

    def bounds(self) -> tuple[int | None, int]:
        """Of `*`, `*N`, `*M..N`, `*..N` and `*M..`."""
        if not self.r.maybe("*"):
            return None, 1
        low = int(self.r.take(kind="number")) if self.r.peek(kind="number") else None
        if self.r.maybe(".."):
            high = int(self.r.take(kind="number")) if self.r.peek(kind="number") else MOST_HOPS
            return (1 if low is None else low), high
        return (1, MOST_HOPS) if low is None else (low, low)

    def edge(self) -> tuple[str, str | None, int | None, int, str]:
        if self.r.maybe("-->"):
            return self.fresh("e"), None, None, 1, "forward"
        left = self.r.maybe("<-")
        if not left:
            self.r.take("-")
        var, kind, least, most = self.fresh("e"), None, None, 1
        if self.r.maybe("["):
            if self.r.peek(kind="name"):
                var = self.r.take(kind="name")
            if self.r.maybe(":"):
                kind = self.r.take(kind="name")
            least, most = self.bounds()
            self.r.take("]")
        if self.r.maybe("->"):
            if left:
                raise self.r.Error("an edge points one way only")
            return var, kind, least, most, "forward"
        self.r.take("-")
        return var, kind, least, most, "backward" if left else "both"

    def chain(self, optional: bool = False) -> None:
        a, first = self.node(), len(self.pattern.hops)
        while self.r.peek("-") or self.r.peek("<-") or self.r.peek("-->"):
            var, kind, least, most, direction = self.edge()
            b = self.node()
            self.edge_vars.add(var)
            self.pattern.hops.append(Hop(a, b, var, kind, direction, least, most, optional))
            a = b
        mine = self.pattern.hops[first:]
        if not mine and not optional:
            self.pattern.alone.append(a)
        if len(mine) > 1 and any(h.least is not None for h in mine):
            raise self.r.Error("a hop of variable length stands alone")
