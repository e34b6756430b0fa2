"""A KQL-style pipe language, compiled operator by operator into one DataFrame plan.

`T | where x > 1 | summarize n = count() by k | top 3 by n`: each operator applies to the rows of
the one before, in the order written. Expressions become Spark SQL text, so Catalyst sees plain
built-ins: filters and columns reach the scan.

Beyond plain KQL: `join kind=inner|leftouter|rightouter|fullouter (T ...) on k` (or `$left.a ==
$right.b`), `project a = expr`, `by a = expr`, `!in`, `matches regex`, `["odd name"]`, and any Spark
function by its own name. `has` matches whole tokens without case, `contains` is a
case-sensitive substring.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oxbow.functions import vectors
from oxbow.operators import graph
from oxbow.operators.patterns import Graph, Hop, Pattern, match_pattern
from oxbow.plans.chains import ChainReader
from oxbow.plans.reader import QueryError, Reader, literal, quoted

TOKEN = re.compile(
    r"""\s+|//[^\n]*|(?P<number>\d+\.\d+|\d+(?P<unit>[smhd])\b|\d+)|(?P<string>"(?:\\.|[^"\\])*"|'[^']*')"""
    r"""|\[(?P<quoted>"[^"]*"|'[^']*')\]|(?P<name>\$?[A-Za-z_](?:[A-Za-z0-9_]|-(?=[A-Za-z]))*)|(?P<op>==|!=|<=|>=|=~|!in\b|\.\.|-->|->|<-|[-+*/%<>=(),|.\[\]:!])"""
)
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"'}
NAMED = {"tolower": "lower", "toupper": "upper", "strlen": "char_length", "tostring": "string", "toint": "int", "tolong": "bigint", "todouble": "double"}


class KqlError(QueryError):
    pass


def tokens_of(text: str) -> list[tuple[str, str]]:
    found, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise KqlError(f"unexpected character {text[at]!r} at {at}")
        at = m.end()
        kind = m.lastgroup
        if m["unit"]:
            found.append(("duration", str(int(m["number"][:-1]) * UNITS[m["unit"]])))
        elif kind == "string":
            body = m["string"][1:-1]
            found.append(("string", re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), body) if m["string"][0] == '"' else body))
        elif kind == "quoted":
            found.append(("name", m["quoted"][1:-1]))
        elif kind:
            found.append((kind, m[kind]))
    return found


def alias_of(expression: str) -> str:
    """The implicit name of an aggregate: its text with other characters as underscores."""
    return re.sub(r"[^A-Za-z0-9]", "_", expression).strip("_")[:40]


def has(left: str, right: str) -> str:
    """Whether a token of `left` is `right`. A plain word stops at its first place, behind a cheap search for its letters."""
    if re.fullmatch(r"'[0-9A-Za-z]+'", right):
        word = right[1:-1].lower()
        return f"(contains(lower({left}), '{word}') AND lower({left}) RLIKE '(^|[^0-9a-z]){word}([^0-9a-z]|$)')"
    return f"array_contains(split(lower({left}), '[^0-9a-z]+'), lower({right}))"


class Compiler(Reader):
    """Reads tokens from left to right; `table` gives the DataFrame of a name."""

    Error = KqlError

    def __init__(self, text: str, table: Callable[[str], DataFrame]) -> None:
        super().__init__(tokens_of(text))
        self.table = table
        self.df: DataFrame | None = None
        self.graph: Graph | None = None

    # expressions, as Spark SQL
    def expression(self) -> str:
        return self.chain(("or",), lambda: self.chain(("and",), self.negation))

    def chain(self, operators: tuple[str, ...], below: Callable[[], str]) -> str:
        left = below()
        while any(self.peek(o) for o in operators):
            left = f"({left} {self.take()} {below()})"
        return left

    def negation(self) -> str:
        return f"(NOT {self.negation()})" if self.maybe("not") else self.comparison()

    def comparison(self) -> str:
        left = self.sum()
        for sign, sql in (("==", "="), ("!=", "<>"), ("<=", "<="), (">=", ">="), ("<", "<"), (">", ">")):
            if self.maybe(sign):
                return f"({left} {sql} {self.sum()})"
        if self.maybe("=~"):
            return f"(lower({left}) = lower({self.sum()}))"
        if self.maybe("between"):
            self.take("(")
            low = self.sum()
            self.take("..")
            high = self.sum()
            self.take(")")
            return f"({left} BETWEEN {low} AND {high})"
        for word, sql in (("in", "IN"), ("!in", "NOT IN")):
            if self.maybe(word):
                self.take("(")
                items = self.listed(self.expression)
                self.take(")")
                return f"({left} {sql} ({', '.join(items)}))"
        for word in ("contains", "startswith", "endswith"):
            if self.maybe(word):
                return f"{word}({left}, {self.sum()})"
        if self.maybe("has"):
            return has(left, self.sum())
        if self.maybe("matches"):
            self.take("regex")
            return f"({left} RLIKE {self.sum()})"
        return left

    def sum(self) -> str:
        left = self.product()
        while self.peek("+") or self.peek("-"):
            left = f"({left} {self.take()} {self.product()})"
        return left

    def product(self) -> str:
        left = self.unary()
        while self.peek("*") or self.peek("/") or self.peek("%"):
            sign, right = self.take(), self.unary()
            if sign == "/" and self.is_whole(left) and self.is_whole(right):
                sign = "div"  # whole numbers divide to whole numbers
            left = f"({left} {sign} {right})"
        return left

    def is_whole(self, sql: str) -> bool:
        kind = self.df.select(F.expr(sql)).schema[0].dataType
        return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))

    def unary(self) -> str:
        return f"(- {self.unary()})" if self.maybe("-") else self.atom()

    def atom(self) -> str:
        if self.maybe("("):
            inner = self.expression()
            self.take(")")
            return f"({inner})"
        if self.at >= len(self.tokens):
            raise KqlError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return value + "D" if "." in value else value
        if kind == "duration":
            return f"INTERVAL {value} SECOND"
        if kind == "string":
            return literal(value)
        if kind == "name" and self.maybe("("):
            if value.lower() == "datetime":
                return self.datetime()
            arguments = [] if self.peek(")") else self.listed(lambda: "*" if self.maybe("*") else self.expression())
            self.take(")")
            return self.call(value.lower(), arguments)
        if kind == "name" and value.lower() in ("true", "false", "null"):
            return value.upper()
        if kind == "name":
            out = quoted(value)
            while self.peek(".") and self.tokens[self.at + 1][0] == "name":
                self.at += 1
                out = f"get_json_object({out}, {literal('$.' + self.take())})"
            return out
        raise KqlError(f"unexpected {value!r}")

    def datetime(self) -> str:
        if self.peek(kind="string"):
            text = literal(self.take())
        else:  # a bare ISO date or time
            parts = ""
            while not self.peek(")"):
                parts += self.tokens[self.at][1]
                self.at += 1
            text = literal(parts)
        self.take(")")
        return f"to_timestamp_ntz({text})"

    def call(self, name: str, a: list[str]) -> str:
        if name == "now":
            return "current_timestamp()"
        if name == "ago":
            return f"(current_timestamp() - {a[0]})"
        if name == "bin":
            return self.bin(*a)
        if name in ("startofhour", "startofday", "startofmonth", "startofweek", "startofyear"):
            return f"cast(date_trunc('{name[7:]}', {a[0]}) AS timestamp_ntz)"
        if name == "strcat":
            return f"concat_ws('', {', '.join(a)})"
        if name in ("isnull", "isnotnull"):
            return f"({a[0]} IS {'NOT ' * (name == 'isnotnull')}NULL)"
        if name == "iff":
            return f"(CASE WHEN {a[0]} THEN {a[1]} ELSE {a[2]} END)"
        if name in vectors.SQL:
            return vectors.SQL[name].format(a=a[0], b=a[1])
        if name == "count":
            return f"count({a[0] if a else '*'})"
        if name == "countif":
            return f"count_if({a[0]})"
        if name == "dcount":
            return f"count(DISTINCT {a[0]})"
        if name == "dcountif":
            return f"count(DISTINCT CASE WHEN {a[1]} THEN {a[0]} END)"
        if name == "make_list":  # nulls stay
            return f"transform(collect_list(struct({a[0]} AS x)), s -> s.x)"
        if name in ("tostring", "toint", "tolong", "todouble"):
            return f"cast({a[0]} AS {NAMED[name]})"
        return f"{NAMED.get(name, name)}({', '.join(a)})"

    def bin(self, column: str, size: str) -> str:
        if not (seconds := re.fullmatch(r"INTERVAL (\d+) SECOND", size)):
            return f"(floor({column} / {size}) * {size})"
        start = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
        micros = f"timestampdiff(MICROSECOND, {start}, cast({column} AS timestamp_ntz))"
        return f"({start} + make_dt_interval(0, 0, 0, cast(floor({micros} / {int(seconds[1]) * 1000000}) * {seconds[1]} AS decimal(18, 6))))"

    # operators
    def named(self, default: Callable[[str], str]) -> tuple[str, str]:
        """`name = expr` or `expr`."""
        if self.peek(kind="name") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1] == ("op", "="):
            name = self.take()
            self.take("=")
            return name, self.expression()
        begin = self.at
        sql = self.expression()
        text = "".join(v for _, v in self.tokens[begin : self.at])
        return (text if self.at == begin + 1 else default(text)), sql

    def query(self) -> DataFrame:
        self.df = self.union([]) if self.maybe("union") else self.table(self.take(kind="name"))
        while self.maybe("|"):
            name = self.take(kind="name").lower().replace("-", "_")
            step = getattr(self, f"do_{name}", None)
            if step is None:
                raise KqlError(f"unknown operator {name}")
            step()
        return self.df

    def branch(self) -> DataFrame:
        """A table name or a query in brackets."""
        before = self.df
        if self.maybe("("):
            out = self.query()
            self.take(")")
        else:
            out = self.table(self.take(kind="name"))
        self.df = before
        return out

    def union(self, first: list[tuple[str, DataFrame]]) -> DataFrame:
        source = None
        if self.maybe("withsource"):
            self.take("=")
            source = self.take(kind="name")

        def read() -> tuple[str, DataFrame]:
            name = self.tokens[self.at + self.peek("(")][1]
            return name, self.branch()

        parts = first + self.listed(read)
        if source and any(source in df.columns for _, df in parts):
            raise KqlError(f"withsource column {source} is a column already")
        out = None
        for name, df in parts:
            df = df.select(F.lit(name).alias(source), "*") if source else df
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def do_union(self) -> None:
        self.df = self.union([("", self.df)])

    def do_where(self) -> None:
        self.df = self.df.where(self.expression())

    do_filter = do_where

    def do_project(self) -> None:
        items = self.listed(lambda: self.named(alias_of))
        self.df = self.df.select([F.expr(sql).alias(name) for name, sql in items])

    def do_project_away(self) -> None:
        self.df = self.df.drop(*self.listed(lambda: self.take(kind="name")))

    def do_extend(self) -> None:
        while True:  # a later one sees an earlier one
            name, sql = self.named(alias_of)
            self.df = self.df.withColumn(name, F.expr(sql))
            if not self.maybe(","):
                return

    def do_summarize(self) -> None:
        aggregates = [] if self.peek("by") else self.listed(lambda: self.named(alias_of))
        keys = self.listed(lambda: self.named(alias_of)) if self.maybe("by") else []
        grouped = self.df.groupBy(*[F.expr(sql).alias(name) for name, sql in keys])
        self.df = grouped.agg(*[F.expr(sql).alias(name) for name, sql in aggregates]) if aggregates else self.df.select(*[F.expr(sql).alias(name) for name, sql in keys]).distinct()

    def do_take(self) -> None:
        self.df = self.df.limit(int(self.take(kind="number")))

    do_limit = do_take

    def order(self) -> list:
        def one() -> object:
            column = F.expr(self.expression())
            if self.maybe("asc"):
                return column.asc_nulls_last()
            self.maybe("desc")
            return column.desc_nulls_first()

        return self.listed(one)

    def do_sort(self) -> None:
        self.take("by")
        self.df = self.df.orderBy(*self.order())

    do_order = do_sort

    def do_top(self) -> None:
        n = int(self.take(kind="number"))
        self.take("by")
        self.df = self.df.orderBy(*self.order()).limit(n)

    def do_count(self) -> None:
        self.df = self.df.agg(F.count("*").alias("Count"))

    def do_distinct(self) -> None:
        if not self.maybe("*") and self.peek(kind="name"):
            self.df = self.df.select(*map(quoted, self.listed(lambda: self.take(kind="name"))))
        self.df = self.df.distinct()

    def do_join(self) -> None:
        how = "inner"
        if self.maybe("kind"):
            self.take("=")
            how = {"leftouter": "left", "rightouter": "right", "fullouter": "full", "leftsemi": "left_semi", "leftanti": "left_anti"}.get(kind := self.take().lower(), kind)
        left, right = self.df, self.branch()
        self.take("on")

        def pair() -> tuple[str, str]:
            if self.peek("$left"):
                self.take()
                self.take(".")
                a = self.take(kind="name")
                self.take("==")
                self.take("$right")
                self.take(".")
                return a, self.take(kind="name")
            name = self.take(kind="name")
            return name, name

        pairs = self.listed(pair)
        if all(a == b for a, b in pairs):
            self.df = left.join(right, [a for a, _ in pairs], how)
            return
        condition = None
        for a, b in pairs:
            one = left[a] == right[b]
            condition = one if condition is None else condition & one
        self.df = left.join(right, condition, how)

    # graph operators; the current rows are edges
    def graph_words(self) -> dict[str, object]:
        out: dict[str, object] = {}
        while self.at < len(self.tokens) and not self.peek("|") and not self.peek(")"):
            word = self.take(kind="name").lower()
            if word in ("source", "target") and self.maybe("("):
                out[word] = self.listed(self.value)
                self.take(")")
            elif word in ("source", "target", "edge-type"):
                out[word] = self.value()
            elif word in ("min-hops", "max-hops"):
                out[word] = int(self.take(kind="number"))
            else:
                out[word] = self.take(kind="name")
        return out

    def do_graph_traverse(self) -> None:
        w = self.graph_words()
        self.df = graph.traverse(self.df, as_list(w["source"]), w["from"], w["to"], w["max-hops"], w.get("direction", "forward"), w.get("edge-type"))

    def do_graph_var_length(self) -> None:
        w = self.graph_words()
        self.df = graph.var_length(self.df, as_list(w["source"]), w["from"], w["to"], w.get("min-hops", 1), w["max-hops"], w.get("direction", "forward"), w.get("edge-type"))

    def do_graph_shortest_path(self) -> None:
        w = self.graph_words()
        self.df = graph.shortest_path(self.df, w["source"], w["target"], w["from"], w["to"], w["max-hops"], w.get("direction", "forward"))

    def do_make_graph(self) -> None:
        """`make-graph src --> dst with Nodes on id`: the rows become the edges of a graph."""
        src = self.take(kind="name")
        self.take("-->")
        dst = self.take(kind="name")
        self.take("with")
        nodes = self.branch()
        self.take("on")
        self.graph = Graph(nodes, self.df, self.take(kind="name"), src, dst)

    def returned(self) -> list:
        """`project v.c [as x], ...`, by default named v_c."""
        self.take("project")

        def one() -> object:
            var = self.take(kind="name")
            self.take(".")
            column = self.take(kind="name")
            return F.col(quoted(f"{var}_{column}")).alias(self.take(kind="name") if self.maybe("as") else f"{var}_{column}")

        return self.listed(one)

    def bound_graph(self) -> Graph:
        if self.graph is None:
            raise KqlError("make-graph comes first")
        return self.graph

    def do_graph_match(self) -> None:
        """Chains, separated by commas, each possibly `optional`; a variable met twice is one node."""
        chains = ChainReader(self, self.bound_graph())
        self.listed(lambda: chains.chain(self.maybe("optional")))
        self.df = match_pattern(self.graph, chains.pattern).select(*self.returned())

    def do_graph_var_match(self) -> None:
        """(a)-[r:T]->(b) min-hops M max-hops N [direction d] project ...: pairs by their shortest distance."""
        chains = ChainReader(self, self.bound_graph())
        chains.chain()
        hop, words = chains.pattern.hops[0], {"min-hops": 1, "max-hops": None, "direction": hop_direction(chains.pattern)}
        while not self.peek("project"):
            word = self.take(kind="name").lower()
            if word not in words:
                raise KqlError(f"unexpected {word!r}")
            words[word] = self.take() if word == "direction" else int(self.take(kind="number"))
        if words["max-hops"] is None:
            raise KqlError("max-hops is missing")
        far = Hop(hop.a, hop.b, hop.var, hop.kind, words["direction"], words["min-hops"], words["max-hops"])
        self.df = match_pattern(self.graph, Pattern([far], chains.pattern.nodes)).select(*self.returned())

    # further operators
    def do_mv_expand(self) -> None:
        """One row per element of an array column; rows with an empty or null array go."""
        name = self.take(kind="name")
        self.df = self.df.withColumn(name, F.explode(quoted(name)))

    def do_project_rename(self) -> None:
        def one() -> tuple[str, str]:
            new = self.take(kind="name")
            self.take("=")
            return new, self.take(kind="name")

        for new, old in self.listed(one):
            self.df = self.df.withColumnRenamed(old, new)


def hop_direction(pattern: Pattern) -> str:
    return pattern.hops[0].direction


def as_list(x: object) -> list:
    return x if isinstance(x, list) else [x]


def kql(text: str, table: Callable[[str], DataFrame]) -> DataFrame:
    """The DataFrame of a query; `table` maps a name to its DataFrame."""
    compiler = Compiler(text, table)
    out = compiler.query()
    if compiler.at < len(compiler.tokens):
        raise KqlError(f"unexpected {compiler.tokens[compiler.at][1]!r}")
    return out
