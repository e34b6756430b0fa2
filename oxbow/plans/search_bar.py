"""The search-bar grammar compiled to filters, and the search of many sources at once.

`word`, `"some words"`, `field:value`, `-field:value`, `field:>N` (also >= < <=), `field:*`; all must hold.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oxbow.plans.reader import QueryError

PIECE = re.compile(r'\s*(-?)(?:([\w.@]+):)?(?:"([^"]*)"|(\S+))')
SIGNS = (">=", "<=", ">", "<")


class SearchError(QueryError):
    pass


@dataclass(frozen=True)
class Clause:
    """`op` is has (a substring), =, !=, >, >=, <, <= or exists."""

    op: str
    field: str | None
    value: str


def parse(text: str) -> list[Clause]:
    found, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = PIECE.match(text, at)
        if text[at:].strip() == "-":
            raise SearchError("a minus needs a field")
        if not m or (m[4] or "").startswith('"'):
            raise SearchError("a quote is not closed")
        at = m.end()
        minus, field, phrase, word = m.groups()
        value = phrase if word is None else word
        if field is None:
            if minus:
                raise SearchError("only fields can be negated")
            found.append(Clause("has", None, value))
        elif word == "*" and not minus:
            found.append(Clause("exists", field, ""))
        elif minus:
            found.append(Clause("!=", field, value))
        elif word and (sign := next((s for s in SIGNS if word.startswith(s)), None)):
            found.append(Clause(sign, field, word[len(sign) :]))
        else:
            found.append(Clause("=", field, value))
    return found


def compiled(clauses: list[Clause], schema: T.StructType) -> tuple[Column, list[Clause]]:
    """The condition, and the clauses that this schema cannot answer: an unknown field, or an order on no number."""
    condition, dropped = F.lit(True), []
    fields = {f.name: f.dataType for f in schema}
    texts = [n for n, t in fields.items() if isinstance(t, T.StringType)]
    for c in clauses:
        column = F.col(f"`{c.field}`") if c.field in fields else None
        if c.op == "has":
            one = F.lit(False)
            for n in texts:
                one = one | F.coalesce(F.contains(F.lower(f"`{n}`"), F.lit(c.value.lower())), F.lit(False))
        elif column is None:
            dropped.append(c)
            continue
        elif c.op == "exists":
            one = column.isNotNull()
        elif c.op in ("=", "!="):
            same = column.cast("string") == c.value
            if isinstance(fields[c.field], T.NumericType) and number(c.value) is not None:
                same = column == F.lit(number(c.value))
            one = same if c.op == "=" else ~F.coalesce(same, F.lit(False))
        elif not isinstance(fields[c.field], T.NumericType) or number(c.value) is None:
            dropped.append(c)
            continue
        else:
            n = F.lit(number(c.value))
            one = {">": column > n, ">=": column >= n, "<": column < n, "<=": column <= n}[c.op]
        condition = condition & one
    return condition, dropped


def number(text: str) -> int | float | None:
    try:
        return int(text)
    except ValueError:
        try:
            return float(text)
        except ValueError:
            return None


def search(df: DataFrame, text: str, n: int = 500) -> tuple[DataFrame, list[Clause]]:
    """A page of `n` matching rows without vector columns, and the clauses dropped."""
    condition, dropped = compiled(parse(text), df.schema)
    shown = [f"`{f.name}`" for f in df.schema if not (isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.FloatType, T.DoubleType)))]
    return df.where(condition).select(*shown).limit(n), dropped


def fan_out(sources: dict[str, DataFrame], text: str, n: int = 500, seconds: float = 30.0, threads: int = 4) -> Iterator[tuple[str, str | None, object]]:
    """Frames (kind, source, content): plan, then rows and source_done or error of each source, then done.

    Each source gives a page of at most `n` rows; a failing or late one does not stop the others.
    """
    parse(text)
    yield "plan", None, sorted(sources)
    until = time.monotonic() + seconds
    pool = ThreadPoolExecutor(threads)

    groups = {name: f"oxbow-{uuid.uuid4().hex}" for name in sources}

    def rows(name: str, df: DataFrame) -> tuple[list, list[Clause]]:
        df.sparkSession.sparkContext.setJobGroup(groups[name], "one source of a search", True)
        found, dropped = search(df, text, n)
        return found.collect(), dropped

    waiting = {name: pool.submit(rows, name, df) for name, df in sources.items()}
    for name, future in waiting.items():
        try:
            found, dropped = future.result(max(0.0, until - time.monotonic()))
            yield "rows", name, found
            yield "source_done", name, {"rows": len(found), "dropped": dropped}
        except Late:
            if not future.cancel():
                sources[name].sparkSession.sparkContext.cancelJobGroup(groups[name])
            yield "error", name, "deadline"
        except Exception as error:  # isolated: reported as a frame
            yield "error", name, str(error)
    pool.shutdown(wait=False, cancel_futures=True)
    yield "done", None, None
