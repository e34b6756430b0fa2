"""A reader over tokens (kind, text), shared by the query languages."""

from __future__ import annotations

from collections.abc import Callable


class QueryError(ValueError):
    pass


class Reader:
    Error: type[QueryError] = QueryError

    def __init__(self, tokens: list[tuple[str, str]]) -> None:
        self.tokens, self.at = tokens, 0

    def peek(self, value: str | None = None, kind: str | None = None, ahead: int = 0) -> bool:
        if self.at + ahead >= len(self.tokens):
            return False
        k, v = self.tokens[self.at + ahead]
        return (kind is None or k == kind) and (value is None or (k != "string" and v.lower() == value))

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        if not self.peek(value, kind):
            found = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
            raise self.Error(f"expected {value or kind}, found {found!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def maybe(self, value: str) -> bool:
        if self.peek(value):
            self.at += 1
            return True
        return False

    def listed(self, read: Callable[[], object]) -> list:
        out = [read()]
        while self.maybe(","):
            out.append(read())
        return out

    def value(self) -> object:
        """A number or string."""
        sign = -1 if self.maybe("-") else 1
        if self.at >= len(self.tokens):
            raise self.Error("a value is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return sign * (float(value) if "." in value else int(value))
        return value


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}D" if isinstance(value, float) else str(value)
