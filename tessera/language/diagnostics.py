"""What the checker has to say about a query, with the place in its text.

Codes: SQL000 missing input, SQL001 lexical, SQL100 syntax, SQL200 unknown table
or window, SQL201 duplicate name, SQL202 unknown alias, SQL203 unknown column,
SQL204 ambiguous column, SQL205 unsupported type, SQL206 unknown function,
SQL207 incompatible types, SQL208 no condition, SQL209 parameter of unknown type,
SQL210 conflicting parameter, SQL211 bare NULL column, SQL212 wrong arguments,
SQL213 misplaced wildcard, SQL214 misplaced aggregate, SQL215 nested aggregate,
SQL216 column not grouped, SQL218 ambiguous table, SQL219 widths and duplicates,
SQL221 set operation widths, SQL222 subquery columns, SQL999 internal.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Span:
    """[start, start + length) of the query text."""

    start: int
    length: int

    def to(self, other: "Span") -> "Span":
        start = min(self.start, other.start)
        return Span(start, max(self.start + self.length, other.start + other.length) - start)


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    span: Span = Span(0, 0)

    def __str__(self) -> str:
        return f"{self.code} at {self.span.start}: {self.message}"


class QueryError(ValueError):
    """A query that the checker has rejected."""

    def __init__(self, diagnostics: list[Diagnostic]):
        super().__init__("; ".join(map(str, diagnostics)))
        self.diagnostics = list(diagnostics)
