"""Tokens of the query language, for every dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .diagnostics import Diagnostic, Span
from .dialects import Dialect

#: Words that are never read as a bare alias or column name.
RESERVED = frozenset(
    """
    all and any as asc between by case cast cross current_date current_timestamp default delete desc distinct
    do else end except exists false fetch filter for from full group having in inner insert intersect into is
    join lateral left like limit natural not null offset on or order outer over partition recursive returning
    right select set some table then true truncate union unknown update using values when where window with
    """.split()
)

_OPERATORS = ("->>", "#>>", "!~*", "::", "<>", "!=", "<=", ">=", "||", "->", "#>", "@>", "<@", "&&", "~*", "!~", "(", ")", "[", "]", ",", ";", ".", "+", "-", "*", "/", "%", "^", "=", "<", ">", "~")
_WORD = re.compile(r"[^\W\d]\w*\$?\w*")
_NUMBER = re.compile(r"\d+(?:\.\d+)?")
_SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class Token:
    """``kind``: word, name (quoted), string, number, parameter, operator, end."""

    kind: str
    text: str
    start: int
    length: int

    @property
    def span(self) -> Span:
        return Span(self.start, self.length)

    def word(self) -> str | None:
        return self.text.lower() if self.kind == "word" else None


def _quoted(sql: str, at: int, close: str) -> tuple[str, int] | None:
    """The content up to ``close``, doubled closers undone, and the place behind it."""
    out: list[str] = []
    i = at
    while i < len(sql):
        if sql[i] == close:
            if sql[i + 1 : i + 2] != close:
                return "".join(out), i + 1
            i += 1
        out.append(sql[i])
        i += 1
    return None


def _comment_end(sql: str, at: int) -> int | None:
    depth, i = 0, at
    while i < len(sql):
        pair = sql[i : i + 2]
        if pair == "/*":
            depth, i = depth + 1, i + 2
        elif pair == "*/":
            depth, i = depth - 1, i + 2
            if not depth:
                return i
        else:
            i += 1
    return None


def tokenize(sql: str, dialect: Dialect) -> tuple[list[Token], list[Diagnostic]]:
    """All tokens, an end token last, and what could not be read (SQL001)."""
    tokens: list[Token] = []
    found: list[Diagnostic] = []

    def bad(start: int, end: int, message: str) -> None:
        found.append(Diagnostic("SQL001", message, Span(start, min(end, len(sql)) - start)))

    i = 0
    while i < len(sql):
        c = sql[i]
        if m := _SPACE.match(sql, i):
            i = m.end()
            continue
        if sql.startswith("--", i):
            end = sql.find("\n", i)
            i = len(sql) if end < 0 else end
            continue
        if sql.startswith("/*", i):
            end_ = _comment_end(sql, i)
            if end_ is None:
                bad(i, i + 2, "The comment is not closed.")
                break
            i = end_
            continue
        if c == "'":
            got = _quoted(sql, i + 1, "'")
            if got is None:
                bad(i, len(sql), "The string is not closed.")
                break
            tokens.append(Token("string", got[0], i, got[1] - i))
            i = got[1]
            continue
        subscript = c == "[" and tokens and i == tokens[-1].start + tokens[-1].length and not dialect.brackets_quote
        if c in dialect.quotes and not subscript:
            got = _quoted(sql, i + 1, dialect.quotes[c])
            if got is None or not got[0]:
                bad(i, len(sql) if got is None else got[1], "The quoted name is empty or not closed.")
                if got is None:
                    break
                i = got[1]
                continue
            tokens.append(Token("name", got[0], i, got[1] - i))
            i = got[1]
            continue
        if c in dialect.parameter_prefixes and (m := (re.compile(r"\w+") if dialect.numeric_parameters else _WORD).match(sql, i + 1)) and not sql.startswith("::", i):
            tokens.append(Token("parameter", c + m[0], i, m.end() - i))
            i = m.end()
            continue
        if m := _NUMBER.match(sql, i):
            if _WORD.match(sql, m.end()) or sql.startswith(".", m.end()) and not sql.startswith("..", m.end()):
                bad(i, m.end() + 1, "The number is malformed.")
                i = m.end() + 1
                continue
            tokens.append(Token("number", m[0], i, m.end() - i))
            i = m.end()
            continue
        if m := _WORD.match(sql, i):
            tokens.append(Token("word", m[0], i, m.end() - i))
            i = m.end()
            continue
        op = next((o for o in _OPERATORS if sql.startswith(o, i)), None)
        if op is None:
            bad(i, i + 1, f"The character {c!r} has no meaning here.")
            i += 1
            continue
        tokens.append(Token("operator", op, i, len(op)))
        i += len(op)
    tokens.append(Token("end", "", len(sql), 0))
    return tokens, found
