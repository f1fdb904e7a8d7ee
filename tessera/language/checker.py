"""Names, types, nullability and parameters of a query, and its Spark SQL.

The checker walks a syntax tree once.  Every expression gets a shape, whether it
may be null, and the Spark SQL text that computes it; every query gets its
columns and its text.  What is wrong is collected, and the walk goes on.
"""

from __future__ import annotations

import functools
import itertools
import re
from dataclasses import dataclass, field, replace

from ..functions.library import AGGREGATES, FUNCTIONS, OFFSETS, RANKINGS, Refused, common, date_part
from . import nodes as n
from .diagnostics import Diagnostic, Span
from .dialects import POSTGRESQL, Dialect
from .lexer import tokenize
from .parser import parse
from .schema import Schema, Table
from .types import BOOL, DECIMAL, ERROR, FLOATS, INT32, INT64, INTS, STRING, UNKNOWN, Kind, Shape, unify

DATE, TIME, DATETIME, OFFSET, INTERVAL = (Shape(k) for k in (Kind.DATE, Kind.TIME, Kind.DATETIME, Kind.DATETIMEOFFSET, Kind.INTERVAL))


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass
class Expr:
    shape: Shape
    nullable: bool
    sql: str
    parameter: str | None = None
    null: bool = False
    literal: str | None = None


@dataclass
class ResultColumn:
    name: str
    shape: Shape
    nullable: bool

    @property
    def type(self) -> str:
        return self.shape.result_name(self.nullable)


@dataclass
class ParameterInfo:
    name: str
    shape: Shape
    database_type: str | None = None

    @property
    def type(self) -> str:
        return self.shape.result_name(False)


@dataclass
class Source:
    """Something in FROM: its name in the query and its columns."""

    alias: str
    quoted: bool
    columns: list[ResultColumn]
    table: Table | None = None
    nulled: bool = False
    hidden: set = field(default_factory=set)  # columns that USING has merged

    def find(self, name: n.Name, dialect: Dialect) -> ResultColumn | None:
        return next((c for c in self.columns if dialect.same_name(name.text, name.quoted, c.name)), None)

    def nullable(self, c: ResultColumn) -> bool:
        return c.nullable or self.nulled


@dataclass
class Frame:
    """The tables that a query's expressions see."""

    sources: list[Source] = field(default_factory=list)
    merged: list[ResultColumn] = field(default_factory=list)
    windows: dict = field(default_factory=dict)
    layered: bool = False
    layers: dict[str, str] = field(default_factory=dict)
    shifts: list[tuple[list[str], str, str, str]] = field(default_factory=list)


@dataclass
class Change:
    """What a data change does, in Spark SQL pieces."""

    kind: str
    table: Table
    alias: str = ""
    columns: list[str] = field(default_factory=list)
    query: str | None = None
    assignments: dict[str, str] = field(default_factory=dict)
    sources: str = ""
    where: str | None = None
    conflict: list[str] | None = None
    conflict_set: dict[str, str] | None = None
    conflict_where: str | None = None
    returning: list[tuple[str, str]] = field(default_factory=list)
    ctes: list[str] = field(default_factory=list)
    tables: list[Table] = field(default_factory=list)


@dataclass
class Analysis:
    columns: list[ResultColumn]
    parameters: list[ParameterInfo]
    diagnostics: list[Diagnostic]
    sql: str | None = None
    change: Change | None = None
    staged: list[tuple[str, Change]] = field(default_factory=list)  # data-changing CTEs, in order
    recursive: list = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.diagnostics


@dataclass
class Bound:
    columns: list[ResultColumn]
    sql: str


_MARK = re.compile("\x00(\\w+)\x00")


_CLOCK = re.compile(r"\s*(?:([+-]?\d+)\s*(?:d|days?)\b)?\s*([+-]?)(\d+):(\d\d)(?::(\d\d(?:\.\d{1,6})?))?\s*\Z", re.I)


def clock_interval(text: str) -> str | None:
    """Spark's literal of an interval of days and a time of day, as in '1 day 02:03:04'; None for other forms."""
    m = _CLOCK.match(text)
    if not m:
        return None
    clock = (int(m[3]) * 3600 + int(m[4]) * 60) * 1_000_000 + round(float(m[5] or 0) * 1_000_000)
    total = int(m[1] or 0) * 86_400_000_000 + (-clock if m[2] == "-" else clock)
    seconds, micros = divmod(abs(total), 1_000_000)
    days, seconds = divmod(seconds, 86_400)
    return f"INTERVAL '{'-' if total < 0 else ''}{days} {seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}.{micros:06d}' DAY TO SECOND"


class Checker:
    def __init__(self, schema: Schema, dialect: Dialect):
        self.schema, self.dialect = schema, dialect
        self.found: list[Diagnostic] = []
        self.frames: list[Frame] = []
        self.ctes: list[dict[str, Bound]] = [{}]
        self.parameters: dict[str, ParameterInfo] = {}
        self.uses: dict[str, Span] = {}
        self.conflicts: set[str] = set()
        self.aggregates_ok: list[str | None] = []  # why aggregates may not stand here
        self.staged: list[tuple[str, Change]] = []
        self.fixpoints: list = []
        self.bare = ""

    # diagnostics and parameters

    def bad(self, code: str, message: str, span: Span) -> Expr:
        d = Diagnostic(code, message, span)
        if d not in self.found:
            self.found.append(d)
        return Expr(ERROR, True, "NULL")

    def typed(self, e: Expr, shape: Shape) -> Expr:
        """``e`` with the type that its place asks for, if it is a parameter or NULL without one."""
        if e.parameter and shape.known:
            info = self.parameters[e.parameter]
            if not info.shape.known:
                info.shape = shape
            elif unify(info.shape, shape) is None and e.parameter not in self.conflicts:
                self.conflicts.add(e.parameter)
                self.bad("SQL210", f"The parameter {info.name} is used with different types.", self.uses[e.parameter])
            e.shape = info.shape
        elif e.null and not e.shape.known and shape.known:
            return replace(e, shape=shape)
        return e

    def unified(self, items: list[Expr], span: Span, what: str) -> Shape:
        out = UNKNOWN
        for e in items:
            both = unify(out, e.shape)
            if both is None:
                if any(x.parameter for x in items):
                    for x in items:
                        self.typed(x, out)
                    if self.conflicts:
                        return ERROR
                self.bad("SQL207", f"The types of {what} do not fit together.", span)
                return ERROR
            out = both
        for e in items:
            self.typed(e, out)
        return out

    def condition(self, node: n.Node, forbidden: str | None = None) -> Expr:
        self.aggregates_ok.append(forbidden)
        e = self.typed(self.expr(node), BOOL)
        self.aggregates_ok.pop()
        if e.shape.known and e.shape != BOOL:
            self.bad("SQL208", "A condition is expected here.", node.span)
        return e

    # names

    def lookup(self, node: n.ColumnRef) -> Expr:
        *path, name = node.path
        if not path:
            for frame in reversed(self.frames):
                merged = next((c for c in frame.merged if self.dialect.same_name(name.text, name.quoted, c.name)), None)
                if merged is not None:
                    return Expr(merged.shape, merged.nullable, quote(merged.name))
                hits = [(s, c) for s in frame.sources if (c := s.find(name, self.dialect)) is not None]
                if len(hits) > 1:
                    return self.bad("SQL204", f"The column {name.text} is ambiguous.", node.span)
                if hits:
                    return self._column(*hits[0])
            return self.bad("SQL203", f"There is no column {name.text}.", node.span)
        source = self.source(path)
        if source is None:
            return self.bad("SQL202", f"There is no table or alias {path[-1].text} here.", path[-1].span)
        column = source.find(name, self.dialect)
        if column is None:
            return self.bad("SQL203", f"There is no column {name.text} in {source.alias}.", name.span)
        return self._column(source, column)

    def _column(self, source: Source, column: ResultColumn) -> Expr:
        if column.shape.kind is Kind.ERROR:
            return Expr(ERROR, True, "NULL")
        return Expr(column.shape, source.nullable(column), f"{quote(source.alias)}.{quote(column.name)}")

    def source(self, path: list[n.Name]) -> Source | None:
        name = path[-1]
        for frame in reversed(self.frames):
            for s in frame.sources:
                if self.dialect.same_name(name.text, name.quoted, s.alias) or s.quoted and name.text == s.alias:
                    if len(path) > 1 and not (s.table and (s.table.schema or "").lower() == path[-2].text.lower()):
                        continue
                    return s
        return None

    def table(self, item: n.TableItem) -> Table | None:
        *path, name = item.path
        hits = [t for t in self.schema.find(name.text, path[-1].text if path else None) if self.dialect.same_name(name.text, name.quoted, t.name)]
        if not path and self.dialect.default_schema and len(hits) > 1:
            hits = [t for t in hits if (t.schema or "").lower() in ("", self.dialect.default_schema)] or hits
        if len(hits) > 1:
            self.bad("SQL218", f"The table {name.text} is in several schemas.", item.span)
            return None
        if not hits:
            self.bad("SQL200", f"There is no table {name.text}.", name.span)
            return None
        return hits[0]

    def table_columns(self, table: Table, span: Span) -> list[ResultColumn]:
        out = []
        for c in table.columns:
            shape = self.dialect.type_of(c.type)
            if shape is None:
                self.bad("SQL205", f"The type {c.type} of {table.name}.{c.name} is not supported.", span)
                shape = ERROR
            out.append(ResultColumn(c.name, shape, c.nullable))
        return out

    # statements

    def statement(self, s: n.Statement, top: bool = False) -> tuple[Bound, Change | None]:
        self.ctes.append(dict(self.ctes[-1]))
        texts = []
        names: set[str] = set()
        recursive = False
        for cte in s.ctes:
            key = cte.name.text.lower()
            if key in names:
                self.bad("SQL201", f"The name {cte.name.text} is given twice.", cte.name.span)
            names.add(key)
            own = self.cte(cte, s.recursive)
            if own is not None:
                texts.append(own[0])
                recursive |= own[1]
        with_ = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(texts)} " if texts else ""
        change = None
        if isinstance(s.body, n.Query):
            bound = self.query(s.body)
            bound = Bound(bound.columns, with_ + bound.sql)
        else:
            change = {n.Insert: self.insert, n.Update: self.update, n.Delete: self.delete, n.Truncate: self.truncate}[type(s.body)](s.body)
            change.ctes = texts
            bound = Bound(self.returned, "")
        self.ctes.pop()
        return bound, change

    def cte(self, cte: n.Cte, recursive: bool) -> tuple[str, bool] | None:
        body = cte.query.body
        again = False
        if recursive and isinstance(body, n.Query) and body.rest:
            seed = self.term(body.first)
            columns = self.renamed(cte.columns, seed.columns, cte.name.span)
            self.ctes[-1][cte.name.text.lower()] = Bound(columns, "")
            again = True
            if any(op == "union" and not all_ for op, all_, _ in body.rest):
                self.fixpoints.append(cte)
        bound, change = self.statement(cte.query)
        columns = self.renamed(cte.columns, bound.columns, cte.name.span)
        if again and cte not in self.fixpoints:  # Spark wants the bare union here
            bound = Bound(bound.columns, self.bare)
        if again:
            columns = [replace(c, shape=r.shape, nullable=r.nullable) for c, r in zip(columns, self.ctes[-1][cte.name.text.lower()].columns)]
        self.ctes[-1][cte.name.text.lower()] = Bound(columns, "")
        names = ", ".join(quote(c.name) for c in columns)
        if change is not None:
            view = f"__staged_{len(self.staged)}"
            self.staged.append((view, change))
            return f"{quote(cte.name.text)}({names}) AS (SELECT * FROM {view})", False
        return f"{quote(cte.name.text)}({names}) AS ({bound.sql})", again

    def renamed(self, names: list[n.Name], columns: list[ResultColumn], span: Span) -> list[ResultColumn]:
        if not names:
            return [replace(c) for c in columns]
        if len(names) > len(columns):
            self.bad("SQL219", "There are more names than columns.", span)
        return [replace(c, name=names[i].text if i < len(names) else c.name) for i, c in enumerate(columns)]

    def query(self, q: n.Query) -> Bound:
        if not q.rest and isinstance(q.first, n.Select):
            return self.select(q.first, q)
        terms = [("", False, self.term(q.first))] + [(op, all_, self.term(t)) for op, all_, t in q.rest]
        columns = [replace(c) for c in terms[0][2].columns]
        casts = False
        for _, _, other in terms[1:]:
            if len(other.columns) != len(columns):
                self.bad("SQL221", "The terms of a set operation have different numbers of columns.", q.span)
                break
            for i, (a, b) in enumerate(zip(columns, other.columns)):
                shape = unify(a.shape, b.shape)
                if shape is None:
                    self.bad("SQL207", f"Column {i + 1} of the set operation has types that do not fit together.", q.span)
                    shape = ERROR
                columns[i] = ResultColumn(a.name, shape, a.nullable or b.nullable)
        # INTERSECT binds closer; Spark keeps that order of precedence
        sql = f"({terms[0][2].sql})" if len(terms) > 1 or q.order or q.limit else terms[0][2].sql
        for op, all_, t in terms[1:]:
            sql += f" {op.upper()} {'ALL ' if all_ else ''}({t.sql})"
        if len(terms) > 1 or isinstance(q.first, n.Values) or isinstance(q.first, n.Query):
            own = ", ".join(quote(c.name) for c in columns)
            self.bare = sql
            sql = f"SELECT * FROM ({sql}) AS `__set`({own})"
        frame = Frame([Source("__set", True, columns)])
        self.frames.append(frame)
        sql += self.ordering([self.order_item(o, columns) for o in q.order])
        self.frames.pop()
        return Bound(columns, sql + self.limits(q))

    def term(self, t) -> Bound:
        if isinstance(t, n.Select):
            return self.select(t, None)
        return self.query(t) if isinstance(t, n.Query) else self.values(t)

    def values(self, v: n.Values, targets: list[Shape] | None = None) -> Bound:
        width = len(v.rows[0])
        cells = [[self.cell(c, targets[i] if targets and i < len(targets) else None) for i, c in enumerate(row)] for row in v.rows]
        if any(len(row) != width for row in cells):
            self.bad("SQL219", "The rows of VALUES have different widths.", v.span)
        columns = []
        for i in range(width):
            own = [row[i] for row in cells if i < len(row)]
            shape = self.unified(own, v.span, f"column {i + 1} of VALUES")
            columns.append(ResultColumn(f"column{i + 1}", shape, any(e.nullable for e in own)))
        rows = ", ".join("(" + ", ".join(e.sql for e in row) + ")" for row in cells)
        return Bound(columns, f"SELECT * FROM VALUES {rows} AS `__v`({', '.join(quote(c.name) for c in columns)})")

    def cell(self, node: n.Node, target: Shape | None = None) -> Expr:
        if isinstance(node, n.Default):
            return self.bad("SQL219", "DEFAULT has no meaning here.", node.span)
        e = self.expr(node)
        return self.typed(e, target) if target else e

    def limits(self, q: n.Query) -> str:
        out = ""
        for node, word in ((q.limit, "LIMIT"), (q.offset, "OFFSET")):
            if node is not None:
                e = self.typed(self.expr(node), INT64)
                if e.shape.known and e.shape.kind not in INTS:
                    self.bad("SQL207", f"{word} takes an integer.", node.span)
                out += f" {word} {e.sql if not e.parameter else f'int({e.sql})'}"
        return out

    def ordering(self, items: list[str]) -> str:
        return f" ORDER BY {', '.join(items)}" if items else ""

    def direction(self, item: n.OrderItem) -> str:
        last = self.dialect.name in ("postgresql", "oracle")
        nulls = item.nulls or ("last" if last != item.descending else "first")
        return f"{'DESC' if item.descending else 'ASC'} NULLS {nulls.upper()}"

    def order_item(self, item: n.OrderItem, columns: list[ResultColumn] | None = None) -> str:
        """An ORDER BY item; a bare name that is an output column means that."""
        if columns is not None and isinstance(item.expr, n.ColumnRef) and len(item.expr.path) == 1:
            name = item.expr.path[0]
            own = [c for c in columns if self.dialect.same_name(name.text, name.quoted, c.name)]
            if own:
                return f"{quote(own[0].name)} {self.direction(item)}"
        return f"{self.expr(item.expr).sql} {self.direction(item)}"

    # SELECT

    def layer(self, sql: str) -> str:
        """A column of the query's rows that is computed below its select list, for windows over what a window gives."""
        layers = self.frames[-1].layers
        return layers.setdefault(sql, f"`__l{len(layers)}`")

    def with_layers(self, frame: Frame, tail: str) -> str:
        """FROM and WHERE with the layers' columns; each table is a struct of its alias there, so names mean what they meant.

        A shift joins the row that lies an offset further in its partition, found by its number.
        """
        if not frame.layers:
            return tail
        columns = [f"struct({quote(s.alias)}.*) AS {quote(s.alias)}" for s in frame.sources] + [quote(c.name) for c in frame.merged]
        rows = f"(SELECT {', '.join(columns + [f'{sql} AS {name}' for sql, name in frame.layers.items()])}{tail})"
        out = f" FROM {rows} AS `__rows`"
        for i, (keys, number, value, target) in enumerate(frame.shifts):
            own = [f"{k} AS `__k{i}_{j}`" for j, k in enumerate(keys)] + [f"{number} AS `__m{i}`", f"{value} AS `__v{i}`"]
            same = [f"{k} <=> `__k{i}_{j}`" for j, k in enumerate(keys)] + [f"`__m{i}` = {target}"]
            out += f" LEFT JOIN (SELECT {', '.join(own)} FROM {rows} AS `__rows`) AS `__s{i}` ON {' AND '.join(same)}"
        return out

    def select(self, s: n.Select, q: n.Query | None) -> Bound:
        frame = Frame()
        self.frames.append(frame)
        self.aggregates_ok.append(None)
        from_ = self.sources(s.sources)
        for name, spec in s.windows:
            if name.text.lower() in frame.windows:
                self.bad("SQL201", f"The window {name.text} is defined twice.", name.span)
            frame.windows[name.text.lower()] = spec
        where = self.condition(s.where, "WHERE").sql if s.where else None
        self.aggregates_ok.append("GROUP BY")
        groups = [self.expr(g) for g in s.group]
        self.aggregates_ok.pop()
        self._grouped.append(bool(s.group))
        frame.layered = bool(frame.sources) and not (s.group or s.having is not None or any(self.has_aggregate(i.expr) for i in s.items))
        items = self.items(s.items)
        having = self.condition(s.having).sql if s.having else None
        self._grouped.pop()
        grouped = bool(s.group) or s.having is not None or any(self.has_aggregate(i.expr) for i in s.items)
        if grouped:
            texts = {g.sql for g in groups}
            for node in [i.expr for i in s.items] + ([s.having] if s.having else []):
                self.check_grouped(node, texts)
        columns = [c for c, _ in items]
        orders = []
        if q is not None:
            for o in q.order:
                orders.append((self.order_item(o, columns), o))
                alias = isinstance(o.expr, n.ColumnRef) and len(o.expr.path) == 1 and any(self.dialect.same_name(o.expr.path[0].text, o.expr.path[0].quoted, c.name) for c in columns)
                if grouped and not alias:
                    self.check_grouped(o.expr, texts)
            for lock in q.locks:
                if self.source([lock]) is None:
                    self.bad("SQL202", f"There is no table or alias {lock.text} here.", lock.span)
        tail = self.with_layers(frame, from_ + (f" WHERE {where}" if where else ""))
        if s.group:
            tail += " GROUP BY " + ", ".join(g.sql for g in groups)
        if having:
            tail += f" HAVING {having}"
        listed = ", ".join(f"{sql} AS {quote(c.name)}" for c, sql in items)
        if s.distinct_on:
            keys = [self.expr(k).sql for k in s.distinct_on]
            by_name = {c.name: sql for c, sql in items}
            own = [re.sub(r"^`([^`]+)` (ASC|DESC)", lambda m: f"{by_name.get(m[1], quote(m[1]))} {m[2]}", text) for text, _ in orders]
            inner = [f"{sql} AS `__c{i}`" for i, (_, sql) in enumerate(items)] + [f"{text[: -len(self.direction(o)) - 1]} AS `__o{i}`" for i, (text, (_, o)) in enumerate(zip(own, orders))]
            rank = f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(own) or ', '.join(keys)}) AS `__n`"
            sql = f"SELECT {', '.join(f'`__c{i}` AS {quote(c.name)}' for i, c in enumerate(columns))} FROM (SELECT {', '.join([*inner, rank])}{tail}) AS `__d` WHERE `__n` = 1"
            sql += self.ordering([f"`__o{i}` {self.direction(o)}" for i, (_, o) in enumerate(orders)])
        else:
            sql = f"SELECT {'DISTINCT ' if s.distinct else ''}{listed}{tail}" + self.ordering([text for text, _ in orders])
        if q is not None:
            sql += self.limits(q)
        self.aggregates_ok.pop()
        self.frames.pop()
        return Bound(columns, sql)

    def items(self, items: list[n.SelectItem], only: Source | None = None) -> list[tuple[ResultColumn, str]]:
        out: list[tuple[ResultColumn, str]] = []
        for item in items:
            if isinstance(item.expr, n.Star):
                if item.alias:
                    self.bad("SQL213", "A wildcard takes no alias.", item.span)
                out += self.star(item.expr, only)
                continue
            e = self.expr(item.expr)
            if e.null and not e.shape.known:
                self.bad("SQL211", "The type of NULL is not known; cast it.", item.expr.span)
            out.append((ResultColumn(item.alias.text if item.alias else self.default_name(item.expr), e.shape, e.nullable), e.sql))
            if e.parameter:
                self.pending.append((out[-1][0], e.parameter))
        return out

    @functools.cached_property
    def pending(self) -> list:
        return []

    def star(self, star: n.Star, only: Source | None) -> list[tuple[ResultColumn, str]]:
        frame = self.frames[-1]
        if star.path:
            source = self.source(star.path)
            if source is None:
                self.bad("SQL202", f"There is no table or alias {star.path[-1].text} here.", star.span)
                return []
            return [(replace(c, nullable=source.nullable(c)), f"{quote(source.alias)}.{quote(c.name)}") for c in source.columns]
        if only is None and not frame.sources:
            self.bad("SQL213", "A wildcard needs a table.", star.span)
        sources = [only] if only else frame.sources
        out = [(replace(c), quote(c.name)) for c in frame.merged] if only is None else []
        for s in sources:
            out += [(replace(c, nullable=s.nullable(c)), f"{quote(s.alias)}.{quote(c.name)}") for c in s.columns if only is not None or c.name.lower() not in s.hidden]
        return out

    def default_name(self, node: n.Node) -> str:
        if isinstance(node, n.ColumnRef):
            return node.path[-1].text
        if isinstance(node, n.Call):
            return node.name
        return {n.Case: "case", n.Cast: "cast", n.Extract: "extract"}.get(type(node), "?column?")

    # FROM

    def sources(self, sources: list) -> str:
        parts = []
        for item, joins in sources:
            text = self.from_item(item, bool(parts))
            for j in joins:
                text = self.join(text, j)
            parts.append(text)
        if not parts:
            return ""
        out = parts[0]
        for text in parts[1:]:
            out += f" CROSS JOIN {text}" if text.startswith("LATERAL") else f", {text}" if " JOIN " not in out else f" CROSS JOIN {text}"
        return f" FROM {out}"

    def add(self, source: Source, span: Span) -> None:
        if any(source.alias.lower() == s.alias.lower() for s in self.frames[-1].sources):
            self.bad("SQL201", f"The name {source.alias} is given twice; use another alias.", span)
        self.frames[-1].sources.append(source)

    def from_item(self, item: n.FromItem, follows: bool = False) -> str:
        if isinstance(item, n.TableItem):
            name = item.path[-1]
            bound = self.ctes[-1].get(name.text.lower()) if len(item.path) == 1 else None
            table = None if bound else self.table(item)
            columns = [replace(c) for c in bound.columns] if bound else self.table_columns(table, item.span) if table else []
            alias = item.alias or name
            relation = quote(name.text) if bound else quote(table.view) if table else "`?`"
            if table is None and bound is None:  # already told; every column is unknown
                source = _Anything(alias.text, alias.quoted, [])
            else:
                source = Source(alias.text, alias.quoted, columns, table)
            if item.columns:
                source.columns = self.renamed(item.columns, columns, item.span)
            self.add(source, item.span)
            own = f"({', '.join(quote(c.name) for c in source.columns)})" if item.columns else ""
            return f"{relation} AS {quote(alias.text)}{own}"
        if isinstance(item, n.QueryItem):
            if item.lateral:
                bound, _ = self.statement(item.query)
            else:
                hidden, self.frames[-1] = self.frames[-1], Frame()
                bound, change = self.statement(item.query)
                self.frames[-1] = hidden
                if change is not None:
                    self.bad("SQL100", "A data change cannot stand in FROM.", item.span)
            columns = self.renamed(item.columns, bound.columns, item.span)
            self.add(Source(item.alias.text, item.alias.quoted, columns), item.span)
            names = ", ".join(quote(c.name) for c in columns)
            return f"{'LATERAL ' if item.lateral else ''}({bound.sql}) AS {quote(item.alias.text)}({names})"
        return self.function_item(item)

    def function_item(self, item: n.FunctionItem) -> str:
        alias = item.alias or n.Name(item.name, False, item.span)
        args = [self.expr(a) for a in item.args]
        if item.name == "unnest" and self.dialect.arrays:
            if not args:
                self.bad("SQL212", "unnest takes arrays.", item.span)
            for a, node in zip(args, item.args):
                if a.shape.known and not a.shape.array:
                    self.bad("SQL207", "unnest takes arrays.", node.span)
            default = [alias.text if len(args) == 1 else f"column{i + 1}" for i in range(len(args))]
            columns = self.renamed(item.columns, [ResultColumn(d, a.shape.element(), True) for d, a in zip(default, args)], item.span)
            body = f"explode({args[0].sql})" if len(args) == 1 else f"inline(arrays_zip({', '.join(a.sql for a in args)}))"
        elif item.name == "generate_subscripts" and self.dialect.arrays:
            if not 2 <= len(args) <= 3:
                self.bad("SQL212", "generate_subscripts takes an array, a dimension and a flag.", item.span)
            elif args[0].shape.known and not args[0].shape.array:
                self.bad("SQL207", "generate_subscripts takes an array.", item.args[0].span)
            columns = self.renamed(item.columns, [ResultColumn(alias.text, INT32, False)], item.span)
            a = args[0].sql if args else "array()"
            dimension = args[1].sql if len(args) > 1 else "1"
            series = f"if(size({a}) > 0 AND {dimension} = 1, sequence(1, size({a})), CAST(array() AS ARRAY<INT>))"
            body = f"explode({f'if({args[2].sql}, reverse({series}), {series})' if len(args) > 2 else series})"
        else:
            self.bad("SQL206", f"There is no table function {item.name}.", item.span)
            columns, body = [], "explode(array())"
        self.add(Source(alias.text, alias.quoted, columns), item.span)
        return f"LATERAL {body} AS {quote(alias.text)}({', '.join(quote(c.name) for c in columns)})"

    def join(self, left: str, j: n.Join) -> str:
        frame = self.frames[-1]
        before = list(frame.sources)
        text = self.from_item(j.item)
        right = frame.sources[-1]
        word = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN", "cross": "CROSS JOIN"}[j.kind]
        using = j.using
        if j.natural:
            seen = [c.name for s in before for c in s.columns if c.name.lower() not in s.hidden]
            using = [n.Name(c.name, True, j.span) for c in right.columns if c.name.lower() in {x.lower() for x in seen}]
        merged = []
        for name in using or []:
            r = right.find(name, self.dialect)
            m = next((c for c in frame.merged if c.name.lower() == name.text.lower()), None)
            lefts = [] if m else [(s, c) for s in before if (c := s.find(name, self.dialect)) is not None]
            if r is None or not m and not lefts:
                self.bad("SQL203", f"There is no column {name.text} on both sides.", name.span)
                continue
            if len(lefts) > 1:
                self.bad("SQL204", f"The column {name.text} is ambiguous on the left.", name.span)
            a_shape, a_null = (m.shape, m.nullable) if m else (lefts[0][1].shape, lefts[0][0].nullable(lefts[0][1]))
            shape = unify(a_shape, r.shape)
            if shape is None:
                self.bad("SQL207", f"The columns {name.text} have types that do not fit together.", name.span)
                shape = ERROR
            nullable = r.nullable if j.kind == "right" else a_null or r.nullable if j.kind == "full" else a_null
            column = ResultColumn(r.name, r.shape if j.kind == "right" else shape if j.kind == "full" else a_shape, nullable)
            if m:
                frame.merged[frame.merged.index(m)] = column
            else:
                merged.append(column)
                lefts[0][0].hidden.add(lefts[0][1].name.lower())
            right.hidden.add(r.name.lower())
        if j.kind in ("left", "full"):
            right.nulled = True
        if j.kind in ("right", "full"):
            for s in before:
                s.nulled = True
            if j.kind == "right" and not using:
                frame.merged = [replace(c, nullable=True) for c in frame.merged]
        frame.merged += merged
        if using:
            return f"{left} {word} {text} USING ({', '.join(quote(x.text) for x in using)})"
        if j.natural and not using:
            return f"{left} CROSS JOIN {text}"
        on = self.condition(j.on, "JOIN") if j.on is not None else None
        return f"{left} {word} {text}" + (f" ON {on.sql}" if on else "")

    # grouping

    def children(self, node) -> list:
        out = []
        for value in vars(node).values():
            for v in value if isinstance(value, list) else [value]:
                for w in v if isinstance(v, tuple) else [v]:
                    if isinstance(w, n.Node) and not isinstance(w, n.Statement):
                        out.append(w)
        return out

    def is_aggregate(self, node) -> bool:
        return isinstance(node, n.Call) and node.name in AGGREGATES and node.over is None

    def has_aggregate(self, node) -> bool:
        return self.is_aggregate(node) or any(self.has_aggregate(c) for c in self.children(node))

    def check_grouped(self, node, groups: set[str]) -> None:
        if self.is_aggregate(node) or isinstance(node, (n.Literal, n.Parameter)):
            return
        if isinstance(node, n.Star):
            for c, sql in self.star(node, None):
                if sql not in groups:
                    self.bad("SQL216", f"The column {c.name} is neither grouped nor aggregated.", node.span)
            return
        quiet, self.found = self.found, []
        text = self.expr(node).sql if not isinstance(node, (n.WindowSpec, n.OrderItem)) else None
        self.found = quiet
        if text in groups:
            return
        if isinstance(node, n.ColumnRef):
            frame = self.frames[-1]
            if any(text == f"{quote(s.alias)}.{quote(c.name)}" for s in frame.sources for c in s.columns) or any(text == quote(c.name) for c in frame.merged):
                self.bad("SQL216", f"The column {node.path[-1].text} is neither grouped nor aggregated.", node.span)
            return
        for c in self.children(node):
            self.check_grouped(c, groups)

    # expressions

    def expr(self, node: n.Node) -> Expr:
        return getattr(self, "_" + type(node).__name__.lower())(node)

    def _star(self, node) -> Expr:
        return self.bad("SQL213", "A wildcard cannot stand here.", node.span)

    def _default(self, node) -> Expr:
        return self.bad("SQL219", "DEFAULT has no meaning here.", node.span)

    def _columnref(self, node) -> Expr:
        return self.lookup(node)

    def _literal(self, node: n.Literal) -> Expr:
        v = node.value
        if node.kind == "null":
            return Expr(UNKNOWN, True, "NULL", null=True)
        if node.kind == "bool":
            return Expr(BOOL, False, "true" if v else "false")
        if node.kind == "string":
            return Expr(STRING, False, text_literal(v), literal=v)
        if node.kind == "decimal":
            return Expr(DECIMAL, False, f"{v}BD")
        if node.kind == "int":
            number = int(v)
            if number < 1 << 31:
                return Expr(INT32, False, str(number))
            return Expr(INT64, False, f"{number}L") if number < 1 << 63 else Expr(DECIMAL, False, f"{number}BD")
        shape, word = {"date": (DATE, "DATE"), "time": (TIME, "TIME"), "timestamp": (DATETIME, "TIMESTAMP_NTZ"), "timestamptz": (OFFSET, "TIMESTAMP"), "interval": (INTERVAL, "INTERVAL")}[node.kind]
        if node.kind == "interval" and (clock := clock_interval(v)):
            return Expr(shape, False, clock)
        return Expr(shape, False, f"{word} {text_literal(v)}")

    def _parameter(self, node: n.Parameter) -> Expr:
        key = node.name[1:].lower()
        if key not in self.parameters:
            self.parameters[key] = ParameterInfo(node.name, UNKNOWN)
            self.uses[key] = node.span
        self.uses[key] = node.span if not self.parameters[key].shape.known else self.uses[key]
        return Expr(self.parameters[key].shape, False, f"\x00{key}\x00", parameter=key)

    def _unary(self, node: n.Unary) -> Expr:
        if node.op == "not":
            e = self.condition(node.arg, self.aggregates_ok[-1] if self.aggregates_ok else None)
            return Expr(BOOL, e.nullable, f"(NOT {e.sql})")
        e = self.expr(node.arg)
        if e.shape.known and not e.shape.number and e.shape != INTERVAL:
            return self.bad("SQL207", "A sign needs a number.", node.span)
        return Expr(e.shape, e.nullable, f"({node.op}{e.sql})")

    def _binary(self, node: n.Binary) -> Expr:
        op = node.op
        if op in ("and", "or"):
            why = self.aggregates_ok[-1] if self.aggregates_ok else None
            a, b = self.condition(node.left, why), self.condition(node.right, why)
            return Expr(BOOL, a.nullable or b.nullable, f"({a.sql} {op.upper()} {b.sql})")
        a, b = self.expr(node.left), self.expr(node.right)
        null = a.nullable or b.nullable
        if op in ("=", "<>", "<", "<=", ">", ">="):
            self.unified([a, b], node.span, f"the sides of {op}")
            return Expr(BOOL, null, f"({a.sql} {op} {b.sql})")
        if op in ("like", "not like", "ilike", "not ilike", "~", "~*", "!~", "!~*"):
            for e, side in ((a, node.left), (b, node.right)):
                if self.typed(e, STRING).shape.known and not e.shape.text:
                    self.bad("SQL207", f"{op.upper()} compares texts.", side.span)
            if "like" in op:
                return Expr(BOOL, null, f"({a.sql} {op.upper()} {b.sql})")
            pattern = f"concat('(?i)', {b.sql})" if op.endswith("*") else b.sql
            return Expr(BOOL, null, f"({'NOT ' if op[0] == '!' else ''}({a.sql} RLIKE {pattern}))")
        if op in ("@>", "<@", "&&"):
            return self.containment(node, a, b, null)
        if op in ("->", "->>", "#>", "#>>"):
            return self.json(node, a, b)
        if op == "||":
            if a.shape.array or b.shape.array:
                shape = self.unified([a, b], node.span, "the sides of ||")
                return Expr(shape, null, f"concat({a.sql}, {b.sql})")
            a, b = self.typed(a, STRING), self.typed(b, STRING)
            for e, side in ((a, node.left), (b, node.right)):
                if e.shape.known and not e.shape.text:
                    return self.bad("SQL207", "|| joins texts or arrays.", side.span)
            return Expr(STRING, null, f"concat({a.sql}, {b.sql})")
        return self.arithmetic(node, a, b, null)

    def arithmetic(self, node: n.Binary, a: Expr, b: Expr, null: bool) -> Expr:
        op = node.op
        timed = self.temporal(op, a, b, null)
        if timed is not None:
            return timed
        shape = unify(a.shape, b.shape)
        if shape is None or shape.known and not shape.number:
            return self.bad("SQL207", f"The types of the sides of {op} do not fit together.", node.span)
        self.typed(a, shape), self.typed(b, shape)
        if op == "^":
            shape = shape if shape.kind in FLOATS else DECIMAL
            sql = f"power({a.sql}, {b.sql})"
            return Expr(shape, null, f"CAST({sql} AS {'DOUBLE' if shape.kind in FLOATS else 'DECIMAL(38,10)'})")
        if op == "/" and shape.kind in INTS:
            return Expr(shape, null, f"CAST(({a.sql} DIV {b.sql}) AS {shape.spark()})")
        return Expr(shape, null, f"({a.sql} {op} {b.sql})")

    def temporal(self, op: str, a: Expr, b: Expr, null: bool) -> Expr | None:
        """Date, time and interval arithmetic; None if it is none."""
        kinds = (a.shape.kind, b.shape.kind)
        moments = (Kind.DATE, Kind.TIME, Kind.DATETIME, Kind.DATETIMEOFFSET, Kind.INTERVAL)
        if a.shape.array or b.shape.array or not any(k in moments for k in kinds):
            return None
        if op == "+" and b.shape.kind in moments[:4] and a.shape.kind not in moments[:4]:
            a, b, kinds = b, a, kinds[::-1]
        ka, kb = kinds
        if op in "+-" and ka is Kind.DATE and kb in INTS:
            return Expr(DATE, null, f"date_{'add' if op == '+' else 'sub'}({a.sql}, CAST({b.sql} AS INT))")
        if op == "-" and ka is kb is Kind.DATE:
            return Expr(INT32, null, f"datediff({a.sql}, {b.sql})")
        if op in "+-" and kb is Kind.INTERVAL and ka in moments:
            if ka is Kind.DATE:
                return Expr(DATETIME, null, f"(CAST({a.sql} AS TIMESTAMP_NTZ) {op} {b.sql})")
            return Expr(a.shape, null, f"({a.sql} {op} {b.sql})")
        if op == "-" and ka is kb and ka in (Kind.TIME, Kind.DATETIME, Kind.DATETIMEOFFSET):
            return Expr(INTERVAL, null, f"({a.sql} - {b.sql})")
        if op == "*" and kb is Kind.INTERVAL and a.shape.number or op in "*/" and ka is Kind.INTERVAL and b.shape.number:
            return Expr(INTERVAL, null, f"({a.sql} {op} {b.sql})")
        return None

    def containment(self, node: n.Binary, a: Expr, b: Expr, null: bool) -> Expr:
        op = node.op
        if op == "<@":
            a, b = b, a
        if op != "&&" and {a.shape.kind, b.shape.kind} <= {Kind.JSONB, Kind.UNKNOWN} and not a.shape.array:
            self.typed(a, Shape(Kind.JSONB)), self.typed(b, Shape(Kind.JSONB))
            return Expr(BOOL, null, f"tessera_json_contains({a.sql}, {b.sql})")
        shape = self.unified([a, b], node.span, f"the sides of {op}")
        if shape.known and not shape.array:
            return self.bad("SQL207", f"{op} compares arrays.", node.span)
        if op == "&&":
            return Expr(BOOL, null, f"if({a.sql} IS NULL OR {b.sql} IS NULL, NULL, coalesce(arrays_overlap({a.sql}, {b.sql}), false))")
        # a NULL element is contained in nothing
        return Expr(BOOL, null, f"if({a.sql} IS NULL OR {b.sql} IS NULL, NULL, forall({b.sql}, __x -> __x IS NOT NULL AND coalesce(array_contains({a.sql}, __x), false)))")

    def json(self, node: n.Binary, a: Expr, b: Expr) -> Expr:
        if a.shape.known and (a.shape.array or a.shape.kind not in (Kind.JSON, Kind.JSONB)):
            return self.bad("SQL207", f"{node.op} takes JSON.", node.left.span)
        if node.op in ("->", "->>"):
            if b.parameter:
                self.typed(b, STRING)
            if b.shape.known and not (b.shape.text or b.shape.kind in INTS):
                return self.bad("SQL207", f"{node.op} takes a name or a place.", node.right.span)
            if b.literal is not None:
                path = text_literal("$." + b.literal if re.fullmatch(r"\w+", b.literal) else f"$['{b.literal}']")
            elif b.shape.kind in INTS:
                path = f"concat('$[', {b.sql}, ']')"
            else:
                path = f"concat('$.', {b.sql})"
        else:
            if b.shape.known and not (b.shape.text or b.shape == Shape(Kind.STRING, True)):
                return self.bad("SQL207", f"{node.op} takes a path.", node.right.span)
            if b.literal is not None:
                steps = [x.strip().strip('"') for x in b.literal.strip("{}").split(",") if x.strip()]
                # a number is a place in a list or a name in an object: one of the paths fits the document
                forms = [(f"[{x}]", f"['{x}']") if x.isdigit() else (f"['{x}']",) for x in steps]
                paths = [text_literal("$" + "".join(f)) for f in itertools.islice(itertools.product(*forms), 64)]
            else:
                spelled = lambda place: f"concat('$', array_join(transform({b.sql}, __s -> {place}), ''))"
                name = "concat('[\\'', __s, '\\']')"
                paths = [spelled(f"if(__s RLIKE '^[0-9]+$', concat('[', __s, ']'), {name})"), spelled(name)]
            return self.at_paths(node, a, paths, b.literal is not None)
        return self.at_paths(node, a, [path], path.startswith("'"))

    def at_paths(self, node: n.Binary, a: Expr, paths: list[str], literal: bool) -> Expr:
        """What stands at the first of ``paths`` that leads somewhere."""
        text = [f"get_json_object({a.sql}, {p})" for p in paths]
        first = lambda found: found[0] if len(found) == 1 else f"coalesce({', '.join(found)})"
        if node.op.endswith(">>"):
            return Expr(STRING, True, first(text))
        shape = a.shape if a.shape.known else Shape(Kind.JSON)
        if literal:
            return Expr(shape, True, first([f"to_json(variant_get(parse_json({a.sql}), {p}))" for p in paths]))
        return Expr(shape, True, first(text))

    def _is(self, node: n.Is) -> Expr:
        no = "NOT " if node.negated else ""
        if node.what == "null":
            return Expr(BOOL, False, f"({self.expr(node.arg).sql} IS {no}NULL)")
        if node.what == "distinct":
            a, b = self.expr(node.arg), self.expr(node.other)
            self.unified([a, b], node.span, "the sides of IS DISTINCT FROM")
            return Expr(BOOL, False, f"({a.sql} IS {no}DISTINCT FROM {b.sql})")
        e = self.condition(node.arg, self.aggregates_ok[-1] if self.aggregates_ok else None)
        return Expr(BOOL, False, f"({e.sql} IS {no}{node.what.upper()})")

    def _in(self, node: n.In) -> Expr:
        a, no = self.expr(node.arg), "NOT " if node.negated else ""
        if node.query is not None:
            bound = self.subquery(node.query, node.span)
            if len(bound.columns) != 1:
                return self.bad("SQL222", "The subquery of IN needs one column.", node.span)
            c = bound.columns[0]
            self.unified([a, Expr(c.shape, c.nullable, "")], node.span, "IN")
            return Expr(BOOL, a.nullable or c.nullable, f"({a.sql} {no}IN ({bound.sql}))")
        values = [self.expr(v) for v in node.values]
        self.unified([a, *values], node.span, "IN")
        return Expr(BOOL, any(e.nullable for e in (a, *values)), f"({a.sql} {no}IN ({', '.join(v.sql for v in values)}))")

    def _between(self, node: n.Between) -> Expr:
        parts = [self.expr(x) for x in (node.arg, node.low, node.high)]
        self.unified(parts, node.span, "BETWEEN")
        a, low, high = (p.sql for p in parts)
        return Expr(BOOL, any(p.nullable for p in parts), f"({a} {'NOT ' if node.negated else ''}BETWEEN {low} AND {high})")

    def _quantified(self, node: n.Quantified) -> Expr:
        a, b = self.expr(node.arg), self.expr(node.array)
        if not self.dialect.arrays:
            return self.bad("SQL100", "ANY and ALL over arrays are not part of this dialect.", node.span)
        if b.parameter and a.shape.known:
            b = self.typed(b, Shape(a.shape.kind, True))
        if b.shape.known and not b.shape.array:
            return self.bad("SQL207", f"{node.which.upper()} takes an array.", node.array.span)
        self.unified([a, Expr(b.shape.element(), True, "")], node.span, f"the sides of {node.op}")
        how = "exists" if node.which == "any" else "forall"
        return Expr(BOOL, True, f"{how}({b.sql}, __e -> {a.sql} {node.op} __e)")

    def _case(self, node: n.Case) -> Expr:
        subject = self.expr(node.subject) if node.subject else None
        why = self.aggregates_ok[-1] if self.aggregates_ok else None
        whens = []
        for condition, _ in node.branches:
            if subject is None:
                whens.append(self.condition(condition, why))
            else:
                e = self.expr(condition)
                self.unified([subject, e], condition.span, "CASE")
                whens.append(e)
        results = [self.expr(r) for _, r in node.branches] + ([self.expr(node.default)] if node.default else [])
        shape = self.unified(results, node.span, "the results of CASE")
        text = "CASE" + (f" {subject.sql}" if subject else "") + "".join(f" WHEN {w.sql} THEN {r.sql}" for w, r in zip(whens, results))
        return Expr(shape, node.default is None or any(r.nullable for r in results), f"({text}{f' ELSE {results[-1].sql}' if node.default else ''} END)")

    def _cast(self, node: n.Cast) -> Expr:
        e = self.expr(node.arg)
        shape = self.dialect.type_of(node.type_name)
        if shape is None:
            return self.bad("SQL205", f"The type {node.type_name} is not supported.", node.type_span)
        if e.parameter:
            e = self.typed(e, shape)
            self.parameters[e.parameter].database_type = self.parameters[e.parameter].database_type or node.type_name
        target = shape.spark()
        numbers = re.search(r"\((\d+)(?:,(\d+))?\)", node.type_name)
        if shape.kind is Kind.DECIMAL and numbers and not shape.array:
            target = f"decimal({numbers[1]},{numbers[2] or 0})"
        if shape.kind in INTS and not shape.array and e.shape.kind in (*FLOATS, Kind.DECIMAL):
            return Expr(shape, e.nullable, f"CAST({'bround' if e.shape.kind in FLOATS else 'round'}({e.sql}) AS {target})")
        if shape == INTERVAL and e.literal is not None:
            return Expr(shape, e.nullable, f"INTERVAL {e.sql}")
        return Expr(shape, e.nullable, f"CAST({e.sql} AS {target})")

    def _arrayliteral(self, node: n.ArrayLiteral) -> Expr:
        items = [self.expr(i) for i in node.items]
        if not self.dialect.arrays:
            return self.bad("SQL100", "Arrays are not part of this dialect.", node.span)
        if any(i.shape.array for i in items):
            return self.bad("SQL207", "Arrays of arrays are not supported.", node.span)
        shape = self.unified(items, node.span, "the elements of the array")
        return Expr(Shape(shape.kind, True), False, f"array({', '.join(i.sql for i in items)})")

    def _subscript(self, node: n.Subscript) -> Expr:
        a, i = self.expr(node.arg), self.typed(self.expr(node.index), INT32)
        if a.shape.known and not a.shape.array:
            return self.bad("SQL207", "Only arrays have elements.", node.arg.span)
        if i.shape.known and i.shape.kind not in INTS:
            return self.bad("SQL207", "The place of an element is an integer.", node.index.span)
        return Expr(a.shape.element(), True, f"get({a.sql}, CAST({i.sql} AS INT) - 1)")

    def _extract(self, node: n.Extract) -> Expr:
        try:
            return Expr(*date_part(node.part, self.expr(node.arg)))
        except Refused as r:
            return self.bad(r.code, str(r), node.span)

    def subquery(self, s: n.Statement, span: Span) -> Bound:
        bound, change = self.statement(s)
        if change is not None:
            self.bad("SQL100", "A data change cannot be a subquery.", span)
        return bound

    def _exists(self, node: n.Exists) -> Expr:
        return Expr(BOOL, False, f"EXISTS ({self.subquery(node.query, node.span).sql})")

    def _scalar(self, node: n.Scalar) -> Expr:
        bound = self.subquery(node.query, node.span)
        if len(bound.columns) != 1:
            return self.bad("SQL222", "A scalar subquery needs one column.", node.span)
        return Expr(bound.columns[0].shape, True, f"({bound.sql})")

    # functions

    def _call(self, node: n.Call) -> Expr:
        name = node.name
        if name in AGGREGATES:
            return self.aggregate(node)
        if name in RANKINGS or name in OFFSETS:
            return self.window_function(node)
        if node.star:
            return self.bad("SQL213", f"{name} takes no wildcard.", node.span)
        function = FUNCTIONS.get(name)
        if function is None:
            for a in node.args:
                self.expr(a)
            return self.bad("SQL206", f"There is no function {name}.", node.span)
        args = [self.expr(a) for a in node.args]
        if len(args) < function.least or function.most is not None and len(args) > function.most:
            return self.bad("SQL212", f"{name} takes another number of arguments.", node.span)
        try:
            if name in ("coalesce", "greatest", "least", "nullif"):
                shape = common(args)
            elif name in ("abs", "round", "ceil", "ceiling", "floor", "power", "date_trunc", "date_part", "to_char"):
                shape = UNKNOWN
            else:
                shape = STRING
            for k, a in enumerate(args):
                self.typed(a, INT32 if name in ("substring", "substr", "repeat") and k else shape)
            return Expr(*function.rule(name, args))
        except Refused as r:
            return self.bad(r.code, str(r), node.span)

    def aggregate(self, node: n.Call) -> Expr:
        name = node.name
        why = self.aggregates_ok[-1] if self.aggregates_ok else None
        if node.over is None:
            if why == "aggregate":
                return self.bad("SQL215", "Aggregates cannot be nested.", node.span)
            if why:
                return self.bad("SQL214", f"An aggregate cannot stand in {why}.", node.span)
        self.aggregates_ok.append("aggregate" if node.over is None else why)
        args = [self.expr(a) for a in node.args]
        condition = self.condition(node.condition, "aggregate") if node.condition else None
        self.aggregates_ok.pop()
        if node.star and name != "count":
            return self.bad("SQL213", f"{name} takes no wildcard.", node.span)
        if len(args) != (0 if node.star else 1):
            return self.bad("SQL212", f"{name} takes one argument.", node.span)
        window = self.window(node.over, node.span) if node.over is not None else None
        if name == "count":
            sql = self.aggregated("count", "*" if node.star else args[0].sql, node, condition, window, None)
            kind = self.dialect.aggregate_kind("count", Kind.INT64)
            return Expr(Shape(kind), False, f"CAST({sql} AS INT)" if kind is Kind.INT32 else sql)
        e = args[0]
        if name in ("min", "max"):
            shape = e.shape
            sql = self.aggregated(name, e.sql, node, condition, window, shape)
        else:
            if e.shape.known and not e.shape.number:
                return self.bad("SQL207", f"{name} takes a number.", node.span)
            shape = Shape(self.dialect.aggregate_kind(name, e.shape.kind if e.shape.known else Kind.DECIMAL))
            arg = e.sql
            if shape.kind is Kind.DECIMAL and e.shape.kind in INTS:
                arg = f"CAST({e.sql} AS DECIMAL({'38,0' if name == 'sum' else '20,0'}))"
            sql = self.aggregated(name, arg, node, condition, window, shape)
            if shape.kind is not Kind.DECIMAL:
                sql = f"CAST({sql} AS {shape.spark()})"
        group = node.over is None and self.grouped_now
        return Expr(shape, e.nullable if group and condition is None else True, sql)

    @property
    def grouped_now(self) -> bool:
        return self._grouped[-1] if self._grouped else False

    @functools.cached_property
    def _grouped(self) -> list[bool]:
        return []

    def aggregated(self, name: str, arg: str, node: n.Call, condition: Expr | None, window: str | None, shape: Shape | None) -> str:
        distinct = node.distinct and name not in ("min", "max")
        if window is None:
            text = f"{name}({'DISTINCT ' if distinct else ''}{arg})"
            return text + (f" FILTER (WHERE {condition.sql})" if condition else "")
        if condition:  # no FILTER in windows: other rows give null
            arg = f"CASE WHEN {condition.sql} THEN {'1' if arg == '*' else arg} END"
        if not distinct:
            return f"{name}({arg}) OVER {window}"
        partition, order, bounds = self.window_parts(node.over, node.span, ())
        if self.frames[-1].layered and bounds is None:  # the first row of each value counts
            first = self.layer(f"row_number() OVER (PARTITION BY {', '.join([*partition, arg])} ORDER BY {', '.join(order) or 'NULL'})")
            return f"{name}(CASE WHEN {first} = 1 THEN {arg} END) OVER {window}"
        found = f"collect_set({arg}) OVER {window}"
        if name == "count":
            return f"CAST(size({found}) AS BIGINT)"
        total = f"aggregate({found}, CAST(0 AS {shape.spark()}), (__a, __x) -> CAST(__a + __x AS {shape.spark()}))"
        return total if name == "sum" else f"({total} / nullif(size({found}), 0))"

    def window_function(self, node: n.Call) -> Expr:
        name = node.name
        if node.over is None:
            return self.bad("SQL212", f"{name} needs OVER.", node.span)
        if node.star:
            return self.bad("SQL213", f"{name} takes no wildcard.", node.span)
        args = [self.expr(a) for a in node.args]
        least, most = (0, 0) if name in RANKINGS else (1, 3) if name in ("lag", "lead") else (1, 1)
        if not least <= len(args) <= most:
            return self.bad("SQL212", f"{name} takes another number of arguments.", node.span)
        # Spark has ranks and offsets over their own frame only
        window = self.window(node.over, node.span, frame=name in ("first_value", "last_value"))
        if name in RANKINGS:
            return Expr(INT64, False, f"CAST({name}() OVER {window} AS BIGINT)")
        if len(args) > 2:
            self.unified([args[0], args[2]], node.span, name)
        if len(args) > 1 and self.typed(args[1], INT32).shape.known and args[1].shape.kind not in INTS:
            self.bad("SQL207", "The offset is an integer.", node.args[1].span)
        if name in ("lag", "lead") and len(args) > 1 and "`" in args[1].sql:
            return Expr(args[0].shape, True, self.shifted(node, args))
        return Expr(args[0].shape, True if name in ("lag", "lead") else args[0].nullable, f"{name}({', '.join(a.sql for a in args)}) OVER {window}")

    def shifted(self, node: n.Call, args: list[Expr]) -> str:
        """LAG or LEAD by an offset of the row's own, which Spark's windows do not take."""
        frame = self.frames[-1]
        if not frame.layered:
            self.bad("SQL100", f"{node.name} by an offset that is no constant stands beside aggregates.", node.span)
            return "NULL"
        partition, order, _ = self.window_parts(node.over, node.span, ())
        number = self.layer(f"row_number() OVER ({f'PARTITION BY {', '.join(partition)} ' if partition else ''}ORDER BY {', '.join(order) or 'NULL'})")
        offset = f"({args[1].sql})"
        shift = (partition, number, args[0].sql, f"{number} {'-' if node.name == 'lag' else '+'} {offset}")
        if shift not in frame.shifts:
            frame.shifts.append(shift)
        i = frame.shifts.index(shift)
        if len(args) < 3:
            return f"`__v{i}`"
        return f"CASE WHEN {offset} IS NULL THEN NULL WHEN `__m{i}` IS NOT NULL THEN `__v{i}` ELSE {args[2].sql} END"

    def window(self, over, span: Span, frame: bool = True, seen: tuple = ()) -> str:
        partition, order, bounds = self.window_parts(over, span, seen)
        if bounds and bounds.lower().startswith("groups") and frame:
            if order and self.frames[-1].layered:  # peers are rows of one rank
                over = f"{f'PARTITION BY {', '.join(partition)} ' if partition else ''}ORDER BY {', '.join(order)}"
                order, bounds = [self.layer(f"dense_rank() OVER ({over})")], "RANGE" + bounds[len("groups") :]
            else:
                self.bad("SQL100", "GROUPS frames need an order and stand beside no aggregates.", span)
        parts = ([f"PARTITION BY {', '.join(partition)}"] if partition else []) + ([f"ORDER BY {', '.join(order)}"] if order else [])
        return f"({' '.join(parts + ([bounds] if bounds and frame else []))})"

    def window_parts(self, over, span: Span, seen: tuple) -> tuple[list[str], list[str], str | None]:
        if isinstance(over, n.Name):
            over = n.WindowSpec(over.span, over, [], [], None)
        partition, order, bounds = [], [], None
        if over.base is not None:
            key = over.base.text.lower()
            base = next((f.windows[key] for f in reversed(self.frames) if key in f.windows), None)
            if base is None or key in seen:
                self.bad("SQL200", f"There is no window {over.base.text}.", over.base.span)
            else:
                partition, order, bounds = self.window_parts(base, span, (*seen, key))
        partition += [self.expr(p).sql for p in over.partition]
        order += [self.order_item(o) for o in over.order]
        return partition, order, over.frame or bounds

    # changes

    @functools.cached_property
    def returned(self) -> list[ResultColumn]:
        return []

    def target(self, item: n.TableItem) -> tuple[Table | None, Source]:
        table = self.table(item)
        alias = item.alias or item.path[-1]
        source = Source(alias.text, alias.quoted, self.table_columns(table, item.span), table) if table else _Anything(alias.text, alias.quoted, [])
        return table, source

    def returning(self, items: list[n.SelectItem], target: Source) -> list[tuple[str, str]]:
        found = self.items(items, only=target)
        self.__dict__["returned"] = [c for c, _ in found]
        return [(c.name, sql) for c, sql in found]

    def assigned(self, assignments: list[n.Assignment], source: Source) -> dict[str, str]:
        out: dict[str, str] = {}
        for a in assignments:
            c = source.find(a.column, self.dialect)
            if c is None:
                self.bad("SQL203", f"There is no column {a.column.text}.", a.column.span)
                continue
            if c.name in out:
                self.bad("SQL219", f"The column {c.name} is assigned twice.", a.column.span)
            out[c.name] = self.assigned_value(c, a.value, source)
        return out

    def assigned_value(self, c: ResultColumn, node: n.Node, source: Source) -> str:
        if isinstance(node, n.Default):
            column = source.table.column(c.name) if source.table else None
            return self.default_sql(column, c.shape)
        e = self.typed(self.expr(node), c.shape)
        self.check_assignable(e, c, node.span)
        return f"CAST({e.sql} AS {c.shape.spark()})"

    def check_assignable(self, e: Expr, c: ResultColumn, span: Span) -> None:
        if e.shape.known and c.shape.known:
            number = e.shape.number and c.shape.number
            text = c.shape.kind in (Kind.JSON, Kind.JSONB, Kind.GUID) and e.shape.text and e.literal is not None
            if not number and not text and unify(e.shape, c.shape) is None:
                self.bad("SQL207", f"The value does not fit the column {c.name}.", span)

    def default_sql(self, column, shape: Shape) -> str:
        if column is None or column.default is None:
            return f"CAST(NULL AS {shape.spark()})"
        tokens, _ = tokenize(column.default, self.dialect)
        try:
            from .parser import Parser

            return f"CAST({self.expr(Parser(tokens).expression()).sql} AS {shape.spark()})"
        except Exception:  # an opaque default
            return f"CAST(NULL AS {shape.spark()})"

    def insert(self, node: n.Insert) -> Change:
        table, source = self.target(node.table)
        change = Change("insert", table, source.alias)
        names = [c for c in (source.find(x, self.dialect) for x in node.columns) if c is not None]
        for x in node.columns:
            if source.find(x, self.dialect) is None and not isinstance(source, _Anything):
                self.bad("SQL203", f"There is no column {x.text}.", x.span)
        lowered = [x.text.lower() for x in node.columns]
        for x in node.columns:
            if lowered.count(x.text.lower()) > 1:
                self.bad("SQL219", f"The column {x.text} is listed twice.", x.span)
                break
        targets = names if node.columns else list(source.columns)
        change.columns = [c.name for c in targets]
        self.frames.append(Frame())
        if node.rows is not None:
            rows = []
            for row in node.rows:
                if len(row) != len(targets) and not (not node.columns and len(row) < len(targets)) and not isinstance(source, _Anything):
                    self.bad("SQL219", "The row has another number of values than there are columns.", node.span)
                rows.append([self.assigned_value(c, v, source) for c, v in zip(targets, row)])
            width = len(rows[0]) if rows else 0
            change.columns = change.columns[:width]
            change.query = " UNION ALL ".join("SELECT " + ", ".join(f"{v} AS {quote(c)}" for v, c in zip(row, change.columns)) for row in rows)
        elif node.query is not None:
            bound, inner = self.statement(node.query)
            if inner is None:
                if len(bound.columns) > len(targets) or node.columns and len(bound.columns) != len(targets):
                    self.bad("SQL219", "The query has another number of columns than the table takes.", node.span)
                for b, c in zip(bound.columns, targets):
                    self.check_assignable(Expr(b.shape, b.nullable, ""), c, node.span)
                change.columns = change.columns[: len(bound.columns)]
                casts = ", ".join(f"CAST({quote(f'__i{i}')} AS {c.shape.spark()}) AS {quote(c.name)}" for i, c in enumerate(targets[: len(bound.columns)]))
                inner_names = ", ".join(quote(f"__i{i}") for i in range(len(bound.columns)))
                change.query = f"SELECT {casts} FROM ({bound.sql}) AS `__q`({inner_names})"
        else:
            change.columns = []
        self.frames.pop()
        if node.conflict:
            self.conflict(node.conflict, source, change)
        self.frames.append(Frame([source]))
        change.returning = self.returning(node.returning, source)
        self.frames.pop()
        return change

    def conflict(self, c: n.Conflict, source: Source, change: Change) -> None:
        for x in c.columns:
            if source.find(x, self.dialect) is None:
                self.bad("SQL203", f"There is no column {x.text}.", x.span)
        change.conflict = [x.text for x in c.columns] or list(change.table.key if change.table else ())
        if c.assignments is not None:
            excluded = Source("excluded", False, [replace(x) for x in source.columns], source.table)
            self.frames.append(Frame([source, excluded]))
            # a bare name means the table's own column
            change.conflict_set = self.assigned(c.assignments, source)
            change.conflict_where = self.condition(c.update_where, "ON CONFLICT").sql if c.update_where else None
            self.frames.pop()

    def update(self, node: n.Update) -> Change:
        table, source = self.target(node.table)
        change = Change("update", table, source.alias)
        self.frames.append(Frame([source]))
        self.aggregates_ok.append("UPDATE")
        change.sources = self.sources(node.sources)
        change.assignments = self.assigned(node.assignments, source)
        change.where = self.condition(node.where, "UPDATE").sql if node.where else None
        change.returning = self.returning(node.returning, source)
        self.aggregates_ok.pop()
        self.frames.pop()
        return change

    def delete(self, node: n.Delete) -> Change:
        table, source = self.target(node.table)
        change = Change("delete", table, source.alias)
        self.frames.append(Frame([source]))
        self.aggregates_ok.append("DELETE")
        change.sources = self.sources(node.sources)
        change.where = self.condition(node.where, "DELETE").sql if node.where else None
        change.returning = self.returning(node.returning, source)
        self.aggregates_ok.pop()
        self.frames.pop()
        return change

    def truncate(self, node: n.Truncate) -> Change:
        tables = [t for t in (self.table(x) for x in node.tables) if t is not None]
        self.__dict__["returned"] = []
        return Change("truncate", tables[0] if tables else None, tables=tables)


class _Anything(Source):
    """A table that is not known: its columns are taken as they come."""

    def find(self, name: n.Name, dialect: Dialect) -> ResultColumn | None:
        return ResultColumn(name.text, ERROR, True)


def _resolved(sql: str | None, parameters: dict[str, ParameterInfo]) -> str | None:
    """Marks of parameters as typed parameter markers."""
    return None if sql is None else _MARK.sub(lambda m: f"CAST(:{m[1]} AS {parameters[m[1]].shape.spark()})", sql)


def _resolve_change(change: Change, parameters) -> None:
    fix = lambda s: _resolved(s, parameters)
    for name in ("query", "sources", "where", "conflict_where"):
        setattr(change, name, fix(getattr(change, name)))
    change.assignments = {k: fix(v) for k, v in change.assignments.items()}
    if change.conflict_set is not None:
        change.conflict_set = {k: fix(v) for k, v in change.conflict_set.items()}
    change.returning = [(k, fix(v)) for k, v in change.returning]
    change.ctes = [fix(x) for x in change.ctes]


def analyze(schema: Schema | None, sql: str | None, dialect: Dialect = POSTGRESQL) -> Analysis:
    """Check ``sql``; columns and parameters are given as far as they are known."""
    if schema is None or sql is None:
        return Analysis([], [], [Diagnostic("SQL000", "A schema and a query are needed.")])
    return _analyze(schema, sql, dialect)


def _analyze(schema: Schema, sql: str, dialect: Dialect) -> Analysis:
    try:
        tokens, found = tokenize(sql, dialect)
        if found:
            return Analysis([], [], found)
        tree, found = parse(tokens)
        if tree is None:
            return Analysis([], [], found)
        checker = Checker(schema, dialect)
        bound, change = checker.statement(tree, top=True)
        for column, key in checker.pending:
            column.shape = checker.parameters[key].shape
        for key, info in checker.parameters.items():
            if not info.shape.known and info.shape.kind is not Kind.ERROR and key not in checker.conflicts:
                checker.bad("SQL209", f"The type of the parameter {info.name} cannot be told.", checker.uses[key])
        for c in bound.columns:
            if c.shape.kind is Kind.UNKNOWN and not checker.found:
                checker.bad("SQL211", f"The type of the column {c.name} is not known; cast it.", tree.span)
        if change is not None:
            _resolve_change(change, checker.parameters)
        for _, staged in checker.staged:
            _resolve_change(staged, checker.parameters)
        text = _resolved(bound.sql, checker.parameters) if change is None else None
        return Analysis(bound.columns, list(checker.parameters.values()), checker.found, text, change, checker.staged, [c.name.text for c in checker.fixpoints])
    except RecursionError:
        return Analysis([], [], [Diagnostic("SQL100", "The query is nested too deeply.", Span(0, len(sql)))])
    except Exception as e:  # never escapes as an exception
        return Analysis([], [], [Diagnostic("SQL999", f"Internal error: {type(e).__name__}: {e}", Span(0, len(sql)))])
