"""Syntax trees.  Every node has the span of its text."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from .diagnostics import Span


@dataclass
class Node:
    span: Span


@dataclass
class Name:
    """A name as written, and whether it stood in quotes."""

    text: str
    quoted: bool
    span: Span


# expressions


@dataclass
class Literal(Node):
    kind: str  # int, decimal, string, bool, null, or a type's name for DATE '...' and its like
    value: Any


@dataclass
class Parameter(Node):
    name: str


@dataclass
class ColumnRef(Node):
    path: list[Name]


@dataclass
class Star(Node):
    path: list[Name]


@dataclass
class Unary(Node):
    op: str
    arg: Node


@dataclass
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass
class Is(Node):
    """IS [NOT] NULL / TRUE / FALSE / UNKNOWN / DISTINCT FROM other."""

    arg: Node
    what: str
    negated: bool
    other: Node | None = None


@dataclass
class In(Node):
    arg: Node
    values: list[Node] | None
    query: "Statement | None"
    negated: bool


@dataclass
class Between(Node):
    arg: Node
    low: Node
    high: Node
    negated: bool


@dataclass
class Quantified(Node):
    op: str
    which: str  # any, all
    arg: Node
    array: Node


@dataclass
class Case(Node):
    subject: Node | None
    branches: list[tuple[Node, Node]]
    default: Node | None


@dataclass
class Cast(Node):
    arg: Node
    type_name: str
    type_span: Span


@dataclass
class ArrayLiteral(Node):
    items: list[Node]


@dataclass
class Subscript(Node):
    arg: Node
    index: Node


@dataclass
class Extract(Node):
    part: str
    arg: Node


@dataclass
class Exists(Node):
    query: "Statement"


@dataclass
class Scalar(Node):
    query: "Statement"


@dataclass
class Default(Node):
    pass


@dataclass
class WindowSpec(Node):
    base: Name | None
    partition: list[Node]
    order: list["OrderItem"]
    frame: str | None


@dataclass
class Call(Node):
    name: str
    args: list[Node]
    distinct: bool = False
    star: bool = False
    condition: Node | None = None
    over: "WindowSpec | Name | None" = None


# queries


@dataclass
class OrderItem(Node):
    expr: Node
    descending: bool
    nulls: str | None


@dataclass
class SelectItem(Node):
    expr: Node
    alias: Name | None


@dataclass
class FromItem(Node):
    alias: Name | None
    columns: list[Name]


@dataclass
class TableItem(FromItem):
    path: list[Name] = field(default_factory=list)


@dataclass
class QueryItem(FromItem):
    query: "Statement | None" = None
    lateral: bool = False


@dataclass
class FunctionItem(FromItem):
    name: str = ""
    args: list[Node] = field(default_factory=list)


@dataclass
class Join(Node):
    kind: str  # inner, left, right, full, cross
    item: FromItem
    on: Node | None = None
    using: list[Name] | None = None
    natural: bool = False


@dataclass
class Select(Node):
    items: list[SelectItem]
    distinct: bool = False
    distinct_on: list[Node] = field(default_factory=list)
    sources: list[tuple[FromItem, list[Join]]] = field(default_factory=list)
    where: Node | None = None
    group: list[Node] = field(default_factory=list)
    having: Node | None = None
    windows: list[tuple[Name, WindowSpec]] = field(default_factory=list)


@dataclass
class Values(Node):
    rows: list[list[Node]]


@dataclass
class Query(Node):
    """Terms joined by set operations, left to right, then order and limits."""

    first: "Select | Values | Query"
    rest: list[tuple[str, bool, "Select | Values | Query"]]  # operation, all, term
    order: list[OrderItem] = field(default_factory=list)
    limit: Node | None = None
    offset: Node | None = None
    locks: list[Name] = field(default_factory=list)


@dataclass
class Cte(Node):
    name: Name
    columns: list[Name]
    query: "Statement"


@dataclass
class Assignment(Node):
    column: Name
    value: Node


@dataclass
class Conflict(Node):
    columns: list[Name]
    where: Node | None
    constraint: Name | None
    assignments: list[Assignment] | None  # None: do nothing
    update_where: Node | None


@dataclass
class Insert(Node):
    table: TableItem
    columns: list[Name]
    rows: list[list[Node]] | None  # None and no query: DEFAULT VALUES
    query: "Statement | None"
    conflict: Conflict | None
    returning: list[SelectItem]


@dataclass
class Update(Node):
    table: TableItem
    assignments: list[Assignment]
    sources: list[tuple[FromItem, list[Join]]]
    where: Node | None
    returning: list[SelectItem]


@dataclass
class Delete(Node):
    table: TableItem
    sources: list[tuple[FromItem, list[Join]]]
    where: Node | None
    returning: list[SelectItem]


@dataclass
class Truncate(Node):
    tables: list[TableItem]


@dataclass
class Statement(Node):
    ctes: list[Cte]
    recursive: bool
    body: "Query | Insert | Update | Delete | Truncate"
