"""The engine: checked queries, tables with composable predicates, named queries."""

from __future__ import annotations

import datetime
import decimal
import functools
import re
import uuid as uuid_
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language.checker import Analysis, analyze, quote
from .language.diagnostics import Diagnostic, QueryError
from .language.dialects import POSTGRESQL, Dialect
from .language.schema import Schema, Table, table_of
from .language.types import Kind
from .mapping import mapper
from .operators.changes import Changer, Outcome
from .sources.catalog import SnapshotStore, jdbc_table, parquet_schema

#: Python types that a parameter of a kind takes.
PYTHON_TYPES = {
    Kind.BOOL: (bool,),
    Kind.INT16: (int,),
    Kind.INT32: (int,),
    Kind.INT64: (int,),
    Kind.FLOAT: (float, int),
    Kind.DOUBLE: (float, int),
    Kind.DECIMAL: (decimal.Decimal, int),
    Kind.STRING: (str,),
    Kind.JSON: (str,),
    Kind.JSONB: (str,),
    Kind.GUID: (uuid_.UUID, str),
    Kind.DATE: (datetime.date,),
    Kind.TIME: (datetime.time,),
    Kind.DATETIME: (datetime.datetime,),
    Kind.DATETIMEOFFSET: (datetime.datetime,),
    Kind.INTERVAL: (datetime.timedelta,),
    Kind.BYTES: (bytes, bytearray),
}


@functools.lru_cache(maxsize=4096)
def _cached(schema: Schema, dialect_name: str, sql: str) -> Analysis:
    from .language.dialects import DIALECTS

    return analyze(schema, sql, DIALECTS[dialect_name])


def _json_contains(whole: pd.Series, part: pd.Series) -> pd.Series:
    """jsonb @> jsonb over Arrow batches; each different right side is parsed once a batch."""
    import json

    def within(a, b) -> bool:
        if isinstance(b, dict):
            return isinstance(a, dict) and all(k in a and within(a[k], v) for k, v in b.items())
        if isinstance(b, list):
            return isinstance(a, list) and all(any(within(x, y) for x in a) for y in b)
        if isinstance(a, list):
            return any(within(x, b) and not isinstance(x, (list, dict)) for x in a)
        return type(a) is type(b) and a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b

    parsed = {x: json.loads(x) for x in part.dropna().unique()}
    return pd.Series([None if a is None or b is None else within(json.loads(a), parsed[b]) for a, b in zip(whole, part)], dtype=object)


# predicates


class Predicate:
    """A condition on a table's columns; ``&`` and ``|`` combine, each in parentheses."""

    def __init__(self, column: SparkColumn, render: Callable[[list], str]):
        self.column, self._render = column, render

    def sql(self, start: int = 0) -> tuple[str, list]:
        """The condition's text with numbered parameters, and their values."""
        values: list = []
        text = self._render(values)
        for i in range(len(values)):
            text = text.replace(f"\x00{i}\x00", f"@where_{start + i}")
        return text, values

    def and_(self, other: "Predicate") -> "Predicate":
        return Predicate(self.column & other.column, lambda v: f"({self._render(v)} AND {other._render(v)})")

    def or_(self, other: "Predicate") -> "Predicate":
        return Predicate(self.column | other.column, lambda v: f"({self._render(v)} OR {other._render(v)})")

    __and__, __or__ = and_, or_

    def and_if(self, flag: bool, other: "Predicate | Callable[[], Predicate]") -> "Predicate":
        """AND ``other`` if ``flag``; a factory is not called otherwise."""
        return self.and_(other() if callable(other) else other) if flag else self

    def or_if(self, flag: bool, other: "Predicate | Callable[[], Predicate]") -> "Predicate":
        return self.or_(other() if callable(other) else other) if flag else self

    @staticmethod
    def all(predicates: Iterable["Predicate"]) -> "Predicate":
        return functools.reduce(Predicate.and_, _some(predicates))

    @staticmethod
    def any(predicates: Iterable["Predicate"]) -> "Predicate":
        return functools.reduce(Predicate.or_, _some(predicates))


def _some(items) -> list:
    out = list(items)
    if not out or any(x is None for x in out):
        raise ValueError("one value at least and no None is needed")
    return out


def _value(v):
    if v is None:
        raise ValueError("None has no place here")
    return v


@dataclass(frozen=True, eq=False)
class ColumnRef:
    name: str

    @property
    def _c(self) -> SparkColumn:
        return F.col(quote(self.name))

    @property
    def sql(self) -> str:
        return '"' + self.name.replace('"', '""') + '"'

    def _made(self, column: SparkColumn, template: str, *values) -> Predicate:
        def render(all_: list) -> str:
            marks = []
            for v in values:
                marks.append(f"\x00{len(all_)}\x00")
                all_.append(v)
            return template.format(self.sql, *marks)

        return Predicate(column, render)

    def equal(self, v) -> Predicate:
        """Equal; None means IS NULL."""
        return self.is_null() if v is None else self._made(self._c == F.lit(v), "{0} = {1}", v)

    def not_equal(self, v) -> Predicate:
        return self.is_not_null() if v is None else self._made(self._c != F.lit(v), "{0} <> {1}", v)

    def less_than(self, v) -> Predicate:
        return self._made(self._c < F.lit(_value(v)), "{0} < {1}", v)

    def less_than_or_equal(self, v) -> Predicate:
        return self._made(self._c <= F.lit(_value(v)), "{0} <= {1}", v)

    def greater_than(self, v) -> Predicate:
        return self._made(self._c > F.lit(_value(v)), "{0} > {1}", v)

    def greater_than_or_equal(self, v) -> Predicate:
        return self._made(self._c >= F.lit(_value(v)), "{0} >= {1}", v)

    __lt__, __le__, __gt__, __ge__ = less_than, less_than_or_equal, greater_than, greater_than_or_equal
    __eq__, __ne__ = equal, not_equal  # type: ignore[assignment]
    __hash__ = object.__hash__

    def is_null(self) -> Predicate:
        return self._made(self._c.isNull(), "{0} IS NULL")

    def is_not_null(self) -> Predicate:
        return self._made(self._c.isNotNull(), "{0} IS NOT NULL")

    def like(self, pattern: str) -> Predicate:
        return self._made(self._c.like(_value(pattern)), "{0} LIKE {1}", pattern)

    def not_like(self, pattern: str) -> Predicate:
        return self._made(~self._c.like(_value(pattern)), "{0} NOT LIKE {1}", pattern)

    def in_(self, *values) -> Predicate:
        own = _some(values[0] if len(values) == 1 and isinstance(values[0], (list, tuple, set, frozenset)) else values)
        return self._made(self._c.isin(own), "{0} IN (" + ", ".join(f"{{{i + 1}}}" for i in range(len(own))) + ")", *own)

    def not_in(self, *values) -> Predicate:
        own = _some(values[0] if len(values) == 1 and isinstance(values[0], (list, tuple, set, frozenset)) else values)
        return self._made(~self._c.isin(own), "{0} NOT IN (" + ", ".join(f"{{{i + 1}}}" for i in range(len(own))) + ")", *own)

    def between(self, low, high) -> Predicate:
        return self._made(self._c.between(_value(low), _value(high)), "{0} BETWEEN {1} AND {2}", low, high)

    def not_between(self, low, high) -> Predicate:
        return self._made(~self._c.between(_value(low), _value(high)), "{0} NOT BETWEEN {1} AND {2}", low, high)


# rows and queries


class RawRow:
    """A row by place and by name; a name that several columns have is refused."""

    def __init__(self, names: tuple[str, ...], values: tuple):
        self.names, self.values = names, values

    def __getitem__(self, key):
        if isinstance(key, int):
            return self.values[key]
        found = self.get_values(key)
        if not found:
            raise KeyError(key)
        if len(found) > 1:
            raise KeyError(f"several columns are called {key}")
        return found[0]

    def get_values(self, name: str) -> list:
        return [v for n, v in zip(self.names, self.values) if n == name]

    def __len__(self) -> int:
        return len(self.values)

    def __iter__(self) -> Iterator:
        return iter(self.values)


@dataclass(frozen=True)
class Result:
    """A lazy result; ``read`` runs it."""

    df: DataFrame

    def read(self, into: type | Callable | None = None, stream: bool = False) -> list | Iterator:
        """All rows; as ``into`` (a dataclass, a scalar type or a callable) if it is given."""
        names = tuple(self.df.columns)
        rows = self.df.toLocalIterator() if stream else self.df.collect()
        make = mapper(names, into) if into is not None else lambda v: RawRow(names, v)
        found = (make(tuple(r)) for r in rows)
        return found if stream else list(found)


@dataclass(frozen=True)
class Query:
    """A checked query and the values of its parameters."""

    engine: "Engine"
    sql: str
    values: dict = field(default_factory=dict)

    def with_parameter(self, name: str, value, type: str | None = None) -> "Query":  # noqa: A002
        """``value`` for a parameter; ``type``, a database type, has to be its own."""
        key = name.lstrip("@:$").lower()
        info = next((p for p in self.engine.analyze(self.sql).parameters if p.name[1:].lower() == key), None)
        if info is None:
            raise ValueError(f"the query has no parameter {name}")
        if key in self.values:
            raise ValueError(f"the parameter {name} has a value already")
        if type is not None and self.engine.dialect.type_of(type) != info.shape:
            raise ValueError(f"the parameter {name} is of another type than {type}")
        check_value(name, info.shape, value)
        return Query(self.engine, self.sql, {**self.values, key: value})

    def df(self) -> DataFrame:
        return self.engine.sql(self.sql, **self.values)

    def read(self, into=None, stream: bool = False):
        return Result(self.df()).read(into, stream)

    def execute(self) -> int:
        return self.engine.execute(self.sql, **self.values)


def check_value(name: str, shape, value) -> None:
    """Refuse a value that a parameter's type does not take."""
    if value is None:
        return
    if shape.array:
        if not isinstance(value, (list, tuple)):
            raise TypeError(f"the parameter {name} takes a list")
        for v in value:
            check_value(name, shape.element(), v)
        return
    wanted = PYTHON_TYPES.get(shape.kind)
    if wanted and (not isinstance(value, wanted) or isinstance(value, bool) and bool not in wanted or shape.kind is Kind.DATE and isinstance(value, datetime.datetime)):
        raise TypeError(f"the parameter {name} takes {' or '.join(t.__name__ for t in wanted)}, not {type(value).__name__}")


class TableRef:
    """A table of the schema: its columns as attributes, its rows, single-row writes."""

    def __init__(self, engine: "Engine", table: Table, predicate: Predicate | None = None):
        self._engine, self._table, self._predicate = engine, table, predicate

    def __getattr__(self, name: str) -> ColumnRef:
        c = self._table.column(name)
        if c is None:
            raise AttributeError(f"{self._table.name} has no column {name}")
        return ColumnRef(c.name)

    def query(self) -> DataFrame:
        df = self._engine.spark.table(quote(self._table.view)).select(*[F.col(quote(c.name)) for c in self._table.columns])
        return df if self._predicate is None else df.where(self._predicate.column)

    all = query

    def where(self, p: Predicate) -> "TableRef":
        return TableRef(self._engine, self._table, p if self._predicate is None else self._predicate.and_(p))

    def where_if(self, flag: bool, p: Predicate | Callable[[], Predicate]) -> "TableRef":
        return self.where(p() if callable(p) else p) if flag else self

    def sql(self) -> tuple[str, list]:
        """The SELECT that this stands for, with its parameters' values."""
        listed = ", ".join(ColumnRef(c.name).sql for c in self._table.columns)
        table = ".".join('"' + x + '"' for x in (self._table.schema, self._table.name) if x)
        text, values = self._predicate.sql() if self._predicate else ("", [])
        return f"SELECT {listed} FROM {table}" + (f" WHERE {text}" if text else ""), values

    def read(self, into=None, stream: bool = False):
        return Result(self.query()).read(into, stream)

    def delete_where(self, p: Predicate) -> int:
        store, df = self._engine.store, self._engine.store.read(self._table)
        hit = F.coalesce(p.column, F.lit(False))
        n = df.where(hit).count()
        store.write(self._table, df.where(~hit))
        return n

    def _statement(self, text: str, values: dict) -> Outcome:
        return self._engine.change(text, **values)

    def _name(self) -> str:
        return ".".join('"' + x + '"' for x in (self._table.schema, self._table.name) if x)

    def _insert(self, record, returning: bool) -> Outcome:
        row = _fields(record)
        own = [c for c in self._table.columns if not c.identity and c.name in row]
        listed, marks = ", ".join(ColumnRef(c.name).sql for c in own), ", ".join(f"@v{i}" for i in range(len(own)))
        text = f"INSERT INTO {self._name()} ({listed}) VALUES ({marks})" + (" RETURNING *" if returning else "")
        return self._statement(text, {f"v{i}": row[c.name] for i, c in enumerate(own)})

    def insert(self, record) -> int:
        """Insert a record (a mapping or a dataclass); identity columns number themselves."""
        return self._insert(record, False).count

    def insert_returning(self, record, into=None):
        return Result(self._insert(record, True).rows).read(into)[0]

    def _keyed(self, row: dict, start: int) -> tuple[str, dict]:
        if not self._table.key:
            raise ValueError(f"{self._table.name} has no primary key")
        parts = [f"{ColumnRef(k).sql} = @v{start + i}" for i, k in enumerate(self._table.key)]
        return " AND ".join(parts), {f"v{start + i}": row[k] for i, k in enumerate(self._table.key)}

    def update(self, record) -> int:
        """Write a record over the row of its primary key."""
        row = _fields(record)
        own = [c for c in self._table.columns if c.name in row and not c.primary_key]
        if not own:
            raise ValueError("every column is part of the key")
        where, keys = self._keyed(row, len(own))
        text = f"UPDATE {self._name()} SET {', '.join(f'{ColumnRef(c.name).sql} = @v{i}' for i, c in enumerate(own))} WHERE {where}"
        return self._statement(text, {**{f"v{i}": row[c.name] for i, c in enumerate(own)}, **keys}).count

    def delete(self, record) -> int:
        where, keys = self._keyed(_fields(record), 0)
        return self._statement(f"DELETE FROM {self._name()} WHERE {where}", keys).count


def _fields(record) -> dict:
    import dataclasses

    return dict(record) if isinstance(record, dict) else {f.name: getattr(record, f.name) for f in dataclasses.fields(record)}


class Names:
    """Names of tables and columns as quoted texts; one that is gone is an error."""

    def __init__(self, schema: Schema):
        self._schema = schema

    def __getattr__(self, name: str) -> "TableNames":
        found = self._schema.find(name)
        if len(found) != 1:
            raise AttributeError(f"there is no one table {name}")
        return TableNames(found[0])


class TableNames(str):
    def __new__(cls, table: Table):
        out = super().__new__(cls, ".".join('"' + x.replace('"', '""') + '"' for x in (table.schema, table.name) if x))
        out._table = table
        return out

    def __getattr__(self, name: str) -> str:
        c = self._table.column(name)
        if c is None:
            raise AttributeError(f"{self._table.name} has no column {name}")
        return ColumnRef(c.name).sql


class Engine:
    """Queries over a schema whose tables Spark knows as views.

    ``root``, a folder of snapshots, is needed for data changes only.
    """

    def __init__(self, spark: SparkSession, schema: Schema, root: str | None = None, dialect: Dialect = POSTGRESQL):
        self.spark, self.schema, self.dialect = spark, schema, dialect
        self.store = SnapshotStore(spark, root, dialect) if root else None
        self.named: dict[str, tuple[str, type | None]] = {}
        spark.conf.set("spark.sql.timeType.enabled", "true")
        # recursion ends when a step adds nothing, as in PostgreSQL, not at a level
        spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
        spark.udf.register("tessera_json_contains", F.pandas_udf(_json_contains, "boolean"))

    @classmethod
    def over_parquet(cls, spark: SparkSession, folder: str, names: list[str], **options) -> "Engine":
        return cls(spark, parquet_schema(spark, folder, names), **options)

    @classmethod
    def over_jdbc(cls, spark: SparkSession, url: str, names: list[str], reading: dict | None = None, **options) -> "Engine":
        """An engine over tables of another database, whose driver is on Spark's class path.

        Filters and columns are pushed down to it; ``reading`` are options of
        Spark's JDBC source, such as those that divide a table among tasks.
        """
        tables = []
        for name in names:
            df = jdbc_table(spark, url, name, **(reading or {}))
            df.createOrReplaceTempView(name.replace(".", "__"))
            schema, _, own = name.rpartition(".")
            tables.append(replace(table_of(own, df.schema), schema=schema or None))
        return cls(spark, Schema(tuple(tables)), **options)

    @property
    def names(self) -> Names:
        return Names(self.schema)

    def analyze(self, sql: str) -> Analysis:
        return _cached(self.schema, self.dialect.name, sql)

    def checked(self, sql: str) -> Analysis:
        found = self.analyze(sql)
        if not found.ok:
            raise QueryError(found.diagnostics)
        return found

    def arguments(self, found: Analysis, values: dict) -> dict:
        given = {k.lstrip("@:$").lower(): v for k, v in values.items()}
        own = {p.name[1:].lower(): p for p in found.parameters}
        if missing := own.keys() - given.keys():
            raise ValueError(f"no value for {', '.join(sorted(missing))}")
        if extra := given.keys() - own.keys():
            raise ValueError(f"no parameter {', '.join(sorted(extra))}")
        for k, v in given.items():
            check_value(k, own[k].shape, v)
        lists = lambda v: F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else str(v) if isinstance(v, uuid_.UUID) else v
        return {k: lists(v) for k, v in given.items()}

    def sql(self, text: str, **values) -> DataFrame:
        """The rows of a checked query, or those that a data change returns."""
        found = self.checked(text)
        args = self.arguments(found, values)
        for view, change in found.staged:
            self._changed(change, args).rows.createOrReplaceTempView(view)
        if found.change is not None:
            rows = self._changed(found.change, args).rows
            return rows if rows is not None else self.spark.createDataFrame([], "affected long")
        if found.recursive:
            from .plans.recursion import fixpoint

            return fixpoint(self.spark, found, args)
        df = self.spark.sql(found.sql, args=args) if args else self.spark.sql(found.sql)
        return df

    def _changed(self, change, args: dict) -> Outcome:
        if self.store is None:
            raise ValueError("data changes need a folder of snapshots")
        return Changer(self.spark, self.store).run(change, args)

    def change(self, text: str, **values) -> Outcome:
        """Run a data change: its count and what it returns."""
        found = self.checked(text)
        if found.change is None:
            raise ValueError("the statement changes no data")
        return self._changed(found.change, self.arguments(found, values))

    def execute(self, text: str, **values) -> int:
        """Run a data change and return the number of rows that it has affected."""
        return self.change(text, **values).count

    def query(self, text: str) -> Query:
        self.checked(text)
        return Query(self, text)

    def format(self, text: str, **holes) -> Query:
        """A query with ``{name}`` holes: values become parameters, schema names stay text."""
        values = {}

        def put(m: re.Match) -> str:
            v = holes[m[1]]
            if isinstance(v, TableNames) or isinstance(v, str) and v.startswith('"') and v.endswith('"') and m[1].startswith("name_"):
                return str(v)
            values[f"h_{m[1].lower()}"] = v
            return f"@h_{m[1].lower()}"

        sql = re.sub(r"\{(\w+)\}", put, text)
        self.checked(sql)
        return Query(self, sql, values)

    def unchecked(self, text: str, **values) -> Result:
        """Spark SQL as it is, without any check."""
        return Result(self.spark.sql(text, args=values) if values else self.spark.sql(text))

    def define(self, name: str, sql: str, into: type | None = None) -> Callable:
        """A named query; calling it runs it with its parameters by name."""
        found = self.checked(sql)
        if name in self.named:
            raise QueryError([Diagnostic("SQL201", f"The query {name} is defined twice.")])
        self.named[name] = (sql, into)
        if found.change is not None and not found.columns:
            return lambda **values: self.execute(sql, **values)
        return lambda **values: Result(self.sql(sql, **values)).read(into)

    def table(self, name: str, schema: str | None = None) -> TableRef:
        found = self.schema.find(name, schema)
        if len(found) != 1:
            raise KeyError(f"there is no one table {name}")
        return TableRef(self, found[0])
