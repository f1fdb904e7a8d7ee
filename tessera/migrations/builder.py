"""Migrations written as code: verbs that collect operations."""

from __future__ import annotations

import datetime
import decimal
import enum
import uuid
from collections.abc import Callable, Mapping
from dataclasses import replace
from pathlib import Path

from ..language.schema import Column
from .ddl import AddColumn, AddKey, AlterType, Call, Comment, CreateTable, Data, DropColumn, DropTable, MigrationError, MoveTable, Name, Neutral, RenameColumn, RenameTable, SetDefault, SetNullable, operations_of, quoted


class SystemMethod(enum.Enum):
    """Defaults that are evaluated when a row is inserted."""

    NOW = "CURRENT_TIMESTAMP"
    TODAY = "CURRENT_DATE"
    NEW_GUID = "gen_random_uuid()"


class RawSql(str):
    """SQL text that is put in as it stands."""


def literal(v) -> str:
    if isinstance(v, RawSql):
        return str(v)
    if isinstance(v, SystemMethod):
        return v.value
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float, decimal.Decimal)):
        return str(v)
    kind = {datetime.datetime: "timestamp", datetime.date: "date", datetime.time: "time", uuid.UUID: "uuid"}.get(type(v))
    text = "'" + str(v).replace("'", "''") + "'"
    return f"CAST({text} AS {kind})" if kind else text


class _Typed:
    """Types and options of the column in hand, ``self._column``."""

    def _set(self, **options):
        self._column = replace(self._column, **options)
        return self

    def as_custom(self, text: str):
        return self._set(type=text)

    def as_int16(self):
        return self._set(type="smallint")

    as_byte = as_int16

    def as_int32(self):
        return self._set(type="integer")

    def as_int64(self):
        return self._set(type="bigint")

    def as_boolean(self):
        return self._set(type="boolean")

    def as_decimal(self, precision: int | None = None, scale: int = 0):
        return self._set(type=f"numeric({precision},{scale})" if precision else "numeric")

    def as_currency(self):
        return self.as_decimal(19, 4)

    def as_float(self):
        return self._set(type="real")

    def as_double(self):
        return self._set(type="double precision")

    def as_string(self, length: int | None = None):
        return self._set(type=f"varchar({length})" if length else "varchar")

    as_ansi_string = as_string

    def as_fixed_length_string(self, length: int):
        return self._set(type=f"char({length})")

    as_fixed_length_ansi_string = as_fixed_length_string

    def as_text(self):
        return self._set(type="text")

    as_xml = as_text

    def as_date(self):
        return self._set(type="date")

    def as_datetime(self):
        return self._set(type="timestamp")

    as_datetime2 = as_datetime

    def as_datetime_offset(self):
        return self._set(type="timestamptz")

    def as_time(self):
        return self._set(type="time")

    def as_guid(self):
        return self._set(type="uuid")

    def as_binary(self):
        return self._set(type="bytea")

    def as_json(self):
        return self._set(type="json")

    def as_jsonb(self):
        return self._set(type="jsonb")

    def nullable(self):
        return self._set(nullable=True)

    def not_nullable(self):
        return self._set(nullable=False)

    def primary_key(self):
        return self._set(primary_key=True, nullable=False)

    def identity(self):
        return self._set(identity=True, nullable=False)

    def with_default(self, value):
        return self._set(default=literal(value))

    def with_description(self, text: str):
        return self._set(comment=text)

    def set_existing_rows_to(self, value):
        self._existing = literal(value)
        return self

    def _note(self, text: str):
        self._notes.append(Neutral(text))
        return self

    def indexed(self, name: str | None = None):
        return self._note(f"CREATE INDEX {quoted(name or f'ix_{self._column.name}')} ON {self._name()} ({quoted(self._column.name)})")

    def unique(self, name: str | None = None):
        return self._note(f"CREATE UNIQUE INDEX {quoted(name or f'ux_{self._column.name}')} ON {self._name()} ({quoted(self._column.name)})")

    def foreign_key(self, table: str, column: str):
        return self._note(f"ALTER TABLE {self._name()} ADD FOREIGN KEY ({quoted(self._column.name)}) REFERENCES {quoted(table)} ({quoted(column)})")


class _Step:
    """A statement under construction; ``in_schema`` may come at any place."""

    def __init__(self, table: str | None = None):
        self._table, self._schema, self._notes, self._existing = table, None, [], None

    def in_schema(self, name: str):
        self._schema = name
        return self

    def _name(self) -> Name:
        return Name(self._table, self._schema)


class _NewTable(_Typed, _Step):
    def __init__(self, table: str):
        super().__init__(table)
        self._columns: list[Column] = []
        self._column: Column | None = None
        self._text: str | None = None

    def with_table_description(self, text: str):
        self._text = text
        return self

    def with_column(self, name: str):
        self._close()
        self._column = Column(name, "")
        return self

    def _close(self):
        if self._column is not None:
            self._columns.append(self._column)
            self._column = None

    def build(self) -> list:
        self._close()
        return [CreateTable(self._name(), tuple(self._columns), comment=self._text), *self._notes]


class _OneColumn(_Typed, _Step):
    """A column added to a table or altered."""

    def __init__(self, column: str, table: str | None, new: bool):
        super().__init__(table)
        self._column, self._new = Column(column, ""), new
        self._asked: set[str] = set()

    def _set(self, **options):
        self._asked |= set(options)
        return super()._set(**options)

    def on_table(self, table: str):
        self._table = table
        return self

    def build(self) -> list:
        t, c = self._name(), self._column
        if self._new:
            return [AddColumn(t, c, existing=self._existing), *self._notes]
        out: list = [AlterType(t, c.name, c.type)] if "type" in self._asked else []
        if "nullable" in self._asked:
            out.append(SetNullable(t, c.name, c.nullable))
        if "default" in self._asked:
            out.append(SetDefault(t, c.name, c.default))
        if "comment" in self._asked:
            out.append(Comment(t, c.name, c.comment))
        return out + self._notes


class _Made(_Step):
    """A statement whose operations follow from its name."""

    def __init__(self, make: Callable[["_Made"], list], table: str | None = None):
        super().__init__(table)
        self._make, self._to, self._columns = make, None, []

    def on_table(self, table: str):
        self._table = table
        return self

    from_table = on_table

    def to(self, name: str):
        self._to = name
        return self

    to_schema = to

    def columns(self, *names: str):
        self._columns += names
        return self

    on_column = column = columns

    def build(self) -> list:
        return self._make(self)


class _Rows(_Step):
    """INSERT, UPDATE or DELETE of literal rows."""

    def __init__(self, kind: str, table: str):
        super().__init__(table)
        self._kind, self._rows, self._set, self._all, self._sql = kind, [], None, False, None

    def row(self, row: Mapping | None = None, **cells):
        self._rows.append({**(row or {}), **cells})
        return self

    def rows(self, rows):
        for r in rows:
            self.row(r)
        return self

    def set(self, row: Mapping | None = None, **cells):
        self._set = {**(row or {}), **cells}
        return self

    def where(self, row: Mapping | str | None = None, **cells):
        if isinstance(row, str):
            self._sql = row
            return self
        return self.row(row, **cells)

    def all_rows(self):
        self._all = True
        return self

    def build(self) -> list:
        t = self._name()
        if self._kind == "insert":
            return [Data(f"INSERT INTO {t} ({', '.join(map(quoted, r))}) VALUES ({', '.join(map(literal, r.values()))})") for r in self._rows]
        head = f"DELETE FROM {t}" if self._kind == "delete" else f"UPDATE {t} SET {', '.join(f'{quoted(k)} = {literal(v)}' for k, v in (self._set or {}).items())}"
        if self._kind == "update" and not self._set:
            raise MigrationError("an update sets nothing")
        if self._all:
            return [Data(head)]
        if not self._rows and not self._sql:
            raise MigrationError("a change of rows needs a condition or all_rows()")
        same = lambda k, v: f"{quoted(k)} IS NULL" if v is None else f"{quoted(k)} = {literal(v)}"
        met = [self._sql] if self._sql else ["(" + " AND ".join(same(k, v) for k, v in r.items()) + ")" for r in self._rows]
        return [Data(f"{head} WHERE {' OR '.join(met)}")]


class _Verb:
    def __init__(self, steps: list):
        self._steps = steps

    def _add(self, step):
        self._steps.append(step)
        return step

    def _neutral(self, text: Callable[[_Made], str], table: str | None = None):
        return self._add(_Made(lambda m: [Neutral(text(m))], table))


class _Create(_Verb):
    def table(self, name: str):
        return self._add(_NewTable(name))

    def column(self, name: str):
        return self._add(_OneColumn(name, None, True))

    def primary_key(self, *columns: str):
        return self._add(_Made(lambda m: [AddKey(m._name(), tuple(m._columns))])).columns(*columns)

    def schema(self, name: str):
        return self._neutral(lambda m: f"CREATE SCHEMA {quoted(name)}")

    def sequence(self, name: str):
        return self._neutral(lambda m: f"CREATE SEQUENCE {quoted(name)}")

    def index(self, name: str):
        return self._neutral(lambda m: f"CREATE INDEX {quoted(name)} ON {m._name()} ({', '.join(map(quoted, m._columns))})")

    def unique_constraint(self, name: str):
        return self._neutral(lambda m: f"ALTER TABLE {m._name()} ADD CONSTRAINT {quoted(name)} UNIQUE ({', '.join(map(quoted, m._columns))})")

    def foreign_key(self, name: str):
        return self._neutral(lambda m: f"ALTER TABLE {m._name()} ADD CONSTRAINT {quoted(name)} FOREIGN KEY ({', '.join(map(quoted, m._columns))}) REFERENCES {quoted(m._to or '')}")


class _AlterTable(_Step):
    def __init__(self, verb: _Verb, table: str):
        super().__init__(table)
        self._verb = verb

    def _column(self, name: str, new: bool):
        step = self._verb._add(_OneColumn(name, self._table, new))
        return step.in_schema(self._schema)

    def add_column(self, name: str):
        return self._column(name, True)

    def alter_column(self, name: str):
        return self._column(name, False)

    def to_schema(self, name: str):
        self._verb._add(_Made(lambda m: [MoveTable(self._name(), name)]))

    def with_description(self, text: str):
        self._verb._add(_Made(lambda m: [Comment(self._name(), None, text)]))


class _Alter(_Verb):
    def table(self, name: str):
        return _AlterTable(self, name)

    def column(self, name: str):
        return self._add(_OneColumn(name, None, False))


class _Delete(_Verb):
    def table(self, name: str, if_exists: bool = False):
        return self._add(_Made(lambda m: [DropTable((m._name(),), if_exists)], name))

    def column(self, *names: str):
        return self._add(_Made(lambda m: [DropColumn(m._name(), c) for c in m._columns])).columns(*names)

    def default_constraint(self):
        return self._add(_Made(lambda m: [SetDefault(m._name(), c, None) for c in m._columns]))

    def schema(self, name: str):
        return self._neutral(lambda m: f"DROP SCHEMA {quoted(name)}")

    def sequence(self, name: str):
        return self._neutral(lambda m: f"DROP SEQUENCE {quoted(name)}")

    def index(self, name: str):
        return self._neutral(lambda m: f"DROP INDEX {quoted(name)}")

    def constraint(self, name: str):
        return self._neutral(lambda m: f"ALTER TABLE {m._name()} DROP CONSTRAINT {quoted(name)}")

    foreign_key = unique_constraint = constraint

    def from_table(self, table: str):
        return self._add(_Rows("delete", table))


class _Rename(_Verb):
    def table(self, name: str):
        return self._add(_Made(lambda m: [RenameTable(m._name(), m._to)], name))

    def column(self, name: str):
        return self._add(_Made(lambda m: [RenameColumn(m._name(), name, m._to)]))


class _Insert(_Verb):
    def into_table(self, table: str):
        return self._add(_Rows("insert", table))


class _Update(_Verb):
    def table(self, table: str):
        return self._add(_Rows("update", table))


class _Execute(_Verb):
    def sql(self, text: str):
        self._add(_Made(lambda m: operations_of(text)))

    def script(self, path: str, **tokens):
        """A script file; ``$(name)`` in it stands for the token of that name."""
        text = Path(path).read_text(encoding="utf-8")
        for k, v in tokens.items():
            text = text.replace(f"$({k})", str(v))
        self.sql(text)

    embedded_script = script

    def with_connection(self, function: Callable):
        """``function(engine)`` runs between the other steps."""
        self._add(_Made(lambda m: [Call(function)]))


class _Verbs:
    def __init__(self, steps: list):
        self._steps = steps
        self.create, self.alter, self.delete, self.rename = _Create(steps), _Alter(steps), _Delete(steps), _Rename(steps)
        self.insert, self.update, self.execute = _Insert(steps), _Update(steps), _Execute(steps)

    def delegate(self, function: Callable[[], None]):
        """Run ``function`` where these verbs count."""
        if self._counts:
            function()

    _counts = True


class Migration(_Verbs):
    """A step of a schema: ``version``, ``up`` and, unless forward only, ``down``."""

    version: int = 0
    dialect = "postgresql"

    def __init__(self):
        super().__init__([])

    def up(self) -> None:
        raise NotImplementedError

    def down(self) -> None:
        raise NotImplementedError

    @classmethod
    def forward_only(cls) -> bool:
        return cls.down is Migration.down

    def if_database(self, *names: str | Callable[[str], bool]) -> _Verbs:
        """Verbs that count for the named databases only ('spark' is any)."""
        met = any(n(self.dialect) if callable(n) else n.lower() in (self.dialect, "spark") for n in names)
        out = _Verbs(self._steps if met else [])
        out._counts = met
        return out

    def collect(self, up: bool, dialect: str = "postgresql") -> list:
        self.dialect = dialect
        self._steps.clear()
        (self.up if up else self.down)()
        return [op for step in self._steps for op in step.build()]
