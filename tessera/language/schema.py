"""Tables and columns that queries are checked against."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql.types import StructType

from .types import Kind


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = False
    primary_key: bool = False
    default: str | None = None
    identity: bool = False
    comment: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    schema: str | None = None
    comment: str | None = None

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)

    @property
    def key(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns if c.primary_key)

    @property
    def view(self) -> str:
        """The name under which Spark knows the table."""
        return f"{self.schema}__{self.name}" if self.schema else self.name


@dataclass(frozen=True)
class Schema:
    tables: tuple[Table, ...] = field(default_factory=tuple)

    def find(self, name: str, schema: str | None = None) -> list[Table]:
        return [t for t in self.tables if t.name.lower() == name.lower() and (schema is None or (t.schema or "").lower() == schema.lower())]

    def with_table(self, table: Table) -> "Schema":
        """This schema with a table added or put in place of its namesake."""
        same = lambda t: t.name.lower() == table.name.lower() and (t.schema or "").lower() == (table.schema or "").lower()
        if any(map(same, self.tables)):
            return Schema(tuple(table if same(t) else t for t in self.tables))
        return Schema((*self.tables, table))

    def without(self, table: Table) -> "Schema":
        return Schema(tuple(t for t in self.tables if t is not table))

    def fingerprint(self) -> str:
        return self.to_json()

    def to_json(self) -> str:
        """The schema export: {formatVersion, tables: [{schema, name, columns}]}."""
        tables = [
            {"schema": t.schema, "name": t.name, "columns": [{"name": c.name, "type": c.type, "nullable": c.nullable, "primaryKey": c.primary_key, "default": c.default, "identity": c.identity} for c in t.columns]}
            for t in self.tables
        ]
        return json.dumps({"formatVersion": 1, "tables": tables}, indent=2)


#: Spellings of Spark's types for schemas that are read off Parquet files.
_FROM_SPARK = {
    "boolean": "boolean",
    "tinyint": "smallint",
    "smallint": "smallint",
    "int": "integer",
    "bigint": "bigint",
    "float": "real",
    "double": "double precision",
    "string": "text",
    "date": "date",
    "timestamp_ntz": "timestamp",
    "timestamp": "timestamptz",
    "binary": "bytea",
}


def table_of(name: str, struct: StructType) -> Table:
    """A table as Parquet files declare it; columns of other types are left out."""
    columns = []
    for f in struct.fields:
        text = f.dataType.simpleString()
        array = text.startswith("array<")
        base = text[6:-1] if array else text
        spelled = "numeric" if base.startswith("decimal") else _FROM_SPARK.get(base)
        if spelled:
            columns.append(Column(f.name, spelled + "[]" * array, f.nullable))
    return Table(name, tuple(columns))


def default_kind(kind: Kind) -> str:
    """A PostgreSQL spelling of a kind."""
    return {Kind.INT32: "integer", Kind.INT64: "bigint", Kind.STRING: "text"}.get(kind, kind.value)
