"""The dialects: spelling of names, parameters and types, and aggregate results."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .types import Kind, Shape


@dataclass(frozen=True)
class Dialect:
    name: str
    quotes: dict = field(default_factory=lambda: {'"': '"'})
    fold: str = "lower"  # of unquoted names: lower, upper or keep
    quoted_exact: bool = True
    parameter_prefixes: str = "@"
    numeric_parameters: bool = False
    default_schema: str | None = None
    arrays: bool = False

    @property
    def brackets_quote(self) -> bool:
        return "[" in self.quotes

    def same_name(self, written: str, quoted: bool, declared: str) -> bool:
        """Whether a name in a query means a declared one."""
        if quoted and self.quoted_exact:
            return written == declared
        return written.lower() == declared.lower()

    def type_of(self, text: str) -> Shape | None:
        """The kind that a type's spelling stands for, None if it is not known."""
        return _TYPES[self.name](text, self)

    def aggregate_kind(self, function: str, kind: Kind) -> Kind:
        """The kind of sum, avg and count over a kind."""
        return _aggregate(self.name, function, kind)


def _spellings(pairs: str) -> dict[str, Kind]:
    out: dict[str, Kind] = {}
    for line in pairs.strip().splitlines():
        kind, names = line.split(":")
        out |= {n.strip(): Kind(kind.strip()) for n in names.split(",")}
    return out


# The type names of each provider.
_POSTGRESQL = _spellings("""
    bool: boolean, bool
    int16: smallint, int2, smallserial
    int32: integer, int, int4, serial
    int64: bigint, int8, bigserial
    float: real, float4
    double: double precision, float8
    decimal: numeric, decimal
    string: text, varchar, character varying, char, character, bpchar, name, xml, jsonpath
    json: json
    jsonb: jsonb
    guid: uuid
    date: date
    time: time, time without time zone
    datetime: timestamp, timestamp without time zone
    datetimeoffset: timestamptz, timestamp with time zone
    interval: interval
    bytes: bytea
""")
_MYSQL = _spellings("""
    bool: bool, boolean
    int16: tinyint, smallint, tinyint unsigned
    int32: mediumint, int, integer, year, smallint unsigned, mediumint unsigned
    int64: bigint, int unsigned, integer unsigned
    float: float
    double: double, double precision, real
    decimal: decimal, numeric, dec, fixed, bigint unsigned
    string: char, varchar, text, tinytext, mediumtext, longtext, enum, set
    json: json
    date: date
    time: time
    datetime: datetime
    datetimeoffset: timestamp
    bytes: binary, varbinary, blob, tinyblob, mediumblob, longblob, bit
""")
_SQLSERVER = _spellings("""
    bool: bit
    int16: tinyint, smallint
    int32: int, integer
    int64: bigint
    float: real
    double: float, double precision
    decimal: decimal, numeric, money, smallmoney
    string: char, varchar, nchar, nvarchar, text, ntext, xml, sysname
    guid: uniqueidentifier
    date: date
    time: time
    datetime: datetime, datetime2, smalldatetime
    datetimeoffset: datetimeoffset
    bytes: binary, varbinary, image, rowversion, timestamp
""")
_ORACLE = _spellings("""
    float: binary_float
    double: binary_double, float
    decimal: number, decimal, numeric
    int32: integer, int, smallint
    string: varchar2, nvarchar2, varchar, char, nchar, clob, nclob, long
    json: json
    bool: boolean
    datetime: date, timestamp
    datetimeoffset: timestamp with time zone, timestamp with local time zone
    bytes: raw, blob, long raw
""")


def _parts(text: str) -> tuple[str, tuple[int, ...], int]:
    """(name without modifiers, modifiers, array dimensions)."""
    dims = len(re.findall(r"\[\s*\d*\s*\]", text))
    text = re.sub(r"\[\s*\d*\s*\]", "", text).strip().lower()
    found = re.search(r"\(([^)]*)\)", text)
    numbers = tuple(int(x) for x in re.findall(r"-?\d+", found[1])) if found else ()
    return re.sub(r"\s+", " ", re.sub(r"\s*\([^)]*\)", "", text)).strip(), numbers, dims


def _postgresql(text: str, d: Dialect) -> Shape | None:
    name, _, dims = _parts(text)
    name = name.removeprefix("pg_catalog.")
    kind = _POSTGRESQL.get(name)
    return Shape(kind, dims == 1) if kind and dims <= 1 else None


def _mysql(text: str, d: Dialect) -> Shape | None:
    name, numbers, dims = _parts(text)
    if dims:
        return None
    if name in ("tinyint", "bit") and numbers == (1,):
        return Shape(Kind.BOOL)
    if name == "char" and numbers == (36,):
        return Shape(Kind.GUID)
    kind = _MYSQL.get(name)
    return Shape(kind) if kind else None


def _sqlite(text: str, d: Dialect) -> Shape | None:
    name, _, _ = _parts(text)
    known = {"boolean": Kind.BOOL, "bool": Kind.BOOL, "int16": Kind.INT16, "int32": Kind.INT32, "date": Kind.DATE, "datetime": Kind.DATETIME, "timestamp": Kind.DATETIME, "time": Kind.TIME, "guid": Kind.GUID, "uuid": Kind.GUID}
    if name in known:
        return Shape(known[name])
    for mark, kind in (("int", Kind.INT64), ("char", Kind.STRING), ("clob", Kind.STRING), ("text", Kind.STRING), ("blob", Kind.BYTES), ("real", Kind.DOUBLE), ("floa", Kind.DOUBLE), ("doub", Kind.DOUBLE)):
        if mark in name:
            return Shape(kind)
    return Shape(Kind.DECIMAL if name else Kind.BYTES)


def _sqlserver(text: str, d: Dialect) -> Shape | None:
    kind = _SQLSERVER.get(_parts(text)[0])
    return Shape(kind) if kind else None


def _oracle(text: str, d: Dialect) -> Shape | None:
    name, numbers, _ = _parts(text)
    if name in ("number", "decimal", "numeric") and numbers and (len(numbers) == 1 or numbers[1] == 0):
        p = numbers[0]
        return Shape(Kind.BOOL if p == 1 else Kind.INT16 if p <= 4 else Kind.INT32 if p <= 10 else Kind.INT64 if p <= 18 else Kind.DECIMAL)
    if name == "raw" and numbers == (16,):
        return Shape(Kind.GUID)
    kind = _ORACLE.get(name)
    return Shape(kind) if kind else None


_TYPES = {"postgresql": _postgresql, "mysql": _mysql, "sqlite": _sqlite, "sqlserver": _sqlserver, "oracle": _oracle}

_INTS = (Kind.INT16, Kind.INT32, Kind.INT64)
_FLOATS = (Kind.FLOAT, Kind.DOUBLE)


def _aggregate(dialect: str, function: str, kind: Kind) -> Kind:
    exact = kind in _INTS or kind is Kind.DECIMAL
    small = kind in (Kind.INT16, Kind.INT32)
    if function == "count":
        return Kind.INT32 if dialect == "sqlserver" else Kind.INT64
    if dialect == "mysql":
        return Kind.DECIMAL if exact else Kind.DOUBLE
    if dialect == "oracle":
        return kind if kind in _FLOATS else Kind.DECIMAL
    if function == "sum":
        if dialect == "postgresql":
            return Kind.INT64 if small else Kind.DECIMAL if kind is Kind.INT64 else kind
        if dialect == "sqlite":
            return Kind.INT64 if kind in _INTS else Kind.DOUBLE if kind is Kind.FLOAT else kind
        return Kind.INT32 if kind is Kind.INT16 else kind
    if dialect == "sqlite":
        return Kind.DOUBLE
    if dialect == "sqlserver":
        return Kind.INT32 if small else kind
    return Kind.DECIMAL if exact else Kind.DOUBLE


POSTGRESQL = Dialect("postgresql", arrays=True)
MYSQL = Dialect("mysql", quotes={"`": "`"})
SQLITE = Dialect("sqlite", quotes={'"': '"', "`": "`", "[": "]"}, quoted_exact=False, parameter_prefixes="@:$", numeric_parameters=True)
SQLSERVER = Dialect("sqlserver", quotes={'"': '"', "[": "]"}, fold="keep", quoted_exact=False, default_schema="dbo")
ORACLE = Dialect("oracle", fold="upper", parameter_prefixes=":")
DIALECTS = {d.name: d for d in (POSTGRESQL, MYSQL, SQLITE, SQLSERVER, ORACLE)}
