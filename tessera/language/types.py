"""Kinds of values, how they unify, and their Spark types."""

from __future__ import annotations

import enum
from dataclasses import dataclass, replace


class Kind(enum.Enum):
    BOOL = "bool"
    INT16 = "int16"
    INT32 = "int32"
    INT64 = "int64"
    FLOAT = "float"
    DOUBLE = "double"
    DECIMAL = "decimal"
    STRING = "string"
    JSON = "json"
    JSONB = "jsonb"
    GUID = "guid"
    DATE = "date"
    TIME = "time"
    DATETIME = "datetime"
    DATETIMEOFFSET = "datetimeoffset"
    INTERVAL = "interval"
    BYTES = "bytes"
    UNKNOWN = "unknown"
    ERROR = "error"


#: Names of the result types in analyses, fixed values.
RESULT_NAMES = {
    Kind.BOOL: "bool",
    Kind.INT16: "short",
    Kind.INT32: "int",
    Kind.INT64: "long",
    Kind.FLOAT: "float",
    Kind.DOUBLE: "double",
    Kind.DECIMAL: "decimal",
    Kind.STRING: "string",
    Kind.JSON: "string",
    Kind.JSONB: "string",
    Kind.GUID: "Guid",
    Kind.DATE: "DateOnly",
    Kind.TIME: "TimeOnly",
    Kind.DATETIME: "DateTime",
    Kind.DATETIMEOFFSET: "DateTimeOffset",
    Kind.INTERVAL: "TimeSpan",
    Kind.BYTES: "byte[]",
    Kind.UNKNOWN: "object",
    Kind.ERROR: "object",
}
SPARK_NAMES = {
    Kind.BOOL: "boolean",
    Kind.INT16: "smallint",
    Kind.INT32: "int",
    Kind.INT64: "bigint",
    Kind.FLOAT: "float",
    Kind.DOUBLE: "double",
    Kind.DECIMAL: "decimal(38,18)",
    Kind.STRING: "string",
    Kind.JSON: "string",
    Kind.JSONB: "string",
    Kind.GUID: "string",
    Kind.DATE: "date",
    Kind.TIME: "time",
    Kind.DATETIME: "timestamp_ntz",
    Kind.DATETIMEOFFSET: "timestamp",
    Kind.INTERVAL: "interval day to second",
    Kind.BYTES: "binary",
    Kind.UNKNOWN: "string",
    Kind.ERROR: "string",
}
INTS = (Kind.INT16, Kind.INT32, Kind.INT64)
FLOATS = (Kind.FLOAT, Kind.DOUBLE)
NUMBERS = (*INTS, *FLOATS, Kind.DECIMAL)
TEXTS = (Kind.STRING, Kind.JSON, Kind.JSONB)


@dataclass(frozen=True)
class Shape:
    """A kind, or a one-dimensional array of it."""

    kind: Kind
    array: bool = False

    def spark(self) -> str:
        name = SPARK_NAMES[self.kind]
        return f"array<{name}>" if self.array else name

    def result_name(self, nullable: bool) -> str:
        name = RESULT_NAMES[self.kind] + ("[]" if self.array else "")
        return name + ("?" if nullable else "")

    def element(self) -> "Shape":
        return replace(self, array=False)

    @property
    def known(self) -> bool:
        return self.kind not in (Kind.UNKNOWN, Kind.ERROR)

    @property
    def number(self) -> bool:
        return not self.array and self.kind in NUMBERS

    @property
    def text(self) -> bool:
        return not self.array and self.kind is Kind.STRING


UNKNOWN = Shape(Kind.UNKNOWN)
ERROR = Shape(Kind.ERROR)
BOOL = Shape(Kind.BOOL)
INT32 = Shape(Kind.INT32)
INT64 = Shape(Kind.INT64)
STRING = Shape(Kind.STRING)
DOUBLE = Shape(Kind.DOUBLE)
DECIMAL = Shape(Kind.DECIMAL)


def unify(a: Shape, b: Shape) -> Shape | None:
    """The shape that values of both fit, None if there is none.

    An unknown one takes the other's.  Text and JSON give JSON; a float and any
    other number give double, a decimal and an integer decimal, two integers the
    wider one.  All else has to be equal; arrays go by their elements.
    """
    if Kind.ERROR in (a.kind, b.kind):
        return a if b.kind is Kind.ERROR else b
    if a.kind is Kind.UNKNOWN and not a.array:
        return b
    if b.kind is Kind.UNKNOWN and not b.array:
        return a
    if a.array != b.array:
        return None
    if a == b:
        return a
    if a.array:
        one = unify(a.element(), b.element())
        return Shape(one.kind, True) if one else None
    kinds = {a.kind, b.kind}
    if kinds <= set(TEXTS):
        return Shape(Kind.JSONB if Kind.JSONB in kinds else Kind.JSON)
    if kinds <= set(NUMBERS):
        if kinds & set(FLOATS):
            return DOUBLE
        if Kind.DECIMAL in kinds:
            return DECIMAL
        return Shape(max(kinds, key=INTS.index))
    return None
