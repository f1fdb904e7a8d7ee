"""Scalar functions: what they take, what they give and how Spark spells them.

A rule gets the bound arguments and returns (shape, nullable, Spark SQL).  It
refuses arguments by raising ``Refused`` with a diagnostic code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..language.types import BOOL, DECIMAL, DOUBLE, FLOATS, INT32, STRING, Kind, Shape, unify


class Refused(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Function:
    least: int
    most: int | None
    rule: Callable
    hints: Callable | None = None  # shapes that unknown parameters take


def _incompatible(name: str):
    raise Refused("SQL207", f"The arguments of {name} do not have types that it takes.")


def _texts(name, args):
    for a in args:
        if a.shape.known and not (a.shape.text or a.shape.kind in (Kind.JSON, Kind.JSONB) and not a.shape.array):
            _incompatible(name)


def _any_null(args) -> bool:
    return any(a.nullable for a in args)


def _text(spark: str, result: Shape = STRING, texts: int | None = None):
    """A function of texts (the first ``texts`` arguments), null if one is."""

    def rule(name, args):
        _texts(name, args if texts is None else args[:texts])
        return result, _any_null(args), spark.format(*[a.sql for a in args])

    return rule


def _trim(plain: str, chars: str):
    def rule(name, args):
        _texts(name, args)
        return STRING, _any_null(args), (chars if len(args) > 1 else plain).format(*[a.sql for a in args])

    return rule


def _substring(name, args):
    _texts(name, args[:1])
    for a in args[1:]:
        if a.shape.known and a.shape.kind not in (Kind.INT16, Kind.INT32, Kind.INT64):
            _incompatible(name)
    s, start = args[0].sql, args[1].sql if len(args) > 1 else "1"
    if len(args) < 3:
        return STRING, _any_null(args), f"substring({s}, greatest({start}, 1))"
    # what lies ahead of the first character uses up its share of the length
    return STRING, _any_null(args), f"substring({s}, greatest({start}, 1), greatest(({start}) + ({args[2].sql}) - greatest({start}, 1), 0))"


def _concat(name, args):
    return STRING, False, f"concat_ws('', {', '.join(f'CAST({a.sql} AS STRING)' for a in args)})"


def _concat_ws(name, args):
    _texts(name, args[:1])
    return STRING, args[0].nullable, f"concat_ws({args[0].sql}, {', '.join(f'CAST({a.sql} AS STRING)' for a in args[1:])})"


def _numbers(name, args):
    for a in args:
        if a.shape.known and not a.shape.number:
            _incompatible(name)


def _same(spark: str, cast: bool = False):
    def rule(name, args):
        _numbers(name, args[:1])
        shape = args[0].shape if args[0].shape.known else DOUBLE
        sql = spark.format(*[a.sql for a in args])
        return shape, _any_null(args), f"CAST({sql} AS {shape.spark()})" if cast and shape.kind is not Kind.DECIMAL else sql

    return rule


def _round(name, args):
    _numbers(name, args)
    shape = args[0].shape if args[0].shape.known else DECIMAL
    # double precision rounds half to even, numeric half away from zero
    how = "bround" if shape.kind in FLOATS and len(args) == 1 else "round"
    sql = f"{how}({', '.join(a.sql for a in args)})"
    return shape, _any_null(args), f"CAST({sql} AS {shape.spark()})" if shape.kind is not Kind.DECIMAL else sql


def _power(name, args):
    _numbers(name, args)
    shape = DOUBLE if any(a.shape.kind in FLOATS for a in args) else DECIMAL
    sql = f"power({args[0].sql}, {args[1].sql})"
    return shape, _any_null(args), sql if shape is DOUBLE else f"CAST({sql} AS DECIMAL(38,10))"


def common(args) -> Shape:
    out = args[0].shape
    for a in args[1:]:
        out = unify(out, a.shape)
        if out is None:
            raise Refused("SQL207", "The arguments do not have a type in common.")
    return out


def _extreme(spark: str):
    def rule(name, args):
        shape = common(args)
        return shape, all(a.nullable for a in args), f"{spark}({', '.join(a.sql for a in args)})" if len(args) > 1 else args[0].sql

    return rule


def _coalesce(name, args):
    return common(args), all(a.nullable for a in args), f"coalesce({', '.join(a.sql for a in args)})"


def _nullif(name, args):
    common(args)
    return args[0].shape, True, f"nullif({args[0].sql}, {args[1].sql})"


_CLOCKED = (Kind.DATETIME, Kind.DATETIMEOFFSET, Kind.INTERVAL)


def _date_trunc(name, args):
    _texts(name, args[:1])
    shape = args[1].shape
    if shape.known and (shape.array or shape.kind not in _CLOCKED):
        _incompatible(name)
    return shape, _any_null(args), f"CAST(date_trunc({args[0].sql}, {args[1].sql}) AS {shape.spark()})"


#: Fields whose numbers differ from Spark's, fixed values.
_PARTS = {
    "dow": "(dayofweek({0}) - 1)",
    "isodow": "(weekday({0}) + 1)",
    "doy": "dayofyear({0})",
    "isoyear": "extract(YEAROFWEEK FROM {0})",
    "decade": "floor(year({0}) / 10)",
    "century": "ceil(year({0}) / 100)",
    "millennium": "ceil(year({0}) / 1000)",
    "milliseconds": "(extract(SECOND FROM {0}) * 1000)",
    "microseconds": "(extract(SECOND FROM {0}) * 1000000)",
}
#: Fields that Spark's extract knows by the same name, of moments and of intervals and times of day.
_SAME = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
_OF_INTERVALS = ("day", "hour", "minute", "second", "milliseconds", "microseconds", "epoch")


def date_part(part: str, arg, name: str = "extract"):
    shape = arg.shape
    if shape.known and (shape.array or shape.kind not in (Kind.DATE, Kind.TIME, *_CLOCKED)):
        _incompatible(name)
    part = part.lower()
    if part != "epoch" and part not in _PARTS and part not in _SAME:
        raise Refused("SQL207", f"There is no field {part}.")
    if shape.kind is Kind.INTERVAL and part not in _OF_INTERVALS or shape.kind is Kind.TIME and part not in _OF_INTERVALS[1:]:
        raise Refused("SQL207", f"The type has no field {part}.")
    of = f"CAST({arg.sql} AS INTERVAL DAY TO SECOND)" if shape.kind is Kind.INTERVAL else arg.sql
    if part == "epoch":
        if shape.kind is Kind.TIME:
            sql = f"(extract(HOUR FROM {of}) * 3600 + extract(MINUTE FROM {of}) * 60 + extract(SECOND FROM {of}))"
        elif shape.kind is Kind.INTERVAL:
            sql = f"(extract(DAY FROM {of}) * 86400 + extract(HOUR FROM {of}) * 3600 + extract(MINUTE FROM {of}) * 60 + extract(SECOND FROM {of}))"
        else:
            sql = f"(unix_micros(CAST({of} AS TIMESTAMP)) / 1000000D)"
    elif part in _PARTS:
        sql = _PARTS[part].format(of)
    else:
        sql = f"extract({part.upper()} FROM {of})"
    return DOUBLE, arg.nullable, f"CAST({sql} AS DOUBLE)"


def _date_part(name, args):
    if args[0].literal is None:
        raise Refused("SQL207", "The field has to be a text literal.")
    return date_part(args[0].literal, args[1], name)


#: Patterns of to_char and what date_format calls them, fixed values, longer ones first.
_PATTERNS = (("YYYY", "yyyy"), ("MONTH", "MMMM"), ("HH24", "HH"), ("HH12", "hh"), ("MON", "MMM"), ("DAY", "EEEE"), ("DDD", "DDD"), ("MM", "MM"), ("DD", "dd"), ("DY", "EEE"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("AM", "a"), ("PM", "a"), ("YY", "yy"), ("HH", "hh"))


def pattern(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        for a, b in _PATTERNS:
            if text[i : i + len(a)].upper() == a:
                out, i = out + b, i + len(a)
                break
        else:
            c = text[i]
            out, i = out + (f"'{c}'" if c.isalpha() else c), i + 1
    return out


def _to_char(name, args):
    _texts(name, args[1:])
    if args[1].literal is not None and args[0].shape.kind in (Kind.DATE, Kind.TIME, *_CLOCKED):
        quoted = pattern(args[1].literal).replace("'", "\\'")
        return STRING, _any_null(args), f"date_format({args[0].sql}, '{quoted}')"
    return STRING, _any_null(args), f"to_char({args[0].sql}, {args[1].sql})"


def _constant(spark: str, shape: Shape):
    return lambda name, args: (shape, False, spark)


#: PostgreSQL capitalises after any character that is no letter or digit.
_INITCAP = r"array_join(transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+', 0), __w -> concat(upper(substring(__w, 1, 1)), lower(substring(__w, 2)))), '')"

FUNCTIONS: dict[str, Function] = {
    "lower": Function(1, 1, _text("lower({0})")),
    "upper": Function(1, 1, _text("upper({0})")),
    **{n: Function(1, 1, _text("length({0})", INT32)) for n in ("length", "char_length", "character_length", "len")},
    "octet_length": Function(1, 1, _text("octet_length({0})", INT32)),
    "initcap": Function(1, 1, _text(_INITCAP)),
    "reverse": Function(1, 1, _text("reverse({0})")),
    "md5": Function(1, 1, _text("md5({0})")),
    **{n: Function(1, 3, _substring) for n in ("substring", "substr")},
    **{n: Function(1, 2, _trim("trim({0})", "trim(BOTH {1} FROM {0})")) for n in ("trim", "btrim")},
    "ltrim": Function(1, 2, _trim("ltrim({0})", "ltrim({1}, {0})")),
    "rtrim": Function(1, 2, _trim("rtrim({0})", "rtrim({1}, {0})")),
    "replace": Function(3, 3, _text("replace({0}, {1}, {2})")),
    "strpos": Function(2, 2, _text("instr({0}, {1})", INT32)),
    "repeat": Function(2, 2, _text("repeat({0}, {1})", texts=1)),
    "concat": Function(1, None, _concat),
    "concat_ws": Function(2, None, _concat_ws),
    "abs": Function(1, 1, _same("abs({0})")),
    "round": Function(1, 2, _round),
    "ceil": Function(1, 1, _same("ceil({0})", cast=True)),
    "ceiling": Function(1, 1, _same("ceil({0})", cast=True)),
    "floor": Function(1, 1, _same("floor({0})", cast=True)),
    "power": Function(2, 2, _power),
    "random": Function(0, 0, _constant("rand()", DOUBLE)),
    "greatest": Function(1, None, _extreme("greatest")),
    "least": Function(1, None, _extreme("least")),
    "coalesce": Function(1, None, _coalesce),
    "nullif": Function(2, 2, _nullif),
    "date_trunc": Function(2, 2, _date_trunc),
    "date_part": Function(2, 2, _date_part),
    "to_char": Function(2, 2, _to_char),
    **{n: Function(0, 0, _constant("current_timestamp()", Shape(Kind.DATETIMEOFFSET))) for n in ("now", "transaction_timestamp", "statement_timestamp", "clock_timestamp", "current_timestamp")},
    "current_date": Function(0, 0, _constant("current_date()", Shape(Kind.DATE))),
    "localtime": Function(0, 0, _constant("current_time()", Shape(Kind.TIME))),
    "localtimestamp": Function(0, 0, _constant("localtimestamp()", Shape(Kind.DATETIME))),
    "current_user": Function(0, 0, _constant("current_user()", STRING)),
    "current_role": Function(0, 0, _constant("current_user()", STRING)),
    "session_user": Function(0, 0, _constant("session_user()", STRING)),
    "current_catalog": Function(0, 0, _constant("current_catalog()", STRING)),
    "current_schema": Function(0, 0, _constant("current_schema()", STRING)),
}
AGGREGATES = ("count", "sum", "avg", "min", "max")
RANKINGS = ("row_number", "rank", "dense_rank")
OFFSETS = ("lag", "lead", "first_value", "last_value")
__all__ = ["AGGREGATES", "BOOL", "FUNCTIONS", "Function", "OFFSETS", "RANKINGS", "Refused", "common", "date_part"]
