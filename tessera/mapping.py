"""From result rows to Python objects."""

from __future__ import annotations

import dataclasses
import re
import types
import typing
from collections.abc import Callable

#: Converters of target types: a callable from a column's value.
CONVERTERS: dict[type, Callable] = {}
SCALARS = (int, float, str, bool, bytes)


class MappingError(ValueError):
    """Rows do not fit the type that they are to become."""


def normal(name: str) -> str:
    """A name without case and punctuation."""
    return re.sub(r"[^0-9a-z]", "", name.lower())


def column(name: str, **kwargs):
    """A dataclass field that takes the column ``name``."""
    return dataclasses.field(metadata={"column": name}, **kwargs)


def _optional(hint) -> bool:
    return hint is None or typing.get_origin(hint) in (typing.Union, types.UnionType) and type(None) in typing.get_args(hint) or hint is typing.Any


def _target(hint):
    args = [a for a in typing.get_args(hint) if a is not type(None)]
    return args[0] if _optional(hint) and args else hint


def _converted(value, hint, name: str):
    if value is None:
        if not _optional(hint):
            raise MappingError(f"{name} takes no NULL")
        return None
    target = _target(hint)
    if typing.get_origin(target) is list:
        inner = typing.get_args(target)[0]
        return [_converted(v, inner, name) for v in value]
    if target in CONVERTERS:
        return CONVERTERS[target](value)
    if isinstance(target, type) and not isinstance(value, target):
        if target is float and isinstance(value, int):
            return float(value)
        raise MappingError(f"{name} takes {target.__name__}, not {type(value).__name__}")
    return value


def mapper(names: tuple[str, ...], into) -> Callable:
    """A function from a row's values to ``into``: a dataclass, a scalar type or a callable."""
    if dataclasses.is_dataclass(into):
        hints = typing.get_type_hints(into)
        fields = [f for f in dataclasses.fields(into) if f.init]
        own = [normal(n) for n in names]
        if len(set(own)) != len(own):
            raise MappingError("several columns have the same name")
        wanted = {f.name: normal(f.metadata.get("column", f.name)) for f in fields}
        missing = [f.name for f in fields if wanted[f.name] not in own and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
        extra = set(own) - set(wanted.values())
        if missing or extra:
            raise MappingError(f"columns and members do not fit together: {', '.join([*missing, *sorted(extra)])}")
        places = [(f.name, own.index(wanted[f.name]), hints[f.name]) for f in fields if wanted[f.name] in own]
        return lambda values: into(**{name: _converted(values[i], hint, name) for name, i, hint in places})
    if into in SCALARS or into in CONVERTERS or typing.get_origin(into) is not None:
        if len(names) != 1:
            raise MappingError("a scalar needs one column")
        return lambda values: _converted(values[0], into, names[0])
    if callable(into):
        return lambda values: into(dict(zip(names, values)))
    raise MappingError(f"{into!r} cannot be made from rows")


def check(columns, into) -> list[str]:
    """What in an analysis' columns does not fit ``into``, before anything runs."""
    try:
        mapper(tuple(c.name for c in columns), into)
    except MappingError as e:
        return [str(e)]
    if not dataclasses.is_dataclass(into):
        return []
    hints = typing.get_type_hints(into)
    by_name = {normal(f.metadata.get("column", f.name)): hints[f.name] for f in dataclasses.fields(into)}
    return [f"{c.name} may be NULL" for c in columns if c.nullable and not _optional(by_name.get(normal(c.name)))]
