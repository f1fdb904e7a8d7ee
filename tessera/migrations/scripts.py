"""Migrations that are SQL files of a folder, V<version>__<description>.sql."""

from __future__ import annotations

import re
from pathlib import Path

from .builder import Migration
from .ddl import MigrationError

_NAME = re.compile(r"V(\d+)__(\w+)\.sql\Z")


def scripts(folder: str) -> list[type[Migration]]:
    """A forward-only migration for each script of ``folder``, by version; other files are no migrations."""
    found: dict[int, type[Migration]] = {}
    for path in sorted(Path(folder).iterdir()):
        if not (m := _NAME.match(path.name)):
            continue
        version = int(m[1])
        if version in found or not version:
            raise MigrationError(f"{path.name}: version {version} is {'used twice' if version else 'no version'}")
        found[version] = type(m[2], (Migration,), {"version": version, "up": _runs(str(path)), "__doc__": path.name})
    return [found[v] for v in sorted(found)]


def _runs(path: str):
    return lambda migration: migration.execute.script(path)
