"""Schema changes: DDL scripts, a fluent builder, a runner with a history."""

from .builder import Migration, RawSql, SystemMethod
from .ddl import MigrationError, replay
from .runner import Runner
from .scripts import scripts

__all__ = ["Migration", "MigrationError", "RawSql", "Runner", "SystemMethod", "replay", "scripts"]
