"""Runs migrations over snapshot tables and keeps their history.

Columns that only arrive empty or leave cost no rewrite: Parquet files are read
by the table's present schema.  All else is one declarative query per table,
committed as its next version.  A migration that fails is undone step by step;
those before it stay.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Engine
from ..language.checker import Checker, quote
from ..language.dialects import POSTGRESQL, Dialect
from ..language.schema import Column, Schema, Table
from .builder import Migration
from .ddl import AddColumn, AddKey, AlterType, Call, CreateTable, Data, DropColumn, DropTable, IfTable, MigrationError, MoveTable, RenameColumn, RenameTable, SetNullable, apply, find, sql_of


@dataclass(frozen=True)
class DryRun:
    statements: list[str]
    schema: Schema


class Runner:
    def __init__(self, spark: SparkSession, root: str, migrations: list[type[Migration]], *, dialect: Dialect = POSTGRESQL, history: str = "__tessera_migrations"):
        self.spark, self.root, self.dialect = spark, root, dialect
        self.migrations = sorted(migrations, key=lambda m: m.version)
        for a, b in zip(self.migrations, self.migrations[1:]):
            if a.version == b.version:
                raise MigrationError(f"version {a.version} is used by both {a.__name__} and {b.__name__}")
        self.history = Table(history, (Column("version", "bigint", primary_key=True), Column("name", "text"), Column("applied_at", "timestamptz")))
        self.store = Engine(spark, Schema(), root, dialect).store

    # what is known without running anything

    def schema_at(self, version: int | None = None) -> Schema:
        """The schema after all migrations up to a version (None: all)."""
        schema = Schema()
        for m in self.migrations:
            if version is None or m.version <= version:
                for op in m().collect(True, self.dialect.name):
                    schema = apply(schema, op, self.dialect)
        return schema

    def applied(self) -> list[int]:
        """Applied versions, which have to be the first of the catalog in its order."""
        have = sorted(r[0] for r in self.store.read(self.history).select("version").collect())
        known = [m.version for m in self.migrations]
        if have != known[: len(have)]:
            raise MigrationError(f"the history {have} is not a beginning of the catalog {known}")
        return have

    def status(self) -> DataFrame:
        """version, name, applied, applied_at of each migration."""
        self.applied()
        rows = [(m.version, m.__name__) for m in self.migrations]
        catalog = self.spark.createDataFrame(rows, "version long, name string")
        done = self.store.read(self.history).select("version", "applied_at")
        return catalog.join(done, "version", "left").select("version", "name", F.col("applied_at").isNotNull().alias("applied"), "applied_at").orderBy("version")

    def engine(self) -> Engine:
        """An engine over the schema that is applied."""
        have = self.applied()
        schema = self.schema_at(have[-1]) if have else Schema()
        for t in schema.tables:
            self.store.show(t)
        return Engine(self.spark, schema, self.root, self.dialect)

    def _upward(self, target: int | None) -> list[type[Migration]]:
        have = set(self.applied())
        return [m for m in self.migrations if m.version not in have and (target is None or m.version <= target)]

    def _downward(self, target: int) -> list[type[Migration]]:
        have = set(self.applied())
        if target and target not in {m.version for m in self.migrations}:
            raise MigrationError(f"there is no version {target}")
        back = [m for m in reversed(self.migrations) if m.version in have and m.version > target]
        for m in back:
            if m.forward_only():
                raise MigrationError(f"{m.__name__} cannot be taken back")
        return back

    def _dry(self, steps: list[type[Migration]], up: bool) -> DryRun:
        have = self.applied()
        schema, texts = self.schema_at(have[-1]) if have else Schema(), []
        for m in steps:
            for op in m().collect(up, self.dialect.name):
                schema = apply(schema, op, self.dialect)
                texts.append(sql_of(op) or "-- a function of the migration")
        return DryRun(texts, schema)

    def dry_run_up(self, target: int | None = None) -> DryRun:
        return self._dry(self._upward(target), True)

    def dry_run_down(self, target: int) -> DryRun:
        return self._dry(self._downward(target), False)

    # running

    def up(self, target: int | None = None) -> list[int]:
        return [self._run(m, True) for m in self._upward(target)]

    def down(self, target: int = 0) -> list[int]:
        return [self._run(m, False) for m in self._downward(target)]

    def _run(self, m: type[Migration], up: bool) -> int:
        engine, undo = self.engine(), []
        try:
            for op in m().collect(up, self.dialect.name):
                self._step(engine, op, undo)
            done = self.store.read(self.history)
            if up:
                done = done.unionByName(self.spark.sql(f"SELECT CAST({m.version} AS BIGINT) AS version, '{m.__name__}' AS name, current_timestamp() AS applied_at"))
            else:
                done = done.where(F.col("version") != m.version)
            self.store.write(self.history, done.coalesce(1))
        except BaseException:
            for back in reversed(undo):
                back()
            raise
        return m.version

    def _write(self, table: Table, df: DataFrame, undo: list) -> None:
        version = self.store.write(table, df)
        undo.append(lambda: self._forget(table, version))

    def _forget(self, table: Table, version: int) -> None:
        self.store._fs.delete(self.store._path(f"{self.store.folder(table)}/v{version:08d}"), True)

    def _move(self, a: str, b: str, undo: list) -> None:
        fs, path = self.store._fs, self.store._path
        if fs.exists(path(a)):
            fs.mkdirs(path(b).getParent())
            if not fs.rename(path(a), path(b)):
                raise MigrationError(f"{a} cannot be moved to {b}")
            undo.append(lambda: fs.rename(path(b), path(a)))

    def _step(self, engine: Engine, op, undo: list) -> None:
        """Take one operation: first what it does to rows, then to the schema."""
        if isinstance(op, IfTable):
            return self._step(engine, op.then, undo) if engine.schema.find(op.table.name, op.table.schema) else None
        if isinstance(op, Call):
            return op.function(engine)
        if isinstance(op, Data):
            before = {t: self.store.versions(t) for t in engine.schema.tables}
            undo.append(lambda: [self._forget(t, v) for t, had in before.items() for v in self.store.versions(t) if v not in had])
            engine.checked(op.sql)
            if op.sql.split(None, 1)[0].lower() in ("insert", "update", "delete", "truncate") or " into " in op.sql.lower():
                engine.execute(op.sql)
            return None
        old, new = engine.schema, apply(engine.schema, op, self.dialect)
        if isinstance(op, CreateTable) and new is not old:
            self._write(new.tables[-1], self.store.read(new.tables[-1]), undo)
        elif isinstance(op, DropTable):
            for t in old.tables:
                if t not in new.tables:
                    self._move(self.store.folder(t), f"{self.root}/.dropped/{uuid.uuid4().hex}", undo)
                    self.spark.catalog.dropTempView(t.view)
        elif isinstance(op, (RenameTable, MoveTable)):
            t = find(old, op.table)
            renamed = next(x for x in new.tables if x not in old.tables)
            self._move(self.store.folder(t), self.store.folder(renamed), undo)
            self.spark.catalog.dropTempView(t.view)
            self.store.show(renamed)
        elif new is not old and hasattr(op, "table"):
            t = find(old, op.table)
            self._rows(t, find(new, op.table), op, engine, undo)
            self.store.show(find(new, op.table))
        engine.schema = new

    def _rows(self, t: Table, new: Table, op, engine: Engine, undo: list) -> None:
        df = self.store.read(t)
        if isinstance(op, AddColumn):
            c, shape = op.column, self.dialect.type_of(op.column.type)
            have = self.store.versions(t)
            files = self.spark.read.parquet(f"{self.store.folder(t)}/v{have[-1]:08d}").columns if have else []
            value = op.existing or c.default
            if value is not None or c.identity or c.name.lower() in {f.lower() for f in files}:
                made = F.monotonically_increasing_id() + 1 if c.identity else F.expr(Checker(Schema(), self.dialect).default_sql(Column(c.name, c.type, True, default=value), shape)) if value is not None else F.lit(None)
                self._write(new, df.withColumn(c.name, made.cast(shape.spark())), undo)
            elif not c.nullable and not df.isEmpty():
                raise MigrationError(f"{t.name} has rows and the new column {c.name} no value for them")
        elif isinstance(op, RenameColumn):
            self._write(new, df.withColumnRenamed(t.column(op.column).name, op.to), undo)
        elif isinstance(op, AlterType):
            c = t.column(op.column)
            kind = self.dialect.type_of(op.type).spark()
            if op.using:
                others = ", ".join('"' + x.name + '"' for x in t.columns if x is not c)
                made = engine.sql(f'SELECT {others}{", " if others else ""}({op.using}) AS "{c.name}" FROM {op.table}')
                self._write(new, made, undo)
            elif kind != self.dialect.type_of(c.type).spark():
                self._write(new, df.withColumn(c.name, F.col(quote(c.name)).cast(kind)), undo)
        elif isinstance(op, (SetNullable, AddKey)) and not getattr(op, "nullable", False):
            names = [op.column] if isinstance(op, SetNullable) else op.columns
            for n in names:
                if not df.where(F.col(quote(n)).isNull()).isEmpty():
                    raise MigrationError(f"{t.name}.{n} has nulls")
            if isinstance(op, AddKey) and not df.groupBy(*map(quote, names)).count().where("count > 1").isEmpty():
                raise MigrationError(f"the key of {t.name} is not unique")
        elif isinstance(op, DropColumn) and len(new.columns) == 0:
            raise MigrationError(f"{t.name} would have no column")
