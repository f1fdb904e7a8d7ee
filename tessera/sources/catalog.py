"""Where tables live: Parquet files, versioned snapshots, other databases."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..language.dialects import POSTGRESQL, Dialect
from ..language.schema import Schema, Table, table_of

_VERSION = re.compile(r"v(\d{8})\Z")


def struct_of(table: Table, dialect: Dialect = POSTGRESQL) -> StructType:
    """A table's columns as Spark reads them; keys and spellings go into the metadata."""
    fields = []
    for c in table.columns:
        shape = dialect.type_of(c.type)
        if shape is None:
            raise ValueError(f"the type {c.type} of {table.name}.{c.name} is not supported")
        kind = StructType.fromDDL(f"x {shape.spark()}")[0].dataType
        meta = {"type": c.type, "primaryKey": c.primary_key, "identity": c.identity} | ({"default": c.default} if c.default else {}) | ({"comment": c.comment} if c.comment else {})
        fields.append(StructField(c.name, kind, True, meta))
    return StructType(fields)


def parquet_schema(spark: SparkSession, folder: str, names: list[str]) -> Schema:
    """Register ``folder``/<name>.parquet as views and read their schema off the files."""
    tables = []
    for name in names:
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        df.createOrReplaceTempView(name)
        tables.append(table_of(name, df.schema))
    return Schema(tuple(tables))


def jdbc_table(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A table of another database; its driver has to be on Spark's class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    return reader.options(**options).load()


class SnapshotStore:
    """Tables as directories of versions; a version is complete or not there.

    A change writes the table's next version beside the last one and moves it to
    its name in one rename.  Readers keep the version that they began with.
    """

    def __init__(self, spark: SparkSession, root: str, dialect: Dialect = POSTGRESQL):
        self.spark, self.root, self.dialect = spark, root.rstrip("/"), dialect
        self._path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def folder(self, table: Table) -> str:
        return f"{self.root}/{table.view}"

    def versions(self, table: Table) -> list[int]:
        folder = self._path(self.folder(table))
        if not self._fs.exists(folder):
            return []
        found = (_VERSION.match(s.getPath().getName()) for s in self._fs.listStatus(folder))
        return sorted(int(m[1]) for m in found if m)

    def read(self, table: Table, version: int | None = None) -> DataFrame:
        have = self.versions(table)
        struct = struct_of(table, self.dialect)
        if not have:
            return self.spark.createDataFrame([], struct)
        version = have[-1] if version is None else version
        return self.spark.read.schema(struct).parquet(f"{self.folder(table)}/v{version:08d}")

    def write(self, table: Table, df: DataFrame) -> int:
        """Commit ``df`` as the table's next version and make the view show it."""
        have = self.versions(table)
        version = have[-1] + 1 if have else 1
        struct = struct_of(table, self.dialect)
        columns = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in struct.fields]
        temporary = f"{self.folder(table)}/.{uuid.uuid4().hex}"
        df.select(*columns).write.parquet(temporary)
        final = self._path(f"{self.folder(table)}/v{version:08d}")
        if self._fs.exists(final) or not self._fs.rename(self._path(temporary), final):
            self._fs.delete(self._path(temporary), True)
            raise RuntimeError(f"version {version} of {table.name} exists")
        self.show(table)
        return version

    def show(self, table: Table) -> None:
        self.read(table).createOrReplaceTempView(table.view)

    def drop(self, table: Table) -> None:
        self._fs.delete(self._path(self.folder(table)), True)
        self.spark.catalog.dropTempView(table.view)

    def rename(self, table: Table, new: Table) -> None:
        """Move a table's versions to another name."""
        if self._fs.exists(self._path(self.folder(table))):
            self._fs.rename(self._path(self.folder(table)), self._path(self.folder(new)))
        self.spark.catalog.dropTempView(table.view)
        self.show(new)
