"""Data changes as new snapshots of their tables (copy on write).

Each change is one declarative query over the old snapshot; its affected rows
are marked in the same pass and written with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..language.checker import Change, quote
from ..language.schema import Table
from ..sources.catalog import SnapshotStore, struct_of

ROW, HIT = "__row", "__hit"


@dataclass
class Outcome:
    count: int
    rows: DataFrame | None  # RETURNING


class ConstraintError(ValueError):
    """Rows that a key or NOT NULL of their table does not allow; nothing was written."""


class Changer:
    def __init__(self, spark: SparkSession, store: SnapshotStore):
        self.spark, self.store = spark, store
        # views of this change alone: results are lazy and other engines share the session
        self.old, self.new, self.out = (f"__{x}_{_token()}" for x in ("old", "new", "returned"))

    def run(self, change: Change, args: dict) -> Outcome:
        self.args, self.with_ = args, f"WITH {', '.join(change.ctes)} " if change.ctes else ""
        if change.kind == "truncate":
            n = 0
            for t in change.tables:
                n += self.store.read(t).count()
                self.store.write(t, self.spark.createDataFrame([], struct_of(t, self.store.dialect)))
            return Outcome(n, None)
        return getattr(self, change.kind)(change)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(self.with_ + text, args=self.args) if self.args else self.spark.sql(self.with_ + text)

    def frozen(self, df: DataFrame) -> DataFrame:
        """``df`` computed once, so that what is counted and returned is what was written."""
        path = f"{self.store.root}/.changes/{_token()}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def returned(self, change: Change, rows: DataFrame) -> DataFrame | None:
        if not change.returning:
            return None
        rows.createOrReplaceTempView(self.out)
        listed = ", ".join(f"{sql} AS {quote(name)}" for name, sql in change.returning)
        text = f"SELECT {listed} FROM {self.out} AS {quote(change.alias)}"
        return self.spark.sql(text, args=self.args) if self.args else self.spark.sql(text)

    def allowed(self, table: Table, rows: DataFrame, columns=None) -> None:
        """Refuse ``rows`` with NULL in a column (of ``columns``) that takes none."""
        strict = [c.name for c in table.columns if not c.nullable and (columns is None or c.name in columns)]
        if strict:
            counts = rows.agg(*[F.count_if(F.col(quote(c)).isNull()).alias(c) for c in strict]).first()
            if bad := [c for c in strict if counts[c]]:
                raise ConstraintError(f"{table.name}.{bad[0]} takes no NULL")

    def unique(self, table: Table, rows: DataFrame, keys, what: str = "the key of {} is not unique") -> None:
        if keys and not rows.groupBy(*[quote(k) for k in keys]).count().where("count > 1").isEmpty():
            raise ConstraintError(what.format(table.name))

    # INSERT

    def complete(self, change: Change) -> DataFrame:
        """The rows to insert with all columns: given ones, identities, defaults."""
        table, struct = change.table, struct_of(change.table, self.store.dialect)
        given = {c.lower() for c in change.columns}
        rows = self.sql(change.query) if change.query else self.spark.range(1)
        from ..language.checker import Checker
        from ..language.schema import Schema

        columns = []
        for f in struct.fields:
            c = table.column(f.name)
            if f.name.lower() in given:
                columns.append(F.col(quote(f.name)).cast(f.dataType).alias(f.name))
            elif c.identity or c.type.lower() in ("serial", "bigserial", "smallserial"):
                top = self.store.read(table).agg(F.coalesce(F.max(quote(f.name)), F.lit(0))).first()[0]
                rows, nth = self.counted(rows)
                columns.append((nth + F.lit(int(top))).cast(f.dataType).alias(f.name))
            else:
                shape = self.store.dialect.type_of(c.type)
                columns.append(F.expr(Checker(Schema(), self.store.dialect).default_sql(c, shape)).alias(f.name))
        return rows.select(*columns)

    def counted(self, rows: DataFrame) -> tuple[DataFrame, Column]:
        """``rows`` written, and the place of each from 1 on: the rows of the parts before its own and its place there."""
        if ROW not in rows.columns:
            rows = self.frozen(rows.withColumn(ROW, F.monotonically_increasing_id()))
        part = F.shiftright(ROW, 33)
        ahead, total = [], 0
        for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():  # a number for each task
            ahead += [F.lit(r["part"]), F.lit(total)]
            total += r["count"]
        before = F.element_at(F.create_map(*ahead), part) if ahead else F.lit(0)
        return rows, before + F.col(ROW).bitwiseAND((1 << 33) - 1) + 1

    def insert(self, change: Change) -> Outcome:
        table = change.table
        old, new = self.store.read(table), self.frozen(self.complete(change))
        self.allowed(table, new)
        keys = change.conflict or (table.key if change.conflict is not None else None)
        if not keys:
            if table.key:
                self.unique(table, new, table.key)
                if not old.join(new.select(*map(quote, table.key)), list(table.key), "left_semi").isEmpty():
                    raise ConstraintError(f"the key of {table.name} is not unique")
            self.store.write(table, old.unionByName(new))
            return Outcome(new.count(), self.returned(change, new))
        if change.conflict_set is not None:
            self.unique(table, new, keys, "two new rows of {} have the same key")
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(f"t.{quote(k)}") == F.col(f"e.{quote(k)}"))
        fresh = new.alias("e").join(old.alias("t"), same, "left_anti")
        first = Window.partitionBy(*[quote(k) for k in keys]).orderBy(F.lit(1))
        fresh = fresh.withColumn(ROW, F.row_number().over(first)).where(f"{ROW} = 1").drop(ROW)  # one of the new rows of a key
        if change.conflict_set is None:
            fresh = self.frozen(fresh)
            self.store.write(table, old.unionByName(fresh))
            return Outcome(fresh.count(), self.returned(change, fresh))
        old.createOrReplaceTempView(self.old)
        new.withColumn(HIT, F.lit(True)).createOrReplaceTempView(self.new)
        alias = quote(change.alias)
        on = " AND ".join(f"{alias}.{quote(k)} = excluded.{quote(k)}" for k in keys)
        met = f"excluded.{HIT} IS NOT NULL" + (f" AND coalesce({change.conflict_where}, false)" if change.conflict_where else "")
        cells = [f"CASE WHEN {met} THEN {change.conflict_set[c.name]} ELSE {alias}.{quote(c.name)} END AS {quote(c.name)}" if c.name in change.conflict_set else f"{alias}.{quote(c.name)} AS {quote(c.name)}" for c in table.columns]
        merged = self.sql(f"SELECT {', '.join(cells)}, coalesce({met}, false) AS {HIT} FROM {self.old} AS {alias} LEFT JOIN {self.new} AS excluded ON {on}")
        after = self.frozen(merged.unionByName(fresh.withColumn(HIT, F.lit(True))))
        self.allowed(table, after, change.conflict_set)
        self.store.write(table, after.drop(HIT))
        hit = after.where(HIT).drop(HIT)
        return Outcome(hit.count(), self.returned(change, hit))

    # UPDATE and DELETE

    def numbered(self, table: Table) -> DataFrame:
        """The table with a number on each row, which survives recomputation."""
        return self.frozen(self.store.read(table).withColumn(ROW, F.monotonically_increasing_id()))

    def update(self, change: Change) -> Outcome:
        table, alias = change.table, quote(change.alias)
        where = change.where or "true"
        new = {c.name: change.assignments.get(c.name) for c in table.columns}
        if not change.sources:
            self.store.read(table).createOrReplaceTempView(self.old)
            cells = [f"CASE WHEN coalesce({where}, false) THEN {v} ELSE {alias}.{quote(c)} END AS {quote(c)}" if v else f"{alias}.{quote(c)} AS {quote(c)}" for c, v in new.items()]
            after = self.frozen(self.sql(f"SELECT {', '.join(cells)}, coalesce({where}, false) AS {HIT} FROM {self.old} AS {alias}"))
        else:
            old = self.numbered(table)
            old.createOrReplaceTempView(self.old)
            cells = [f"{v or f'{alias}.{quote(c)}'} AS {quote(c)}" for c, v in new.items()]
            met = self.sql(f"SELECT {alias}.{ROW} AS {ROW}, {', '.join(cells)} FROM {self.old} AS {alias} CROSS JOIN {change.sources.removeprefix(' FROM ')} WHERE {where}")
            one = self.frozen(met.dropDuplicates([ROW]))  # of several matches any one counts
            rest = old.join(one.select(ROW), ROW, "left_anti")
            after = self.frozen(one.withColumn(HIT, F.lit(True)).unionByName(rest.withColumn(HIT, F.lit(False))).drop(ROW))
        self.allowed(table, after, change.assignments)
        if set(table.key) & set(change.assignments):
            self.unique(table, after, table.key)
        self.store.write(table, after.drop(HIT))
        hit = after.where(HIT).drop(HIT)
        return Outcome(hit.count(), self.returned(change, hit))

    def delete(self, change: Change) -> Outcome:
        table, alias = change.table, quote(change.alias)
        where = change.where or "true"
        self.store.read(table).createOrReplaceTempView(self.old)
        if change.sources:
            where = f"EXISTS (SELECT 1{change.sources} WHERE {where})"
        after = self.frozen(self.sql(f"SELECT {alias}.*, coalesce({where}, false) AS {HIT} FROM {self.old} AS {alias}"))
        self.store.write(table, after.where(~F.col(HIT)).drop(HIT))
        hit = after.where(HIT).drop(HIT)
        return Outcome(hit.count(), self.returned(change, hit))


def _token() -> str:
    import uuid

    return uuid.uuid4().hex
