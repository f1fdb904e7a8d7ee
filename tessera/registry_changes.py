"""Registered queries that change data, migrate schemas and map rows, and their SQL.

Each works on snapshots of the driver's tables in a folder of its own.
"""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession

from .api import Engine, Predicate
from .language.schema import Column, Schema, Table
from .mapping import check, column
from .migrations import Migration, Runner, SystemMethod
from .sources.scratch import folder

PLACES = Table("places", (Column("id", "integer", primary_key=True), Column("name", "text"), Column("region", "integer", True, default="9")))
AREAS = Table("areas", (Column("id", "integer", primary_key=True), Column("label", "text")))
NOTES = Table("notes", (Column("id", "integer", primary_key=True, identity=True), Column("body", "text", True, default="'none'"), Column("place", "integer", True)))
_PLACES = "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation"
_AREAS = "SELECT r_regionkey AS id, r_name AS label FROM region"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def store(spark: SparkSession, sf_dir: str) -> Engine:
    """places and areas filled from nation and region, and empty notes."""
    e = Engine(spark, Schema((PLACES, AREAS, NOTES)), root=f"{folder(spark)}/tables-{uuid.uuid4().hex}")
    e.store.write(PLACES, spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS id", "n_name AS name", "n_regionkey AS region"))
    e.store.write(AREAS, spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr("r_regionkey AS id", "r_name AS label"))
    e.store.show(NOTES)
    return e


def _add(name: str, oracle: str, *statements: str, then: str = "SELECT id, name, region FROM places", **values) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = store(spark, sf_dir)
        for s in statements:
            e.execute(s, **values)
        return e.sql(then)

    QUERIES[name], ORACLE_SQL[name] = run, oracle


def _registered(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, oracle
        return f

    return add


# statements
_add("update_from", f"SELECT p.id, CASE WHEN a.id < 2 THEN p.name || '/' || a.label ELSE p.name END AS name, p.region FROM ({_PLACES}) p JOIN ({_AREAS}) a ON a.id = p.region", "UPDATE places AS p SET name = p.name || '/' || a.label FROM areas AS a WHERE a.id = p.region AND a.id < 2")
_add("delete_using", f"SELECT * FROM ({_PLACES}) WHERE region <> 3", "DELETE FROM places AS p USING areas AS a WHERE a.id = p.region AND a.id = 3")
_add("insert_select", f"SELECT * FROM ({_PLACES}) UNION ALL SELECT id + 100, label, id FROM ({_AREAS})", "INSERT INTO places (id, name, region) SELECT id + 100, label, id FROM areas")
_add("insert_default_values", "SELECT 1 AS id, 'none' AS body, NULL::INT AS place UNION ALL SELECT 2, 'none', NULL", "INSERT INTO notes DEFAULT VALUES", "INSERT INTO notes DEFAULT VALUES", then="SELECT id, body, place FROM notes")
_add("insert_identity", f"SELECT row_number() OVER (ORDER BY id)::INT AS id, COUNT(*) OVER () AS n FROM ({_PLACES})", "INSERT INTO notes (body, place) SELECT name, id FROM places", then="SELECT id, COUNT(*) OVER () AS n FROM notes")
_add("insert_do_nothing", f"SELECT * FROM ({_PLACES}) UNION ALL SELECT 100, 'new', 9", "INSERT INTO places (id, name) VALUES (1, 'kept'), (100, 'new') ON CONFLICT (id) DO NOTHING")
_add("insert_do_nothing_without_target", f"SELECT * FROM ({_PLACES}) UNION ALL SELECT 101, 'new', 9", "INSERT INTO places (id, name) VALUES (2, 'kept'), (101, 'new') ON CONFLICT DO NOTHING")
_add("upsert_excluded", f"SELECT id, CASE WHEN id IN (1, 2) THEN name || '+' || ['x', 'y'][id] ELSE name END AS name, region FROM ({_PLACES}) UNION ALL SELECT 100, 'z', 9", "INSERT INTO places (id, name) VALUES (1, 'x'), (2, 'y'), (100, 'z') ON CONFLICT (id) DO UPDATE SET name = places.name || '+' || excluded.name")
_add("update_with_parameters", f"SELECT id, CASE WHEN region = 2 THEN 'two' ELSE name END AS name, region FROM ({_PLACES})", "UPDATE places SET name = @label WHERE region = @region", label="two", region=2)
_add("truncate", "SELECT 0::BIGINT AS n", "TRUNCATE places", then="SELECT COUNT(*) AS n FROM places")
_add("insert_returning", "SELECT 100 AS id, 'A' AS name, 18 AS twice", then="INSERT INTO places (id, name) VALUES (100, 'a') RETURNING id, UPPER(name) AS name, region * 2 AS twice")
_add("update_returning", f"SELECT id, region + 1 AS region FROM ({_PLACES}) WHERE id < 4", then="UPDATE places SET region = region + 1 WHERE id < 4 RETURNING id, region")
_add("delete_returning", f"SELECT id, name FROM ({_PLACES}) WHERE region = 1", then="DELETE FROM places WHERE region = 1 RETURNING id, name")
_add("data_changing_cte", f"SELECT region, COUNT(*) AS n FROM ({_PLACES}) WHERE id < 9 GROUP BY region", then="WITH gone AS (DELETE FROM places WHERE id < 9 RETURNING id, region) SELECT region, COUNT(*) AS n FROM gone GROUP BY region")


@_registered("SELECT 2::BIGINT AS inserted, 5::BIGINT AS updated, 7::BIGINT AS deleted, 20::BIGINT AS at_end")
def affected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = store(spark, sf_dir)
    inserted = e.execute("INSERT INTO places (id, name) VALUES (100, 'a'), (101, 'b')")
    updated = e.execute("UPDATE places SET name = name || '!' WHERE region = 0")
    deleted = e.execute("DELETE FROM places WHERE region = 2 OR region = 9")
    return spark.createDataFrame([(inserted, updated, deleted, e.sql("SELECT id FROM places").count())], "inserted long, updated long, deleted long, at_end long")


# records and named queries
@dataclasses.dataclass
class Place:
    id: int
    name: str
    region: int | None


@_registered(f"SELECT id, CASE WHEN id = 3 THEN 'three' ELSE name END AS name, region FROM ({_PLACES}) WHERE id NOT IN (4, 5) AND region <> 1 UNION ALL SELECT 100, 'hundred', NULL")
def table_record_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = store(spark, sf_dir).table("places")
    t.insert(Place(100, "hundred", None))
    t.update({"id": 3, "name": "three"})
    t.delete({"id": 4})
    t.delete_where(t.id.equal(5))
    t.delete_where(t.region.equal(1))
    return t.query()


@_registered("SELECT 1 AS id, 'a' AS body, 7 AS place UNION ALL SELECT 2, 'b', NULL")
def table_insert_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = store(spark, sf_dir).table("notes")
    rows = [t.insert_returning({"body": "a", "place": 7}, dict), t.insert_returning({"body": "b", "place": None}, dict)]
    return spark.createDataFrame([(r["id"], r["body"], r["place"]) for r in rows], "id int, body string, place int")


@_registered(f"SELECT id, name, region FROM ({_PLACES}) WHERE region IS NOT NULL AND NOT (name LIKE 'A%') AND id NOT IN (1, 2) AND id NOT BETWEEN 7 AND 9")
def table_negated_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = store(spark, sf_dir).table("places")
    p = Predicate.all([t.region.not_equal(None), t.name.not_like("A%"), t.id.not_in(1, 2), t.id.not_between(7, 9)])
    return t.where(p).where(t.region.is_not_null()).query()


@_registered(f"SELECT id, name, region FROM ({_PLACES}) WHERE id = 6")
def named_query_of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    find = store(spark, sf_dir).define("find", "SELECT id, name, region FROM places WHERE id = @id", Place)
    return spark.createDataFrame([dataclasses.astuple(r) for r in find(id=6)], "id int, name string, region int")


@_registered(f"SELECT id, name FROM ({_PLACES}) WHERE region = 2 AND name > 'I'")
def interpolated_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = store(spark, sf_dir)
    return e.format("SELECT {name_id} AS id, name FROM {table} WHERE region = {region} AND name > {after}", name_id=e.names.places.id, table=e.names.places, region=2, after="I").df()


@_registered(f"SELECT name FROM ({_PLACES}) WHERE id % 10 = 3")
def unchecked_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).unchecked("SELECT name FROM places WHERE id % 10 = :rest", rest=3).df


@_registered(f"SELECT name FROM ({_PLACES}) WHERE region = 4")
def scalar_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = store(spark, sf_dir).query("SELECT name FROM places WHERE region = @r").with_parameter("r", 4, "integer").read(str, stream=True)
    return spark.createDataFrame([(n,) for n in names], "name string")


@dataclasses.dataclass
class Renamed:
    key: int = column("id")
    label: str = column("NAME")


@_registered(f"SELECT id AS key, name AS label FROM ({_PLACES})")
def renamed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(spark, sf_dir).table("places").query().select("id", "name")
    from .api import Result

    return spark.createDataFrame([dataclasses.astuple(r) for r in Result(rows).read(Renamed)], "key int, label string")


@_registered("SELECT * FROM (VALUES ('missing', 1::BIGINT), ('nullable', 1), ('fits', 0)) t(what, faults)")
def mapping_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = store(spark, sf_dir)

    @dataclasses.dataclass
    class Strict:
        id: int
        region: int

    found = lambda sql, into: len(check(e.checked(sql).columns, into))
    rows = [("missing", found("SELECT id FROM places", Strict)), ("nullable", found("SELECT id, region FROM places", Strict)), ("fits", found("SELECT id, name, region FROM places", Place))]
    return spark.createDataFrame(rows, "what string, faults long")


@_registered("SELECT * FROM (VALUES ('number', true), ('list', true), ('missing', true), ('extra', true), ('twice', true)) t(what, refused)")
def parameter_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, sql = store(spark, sf_dir), "SELECT id FROM places WHERE id = @id AND region = ANY(@regions)"

    def refused(f) -> bool:
        try:
            f()
        except (TypeError, ValueError):
            return True
        return False

    rows = [
        ("number", refused(lambda: e.sql(sql, id="x", regions=[1]))),
        ("list", refused(lambda: e.sql(sql, id=1, regions=2))),
        ("missing", refused(lambda: e.sql(sql, id=1))),
        ("extra", refused(lambda: e.sql(sql, id=1, regions=[1], more=2))),
        ("twice", refused(lambda: e.query(sql).with_parameter("id", 1).with_parameter("@id", 2))),
    ]
    return spark.createDataFrame(rows, "what string, refused boolean")


# migrations
class _Create(Migration):
    version = 10

    def up(self):
        t = self.create.table("members").in_schema("club").with_column("id").as_int32().primary_key()
        t.with_column("mail").as_string(200).unique()
        self.insert.into_table("members").in_schema("club").row(id=1, mail="one").row(id=2, mail="two").row(id=3, mail="it's")

    def down(self):
        self.delete.table("members").in_schema("club")


class _Extend(Migration):
    version = 20

    def up(self):
        self.execute.sql("ALTER TABLE club.members ADD COLUMN label varchar(80); UPDATE club.members SET label = UPPER(mail) WHERE id < 3; CREATE INDEX i ON club.members (mail);")
        self.alter.table("members").in_schema("club").add_column("points").as_int32().set_existing_rows_to(7)
        self.delete.from_table("members").in_schema("club").row(id=3)

    def down(self):
        self.delete.column("label", "points").from_table("members").in_schema("club")


class _Reshape(Migration):
    version = 30

    def up(self):
        self.rename.column("mail").on_table("members").in_schema("club").to("address")
        self.execute.sql("ALTER TABLE club.members ALTER COLUMN points TYPE bigint; ALTER TABLE club.members ALTER COLUMN label SET DEFAULT 'x'")
        self.create.column("since").on_table("members").in_schema("club").as_datetime_offset().with_default(SystemMethod.NOW)
        self.if_database("mysql").create.table("never").with_column("x").as_int32()

    def down(self):
        self.execute.sql("ALTER TABLE club.members DROP COLUMN since; ALTER TABLE club.members RENAME COLUMN address TO mail; ALTER TABLE club.members ALTER COLUMN points TYPE integer USING points::integer")


STEPS = [_Create, _Extend, _Reshape]


def _runner(spark: SparkSession) -> Runner:
    return Runner(spark, f"{folder(spark)}/club-{uuid.uuid4().hex}", STEPS)


@_registered("SELECT * FROM (VALUES (1, 'one', 'ONE', 7::BIGINT, true), (2, 'two', 'TWO', 7, true)) t(id, address, label, points, dated)")
def migrate_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runner(spark)
    r.up()
    return r.engine().sql("SELECT id, address, label, points, since IS NOT NULL AS dated FROM club.members")


@_registered("SELECT * FROM (VALUES (1, 'one'), (2, 'two')) t(id, mail)")
def migrate_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runner(spark)
    r.up()
    r.down(10)
    return r.engine().sql("SELECT * FROM club.members")


@_registered("SELECT * FROM (VALUES (1, 'one', NULL::VARCHAR, 7), (2, 'two', NULL, 7), (9, 'nine', NULL, 7)) t(id, mail, label, points) WHERE id < 9")
def migrate_up_down_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runner(spark)
    r.up()
    r.down(0)
    r.up(20)
    return r.engine().sql("SELECT id, mail, NULLIF(label, UPPER(mail)) AS label, points FROM club.members")


@_registered("SELECT * FROM (VALUES (10::BIGINT, '_Create', true), (20, '_Extend', true), (30, '_Reshape', false)) t(version, name, applied)")
def migration_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runner(spark)
    r.up(20)
    return r.status().select("version", "name", "applied")


@_registered("SELECT * FROM (VALUES ('up', 10::BIGINT, 0::BIGINT), ('down', 3, 3)) t(way, statements, applied)")
def migration_dry_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runner(spark)
    rows = [("up", len(r.dry_run_up(20).statements), len(r.applied()))]
    r.up()
    rows.append(("down", len(r.dry_run_down(20).statements), len(r.applied())))
    return spark.createDataFrame(rows, "way string, statements long, applied long")


@_registered("SELECT * FROM (VALUES (0, 'id', 'integer', false, true), (1, 'address', 'varchar(200)', false, false), (2, 'label', 'varchar(80)', true, false), (3, 'points', 'bigint', false, false), (4, 'since', 'timestamptz', false, false)) t(place, name, type, nullable, is_key)")
def migrated_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    [t] = json.loads(_runner(spark).schema_at().to_json())["tables"]
    rows = [(i, c["name"], c["type"], c["nullable"], c["primaryKey"]) for i, c in enumerate(t["columns"])]
    return spark.createDataFrame(rows, "place int, name string, type string, nullable boolean, is_key boolean")


@_registered("SELECT * FROM (VALUES ('id', 'integer', false), ('code', 'varchar(90)', true), ('note', 'bigint', true)) t(name, type, nullable)")
def replayed_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .migrations import replay

    schema = replay(
        """CREATE TABLE depot.parcels (id integer PRIMARY KEY, ref varchar(90) NOT NULL, gone text, CHECK (id > 0));
        COMMENT ON TABLE depot.parcels IS 'a; b'; /* ; */ ALTER TABLE depot.parcels ADD COLUMN note numeric(10, 2), ALTER ref DROP NOT NULL, DROP COLUMN gone;
        ALTER TABLE depot.parcels RENAME COLUMN ref TO code; ALTER TABLE depot.parcels ALTER COLUMN note TYPE bigint USING note::bigint;"""
    )
    return spark.createDataFrame([(c.name, c.type, c.nullable) for c in schema.tables[0].columns], "name string, type string, nullable boolean")
