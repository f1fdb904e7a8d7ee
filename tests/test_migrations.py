"""DDL scripts, the builder and the runner."""

import pytest

from tessera.language.diagnostics import QueryError
from tessera.migrations import Migration, MigrationError, Runner, SystemMethod, replay, scripts
from tessera.migrations.ddl import Neutral, classify, operations_of, split


def _columns(schema, name):
    return [(c.name, c.type, c.nullable) for c in schema.find(name)[0].columns]


def test_split_keeps_quotes_and_comments_together():
    text = "SELECT ';'; -- a;b\nCREATE FUNCTION f() AS $x$ a; b $x$; /* c; /* d; */ */ SELECT \"a;b\";"
    assert [s.split()[-1] for s, _ in split(text)] == ["';'", "$x$", '"a;b"']


@pytest.mark.parametrize("text,kind", [("create table t (a int)", "table"), ("/* x */ DROP TABLE t", "table"), ("CREATE UNIQUE INDEX i ON t (a)", "neutral"), ("with a as (select 1) select 1", "data"), ("CREATE VIEW v AS SELECT 1", "unsupported")])
def test_classify(text, kind):
    assert classify(text) == kind


def test_replay():
    schema = replay(
        """CREATE TABLE depot.parcels (id integer PRIMARY KEY, ref varchar(90) NOT NULL, tags text[], CHECK (id > 0), UNIQUE (ref));
        ALTER TABLE depot.parcels ADD COLUMN note numeric(10, 2) DEFAULT 1.5, ALTER ref DROP NOT NULL, ADD CONSTRAINT c CHECK (id > 1);
        ALTER TABLE depot.parcels RENAME COLUMN ref TO code; ALTER TABLE depot.parcels ALTER COLUMN note TYPE bigint USING note::bigint;
        ALTER TABLE IF EXISTS nobody ADD a int; CREATE INDEX i ON depot.parcels (code); DROP TABLE IF EXISTS nobody;"""
    )
    assert _columns(schema, "parcels") == [("id", "integer", False), ("code", "varchar(90)", True), ("tags", "text[]", True), ("note", "bigint", True)]
    assert schema.tables[0].key == ("id",) and schema.tables[0].column("note").default == "1.5"


@pytest.mark.parametrize(
    "script,code",
    [
        ("CREATE TABLE t (a int); CREATE TABLE t (a int)", "DDL200"),
        ("DROP TABLE t", "DDL201"),
        ("ALTER TABLE t ADD a int", "DDL202"),
        ("CREATE TABLE t (a int, A int)", "DDL203"),
        ("CREATE TABLE t (a int); ALTER TABLE t DROP b", "DDL204"),
        ("CREATE TABLE t (a int, PRIMARY KEY (b))", "DDL204"),
        ("CREATE TABLE t (a no_type)", "DDL205"),
        ("CREATE TABLE t (a int PRIMARY KEY, PRIMARY KEY (a))", "DDL206"),
        ("CREATE TABLE t (a int PRIMARY KEY); ALTER TABLE t ALTER a DROP NOT NULL", "DDL206"),
        ("CREATE TABLE x.t (a int); CREATE TABLE y.t (a int); ALTER TABLE t ADD b int", "DDL207"),
        ("CREATE TABLE t ()", "DDL208"),
        ("CREATE VIEW v AS SELECT 1", "DDL300"),
        ("CREATE TABLE x.t (a int); DROP SCHEMA x CASCADE", "DDL300"),
        ("CREATE FUNCTION f() RETURNS int AS $$ SELECT 1; $$", "DDL300"),
        ("CREATE TABLE t (a", "DDL001"),
        ("SELECT 'a", "DDL001"),
        (None, "DDL000"),
    ],
)
def test_codes(script, code):
    with pytest.raises(QueryError) as found:
        replay(script)
    assert found.value.diagnostics[0].code == code


class First(Migration):
    version = 10

    def up(self):
        t = self.create.table("parcels").in_schema("depot").with_column("id").as_int32().primary_key()
        t.with_column("ref").as_string(90).unique()
        self.insert.into_table("parcels").in_schema("depot").row(id=1, ref="a'b").row(id=2, ref="c")
        self.if_database("mysql").create.table("never").with_column("x").as_int32()

    def down(self):
        self.delete.table("parcels").in_schema("depot")


class Second(Migration):
    version = 20

    def up(self):
        self.execute.sql("ALTER TABLE depot.parcels ADD COLUMN title varchar(60)")
        self.alter.table("parcels").in_schema("depot").add_column("score").as_int64().set_existing_rows_to(7)
        self.create.column("made").on_table("parcels").in_schema("depot").as_datetime_offset().with_default(SystemMethod.NOW)
        self.update.table("parcels").in_schema("depot").set(title="two").where(id=2)

    def down(self):
        self.delete.column("title", "score", "made").from_table("parcels").in_schema("depot")


class Third(Migration):
    version = 30

    def up(self):
        self.rename.table("parcels").in_schema("depot").to("people")
        self.rename.column("ref").on_table("people").in_schema("depot").to("code")
        self.delete.from_table("people").in_schema("depot").row(id=1)


class Broken(Migration):
    version = 40

    def up(self):
        self.delete.from_table("people").in_schema("depot").all_rows()
        self.alter.table("people").in_schema("depot").add_column("must").as_int32()
        self.rename.table("people").in_schema("depot").to("gone")
        self.execute.sql("INSERT INTO depot.gone (nothing) VALUES (1)")


def test_runner(spark, tmp_path):
    runner = Runner(spark, str(tmp_path), [Second, First])
    assert runner.dry_run_up().statements[0].startswith('CREATE TABLE "depot"."parcels"')
    assert [r["applied"] for r in runner.status().collect()] == [False, False]
    assert runner.up(10) == [10] and runner.up() == [20]
    rows = runner.engine().sql("SELECT id, ref, title, score FROM depot.parcels ORDER BY id").collect()
    assert [tuple(r) for r in rows] == [(1, "a'b", None, 7), (2, "c", "two", 7)]
    assert runner.engine().sql("SELECT made FROM depot.parcels").where("made IS NULL").count() == 0
    assert runner.down(10) == [20] and _columns(runner.engine().schema, "parcels") == [("id", "integer", False), ("ref", "varchar(90)", False)]
    assert runner.up() == [20]
    # a column that comes back is not filled by what was dropped
    assert runner.engine().sql("SELECT id FROM depot.parcels WHERE title = 'two'").count() == 1
    more = Runner(spark, str(tmp_path), [First, Second, Third])
    assert more.up() == [30]
    with pytest.raises(MigrationError):
        more.down(0)
    broken = Runner(spark, str(tmp_path), [First, Second, Third, Broken])
    with pytest.raises(QueryError):
        broken.up()
    assert broken.applied() == [10, 20, 30]
    assert [tuple(r) for r in broken.engine().sql("SELECT id, code FROM depot.people").collect()] == [(2, "c")]
    assert _columns(runner.schema_at(10), "parcels")[1] == ("ref", "varchar(90)", False)
    with pytest.raises(MigrationError):
        Runner(spark, str(tmp_path), [Second, Third]).applied()


def test_catalog_and_neutral():
    with pytest.raises(MigrationError):
        Runner(None, "", [First, type("Other", (Migration,), {"version": 10})])
    assert operations_of("DROP INDEX i; REINDEX TABLE t") == [Neutral("DROP INDEX i"), Neutral("REINDEX TABLE t")]


def test_command_line(spark, tmp_path, capsys):
    from tessera.__main__ import main

    module = ["--module", __name__]
    assert main(["list", *module]) == 0 and "40 Broken forward only" in capsys.readouterr().out
    root = ["--root", str(tmp_path)]
    assert main(["up", *module, *root, "--target", "20"]) == 0 and capsys.readouterr().out == "10 20\n"
    assert main(["status", *module, *root]) == 0
    assert [line.split()[2] for line in capsys.readouterr().out.splitlines()] == ["applied", "applied", "pending", "pending"]
    assert main(["down", *module, *root, "--target", "10", "--dry-run"]) == 0 and "DROP COLUMN" in capsys.readouterr().out
    assert main(["down", *module, *root, "--target", "15"]) == 1


def test_check_command(spark, capsys):
    import os

    from tessera.__main__ import main

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    where = ["check", "--folder", data, "--tables", "nation,region"]
    assert main([*where, "SELECT n_name FROM nation"]) == 0 and "n_name" in capsys.readouterr().out
    assert main([*where, "SELECT n_nam FROM nation"]) == 1 and "SQL203" in capsys.readouterr().out


def test_migrations_that_are_script_files(spark, tmp_path):
    files = tmp_path / "scripts"
    files.mkdir()
    (files / "V2__fill.sql").write_text("INSERT INTO bins (no, label) VALUES (1, 'a;b'), (2, NULL);")
    (files / "V1__bins.sql").write_text("CREATE TABLE bins (no integer PRIMARY KEY, label text); -- the first")
    (files / "notes.txt").write_text("no migration")
    found = scripts(str(files))
    assert [(m.version, m.__name__, m.forward_only()) for m in found] == [(1, "bins", True), (2, "fill", True)]
    runner = Runner(spark, str(tmp_path / "data"), found)
    assert runner.up() == [1, 2] and runner.up() == []
    assert sorted(tuple(r) for r in runner.engine().sql("SELECT no, label FROM bins").collect()) == [(1, "a;b"), (2, None)]
    (files / "V01__again.sql").write_text("SELECT 1")
    with pytest.raises(MigrationError):
        scripts(str(files))
