"""Results of the engine against DuckDB and on small tables."""

import dataclasses
import os

import duckdb
import pytest

from tessera import registry
from tessera.api import Engine, Predicate
from tessera.language.diagnostics import QueryError
from tessera.language.schema import Column, Schema, Table
from tessera.mapping import MappingError, check
from tessera.operators.changes import ConstraintError

DATA = "/root/testdata/sf0.001"


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    try:
        return float(f"{float(v):.9g}")
    except (TypeError, ValueError):
        pass
    text = str(v)
    return text[:10] if text.endswith(" 00:00:00") else text


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_registered_query_equals_its_oracle(spark, name):
    duck = duckdb.connect()
    for t in registry.TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = registry.QUERIES[name](spark, DATA)
    expected = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, df.collect()) == _rows(names, expected.fetchall())


TABLE = Table("items", (Column("id", "integer", primary_key=True, identity=True), Column("label", "text"), Column("note", "text", True, default="'none'")))


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, Schema((TABLE,)), root=str(tmp_path))
    e.store.write(TABLE, spark.createDataFrame([(1, "one", None), (2, "two", "x"), (3, "three", None)], "id int, label string, note string"))
    return e


def _all(engine):
    return sorted(tuple(r) for r in engine.sql("SELECT id, label, note FROM items").collect())


def test_insert_defaults_identity_and_returning(engine):
    rows = engine.sql("INSERT INTO items (label) VALUES ('four') RETURNING id, label, note").collect()
    assert [tuple(r) for r in rows] == [(4, "four", "none")]
    assert engine.execute("INSERT INTO items (id, label, note) SELECT id + 10, label, note FROM items") == 4


def test_upsert_and_do_nothing(engine):
    assert engine.execute("INSERT INTO items (id, label) VALUES (1, 'uno'), (9, 'nine') ON CONFLICT (id) DO UPDATE SET label = excluded.label, note = NULL") == 2
    assert engine.execute("INSERT INTO items (id, label) VALUES (1, 'x') ON CONFLICT (id) DO NOTHING") == 0
    assert (1, "uno", None) in _all(engine) and len(_all(engine)) == 4


def test_update_delete_truncate(engine):
    assert engine.execute("UPDATE items SET note = label || '!' WHERE note IS NULL") == 2
    assert engine.execute("UPDATE items AS i SET label = o.label FROM items AS o WHERE o.id = i.id + 1") == 2
    assert [r[1] for r in _all(engine)] == ["two", "three", "three"]
    assert [tuple(r) for r in engine.sql("DELETE FROM items WHERE id = 1 RETURNING id, note").collect()] == [(1, "one!")]
    assert engine.execute("DELETE FROM items AS i USING items AS o WHERE o.id = i.id + 1") == 1
    assert engine.execute("TRUNCATE items") == 1 and _all(engine) == []


def test_data_changing_cte(engine):
    rows = engine.sql("WITH gone AS (DELETE FROM items WHERE id < 3 RETURNING id) SELECT COUNT(*) AS n FROM gone").collect()
    assert rows[0].n == 2 and len(_all(engine)) == 1


def test_table_objects(engine):
    t = engine.table("items")
    assert t.where(t.label.like("t%")).sql() == ('SELECT "id", "label", "note" FROM "items" WHERE "label" LIKE @where_0', ["t%"])
    assert Predicate.all([t.id > 1, t.note.equal(None)]).sql(3) == ('("id" > @where_3 AND "note" IS NULL)', [1])
    assert t.insert({"label": "new", "note": None}) == 1
    assert t.update({"id": 4, "label": "newer", "note": "n"}) == 1
    assert t.delete({"id": 4}) == 1
    assert t.delete_where(t.id.in_([1, 2])) == 2
    for wrong in (lambda: t.id.in_([]), lambda: t.id.in_([None]), lambda: t.id < None, lambda: t.id.between(None, 1), lambda: Predicate.any([])):
        with pytest.raises(ValueError):
            wrong()


@dataclasses.dataclass
class Item:
    Id: int
    label: str
    note: str | None


@dataclasses.dataclass
class Strict:
    id: int
    label: str
    note: str


def test_mapping(engine):
    q = engine.query("SELECT id, label, note FROM items WHERE id = @id").with_parameter("@id", 1)
    assert q.read(Item) == [Item(1, "one", None)]
    with pytest.raises(MappingError):
        q.read(Strict)
    assert check(engine.analyze(q.sql).columns, Strict) == ["note may be NULL"]
    assert engine.query("SELECT label FROM items WHERE id = 2").read(str) == ["two"]
    row = engine.unchecked("SELECT 1 AS a, 2 AS a").read()[0]
    assert row.get_values("a") == [1, 2]
    with pytest.raises(KeyError):
        row["a"]


def test_parameters_are_checked_and_stay_values(engine):
    q = engine.query("SELECT id FROM items WHERE label = @label")
    with pytest.raises(ValueError):
        q.with_parameter("@other", 1)
    with pytest.raises(TypeError):
        q.with_parameter("@label", 1)
    with pytest.raises(QueryError):
        engine.sql("SELECT id FROM nothing")
    assert q.with_parameter("@label", "x' OR '1'='1").read() == []
    assert engine.format("SELECT id FROM items WHERE label = {x}", x="two").read(int) == [2]
    by_id = engine.define("by_id", "SELECT label FROM items WHERE id = @id", str)
    assert by_id(id=3) == ["three"]
    with pytest.raises(QueryError):
        engine.define("by_id", "SELECT 1")


def test_recursion_goes_on_until_a_round_adds_nothing(engine, monkeypatch):
    from tessera.plans import recursion

    monkeypatch.setattr(recursion, "ROUNDS", 2, raising=False)  # any bound on rounds loses levels
    rows = engine.sql("WITH RECURSIVE n AS (SELECT 1 AS v UNION SELECT n.v + 1 FROM n WHERE n.v < 6) SELECT v FROM n ORDER BY v").collect()
    assert [r.v for r in rows] == [1, 2, 3, 4, 5, 6]


def test_keys_and_not_null_are_kept(engine):
    before = _all(engine)
    for refused in (
        "INSERT INTO items (id, label) VALUES (1, 'again')",
        "INSERT INTO items (id, label) VALUES (7, 'a'), (7, 'b')",
        "INSERT INTO items (id, label) VALUES (8, NULL)",
        "INSERT INTO items (id, label) VALUES (9, 'a'), (9, 'b') ON CONFLICT (id) DO UPDATE SET label = excluded.label",
        "INSERT INTO items (id, label) VALUES (1, 'a') ON CONFLICT (id) DO UPDATE SET label = NULL",
        "UPDATE items SET label = NULL WHERE id = 2",
        "UPDATE items SET id = 1",
    ):
        with pytest.raises(ConstraintError):
            engine.execute(refused)
        assert _all(engine) == before, refused
    assert engine.execute("INSERT INTO items (id, label) VALUES (7, 'a'), (7, 'b'), (1, 'c') ON CONFLICT DO NOTHING") == 1


def test_identities_over_several_partitions(spark, engine):
    engine.spark.range(50, numPartitions=7).createOrReplaceTempView("many")
    wide = Engine(spark, engine.schema.with_table(Table("many", (Column("id", "bigint"),))), root=engine.store.root)
    assert wide.execute("INSERT INTO items (label) SELECT CAST(id AS text) FROM many") == 50
    assert [r[0] for r in _all(engine)] == list(range(1, 54))


def test_a_lazy_returning_outlives_other_changes(engine):
    first = engine.sql("UPDATE items SET note = 'n' WHERE id = 1 RETURNING id, note")
    engine.sql("UPDATE items SET note = 'm' WHERE id = 2 RETURNING id, note")
    assert [tuple(r) for r in first.collect()] == [(1, "n")]


@pytest.mark.parametrize(
    "expression, expected",
    [
        ("ARRAY[1, NULL] @> ARRAY[NULL::integer]", False),
        ("ARRAY[1, 2] @> ARRAY[2, 2]", True),
        ("NULL::integer[] @> ARRAY[1]", None),
        ("""'{"a b": {"0": 5}}'::jsonb #>> '{a b,0}'""", "5"),
        ("""'{"a": [4, 5]}'::jsonb #>> '{a,1}'""", "5"),
        ("EXTRACT(epoch FROM INTERVAL '-1 day 00:00:01')", -86399.0),
        ("EXTRACT(century FROM DATE '2001-01-01')", 21.0),
    ],
)
def test_values_of_expressions(engine, expression, expected):
    assert engine.sql(f"SELECT {expression} AS x").first()[0] == expected


def test_deep_recursion(engine):
    assert engine.sql("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 150) SELECT MAX(n) AS m FROM r").first()[0] == 150
    with pytest.raises(QueryError):
        engine.sql("WITH RECURSIVE a(n) AS (SELECT 1), r(n) AS (SELECT 1 UNION SELECT n FROM r) SELECT n FROM r")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize(
    "sql",
    [
        "SELECT n_name, LAG(n_name, n_nationkey - 12, 'none') OVER (ORDER BY n_nationkey) AS p FROM nation",
        "SELECT n_name, LEAD(n_name, NULLIF(n_regionkey, 2), 'none') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS p FROM nation",
        "SELECT n_regionkey AS k, COUNT(*) OVER (ORDER BY n_regionkey GROUPS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS n FROM nation ORDER BY k, n LIMIT 7",
        "SELECT x.n_name, COUNT(DISTINCT r_name) OVER () AS d, SUM(x.n_nationkey) OVER (ORDER BY r_name GROUPS UNBOUNDED PRECEDING) AS t FROM nation x LEFT JOIN region ON r_regionkey = x.n_regionkey AND r_regionkey < 3",
        "SELECT k, SUM(DISTINCT k) OVER () AS s, COUNT(DISTINCT NULLIF(k, 1)) OVER () AS n FROM (VALUES (1), (2), (2), (NULL)) AS v(k)",
        "SELECT n_regionkey, a.n_name FROM nation a JOIN (SELECT n_nationkey, COUNT(*) OVER (ORDER BY n_regionkey GROUPS 1 PRECEDING) AS n FROM nation) b USING (n_nationkey) WHERE b.n > 5",
        "SELECT n_nationkey, LAG(a.n_name, b.n_regionkey) OVER (ORDER BY n_nationkey) AS p FROM nation a JOIN nation b USING (n_nationkey)",
        "SELECT n_regionkey, (SELECT MAX(g) FROM (SELECT COUNT(*) OVER (ORDER BY r_name GROUPS 1 PRECEDING) AS g FROM region) t) AS m FROM nation",
    ],
)
def test_windows_over_windows(spark, sql):
    duck = duckdb.connect()
    for t in ("nation", "region"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    expected = duck.execute(sql)
    want = _rows([c[0] for c in expected.description], expected.fetchall())
    found = Engine.over_parquet(spark, DATA, ["nation", "region"]).sql(sql)
    assert _rows(found.columns, found.collect()) == want


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT COUNT(*) OVER (GROUPS 1 PRECEDING) AS n FROM nation",
        "SELECT n_regionkey, SUM(COUNT(*)) OVER (ORDER BY n_regionkey GROUPS 1 PRECEDING) AS n FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, LAG(n_regionkey, n_regionkey) OVER (ORDER BY n_regionkey) AS n FROM nation GROUP BY n_regionkey",
    ],
)
@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_windows_that_are_refused(spark, sql):
    with pytest.raises(QueryError) as e:
        Engine.over_parquet(spark, DATA, ["nation"]).sql(sql)
    assert "SQL100" in str(e.value)
