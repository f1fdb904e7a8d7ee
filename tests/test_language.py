"""Inferred columns, parameters and diagnostics."""

import itertools
import random

import pytest

from tessera.language.checker import analyze
from tessera.language.dialects import DIALECTS, MYSQL, ORACLE, SQLITE, SQLSERVER
from tessera.language.schema import Column, Schema, Table

#: A warehouse: its tables are named for what the tests need, a column of each kind among them.
KINDS = {"a_short": "smallint", "an_int": "integer", "a_long": "bigint", "a_real": "real", "a_double": "double precision", "a_number": "numeric", "a_text": "text", "a_flag": "boolean", "a_day": "date", "a_clock": "time", "a_moment": "timestamp", "a_span": "interval", "a_key": "uuid", "a_doc": "jsonb", "a_list": "integer[]"}
SCHEMA = Schema(
    (
        Table("shelf", tuple(Column(n, t) for n, t in KINDS.items())),
        Table("bin", tuple(Column(n, t, True) for n, t in KINDS.items())),
        Table("crate", (Column("crate_no", "integer", primary_key=True), Column("weight", "numeric", True), Column("owner", "varchar(30)"))),
        Table("pallet", (Column("pallet_no", "bigint"), Column("crate_no", "integer"), Column("packed", "date", True))),
    )
)
#: Numeric kinds from the narrowest on, as the checker names them.
LADDER = ["a_short", "an_int", "a_long"]
NAMES = {"a_short": "short", "an_int": "int", "a_long": "long", "a_real": "float", "a_double": "double", "a_number": "decimal"}


def types(sql, schema=SCHEMA, **kwargs):
    found = analyze(schema, sql, **kwargs)
    assert found.ok, [str(d) for d in found.diagnostics]
    return [c.type for c in found.columns]


def codes(sql, schema=SCHEMA, **kwargs):
    return [d.code for d in analyze(schema, sql, **kwargs).diagnostics]


@pytest.mark.parametrize("a, b", list(itertools.product(NAMES, NAMES)))
def test_numbers_widen(a, b):
    if a in LADDER and b in LADDER:
        expected = NAMES[max(a, b, key=LADDER.index)]
    elif "a_double" in (a, b) or "a_real" in (a, b) and a != b:
        expected = "double"
    else:
        expected = "float" if a == b == "a_real" else "decimal"
    for table, mark in (("shelf", ""), ("bin", "?")):
        assert types(f"SELECT {a} + {b} AS s, {a} * {b} AS p, COALESCE({a}, {b}) AS c FROM {table}") == [expected + mark] * 3
        assert types(f"SELECT {a} < {b} AS l, {a} IS DISTINCT FROM {b} AS d FROM {table}") == ["bool" + mark, "bool"]
    assert types(f"SELECT {a} FROM shelf UNION SELECT {b} FROM bin") == [expected + "?"]


@pytest.mark.parametrize("a, b", [(a, b) for a, b in itertools.combinations(["an_int", "a_text", "a_flag", "a_day", "a_clock", "a_key", "a_list"], 2)])
def test_kinds_that_do_not_fit_together(a, b):
    assert codes(f"SELECT {a} = {b} FROM shelf") == ["SQL207"]
    assert codes(f"SELECT CASE WHEN a_flag THEN {a} ELSE {b} END FROM shelf") == ["SQL207"]
    assert codes(f"SELECT {a} FROM shelf UNION ALL SELECT {b} FROM bin") == ["SQL207"]


@pytest.mark.parametrize("name", [n for n in KINDS if n != "a_doc"])
def test_every_kind_passes_through(name):
    [one], [maybe] = types(f"SELECT {name} FROM shelf"), types(f"SELECT {name} FROM bin")
    assert maybe == one + "?"
    assert types(f"SELECT NULLIF({name}, {name}) AS x, {name} IS NULL AS y FROM shelf") == [maybe, "bool"]
    assert types(f"SELECT (SELECT {name} FROM shelf LIMIT 1) AS x") == [maybe]
    assert types(f"SELECT s.{name} AS l, b.{name} AS r FROM shelf s LEFT JOIN shelf b ON b.an_int = s.an_int") == [one, maybe]
    assert types(f"SELECT s.{name} AS l, b.{name} AS r FROM shelf s FULL JOIN shelf b ON b.an_int = s.an_int") == [maybe, maybe]
    found = analyze(SCHEMA, f"SELECT an_int FROM shelf WHERE {name} = @wanted")
    assert found.ok and [p.type for p in found.parameters] == [one]


@pytest.mark.parametrize(
    "expression, expected",
    [
        ("a_day + 7", "DateOnly"),
        ("a_day - a_day", "int"),
        ("a_day + a_span", "DateTime"),
        ("a_moment - a_span", "DateTime"),
        ("a_moment - a_moment", "TimeSpan"),
        ("a_clock - a_clock", "TimeSpan"),
        ("a_span * 2", "TimeSpan"),
        ("INTERVAL '1 day 02:03:04'", "TimeSpan"),
        ("EXTRACT(century FROM a_day)", "double"),
        ("a_list[2]", "int?"),
        ("a_list || a_list", "int[]"),
        ("a_list @> a_list", "bool"),
        ("an_int = ANY(a_list)", "bool?"),
        ("a_doc -> 'x' ->> 'y'", "string?"),
        ("a_text || a_text", "string"),
        ("a_text ILIKE 'x%'", "bool"),
        ("COUNT(*) OVER ()", "long"),
        ("SUM(an_int) OVER ()", "long?"),
        ("LEAD(a_text, 2, '-') OVER (ORDER BY an_int)", "string?"),
        ("CASE a_short WHEN 1 THEN a_day END", "DateOnly?"),
        ("a_number::integer", "int"),
    ],
)
def test_operators_of_other_kinds(expression, expected):
    assert types(f"SELECT {expression} AS x FROM shelf") == [expected]


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("SELECT owner, COUNT(*) AS n, AVG(crate_no) AS a, MIN(weight) AS w FROM crate GROUP BY owner", ["string", "long", "decimal", "decimal?"]),
        ("SELECT SUM(pallet_no) AS s, MAX(packed) AS m FROM pallet", ["decimal?", "DateOnly?"]),
        ("VALUES (1, 'x', NULL::date), (NULL, 'y', DATE '2001-02-03')", ["int?", "string", "DateOnly?"]),
        ("WITH RECURSIVE up(k) AS (SELECT crate_no FROM crate UNION SELECT k + 1 FROM up WHERE k < 9) SELECT k FROM up", ["int"]),
        ("UPDATE crate AS c SET weight = 1 FROM pallet AS p WHERE p.crate_no = c.crate_no RETURNING c.owner, c.weight", ["string", "decimal?"]),
        ("INSERT INTO pallet (pallet_no, crate_no) VALUES (1, 2) RETURNING *", ["long", "int", "DateOnly?"]),
        ("SELECT * FROM crate JOIN pallet USING (crate_no)", ["int", "decimal?", "string", "long", "DateOnly?"]),
    ],
)
def test_types_of_statements(sql, expected):
    assert types(sql) == expected


#: A statement for each code that queries can have.
FAULTS = {
    "SQL001": ["SELECT 'open", 'SELECT "open FROM crate'],
    "SQL100": ["SELECT weight FROM", "TABLE crate", "SELECT owner FROM crate; SELECT owner FROM crate"],
    "SQL200": ["SELECT 1 FROM barrel", "SELECT SUM(weight) OVER nowhere FROM crate"],
    "SQL201": ["SELECT 1 AS x FROM crate c, pallet c"],
    "SQL202": ["SELECT z.owner FROM crate c"],
    "SQL203": ["SELECT colour FROM crate", "UPDATE crate SET colour = 1"],
    "SQL204": ["SELECT crate_no FROM crate, pallet"],
    "SQL205": ["SELECT owner::money_bag FROM crate"],
    "SQL206": ["SELECT FROBNICATE(owner) FROM crate"],
    "SQL207": ["SELECT owner - 1 FROM crate", "SELECT EXTRACT(fortnight FROM packed) FROM pallet", "SELECT EXTRACT(year FROM a_span) FROM shelf"],
    "SQL208": ["SELECT owner FROM crate WHERE weight", "SELECT owner FROM crate HAVING crate_no"],
    "SQL209": ["SELECT @what"],
    "SQL210": ["SELECT 1 AS x FROM crate WHERE owner = @p OR crate_no = @p"],
    "SQL211": ["SELECT NULL"],
    "SQL212": ["SELECT UPPER(owner, owner) FROM crate", "SELECT DENSE_RANK() FROM crate"],
    "SQL213": ["SELECT UPPER(*) FROM crate"],
    "SQL214": ["SELECT owner FROM crate WHERE MAX(weight) > 1"],
    "SQL215": ["SELECT MAX(SUM(weight)) FROM crate"],
    "SQL216": ["SELECT owner, SUM(weight) FROM crate"],
    "SQL219": ["INSERT INTO crate (owner, owner) VALUES ('a', 'b')", "UPDATE crate SET owner = 'a', owner = 'b'"],
    "SQL221": ["SELECT owner FROM crate UNION SELECT crate_no, packed FROM pallet"],
    "SQL222": ["SELECT owner FROM crate WHERE crate_no IN (SELECT crate_no, pallet_no FROM pallet)"],
}


@pytest.mark.parametrize("code, sql", [(c, q) for c, texts in FAULTS.items() for q in texts])
def test_faults_are_named_and_placed(code, sql):
    found = analyze(SCHEMA, sql)
    assert code in [d.code for d in found.diagnostics]
    assert all(0 <= d.span.start <= len(sql) and d.span.start + d.span.length <= len(sql) + 1 for d in found.diagnostics)


def test_nothing_given():
    assert codes("SELECT 1", schema=None) == codes(None) == ["SQL000"]


@pytest.mark.parametrize(
    "dialect, spelled",
    [(MYSQL, {"tinyint(1)": "bool", "char(36)": "Guid", "bigint": "long"}), (SQLITE, {"VARCHAR(9)": "string", "MYINT": "long"}), (SQLSERVER, {"bit": "bool", "money": "decimal", "nvarchar(7)": "string"}), (ORACLE, {"NUMBER(9)": "int", "RAW(16)": "Guid", "VARCHAR2(5)": "string"})],
)
def test_types_of_other_dialects(dialect, spelled):
    schema = Schema((Table("t", tuple(Column(f"c{i}", kind) for i, kind in enumerate(spelled))),))
    assert types("SELECT * FROM t", schema, dialect=dialect) == list(spelled.values())


class Grammar:
    """Random statements from a grammar of expressions and clauses, some spoilt."""

    def __init__(self, seed):
        self.random = random.Random(seed)

    def expression(self, depth=3):
        pick = self.random.choice
        if not depth or self.random.random() < 0.25:
            return pick([*KINDS, "1", "2.5", "'t'", "NULL", "true", "@p", "crate_no", "*"])
        below = lambda: self.expression(depth - 1)
        forms = [
            lambda: f"({below()} {pick(['+', '-', '*', '/', '%', '^', '||', '=', '<>', 'AND', 'OR', 'LIKE', '@>', '->', '#>>'])} {below()})",
            lambda: f"{pick(['UPPER', 'COALESCE', 'SUM', 'COUNT', 'RANK', 'NULLIF', 'DATE_TRUNC'])}({below()}, {below()})",
            lambda: f"CASE WHEN {below()} THEN {below()} END",
            lambda: f"{below()} IN ({below()}, {below()})",
            lambda: f"(SELECT {below()} FROM bin)",
            lambda: f"{below()}::{pick(['integer', 'text[]', 'date', 'thing'])}",
            lambda: f"ARRAY[{below()}][{below()}]",
            lambda: f"MAX({below()}) OVER (PARTITION BY {below()} ORDER BY {below()})",
        ]
        return pick(forms)()

    def statement(self):
        e = self.expression
        text = self.random.choice([f"SELECT {e()} AS x, {e(1)} FROM shelf WHERE {e(2)} GROUP BY {e(1)} HAVING {e(1)} ORDER BY {e(1)} LIMIT 3", f"WITH w AS (SELECT {e()} AS y) SELECT * FROM w JOIN crate ON {e(2)}", f"INSERT INTO crate VALUES ({e(1)}, {e(1)}) RETURNING {e(1)}", f"UPDATE crate SET weight = {e()} WHERE {e(2)}", f"DELETE FROM crate WHERE {e()}"])
        if self.random.random() < 0.4:  # cut off or with something taken out
            at = self.random.randrange(len(text))
            text = text[:at] + (text[at + self.random.randrange(1, 9) :] if self.random.random() < 0.5 else "")
        return text


@pytest.mark.parametrize("dialect", list(DIALECTS.values()), ids=list(DIALECTS))
def test_no_statement_breaks_the_checker(dialect):
    grammar = Grammar(20_011)
    for _ in range(400):
        sql = grammar.statement()
        assert "SQL999" not in codes(sql, dialect=dialect), sql


def test_deep_nesting_is_refused():
    assert codes("SELECT " + "(" * 5000 + "1" + ")" * 5000)
