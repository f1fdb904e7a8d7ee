"""Registered queries of the engine and the SQL that they equal.

Each key covers rows of the operator inventory.  The text of a query is in the
engine's dialect; its oracle is DuckDB's SQL for the same rows.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .api import ColumnRef, Engine, Predicate

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]
FLAGSHIP = """
SELECT c.c_custkey, c.c_name, COUNT(o.o_orderkey) AS order_count, SUM(o.o_totalprice) AS total_spent
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderdate > @since
GROUP BY c.c_custkey, c.c_name
"""
SINCE = datetime.datetime(1998, 1, 1)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, root: str | None = None) -> Engine:
    return Engine.over_parquet(spark, sf_dir, TABLES, root=root)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql(FLAGSHIP, since=SINCE)


def _add(name: str, sql: str, oracle: str | None = None, **values) -> None:
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).sql(sql, **values)
    ORACLE_SQL[name] = oracle or sql


QUERIES["flagship_customer_orders"] = flagship
ORACLE_SQL["flagship_customer_orders"] = FLAGSHIP.replace("@since", "TIMESTAMP '1998-01-01'")

# lexical layer
_add(
    "lexical_names_literals_comments",
    """SELECT "c_name" AS "Quoted Name", 'it''s' AS s, 1.50 AS d, 2147483648 AS big /* a /* nested */ comment */
       FROM "customer" -- to the end of the line
       WHERE c_custkey < 20;""",
    "SELECT c_name AS \"Quoted Name\", 'it''s' AS s, 1.50 AS d, 2147483648 AS big FROM customer WHERE c_custkey < 20",
)
_add("operator_precedence", "SELECT o_orderkey, 2 + 3 * 4 - -1 AS a, NOT o_orderkey = 1 AND true OR false AS b FROM orders", "SELECT o_orderkey, 2 + 3 * 4 + 1 AS a, ((NOT (o_orderkey = 1)) AND true) OR false AS b FROM orders")

# scans, projection, predicates
_add("scan_column_aliases", "SELECT n.k, n.label FROM nation AS n(k, label)", "SELECT n_nationkey AS k, n_name AS label FROM nation")
_add("derived_table", "SELECT d.seg, d.n FROM (SELECT c_mktsegment AS seg, COUNT(*) AS n FROM customer GROUP BY c_mktsegment) AS d WHERE d.n > 10")
_add("lateral_derived_table", "SELECT r.r_name, x.n FROM region r CROSS JOIN LATERAL (SELECT COUNT(*) AS n FROM nation WHERE n_regionkey = r.r_regionkey) AS x")
_add("values_statement", "VALUES (1, 'one'), (2, 'two'), (3, NULL) ORDER BY column1 DESC LIMIT 2", "SELECT 3 AS column1, NULL AS column2 UNION ALL SELECT 2, 'two'")
_add("values_derived", "SELECT v.id, v.label FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS v(id, label) WHERE v.id > 1")
_add("unnest_array", "SELECT u.item FROM region CROSS JOIN unnest(ARRAY[r_regionkey, r_regionkey + 10]) AS u(item)", "SELECT unnest([r_regionkey, r_regionkey + 10]) AS item FROM region")
_add("unnest_zip", "SELECT z.a, z.b FROM unnest(ARRAY[1,2,3], ARRAY['x','y']) AS z(a, b)", "SELECT * FROM (VALUES (1,'x'),(2,'y'),(3,NULL)) t(a,b)")
_add("generate_subscripts", "SELECT r.r_regionkey, s.i FROM region r CROSS JOIN generate_subscripts(ARRAY[5,6,7], 1) AS s(i)", "SELECT r_regionkey, i::INT AS i FROM region, range(1,4) t(i)")
_add("select_without_from", "SELECT 1 AS one, 'a' AS letter, true AS yes")
_add("star_expansion", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
_add("comparisons", "SELECT o_orderkey, o_totalprice > 100000 AS a, o_orderstatus <> 'F' AS b, o_orderkey <= 100 AS c FROM orders")
_add("boolean_logic", "SELECT p_partkey FROM part WHERE (p_size > 10 AND NOT p_size = 20) OR p_retailprice < 950")
_add("null_and_truth_tests", "SELECT p_partkey, (p_size IS NULL) AS a, (p_size > 10) IS TRUE AS b, (p_size > 10) IS NOT FALSE AS c, NULLIF(p_size, 10) IS NOT NULL AS d FROM part")
_add("distinct_from", "SELECT p_partkey, NULLIF(p_size, 10) IS DISTINCT FROM 20 AS a, NULLIF(p_size, 10) IS NOT DISTINCT FROM NULL AS b FROM part")
_add("like_ilike", "SELECT c_custkey, c_mktsegment LIKE '%B%' AS a, c_mktsegment ILIKE '%b%' AS b, c_mktsegment NOT ILIKE 'a%' AS c, c_name LIKE '%\\_1%' AS d FROM customer", "SELECT c_custkey, c_mktsegment LIKE '%B%' AS a, c_mktsegment ILIKE '%b%' AS b, c_mktsegment NOT ILIKE 'a%' AS c, contains(c_name, '_1') AS d FROM customer")
_add("regex_match", "SELECT p_partkey, p_brand ~ '[0-9]+' AS a, p_brand ~* 'BRAND' AS b, p_brand !~ 'x' AS c FROM part", "SELECT p_partkey, regexp_matches(p_brand, '[0-9]+') AS a, regexp_matches(p_brand, '(?i)BRAND') AS b, NOT regexp_matches(p_brand, 'x') AS c FROM part")
_add("in_list", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 2) AND n_nationkey NOT IN (3, 4)")
_add("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
_add("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
_add("between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 AND o_orderkey NOT BETWEEN 10 AND 20")
_add("exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice < 1000)")
_add("scalar_subquery", "SELECT r_name, (SELECT COUNT(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region")
_add("any_all", "SELECT p_partkey FROM part WHERE p_size = ANY(ARRAY[1,2,3,10]) OR p_size > ALL(ARRAY[40, 45])", "SELECT p_partkey FROM part WHERE p_size IN (1,2,3,10) OR p_size > 45")
_add("any_parameter", "SELECT p_partkey FROM part WHERE p_size = ANY(@sizes)", "SELECT p_partkey FROM part WHERE p_size IN (5, 6)", sizes=[5, 6])
_add("array_containment", "SELECT n_nationkey, ARRAY[1,2,n_regionkey] @> ARRAY[n_regionkey] AS a, ARRAY[n_regionkey] <@ ARRAY[1,2] AS b, ARRAY[n_regionkey] && ARRAY[3,4] AS c FROM nation", "SELECT n_nationkey, true AS a, n_regionkey IN (1,2) AS b, n_regionkey IN (3,4) AS c FROM nation")
_add("case_expressions", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size_class, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
_add("casts", "SELECT o_orderkey, CAST(o_totalprice AS bigint) AS a, o_orderkey::text AS b, CAST(2.5 AS integer) AS c, CAST('12' AS smallint) AS d FROM orders", "SELECT o_orderkey, CAST(round_even(o_totalprice, 0) AS BIGINT) AS a, CAST(o_orderkey AS VARCHAR) AS b, 3::INT AS c, 12::SMALLINT AS d FROM orders")
_add("parameters", "SELECT o_orderkey FROM orders WHERE o_orderdate >= @from AND o_totalprice < @most LIMIT ALL", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_totalprice < 50000", **{"from": SINCE, "most": 50000.0})

# joins
_add("join_inner", "SELECT c.c_name, o.o_orderkey FROM customer c INNER JOIN orders o ON o.o_custkey = c.c_custkey")
_add("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_add("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT OUTER JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 150000")
_add("join_right", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 150000")
_add("join_full", "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey + 3")
_add("join_cross_and_comma", "SELECT r_name, n_name FROM region, nation WHERE n_nationkey < 3")
_add("join_using", "SELECT k, a.n_name, b.r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) AS a JOIN (SELECT r_regionkey AS k, r_name FROM region) AS b USING (k)")
_add("join_full_using", "SELECT k, a.s_name, b.c_name FROM (SELECT s_suppkey + 5 AS k, s_name FROM supplier) AS a FULL JOIN (SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey < 9) AS b USING (k)")
_add("join_natural", "SELECT k, x, y FROM (SELECT n_regionkey AS k, n_name AS x FROM nation) AS a NATURAL LEFT JOIN (SELECT r_regionkey AS k, r_name AS y FROM region WHERE r_regionkey < 3) AS b")

# aggregation
_add("group_by_expression", "SELECT o_orderkey % 7 AS k, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders GROUP BY o_orderkey % 7")
_add("aggregates", "SELECT l_returnflag, COUNT(*) AS n, COUNT(l_tax) AS m, SUM(l_quantity) AS q, AVG(l_extendedprice) AS p, MIN(l_shipdate) AS a, MAX(l_shipdate) AS z FROM lineitem GROUP BY l_returnflag")
_add("aggregate_types", "SELECT SUM(p_size) AS s32, CAST(SUM(p_partkey) AS bigint) AS s64, CAST(AVG(p_size) AS double precision) AS a32 FROM part", "SELECT SUM(p_size)::BIGINT AS s32, SUM(p_partkey)::BIGINT AS s64, AVG(p_size)::DOUBLE AS a32 FROM part")
_add("aggregate_global_empty", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, MIN(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
_add("aggregate_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n, SUM(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n, SUM(DISTINCT l_linenumber)::BIGINT AS s FROM lineitem GROUP BY l_returnflag")
_add("aggregate_filter", "SELECT l_linestatus, COUNT(*) FILTER (WHERE l_discount > 0.05) AS n, SUM(l_quantity) FILTER (WHERE l_tax = 0) AS q FROM lineitem GROUP BY l_linestatus")
_add("having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND SUM(o_totalprice) > 0")
_add("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_add("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")

# windows
_add("window_ranking", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, RANK() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS rk, DENSE_RANK() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS dr FROM orders")
_add("window_offsets", "SELECT o_orderkey, LAG(o_orderkey) OVER w AS p, LEAD(o_orderkey, 2, -1) OVER w AS nx, FIRST_VALUE(o_orderkey) OVER w AS f, LAST_VALUE(o_orderkey) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", "SELECT o_orderkey, LAG(o_orderkey) OVER w AS p, LEAD(o_orderkey, 2, -1) OVER w AS nx, FIRST_VALUE(o_orderkey) OVER w AS f, LAST_VALUE(o_orderkey) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
_add("window_aggregate", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS top FROM orders")
_add("window_distinct_and_filter", "SELECT n_nationkey, COUNT(DISTINCT n_regionkey) OVER () AS d, COUNT(*) FILTER (WHERE n_nationkey > 5) OVER (PARTITION BY n_regionkey) AS f FROM nation", "SELECT n_nationkey, (SELECT COUNT(DISTINCT n_regionkey) FROM nation) AS d, COUNT(*) FILTER (WHERE n_nationkey > 5) OVER (PARTITION BY n_regionkey) AS f FROM nation")
_add("window_groups_frame", "SELECT o.o_orderkey, SUM(o.o_totalprice) OVER (PARTITION BY c.c_nationkey ORDER BY o.o_orderdate GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS near, COUNT(*) OVER (PARTITION BY c.c_nationkey ORDER BY o.o_orderdate GROUPS 2 PRECEDING) AS n FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 1000")
_add("window_offset_per_row", "SELECT o_orderkey, LAG(o_orderkey, o_custkey % 4) OVER w AS p, LEAD(o_orderkey, o_custkey % 3, -1) OVER w AS nx FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
_add("window_distinct_running", "SELECT l_orderkey, l_linenumber, COUNT(DISTINCT l_suppkey) OVER (PARTITION BY l_orderkey) AS suppliers, SUM(DISTINCT l_linenumber) OVER (PARTITION BY l_suppkey) AS numbers, COUNT(DISTINCT l_returnflag) FILTER (WHERE l_linenumber > 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS flags FROM lineitem")
_add("window_inheritance", "SELECT o_orderkey, ROW_NUMBER() OVER (w ORDER BY o_orderkey DESC) AS a, COUNT(*) OVER w2 AS b FROM orders WINDOW w AS (PARTITION BY o_custkey), w2 AS (w ORDER BY o_orderkey)", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS a, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders")

# order, limits, set operations, CTEs
_add("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
_add("order_nulls", "SELECT p_partkey, NULLIF(p_size, 10) AS s FROM part ORDER BY NULLIF(p_size, 10) DESC NULLS LAST, p_partkey FETCH FIRST 20 ROWS ONLY", "SELECT p_partkey, NULLIF(p_size, 10) AS s FROM part ORDER BY NULLIF(p_size, 10) DESC NULLS LAST, p_partkey LIMIT 20")
_add("order_default_nulls", "SELECT p_partkey, NULLIF(p_size, 10) AS s FROM part ORDER BY s, p_partkey DESC LIMIT 30", "SELECT p_partkey, NULLIF(p_size, 10) AS s FROM part ORDER BY s NULLS LAST, p_partkey DESC LIMIT 30")
_add("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_add("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_add("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_add("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
_add("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 9")
_add("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
_add("set_operation_precedence", "SELECT 1 AS k UNION SELECT 2 INTERSECT SELECT 3 ORDER BY k", "SELECT 1 AS k UNION (SELECT 2 INTERSECT SELECT 3)")
_add("cte", "WITH big(k, total) AS (SELECT o_custkey, SUM(o_totalprice) FROM orders GROUP BY o_custkey), top AS MATERIALIZED (SELECT k FROM big WHERE total > 500000) SELECT c.c_name FROM customer c JOIN top ON top.k = c.c_custkey", "WITH big(k, total) AS (SELECT o_custkey, SUM(o_totalprice) FROM orders GROUP BY o_custkey) SELECT c.c_name FROM customer c JOIN big ON big.k = c.c_custkey WHERE total > 500000")
_add("cte_recursive", "WITH RECURSIVE numbers(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM numbers WHERE n < 30) SELECT n FROM numbers")
_add("cte_recursive_union", "WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT (n * 2) % 10 FROM r) SELECT n FROM r", "SELECT unnest([1,2,4,8,6]) AS n")
_add("cte_recursive_deep", "WITH RECURSIVE numbers(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM numbers WHERE n < 130) SELECT COUNT(*) AS n, MAX(n) AS top FROM numbers", "SELECT 130::BIGINT AS n, 130 AS top")
_add("row_locks_ignored", "SELECT r_name FROM region FOR UPDATE OF region NOWAIT", "SELECT r_name FROM region")

# arithmetic
_add("arithmetic", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_linenumber / 2 AS half, l_orderkey % 5 AS m, -l_linenumber AS neg, 2 ^ 3 AS cube FROM lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_linenumber // 2 AS half, l_orderkey % 5 AS m, -l_linenumber AS neg, 8::DECIMAL(38,10) AS cube FROM lineitem")
_add("math_functions", "SELECT p_partkey, ABS(-p_size) AS a, ROUND(p_retailprice) AS r, CEIL(p_retailprice) AS c, FLOOR(p_retailprice) AS f, POWER(p_retailprice, 2) AS p FROM part", "SELECT p_partkey, ABS(-p_size) AS a, round_even(p_retailprice, 0) AS r, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, power(p_retailprice, 2) AS p FROM part")
_add("greatest_least_coalesce", "SELECT p_partkey, GREATEST(p_size, 20, NULLIF(p_size, 10)) AS g, LEAST(p_size, 20) AS l, COALESCE(NULLIF(p_size, 10), -1) AS c, NULLIF(p_brand, 'x') AS n FROM part")

# texts
_add("text_functions", "SELECT c_custkey, LOWER(c_name) AS a, UPPER(c_mktsegment) AS b, LENGTH(c_name) AS c, OCTET_LENGTH(c_name) AS d, REVERSE(c_name) AS e, MD5(c_name) AS f, REPLACE(c_name, 'C', 'K') AS g, STRPOS(c_name, '#') AS h, REPEAT('ab', 2) AS i FROM customer", "SELECT c_custkey, LOWER(c_name) AS a, UPPER(c_mktsegment) AS b, LENGTH(c_name)::INT AS c, strlen(c_name)::INT AS d, REVERSE(c_name) AS e, MD5(c_name) AS f, REPLACE(c_name, 'C', 'K') AS g, STRPOS(c_name, '#')::INT AS h, 'abab' AS i FROM customer")
_add("substring_trim", "SELECT c_custkey, SUBSTRING(c_name, 3) AS a, SUBSTRING(c_name, 0, 4) AS b, SUBSTRING(c_name, 2, 3) AS c, TRIM('  x ') AS d, LTRIM('xxa', 'x') AS e, RTRIM('axx', 'x') AS f, BTRIM('xax', 'x') AS g FROM customer", "SELECT c_custkey, c_name[3:] AS a, c_name[1:3] AS b, c_name[2:4] AS c, 'x' AS d, 'a' AS e, 'a' AS f, 'a' AS g FROM customer")
_add("concatenation", "SELECT n_name || '-' || n_nationkey::text AS a, CONCAT(n_name, NULL, n_regionkey) AS b, CONCAT_WS('/', n_name, NULL, 'z') AS c, INITCAP('hello wORLD-foo') AS d FROM nation", "SELECT n_name || '-' || CAST(n_nationkey AS VARCHAR) AS a, n_name || CAST(n_regionkey AS VARCHAR) AS b, n_name || '/z' AS c, 'Hello World-Foo' AS d FROM nation")

# dates
_add("date_parts", "SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate) AS y, DATE_PART('month', o_orderdate) AS m, EXTRACT(dow FROM o_orderdate) AS dow, EXTRACT(isodow FROM o_orderdate) AS iso, EXTRACT(doy FROM o_orderdate) AS doy, EXTRACT(epoch FROM o_orderdate) AS ep FROM orders", "SELECT o_orderkey, year(o_orderdate)::DOUBLE AS y, month(o_orderdate)::DOUBLE AS m, dayofweek(o_orderdate)::DOUBLE AS dow, isodow(o_orderdate)::DOUBLE AS iso, dayofyear(o_orderdate)::DOUBLE AS doy, epoch(o_orderdate)::DOUBLE AS ep FROM orders")
_add("date_arithmetic", "SELECT o_orderkey, DATE_TRUNC('month', o_orderdate) AS t, CAST(o_orderdate AS date) + 3 AS p, CAST(o_orderdate AS date) - DATE '1995-01-01' AS d, o_orderdate + INTERVAL '2 days' AS i, TO_CHAR(o_orderdate, 'YYYY-MM-DD HH24:MI:SS') AS c FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS t, CAST(o_orderdate AS DATE) + 3 AS p, (CAST(o_orderdate AS DATE) - DATE '1995-01-01')::INT AS d, o_orderdate + INTERVAL 2 DAY AS i, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS c FROM orders")

_add(
    "date_fields",
    "SELECT o_orderkey, EXTRACT(century FROM o_orderdate) AS c, EXTRACT(decade FROM o_orderdate) AS d, EXTRACT(millennium FROM o_orderdate) AS m, EXTRACT(quarter FROM o_orderdate) AS q, EXTRACT(week FROM o_orderdate) AS w, EXTRACT(isoyear FROM o_orderdate) AS iso, EXTRACT(milliseconds FROM o_orderdate) AS ms, EXTRACT(day FROM CAST(o_orderdate AS date)) AS dd, EXTRACT(hour FROM o_orderdate) AS h FROM orders",
    "SELECT o_orderkey, extract(century FROM o_orderdate)::DOUBLE AS c, extract(decade FROM o_orderdate)::DOUBLE AS d, extract(millennium FROM o_orderdate)::DOUBLE AS m, extract(quarter FROM o_orderdate)::DOUBLE AS q, extract(week FROM o_orderdate)::DOUBLE AS w, extract(isoyear FROM o_orderdate)::DOUBLE AS iso, extract(milliseconds FROM o_orderdate)::DOUBLE AS ms, extract(day FROM o_orderdate)::DOUBLE AS dd, extract(hour FROM o_orderdate)::DOUBLE AS h FROM orders",
)
_add("interval_literals", "SELECT o_orderkey, o_orderdate + INTERVAL '1 day 02:03:04' AS a, o_orderdate - INTERVAL '00:00:01.5' AS b, CAST(o_orderdate AS date) + INTERVAL '3 days' AS c, CAST(o_orderdate AS date) - INTERVAL '12:00:00' AS d FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL '1 day' + INTERVAL '2 hours 3 minutes 4 seconds' AS a, o_orderdate - INTERVAL '1500 milliseconds' AS b, CAST(o_orderdate AS DATE) + INTERVAL '3 days' AS c, CAST(o_orderdate AS DATE) - INTERVAL '12 hours' AS d FROM orders")
_add("moment_differences", "SELECT o_orderkey, EXTRACT(epoch FROM (o_orderdate - TIMESTAMP '1995-01-01 00:00:10')) AS a, EXTRACT(epoch FROM (TIME '10:00:00' - TIME '09:30:00')) AS b, EXTRACT(epoch FROM ((TIMESTAMP '2000-01-02 00:00:00' - TIMESTAMP '2000-01-01 00:00:00') * 3)) AS c, EXTRACT(epoch FROM (INTERVAL '2 days' / 4)) AS d, EXTRACT(day FROM 2 * INTERVAL '36:00:00') AS e FROM orders", "SELECT o_orderkey, epoch(o_orderdate) - epoch(TIMESTAMP '1995-01-01 00:00:10') AS a, 1800::DOUBLE AS b, 259200::DOUBLE AS c, 43200::DOUBLE AS d, 3::DOUBLE AS e FROM orders")
_add("time_arithmetic", "SELECT r_regionkey, CAST(TIME '10:00:00' + INTERVAL '01:30:00' AS text) AS a, CAST(TIME '10:00:00' - INTERVAL '00:00:30' AS text) AS b FROM region", "SELECT r_regionkey, '11:30:00' AS a, '09:59:30' AS b FROM region")
_add("current_moments", "SELECT r_regionkey, CURRENT_DATE = CAST(NOW() AS date) AS a, CURRENT_TIMESTAMP = NOW() AS b, EXTRACT(year FROM NOW()) > 2020 AS c, LOCALTIMESTAMP > TIMESTAMP '2020-01-01 00:00:00' AS d FROM region", "SELECT r_regionkey, true AS a, true AS b, true AS c, true AS d FROM region")
_add("random_and_session", "SELECT r_regionkey, RANDOM() >= 0 AND RANDOM() < 1 AS a, LENGTH(CURRENT_USER) > 0 AS b FROM region", "SELECT r_regionkey, true AS a, true AS b FROM region")
_add("window_range_frame", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS n, SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE UNBOUNDED PRECEDING)::bigint AS s FROM orders", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS n, (SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE UNBOUNDED PRECEDING))::BIGINT AS s FROM orders")
_add("round_to_places", "SELECT p_partkey, ROUND(CAST(p_retailprice AS numeric(12, 3)), 1) AS a, TO_CHAR(DATE '2024-03-05', 'DD.MM.YYYY') AS b FROM part", "SELECT p_partkey, ROUND(CAST(p_retailprice AS DECIMAL(12, 3)), 1) AS a, '05.03.2024' AS b FROM part")

# arrays and JSON
_add("array_operators", "SELECT n_nationkey, (ARRAY[10,20,30])[2] AS a, (ARRAY[1,2])[9] AS b, ARRAY[n_regionkey] || ARRAY[7] = ARRAY[n_regionkey, 7] AS c, (ARRAY['5','6']::integer[])[1] AS d FROM nation", "SELECT n_nationkey, 20 AS a, NULL::INT AS b, true AS c, 5 AS d FROM nation")
_add("json_operators", "SELECT event_id, props::json ->> 'k' AS a, CAST(props::jsonb -> 'k' AS text) AS b, props::jsonb #>> '{k}' AS c FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS a, json_extract_string(props, '$.k') AS b, json_extract_string(props, '$.k') AS c FROM events")
_add(
    "json_contains",
    "SELECT event_id, props::jsonb @> '{\"k\": 7}'::jsonb AS a, '{\"k\": 7, \"l\": [1, 2]}'::jsonb @> props::jsonb AS b, '{\"a\": [1, 2], \"b\": 1}'::jsonb @> '{\"a\": [3]}'::jsonb AS c FROM events",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) = 7 AS a, CAST(json_extract_string(props, '$.k') AS INT) = 7 AS b, false AS c FROM events",
)
_add("json_paths", """SELECT event_id, '{"a b": {"0": 5}, "l": [7, {"1": 8}]}'::jsonb #>> '{a b,0}' AS a, '{"l": [7, {"1": 8}]}'::jsonb #>> '{l,1,1}' AS b, '{"l": [7, 8]}'::json -> 'l' ->> 1 AS c FROM events""", "SELECT event_id, '5' AS a, '8' AS b, '8' AS c FROM events")
_add("array_containment_nulls", "SELECT n_nationkey, ARRAY[1, NULL, n_regionkey] @> ARRAY[NULLIF(n_regionkey, 2)] AS a, ARRAY[1, NULLIF(n_regionkey, 3)] && ARRAY[NULLIF(n_regionkey, 3), 1] AS b FROM nation", "SELECT n_nationkey, n_regionkey <> 2 AS a, true AS b FROM nation")
_add("generate_subscripts_of_a_missing_dimension", "SELECT r.r_regionkey, s.i FROM region r LEFT JOIN LATERAL (SELECT i FROM generate_subscripts(ARRAY[5, 6], r.r_regionkey) AS g(i)) AS s ON true", "SELECT r_regionkey, i FROM region LEFT JOIN (VALUES (1), (2)) t(i) ON r_regionkey = 1")


# the query API
def _predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).table("orders")
    p = (t.o_totalprice > 50000.0).and_(t.o_orderstatus.in_("F", "O")).or_if(True, t.o_orderkey.between(1, 20))
    return t.where(p).where_if(False, lambda: t.o_orderkey.is_null()).where(t.o_orderpriority.not_equal(None)).query()


def _all_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).table("part")
    return t.where(Predicate.any([t.p_name.like("%a%"), Predicate.all([t.p_size <= 10, t.p_brand.not_like("%9%")])])).query()


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = @id").with_parameter("@id", 7).df()


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, upsert, update, delete and what they return, on a snapshot of nation."""
    import uuid

    from .language.schema import Column, Schema, Table
    from .sources.scratch import folder

    table = Table("places", (Column("id", "integer", primary_key=True), Column("name", "text"), Column("region", "integer", True, default="9")))
    e = Engine(spark, Schema((table,)).with_table(Table("nation", ())), root=f"{folder(spark)}/tables-{uuid.uuid4().hex}")
    source = spark.read.parquet(f"{sf_dir}/nation.parquet")
    e.store.write(table, source.selectExpr("n_nationkey AS id", "n_name AS name", "n_regionkey AS region"))
    e.execute("INSERT INTO places (id, name) VALUES (100, 'new'), (101, 'newer')")
    e.execute("INSERT INTO places (id, name, region) VALUES (1, 'one', 1), (102, 'more', NULL) ON CONFLICT (id) DO UPDATE SET name = excluded.name || '!' WHERE places.id < 50")
    e.execute("UPDATE places SET region = region + 1 WHERE region = 4")
    e.execute("DELETE FROM places WHERE region = 0")
    return e.sql("SELECT id, name, region FROM places")


QUERIES["table_predicates"] = _predicates
ORACLE_SQL["table_predicates"] = "SELECT * FROM orders WHERE ((o_totalprice > 50000 AND o_orderstatus IN ('F', 'O')) OR o_orderkey BETWEEN 1 AND 20) AND o_orderpriority IS NOT NULL"
QUERIES["predicate_lists"] = _all_any
ORACLE_SQL["predicate_lists"] = "SELECT * FROM part WHERE p_name LIKE '%a%' OR (p_size <= 10 AND p_brand NOT LIKE '%9%')"
QUERIES["checked_query_parameters"] = _named
ORACLE_SQL["checked_query_parameters"] = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7"
QUERIES["data_changes"] = _changes
ORACLE_SQL["data_changes"] = """
SELECT id, CASE WHEN id = 1 THEN 'one!' ELSE name END AS name, CASE WHEN region = 4 THEN 5 ELSE region END AS region FROM (
  SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation
  UNION ALL SELECT * FROM (VALUES (100, 'new', 9), (101, 'newer', 9), (102, 'more', NULL)) t) WHERE region <> 0 OR region IS NULL
"""
from . import registry_changes  # noqa: E402

QUERIES.update(registry_changes.QUERIES)
ORACLE_SQL.update(registry_changes.ORACLE_SQL)

__all__ = ["ColumnRef", "ORACLE_SQL", "QUERIES", "engine", "flagship"]
