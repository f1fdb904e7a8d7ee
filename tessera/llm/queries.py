"""The registered queries of the corpus operators and the SQL that some equal.

A query applies its operator, with its production parameters, to the whole
table and derives the columns that its contract names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, licenses, mixing, near, packing, quality, secrets, substring, toxicity
from .common import shared_dir, table
from .sharding import ShardStore


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = mixing.schedule(table(spark, sf_dir, "documents"))
    return mixing.taken_by_document(entries).select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_compact_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended as small shards and compacted; each with the shard that holds it."""
    store = ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the table's files
    store.append(docs, store.arrivals(docs.count(), size))
    store.settle(keep=1)
    store.vacuum()
    return store.read().select("doc_id", "shard", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_code_points"))


def op4_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_exact_dedup, op3_compact_shards, op4_remove_repeats, op5_scan_licenses, op6_pack_best_fit, op7_quality_rules, op8_score_toxicity, op9_scan_secrets, op10_near_duplicates)
}

_OP1 = r"""
WITH base AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
named AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight, sum(source_size) OVER () AS total FROM src),
filled AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY source_size * (10 // weight), source NULLS LAST) AS place FROM named),
sums AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS limited,
         sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM filled),
level AS (
  SELECT place AS l_place, limited AS l_limited, open_weight AS l_weight FROM sums
  WHERE CAST(total - limited AS DOUBLE) * weight <= CAST(cap AS DOUBLE) * open_weight ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size, total,
         CASE WHEN l_place IS NULL OR place < l_place THEN CAST(cap AS DOUBLE)
              ELSE least(CAST(total - l_limited AS DOUBLE) * weight / l_weight, CAST(cap AS DOUBLE)) END AS target
  FROM sums LEFT JOIN level ON true),
queued AS (
  SELECT b.doc_id, b.size, b.k, coalesce('=' || b.source, '') AS queue, t.source_size, t.target, t.total,
         coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.k, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         row_number() OVER (ORDER BY b.k) AS row
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
entries AS (
  SELECT *, epoch * source_size + before AS a, epoch * source_size + before + size AS z, floor(target) AS met
  FROM queued, (SELECT unnest(range(3)) AS epoch)),
pieces AS (
  SELECT *, 0 AS piece, CASE WHEN a < met AND met < z THEN met ELSE z END AS till FROM entries
  UNION ALL SELECT * REPLACE (met AS a), 1, z FROM entries WHERE a < met AND met < z),
served AS (
  SELECT *, till - a AS words, sum(till - a) OVER (
    ORDER BY coalesce(CAST(till AS DOUBLE) / nullif(target, 0), 0), queue, k, size, epoch, piece ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent
  FROM pieces)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       CAST(sum(greatest(0, least(words, total - spent + words))) AS BIGINT) AS taken
FROM served GROUP BY row, doc_id
"""

_OP2 = r"""
WITH base AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS flat, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY flat) AS BIGINT) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(flat) AS text_sha256
FROM base WINDOW w AS (PARTITION BY flat ORDER BY n DESC, doc_id)
"""

_OP4 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, w[s : s + 19] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS nth FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS k FROM ranked WHERE nth > 1),
per AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(ks, []), i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
"""


def _op5_sql() -> str:
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    lower = f"translate(coalesce({{}}, ''), '{licenses.UPPER}', '{licenses.LOWER}')"
    wanted = ", ".join(f"('{label}', {sorted(set(t.split()))!r})" for label, t in licenses.TEMPLATES)
    phrases = ", ".join(f"('{label}', {p.split()!r})" for p, label in licenses.PHRASES.items())
    n, step = licenses.BLOCK_WORDS, licenses.BLOCK_WORDS // 2
    return f"""
WITH d AS (SELECT doc_id, text, regexp_extract_all({lower.format("text")}, {word}) AS w FROM documents),
phrases(label, p) AS (VALUES {phrases}),
places AS (
  SELECT doc_id, label, s - 1 AS k FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS s FROM d WHERE regexp_matches(text, '(?i)cc|general|rights')) x
  JOIN phrases ON w[s : s + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
templates(label, t) AS (VALUES {wanted}),
lines AS (SELECT doc_id, regexp_extract_all({lower.format("line")}, {word}) AS w FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
  UNION ALL SELECT doc_id, text FROM documents WHERE contains(text, chr(10))) y),
parts AS (SELECT doc_id, w[s : s + {n - 1}] AS b FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {step}) + 1, {step})) AS s FROM lines WHERE len(w) > 0) z),
alike AS (
  SELECT doc_id, label, len(list_intersect(t, b)) / len(t) AS share FROM parts, templates
  WHERE len(list_intersect(t, b)) >= ceil({licenses.THRESHOLD} * len(t) - 1e-9)),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS best FROM alike GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


_OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
edges AS MATERIALIZED (SELECT p.a, p.b FROM pairs p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": _OP1,
    "op2_exact_dedup": _OP2,
    "op4_remove_repeats": _OP4,
    "op5_scan_licenses": _op5_sql(),
    "op10_near_duplicates": _OP10,
}
