"""Recursive queries that drop duplicates (UNION without ALL).

Spark recurses by UNION ALL only.  Here each round joins the rows that the last
one has added, and what is known already is taken off by an anti join.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..language.diagnostics import Diagnostic, QueryError


def _split(sql: str, name: str) -> tuple[str, str, str, str]:
    """(column list, seed, step, rest) of ``WITH RECURSIVE name(columns) AS (...) rest``."""
    head = re.match(rf"WITH RECURSIVE `{re.escape(name)}`\(([^)]*)\) AS \(SELECT \* FROM \(", sql)
    if not head:
        raise QueryError([Diagnostic("SQL100", "Only one recursive query, which stands first, can drop duplicates.")])

    def closing(at: int) -> int:
        depth, i, quoted = 1, at, ""
        while depth:
            c = sql[i]
            if quoted:
                quoted = "" if c == quoted and sql[i - 1] != "\\" else quoted
            elif c in "'`":
                quoted = c
            else:
                depth += (c == "(") - (c == ")")
            i += 1
        return i - 1

    at = head.end() + 1  # behind the parenthesis of the first term
    end = closing(at)
    seed = sql[at:end]
    rest = re.match(r"\) UNION \(", sql[end:])
    if not rest:
        raise QueryError([Diagnostic("SQL100", "A recursive query that drops duplicates has two terms.")])
    at = end + rest.end()
    end = closing(at)
    tail = sql[closing(end + 1) :]  # behind the set operation
    body_end = re.match(r"\) AS `__set`\([^)]*\)\) ", tail)
    return head[1], seed, sql[at:end], tail[body_end.end() :]


def fixpoint(spark: SparkSession, found, args: dict) -> DataFrame:
    name = found.recursive[0]
    columns, seed, step, rest = _split(found.sql, name)
    names = [c.strip().strip("`") for c in columns.split(",")]
    run = lambda text: spark.sql(text, args={k: v for k, v in args.items() if f":{k} " in text}) if args else spark.sql(text)
    from ..sources.scratch import folder, written

    path = f"{folder(spark)}/fixpoint-{uuid.uuid4().hex}"
    fresh = written(run(seed).toDF(*names).distinct())
    while True:  # until a round adds nothing; each adds its own files to what is known
        fresh.write.mode("append").parquet(path)
        every = spark.read.schema(fresh.schema).parquet(path)
        if fresh.isEmpty():
            break
        fresh.createOrReplaceTempView(name)
        more = run(step).toDF(*names).distinct()
        known = None
        for c in names:
            same = more[c].eqNullSafe(every[c])
            known = same if known is None else known & same
        fresh = written(more.join(every, known, "left_anti"))
    every.createOrReplaceTempView(name)
    return run(rest)
