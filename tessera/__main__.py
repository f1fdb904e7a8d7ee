"""Command line: migrations and checks of queries.

    python -m tessera list|status|schema|up|down --module M --scripts FOLDER --root FOLDER [--target N] [--dry-run] [--output FILE]
    python -m tessera check --folder DATA --tables a,b "SELECT ..."
"""

from __future__ import annotations

import argparse
import importlib
import inspect
import sys
from pathlib import Path

from .migrations import Migration, MigrationError, Runner, scripts


def migrations_of(module: str) -> list[type[Migration]]:
    """The migrations that a module defines, by version."""
    found = [m for _, m in inspect.getmembers(importlib.import_module(module), inspect.isclass) if issubclass(m, Migration) and m is not Migration and m.version]
    return sorted(found, key=lambda m: m.version)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _check(args) -> int:
    from .api import Engine
    from .language.checker import analyze

    found = analyze(Engine.over_parquet(_session(), args.folder, args.tables.split(",")).schema, args.query)
    for d in found.diagnostics:
        print(d)
    for c in [] if found.diagnostics else found.columns:
        print(c)
    return 1 if found.diagnostics else 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("list", "status", "schema", "up", "down"):
        p = verbs.add_parser(verb)
        p.add_argument("--module", help="Python module that defines migrations")
        p.add_argument("--scripts", help="folder of migrations V<version>__<description>.sql")
        if verb not in ("list", "schema"):
            p.add_argument("--root", required=True, help="folder of the tables")
        if verb in ("up", "down"):
            p.add_argument("--target", type=int, required=verb == "down")
            p.add_argument("--dry-run", action="store_true")
        if verb == "schema":
            p.add_argument("--output", help="file for the schema as JSON")
    p = verbs.add_parser("check")
    p.add_argument("--folder", required=True)
    p.add_argument("--tables", required=True)
    p.add_argument("query")
    args = parser.parse_args(argv)
    if args.verb == "check":
        return _check(args)
    try:
        found = (migrations_of(args.module) if args.module else []) + (scripts(args.scripts) if args.scripts else [])
        found.sort(key=lambda m: m.version)
        if args.verb == "list":
            for m in found:
                print(m.version, m.__name__, "forward only" if m.forward_only() else "")
            return 0
        if args.verb == "schema":
            from .language.schema import Schema
            from .migrations.ddl import apply

            schema = Schema()
            for m in found:
                for op in m().collect(True):
                    schema = apply(schema, op)
            text = schema.to_json()
            Path(args.output).write_text(text, encoding="utf-8") if args.output else print(text)
            return 0
        runner = Runner(_session(), args.root, found)
        if args.verb == "status":
            for r in runner.status().collect():
                print(r["version"], r["name"], f"applied {r['applied_at']}" if r["applied"] else "pending")
        elif args.dry_run:
            for text in (runner.dry_run_up(args.target) if args.verb == "up" else runner.dry_run_down(args.target)).statements:
                print(text + ";")
        else:
            print(*(runner.up(args.target) if args.verb == "up" else runner.down(args.target)))
    except (MigrationError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
