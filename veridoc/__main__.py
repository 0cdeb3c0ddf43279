"""python -m veridoc compile SCHEMA [-o OUT] [-f sql|json] [--name NAME] [--no-types] [--abort-early]"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from veridoc.ddl import to_ddl
from veridoc.operators.validator import Validator
from veridoc.standalone import bundle, script


def main(argv: list[str] | None = None) -> int:
    """Compiles a schema file to SQL functions, and its columns to DDL beside them."""
    parser = argparse.ArgumentParser(prog="veridoc", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("compile", help="a schema to SQL functions")
    c.add_argument("schema", type=Path)
    c.add_argument("-o", "--output", type=Path)
    c.add_argument("-f", "--format", choices=("sql", "json"), default="sql")
    c.add_argument("--name", default="is_valid_document")
    c.add_argument("--no-types", action="store_true", help="write no DDL")
    c.add_argument("--abort-early", action="store_true", help="the verdict only")
    args = parser.parse_args(argv)
    try:
        schema = json.loads(args.schema.read_text(encoding="utf-8"))
        validator = Validator(schema).compile()
        text = script([(args.name, validator)], not args.abort_early) if args.format == "sql" else bundle({args.name: validator}, not args.abort_early)
    except (OSError, ValueError) as e:
        print(f"veridoc: {e}", file=sys.stderr)
        return 1
    out = args.output or args.schema.with_suffix(f".validator.{args.format}")
    out.write_text(text, encoding="utf-8")
    if not args.no_types:
        out.with_suffix(".ddl").write_text(to_ddl(schema) + "\n", encoding="utf-8")
    for w in validator.warnings:
        print(f"warning: {w['path']}: {w['message']}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
