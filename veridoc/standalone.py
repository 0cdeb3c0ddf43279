"""Compiled validators as SQL text, which runs without this package."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import SparkSession

from veridoc.functions.text import restart
from veridoc.operators.validator import RESULT, Validator, parsed
from veridoc.plans.errors import ERROR

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def _checked(name: str) -> str:
    if not _NAME.match(name):
        raise ValueError(f"not a function name: {name}")
    return name


def to_sql(validator: Validator, text: str = "doc") -> str:
    """The verdict on a column of JSON text as one SQL expression; the same text each time."""
    validator.compile()
    restart()
    return validator.valid_sql(validator.document_sql(parsed(text)))


def _errors_sql(validator: Validator, text: str) -> str:
    validator.compile()
    restart()
    return validator.errors_sql(validator.document_sql(parsed(text)))


def to_function(validator: Validator, name: str, temporary: bool = True, errors: bool = True) -> list[str]:
    """Statements that create name(json) for the verdict and, with errors, name_errors(json) for the errors."""
    kind = "TEMPORARY FUNCTION" if temporary else "FUNCTION"
    out = [f"CREATE OR REPLACE {kind} {_checked(name)}(veridoc_json STRING) RETURNS BOOLEAN RETURN {to_sql(validator, 'veridoc_json')}"]
    if errors:
        out.append(f"CREATE OR REPLACE {kind} {name}_errors(veridoc_json STRING) RETURNS array<{ERROR}> RETURN {_errors_sql(validator, 'veridoc_json')}")
    return out


def bundle(validators: dict[str, Validator], errors: bool = True) -> str:
    """Several validators as one text: JSON of the statements by name; equal verdicts are kept once."""
    statements: dict[str, list[str]] = {}
    same: dict[str, str] = {}
    aliases: dict[str, str] = {}
    for name, v in validators.items():
        body = to_sql(v, "veridoc_json") + (_errors_sql(v, "veridoc_json") if errors else "")
        if body in same:
            aliases[name] = same[body]
        else:
            same[body] = name
            statements[name] = to_function(v, name, errors=errors)
    return json.dumps({"result": RESULT, "functions": statements, "aliases": aliases})


def load_bundle(spark: SparkSession, text: str) -> list[str]:
    """Creates the functions of a bundle in the session; their names."""
    spec = json.loads(text)
    for statements in spec["functions"].values():
        for s in statements:
            spark.sql(s)
    for name, of in spec["aliases"].items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {_checked(name)}(veridoc_json STRING) RETURNS BOOLEAN RETURN {_checked(of)}(veridoc_json)")
        if any(f"FUNCTION {of}_errors(" in s for s in spec["functions"][of]):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_errors(veridoc_json STRING) RETURNS array<{ERROR}> RETURN {of}_errors(veridoc_json)")
    return [*spec["functions"], *spec["aliases"]]


def script(validators: Iterable[tuple[str, Validator]], errors: bool = True) -> str:
    """The functions as a SQL script."""
    return ";\n".join(s for name, v in validators for s in to_function(v, name, errors=errors)) + ";\n"
