"""Flat schemas over typed columns: plain predicates, which Spark pushes down to the scan.

A schema is flat if it is an object of scalar properties. A SQL null counts as a missing key
(``nulls="absent"``) or as JSON null (``nulls="null"``).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridoc.functions import formats
from veridoc.functions.regex import to_java
from veridoc.schema.normalize import Schema, SchemaError, normalize

ROOT = {"type", "properties", "required", "additionalProperties", "$schema", "$id", "$defs", "title", "description", "minProperties", "maxProperties", "dependentRequired"}
LEAF = {"type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "format", "title", "description", "default", "examples"}
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMBERS = (*_INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType)


def is_flat(schema: Schema) -> bool:
    """Whether a schema is an object of scalar properties, without further structure."""
    schema = normalize(schema)
    if not isinstance(schema, dict) or schema.get("type") != "object" or set(schema) - ROOT or not isinstance(schema.get("additionalProperties", False), bool):
        return False
    scalar = lambda x: not isinstance(x, (dict, list))
    for sub in schema.get("properties", {}).values():
        if not isinstance(sub, dict) or set(sub) - LEAF or not all(map(scalar, sub.get("enum", []))) or not scalar(sub.get("const")):
            return False
        names = sub.get("type", "string")
        if set([names] if isinstance(names, str) else names) & {"object", "array"}:
            return False
    return True


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _leaf(c: Column, kind: T.DataType, schema: dict) -> list[Column]:
    """What has to hold for a column that isn't null to fit."""
    names = schema.get("type")
    names = [names] if isinstance(names, str) else names
    number, text, boolean = isinstance(kind, _NUMBERS), not isinstance(kind, (*_NUMBERS, T.BooleanType, T.StructType, T.ArrayType, T.MapType)), isinstance(kind, T.BooleanType)
    parts: list[Column] = []
    as_double = c.cast("double")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        finite = ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))
    else:
        finite = F.lit(True)
    if names is not None:
        if number and "number" in names:
            parts.append(finite)
        elif number and "integer" in names:
            parts.append(F.lit(True) if isinstance(kind, _INTEGRAL) else finite & (as_double % 1 == 0))
        elif not (text and "string" in names or boolean and "boolean" in names):
            return [F.lit(False)]
    for values in [schema[k] if k == "enum" else [schema[k]] for k in ("enum", "const") if k in schema]:
        own = [x for x in values if (isinstance(x, bool) if boolean else isinstance(x, str) if text else isinstance(x, (int, float)) and not isinstance(x, bool))]
        parts.append(c.isin(*own) if own else F.lit(False))
    if number:
        for key, holds in (("minimum", lambda x: c >= x), ("maximum", lambda x: c <= x), ("exclusiveMinimum", lambda x: c > x), ("exclusiveMaximum", lambda x: c < x)):
            if key in schema:
                parts.append(holds(F.lit(schema[key])))
        if "multipleOf" in schema:
            m = F.lit(float(schema["multipleOf"]))
            rest = F.abs(as_double) % m
            parts.append((rest <= 1e-8) | (F.abs(rest - m) <= 1e-8))
    if text:
        if "minLength" in schema:
            parts.append(F.length(c) >= schema["minLength"])
        if "maxLength" in schema:
            parts.append(F.length(c) <= schema["maxLength"])
        if "pattern" in schema:
            parts.append(c.rlike(to_java(schema["pattern"])))
        if schema.get("format") in formats.FORMATS:
            parts.append(c.rlike(formats.java(schema["format"])))
    return parts


def typed_predicate(schema: Schema, columns: T.StructType, nulls: str = "absent") -> Column:
    """The verdict of a flat schema on a row of typed columns, as a conjunction of predicates on columns."""
    schema = normalize(schema)
    if not is_flat(schema):
        raise SchemaError("not a flat schema")
    kinds = {f.name: f.dataType for f in columns.fields}
    declared, parts = schema.get("properties", {}), []
    present = {k: F.col(f"`{k}`").isNotNull() if nulls == "absent" else F.lit(True) for k in kinds}
    for k in schema.get("required", []):
        parts.append(present.get(k, F.lit(False)))
    if schema.get("additionalProperties") is False:
        extra = [k for k in kinds if k not in declared]
        parts += [F.col(f"`{k}`").isNull() for k in extra] if nulls == "absent" else [F.lit(False)] * bool(extra)
    for k, sub in declared.items():
        if k not in kinds:
            continue
        c = F.col(f"`{k}`")
        fits = _leaf(c, kinds[k], sub)
        if nulls == "absent":
            # One disjunction for each condition, so that Spark can push each down.
            parts += fits if k in schema.get("required", []) else [c.isNull() | x for x in fits]
        else:
            names = sub.get("type")
            null_fits = (names is None or "null" in names or names == "null") and None in sub.get("enum", [None]) and sub.get("const") is None
            parts.append(F.when(c.isNull(), F.lit(null_fits)).otherwise(_all(fits)))
    for k, needed in schema.get("dependentRequired", {}).items():
        if k in kinds:
            parts += [~present[k] | present.get(n, F.lit(False)) for n in needed]
    count = sum((p.cast("int") for p in present.values()), F.lit(0))
    if "minProperties" in schema:
        parts.append(count >= schema["minProperties"])
    if "maxProperties" in schema:
        parts.append(count <= schema["maxProperties"])
    return _all(parts)

