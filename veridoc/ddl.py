"""Schemas as Spark types: StructType, and DDL text with comments."""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

from veridoc.schema.normalize import Schema
from veridoc.schema.resolve import Place, RecursiveSchema, Resources

DEPTH = 32


def _type(resources: Resources, place: Place, depth: int) -> T.DataType:
    schema = place.schema
    if depth > DEPTH or not isinstance(schema, dict):
        return T.VariantType()
    if "$ref" in schema or "$dynamicRef" in schema:
        try:
            return _type(resources, resources.follow(place, "$ref" not in schema), depth + 1)
        except RecursiveSchema:
            return T.VariantType()
    if "anyOf" in schema or "oneOf" in schema:
        return T.VariantType()
    names = schema.get("type")
    names = [names] if isinstance(names, str) else list(names or [])
    if not names:
        values = schema.get("enum", [schema["const"]] if "const" in schema else [])
        names = sorted({_name(v) for v in values})
        if not names and "properties" in schema:
            names = ["object"]
    names = [n for n in names if n != "null"]
    if set(names) == {"integer", "number"}:
        names = ["number"]
    if len(names) != 1:
        return T.VariantType()
    match names[0]:
        case "string":
            return T.StringType()
        case "integer":
            return T.LongType()
        case "number":
            return T.DoubleType()
        case "boolean":
            return T.BooleanType()
        case "array":
            if "prefixItems" in schema or not isinstance(schema.get("items"), dict):
                return T.ArrayType(T.VariantType())
            return T.ArrayType(_type(resources, place.sub(schema["items"], resources), depth + 1))
    parts: dict[str, Any] = dict(schema.get("properties", {}))
    required = set(schema.get("required", []))
    for s in schema.get("allOf", []):
        if isinstance(s, dict):
            parts |= s.get("properties", {})
            required |= set(s.get("required", []))
    if not parts:
        extra = schema.get("additionalProperties")
        value = _type(resources, place.sub(extra, resources), depth + 1) if isinstance(extra, dict) else T.VariantType()
        return T.MapType(T.StringType(), value)
    fields = []
    for k, s in parts.items():
        told = (s.get("description") or s.get("title")) if isinstance(s, dict) else None
        nullable = k not in required or isinstance(s, dict) and isinstance(s.get("type"), list) and "null" in s["type"]
        fields.append(T.StructField(k, _type(resources, place.sub(s, resources), depth + 1), nullable, {"comment": told} if told else {}))
    return T.StructType(fields)


def _name(v: Any) -> str:
    if v is None:
        return "null"
    return {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}[type(v)]


def to_type(schema: Schema, schemas=()) -> T.DataType:
    """The Spark type of the documents that a schema describes; what it leaves open is VARIANT."""
    resources, root = Resources.of(schema, schemas)
    return _type(resources, root, 0)


def to_struct_type(schema: Schema, schemas=()) -> T.StructType:
    out = to_type(schema, schemas)
    return out if isinstance(out, T.StructType) else T.StructType([T.StructField("value", out)])


def _ddl(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        return "STRUCT<" + ", ".join(f"`{f.name}`: {_ddl(f.dataType)}{'' if f.nullable else ' NOT NULL'}{_comment(f)}" for f in kind.fields) + ">"
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{_ddl(kind.elementType)}>"
    if isinstance(kind, T.MapType):
        return f"MAP<STRING, {_ddl(kind.valueType)}>"
    return kind.simpleString().upper()


def _comment(field: T.StructField) -> str:
    told = field.metadata.get("comment")
    return " COMMENT '" + told.replace("\\", "\\\\").replace("'", "\\'") + "'" if told else ""


def to_ddl(schema: Schema, schemas=()) -> str:
    """The columns of a table for such documents, as DDL."""
    return ",\n".join(f"`{f.name}` {_ddl(f.dataType)}{'' if f.nullable else ' NOT NULL'}{_comment(f)}" for f in to_struct_type(schema, schemas).fields)
