"""Draft-7 schemas rewritten to 2020-12, and warnings about keywords of the wrong kind."""

from __future__ import annotations

import copy
from typing import Any

Schema = dict | bool
DRAFT7 = {"http://json-schema.org/draft-07/schema#", "http://json-schema.org/draft-07/schema"}
MAPS = ("properties", "patternProperties", "$defs", "definitions", "dependentSchemas")
LISTS = ("allOf", "anyOf", "oneOf", "prefixItems")
SINGLES = ("items", "contains", "not", "if", "then", "else", "additionalProperties", "propertyNames", "unevaluatedItems", "unevaluatedProperties", "additionalItems")


class SchemaError(ValueError):
    """A schema that cannot be compiled: a reference or expression that has no meaning."""


def subschemas(schema: Any):
    """(path steps, subschema) of the direct subschemas of a schema."""
    if not isinstance(schema, dict):
        return
    for key in MAPS:
        if isinstance(schema.get(key), dict):
            for name, sub in schema[key].items():
                yield (key, name), sub
    for key in (*LISTS, "items"):
        if isinstance(schema.get(key), list):
            for i, sub in enumerate(schema[key]):
                yield (key, str(i)), sub
    for key in SINGLES:
        if isinstance(schema.get(key), (dict, bool)):
            yield (key,), schema[key]


def is_draft7(schema: Any) -> bool:
    return isinstance(schema, dict) and schema.get("$schema") in DRAFT7


def normalize(schema: Schema) -> Schema:
    """A copy of the schema in 2020-12 form; other drafts than Draft-7 are only copied."""
    out = copy.deepcopy(schema)
    if is_draft7(out):
        _rewrite(out)
    return out


def _rewrite(schema: Any) -> None:
    if not isinstance(schema, dict):
        return
    if "$ref" in schema:  # in Draft-7 everything beside a reference is ignored
        for key in [k for k in schema if k not in ("$ref", "$schema", "$id", "definitions", "$defs")]:
            del schema[key]
    if "definitions" in schema and "$defs" not in schema:
        schema["$defs"] = schema.pop("definitions")
    for key, value in schema.pop("dependencies", {}).items():
        schema.setdefault("dependentRequired" if isinstance(value, list) else "dependentSchemas", {})[key] = value
    if isinstance(schema.get("items"), list):
        schema["prefixItems"] = schema.pop("items")
        if "additionalItems" in schema:
            schema["items"] = schema.pop("additionalItems")
    for _, sub in subschemas(schema):
        _rewrite(sub)


def _whole(x: Any) -> bool:
    return not isinstance(x, bool) and (isinstance(x, int) or isinstance(x, float) and x.is_integer()) and x >= 0


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _strings(x: Any) -> bool:
    return isinstance(x, list) and all(isinstance(i, str) for i in x)


_KINDS = {
    **dict.fromkeys(("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties", "minContains", "maxContains"), ("a non-negative integer", _whole)),
    **dict.fromkeys(("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"), ("a number", _number)),
    "multipleOf": ("a positive number", lambda x: _number(x) and x > 0),
    **dict.fromkeys(("pattern", "format", "$ref", "$dynamicRef", "$anchor", "$dynamicAnchor", "$id"), ("a string", lambda x: isinstance(x, str))),
    "required": ("an array of strings", _strings),
    "uniqueItems": ("a boolean", lambda x: isinstance(x, bool)),
    "enum": ("an array", lambda x: isinstance(x, list)),
    "type": ("a type name or an array of them", lambda x: isinstance(x, str) or _strings(x)),
    **dict.fromkeys(("properties", "patternProperties", "dependentSchemas", "dependentRequired", "$defs"), ("an object", lambda x: isinstance(x, dict))),
    **dict.fromkeys(("allOf", "anyOf", "oneOf", "prefixItems"), ("an array of schemas", lambda x: isinstance(x, list))),
}
TYPES = ("string", "number", "integer", "boolean", "null", "object", "array")


def warnings(schema: Schema, path: str = "#") -> list[dict[str, str]]:
    """Keywords whose value has the wrong kind (they are ignored), and unknown type names."""
    if not isinstance(schema, dict):
        return []
    out = [{"path": f"{path}/{k}", "message": f"{k} must be {what}"} for k, (what, fits) in _KINDS.items() if k in schema and not fits(schema[k])]
    names = schema.get("type")
    for name in [names] if isinstance(names, str) else names if _strings(names) else []:
        if name not in TYPES:
            out.append({"path": f"{path}/type", "message": f"unknown type {name}"})
    for steps, sub in subschemas(schema):
        out += warnings(sub, "/".join((path, *steps)))
    return out


def without_misfits(schema: Schema) -> Schema:
    """The schema without the keywords that ``warnings`` reports as of the wrong kind; changes it in place."""
    if isinstance(schema, dict):
        for k, (_, fits) in _KINDS.items():
            if k in schema and not fits(schema[k]):
                del schema[k]
        for _, sub in subschemas(schema):
            without_misfits(sub)
    return schema
