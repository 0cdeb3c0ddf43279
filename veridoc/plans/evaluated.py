"""Which keys and items of a value a schema evaluates, as SQL arrays.

What a branch evaluates counts only where the branch holds. With ``beside``, the keywords
unevaluatedProperties and unevaluatedItems of the schema itself are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from veridoc.functions.regex import to_java
from veridoc.functions.text import fresh, let, quote
from veridoc.schema.resolve import Place

_NO_KEYS, _NO_ITEMS = "CAST(array() AS ARRAY<STRING>)", "CAST(array() AS ARRAY<INT>)"


def _union(parts: list[str], none: str) -> str:
    parts = [p for p in parts if p != none]
    out = parts[0] if parts else none
    for p in parts[1:]:
        out = f"array_union({out}, {p})"
    return out


def _branches(compiler, place: Place, v: str, none: str, of) -> list[str]:
    """What the schemas that apply to the same value evaluate."""
    schema, out = place.schema, []
    resources = compiler.resources
    for key in ("$ref", "$dynamicRef"):
        if key in schema:
            out.append(of(resources.follow(place, key == "$dynamicRef")))
    out += [of(place.sub(s, resources)) for s in schema.get("allOf", [])]
    where = lambda check, got: got if got == none or check == "true" else f"CASE WHEN {check} THEN {got} ELSE {none} END"
    for key in ("anyOf", "oneOf"):
        for s in schema.get(key, []):
            out.append(where(compiler.sub(place, s, v), of(place.sub(s, resources))))
    if "if" in schema:
        test = compiler.sub(place, schema["if"], v)
        then = _union([of(place.sub(schema["if"], resources)), *([of(place.sub(schema["then"], resources))] if "then" in schema else [])], none)
        other = of(place.sub(schema["else"], resources)) if "else" in schema else none
        out.append(f"CASE WHEN {test} THEN {then} ELSE {other} END")
    return out


def evaluated_keys(compiler, place: Place, v: str, m: str, beside: bool = False) -> str:
    schema = place.schema
    if not isinstance(schema, dict):
        return _NO_KEYS
    if "additionalProperties" in schema or not beside and "unevaluatedProperties" in schema:
        return f"map_keys({m})"
    parts = []
    if schema.get("properties"):
        parts.append(f"array({', '.join(map(quote, schema['properties']))})")
    for p in schema.get("patternProperties", {}):
        k = fresh("k")
        parts.append(f"filter(map_keys({m}), {k} -> {k} RLIKE {quote(to_java(p))})")
    for k, s in schema.get("dependentSchemas", {}).items():
        got = evaluated_keys(compiler, place.sub(s, compiler.resources), v, m)
        if got != _NO_KEYS:
            parts.append(f"CASE WHEN map_contains_key({m}, {quote(k)}) THEN {got} ELSE {_NO_KEYS} END")
    parts += _branches(compiler, place, v, _NO_KEYS, lambda p: evaluated_keys(compiler, p, v, m))
    return _union(parts, _NO_KEYS)


def evaluated_items(compiler, place: Place, v: str, a: str, beside: bool = False) -> str:
    schema = place.schema
    if not isinstance(schema, dict):
        return _NO_ITEMS
    every = f"CASE WHEN size({a}) = 0 THEN {_NO_ITEMS} ELSE sequence(0, size({a}) - 1) END"
    if isinstance(schema.get("items"), (dict, bool)) or not beside and "unevaluatedItems" in schema:
        return every
    parts = []
    if schema.get("prefixItems"):
        parts.append(f"sequence(0, {len(schema['prefixItems']) - 1})")
    if "contains" in schema:
        i = fresh("i")
        check = let(f"get({a}, {i})", lambda x: compiler.sub(place, schema["contains"], x))
        parts.append(f"filter({every}, {i} -> {check})")
    parts += _branches(compiler, place, v, _NO_ITEMS, lambda p: evaluated_items(compiler, p, v, a))
    return _union(parts, _NO_ITEMS)


@dataclass
class Evaluated:
    """What a schema evaluates as far as it can be told without a value."""

    props: set[str] = field(default_factory=set)
    items: int = 0
    all_props: bool = False
    all_items: bool = False
    dynamic: bool = False

    def add(self, other: Evaluated, dynamic: bool = False) -> None:
        self.props |= other.props
        self.items = max(self.items, other.items)
        self.all_props |= other.all_props
        self.all_items |= other.all_items
        self.dynamic |= dynamic or other.dynamic


def collect(schema: Any, resources=None, place: Place | None = None) -> Evaluated:
    """The static summary of what a schema evaluates."""
    from veridoc.schema.resolve import Resources

    if place is None:
        resources, place = Resources.of(schema)
    out, schema = Evaluated(), place.schema
    if not isinstance(schema, dict):
        return out
    inner = lambda s: collect(s, resources, place.sub(s, resources))
    for key in ("$ref", "$dynamicRef"):
        if key in schema:
            out.add(collect(None, resources, resources.follow(place, key == "$dynamicRef")))
    out.props |= set(schema.get("properties", {}))
    out.all_props |= schema.get("additionalProperties", False) is not False or schema.get("unevaluatedProperties", False) is not False
    out.dynamic |= bool(schema.get("patternProperties")) or "contains" in schema
    out.items = max(out.items, len(schema.get("prefixItems", [])))
    out.all_items |= isinstance(schema.get("items"), (dict, bool)) and schema["items"] is not False or schema.get("unevaluatedItems", False) is not False
    for s in schema.get("allOf", []):
        out.add(inner(s))
    for s in [*schema.get("anyOf", []), *schema.get("oneOf", []), *schema.get("dependentSchemas", {}).values(), *(schema[k] for k in ("if", "then", "else") if k in schema)]:
        out.add(inner(s), True)
    return out
