"""Schemas as boolean SQL over a VARIANT. Every verdict is true or false, never null, for a value that isn't null."""

from __future__ import annotations

import math
import re
from typing import Any

from veridoc.functions import formats
from veridoc.functions.regex import to_java
from veridoc.functions.text import both, either, fresh, let, negate, number, quote
from veridoc.schema.normalize import SchemaError
from veridoc.schema.resolve import MOST_TEXT, Place, Resources, TooManyReferences

NUMERIC = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf")
TEXTUAL = ("minLength", "maxLength", "pattern", "format")
ARRAYS = ("minItems", "maxItems", "uniqueItems", "items", "prefixItems", "contains", "unevaluatedItems")
OBJECTS = ("required", "properties", "patternProperties", "additionalProperties", "propertyNames", "minProperties", "maxProperties", "dependentRequired", "dependentSchemas", "unevaluatedProperties")
_SIGNS = {"minimum": ">=", "maximum": "<=", "exclusiveMinimum": ">", "exclusiveMaximum": "<"}


#: Keys that a path spells as they are.
_SIMPLE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
#: Keywords of objects that need all keys.
_ALL_KEYS = ("patternProperties", "propertyNames", "minProperties", "maxProperties")


class Part(str):
    """SQL of what is at a path of the variant named root; null where nothing is."""

    root: str
    path: str

    def __new__(cls, root: str, path: str = "$") -> Part:
        self = super().__new__(cls, root if path == "$" else f"try_variant_get({root}, {quote(path)}, 'variant')")
        self.root, self.path = root, path
        return self

    def at(self, key: str) -> Part:
        return Part(self.root, f"{self.path}.{key}")


class Merged(str):
    """A conjunction that holds each of its parts once; a part with a path counts only where something is there."""

    parts: dict[tuple[Part | None, str], None]

    def __new__(cls, checks: list[str]) -> Merged:
        parts = {x: None for c in checks if c != "true" for x in (c.parts if isinstance(c, Merged) else {(None, c): None})}
        self = super().__new__(cls, _nested(list(parts), None))
        self.parts = parts
        return self

    @classmethod
    def below(cls, path: Part, check: str) -> Merged:
        """The check, where something is at the path; where something is at a longer one, something is at the path."""
        parts = {(own or path, c): None for own, c in cls([check]).parts}
        self = super().__new__(cls, _nested(list(parts), None))
        self.parts = parts
        return self


def _nested(parts: list[tuple[Part | None, str]], at: Part | None) -> str:
    """The parts at a path, and below it those of each longer one, which is looked at once."""
    here, deeper = [c for path, c in parts if path == at], [x for x in parts if x[0] != at]
    while deeper:
        top = min((path for path, _ in deeper), key=lambda x: len(x.path))
        inside = lambda x, top=top: x[0] == top or x[0].root == top.root and x[0].path.startswith(f"{top.path}.")
        here.append(either([f"{top} IS NULL", _nested([x for x in deeper if inside(x)], top)]))
        deeper = [x for x in deeper if not inside(x)]
    return both(here)


def as_map(v: str) -> str:
    return f"try_cast({v} AS MAP<STRING, VARIANT>)"


def as_array(v: str) -> str:
    return f"try_cast({v} AS ARRAY<VARIANT>)"


def as_double(v: str) -> str:
    return f"try_variant_get({v.root}, {quote(v.path)}, 'double')" if isinstance(v, Part) else f"try_variant_get({v}, '$', 'double')"


def as_text(v: str) -> str:
    return f"try_variant_get({v.root}, {quote(v.path)}, 'string')" if isinstance(v, Part) else f"try_variant_get({v}, '$', 'string')"


def kind(v: str) -> str:
    """One of the names of JSON types, for any variant."""
    return (
        f"CASE WHEN is_variant_null({v}) THEN 'null' WHEN {as_array(v)} IS NOT NULL THEN 'array' WHEN {as_map(v)} IS NOT NULL THEN 'object' "
        f"ELSE {scalar_kind(v)} END"
    )


def scalar_kind(v: str) -> str:
    return let(
        f"schema_of_variant({v})",
        lambda t: f"CASE WHEN {t} = 'BIGINT' OR {t} LIKE 'DECIMAL%' THEN 'number' WHEN {t} = 'STRING' THEN 'string' WHEN {t} = 'BOOLEAN' THEN 'boolean' WHEN {t} = 'VOID' THEN 'null' "
        f"WHEN {t} IN ('DOUBLE', 'FLOAT') THEN CASE WHEN isnan({as_double(v)}) OR abs({as_double(v)}) = double('infinity') THEN 'infinite' ELSE 'number' END "
        f"WHEN {t} LIKE 'OBJECT%' THEN 'object' WHEN {t} LIKE 'ARRAY%' THEN 'array' ELSE 'string' END",
    )


def is_type(v: str, name: str) -> str:
    match name:
        case "object":
            return f"({as_map(v)} IS NOT NULL)"
        case "array":
            return f"({as_array(v)} IS NOT NULL)"
        case "null":
            return f"is_variant_null({v})"
        case "integer":
            return f"(schema_of_variant({v}) = 'BIGINT' OR substr(schema_of_variant({v}), 1, 7) IN {_FRACTIONS} AND {as_double(v)} % 1 = 0)"
        case "number":
            finite = f"NOT isnan({as_double(v)}) AND abs({as_double(v)}) < double('infinity')"
            return f"(schema_of_variant({v}) = 'BIGINT' OR substr(schema_of_variant({v}), 1, 7) IN {_FRACTIONS} AND {finite})"
        case "string":
            return f"(schema_of_variant({v}) IN {_TEXTS})"
        case "boolean":
            return f"(schema_of_variant({v}) = 'BOOLEAN')"
    return "false"


#: How the names begin that schema_of_variant gives to numbers that may have fractions.
_FRACTIONS = "('DECIMAL', 'DOUBLE', 'FLOAT')"
#: What schema_of_variant calls scalars that are texts in JSON.
_TEXTS = "('STRING', 'DATE', 'TIMESTAMP', 'TIMESTAMP_NTZ', 'BINARY', 'UUID')"


def equals(v: str, value: Any) -> str:
    """Whether a variant equals a fixed value: numbers by value, objects whatever the order of keys."""
    if value is None:
        return f"is_variant_null({v})"
    if isinstance(value, bool):
        return f"({is_type(v, 'boolean')} AND try_variant_get({v}, '$', 'boolean') = {str(value).lower()})"
    if isinstance(value, (int, float)):
        return f"({is_type(v, 'number')} AND {as_double(v)} = {number(value)})"
    if isinstance(value, str):
        return f"({is_type(v, 'string')} AND {as_text(v)} = {quote(value)})"
    if isinstance(value, list):
        return let(as_array(v), lambda a: "coalesce(" + both([f"size({a}) = {len(value)}", *(let(f"get({a}, {i})", lambda x, y=y: equals(x, y)) for i, y in enumerate(value))]) + ", false)")
    return let(as_map(v), lambda m: "coalesce(" + both([f"size({m}) = {len(value)}", *(f"coalesce({let(f'element_at({m}, {quote(k)})', lambda x, y=y: f'CASE WHEN {x} IS NULL THEN false ELSE {equals(x, y)} END')}, false)" for k, y in value.items())]) + ", false)")


def one_of_values(v: str, values: list) -> str:
    """Membership; the strings and the numbers among the values as one IN each."""
    texts = [x for x in values if isinstance(x, str)]
    numbers = [x for x in values if isinstance(x, (int, float)) and not isinstance(x, bool)]
    rest = [x for x in values if not isinstance(x, str) and (isinstance(x, bool) or not isinstance(x, (int, float)))]
    parts = []
    if texts:
        parts.append(f"({is_type(v, 'string')} AND {as_text(v)} IN ({', '.join(map(quote, texts))}))")
    if numbers:
        parts.append(f"({is_type(v, 'number')} AND {as_double(v)} IN ({', '.join(map(number, numbers))}))")
    return either(parts + [equals(v, x) for x in rest])


def canonical(v: str) -> str:
    """Text that is the same for equal values only: keys sorted, numbers by value."""
    return let(
        kind(v),
        lambda k: f"CASE {k} WHEN 'number' THEN concat('n', CAST({as_double(v)} + 0 AS STRING)) WHEN 'string' THEN concat('s', {as_text(v)}) "
        f"ELSE regexp_replace(to_json({v}), {quote(_NUMBERS)}, {quote('$1$2')}) END",
    )


#: A JSON string (kept), or a number's whole part (kept) and the zeros after its point (dropped). What repeats gives
#: nothing back, so Java loops over a string of any length instead of calling itself.
_NUMBERS = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|(-?\d++)\.0++(?!\d)'


def member(v: str, m: str, key: str) -> str:
    """The value of a key; null where it is missing."""
    return f"element_at({m}, {quote(key)})"


def has(m: str, key: str) -> str:
    return f"map_contains_key({m}, {quote(key)})"


def undeclared(k: str, schema: dict) -> str:
    """Whether a key is neither declared nor matched by a pattern."""
    parts = []
    if schema.get("properties"):
        parts.append(f"{k} NOT IN ({', '.join(map(quote, schema['properties']))})")
    parts += [f"NOT {k} RLIKE {quote(to_java(p))}" for p in schema.get("patternProperties", {})]
    return both(parts)


def by_path(schema: dict) -> bool:
    """Whether an object's keys that matter are all named, in words that a path can hold."""
    if any(k in schema for k in _ALL_KEYS) or schema.get("additionalProperties", True) is not True or schema.get("unevaluatedProperties", True) is not True:
        return False
    depend = schema.get("dependentRequired", {})
    keys = [*schema.get("required", []), *schema.get("properties", {}), *depend, *schema.get("dependentSchemas", {}), *(n for x in depend.values() for n in x)]
    return all(map(_SIMPLE.match, keys))


class BooleanCompiler:
    """Compiles the verdict of a schema on a variant.

    merge: what several references ask of the same value is asked once, and a definition is compiled once
    for each value, so references that fan out through conjunctions and named keys make little text.
    """

    def __init__(self, resources: Resources, custom: dict[str, str] | None = None, merge: bool = False):
        #: Custom formats as SQL templates with {} for the text.
        self.resources, self.custom, self.merge = resources, custom or {}, merge
        self._all = Merged if merge else both
        self._known: dict[tuple, str] = {}

    def compile(self, place: Place, v: str) -> str:
        """SQL that is true if the variant named v (not null) fits."""
        if isinstance(place.schema, bool):
            return str(place.schema).lower()
        if not self.merge:
            return self._compiled(place, v)
        key = id(place.schema), place.base, place.scope, str(v)
        if key not in self._known:
            self._known[key] = self._compiled(place, v)
            if len(self._known[key]) > MOST_TEXT:
                raise TooManyReferences(f"over {MOST_TEXT} characters")
        return self._known[key]

    def _compiled(self, place: Place, v: str) -> str:
        schema = place.schema
        names = schema.get("type")
        names = [names] if isinstance(names, str) else names
        rest = lambda: self._all([*self._any_kind(place, v), *self._by_kind(place, v, names)])
        if names is None or names == ["object"] and schema.get("required") and by_path(schema):
            return rest()  # what has a key is an object
        test = either([is_type(v, n) for n in dict.fromkeys(names) if n != "integer" or "number" not in names])
        checks = rest()
        if checks == "true":
            return f"coalesce({test}, false)"
        if self.merge:
            return Merged([f"coalesce({test}, false)", checks])
        return f"CASE WHEN {test} THEN {checks} ELSE false END"

    def sub(self, place: Place, schema: Any, v: str) -> str:
        return self.compile(place.sub(schema, self.resources), v)

    def _any_kind(self, place: Place, v: str) -> list[str]:
        schema, parts = place.schema, []
        for key in ("$ref", "$dynamicRef"):
            if key in schema:
                parts.append(self.compile(self.resources.follow(place, key == "$dynamicRef"), v))
        if "enum" in schema:
            parts.append(one_of_values(v, schema["enum"]))
        if "const" in schema:
            parts.append(equals(v, schema["const"]))
        parts += [self.sub(place, s, v) for s in schema.get("allOf", [])]
        if "anyOf" in schema:
            parts.append(either([self.sub(place, s, v) for s in schema["anyOf"]]))
        if "oneOf" in schema:
            parts.append("(" + " + ".join(f"int({self.sub(place, s, v)})" for s in schema["oneOf"]) + " = 1)" if schema["oneOf"] else "false")
        if "not" in schema:
            parts.append(negate(self.sub(place, schema["not"], v)))
        if "if" in schema and ("then" in schema or "else" in schema):
            branch = lambda k: self.sub(place, schema.get(k, True), v)
            parts.append(f"CASE WHEN {self.sub(place, schema['if'], v)} THEN {branch('then')} ELSE {branch('else')} END")
        return parts

    def _by_kind(self, place: Place, v: str, names: list[str] | None) -> list[str]:
        """Checks that hold for one kind of value only; others pass. names: what the type test has left."""
        schema, parts = place.schema, []
        known = names[0] if names and len(names) == 1 else None
        may = lambda *kinds: names is None or bool(set(names) & set(kinds))
        if may("number", "integer") and any(k in schema for k in NUMERIC):
            own = [k for k in NUMERIC if k in schema]
            checks = both([self.numeric(k, as_double(v), schema[k]) for k in own])
            parts.append(checks if known in ("number", "integer") else f"CASE WHEN {is_type(v, 'number')} THEN {checks} ELSE true END")
        if may("string") and any(k in schema for k in TEXTUAL):
            texts = [k for k in TEXTUAL if k in schema]
            checks = both([self.textual(k, as_text(v), schema[k]) for k in texts])
            if checks != "true":
                parts.append(checks if known == "string" else f"CASE WHEN {is_type(v, 'string')} THEN {checks} ELSE true END")
        if may("array") and any(k in schema for k in ARRAYS):
            parts.append(let(as_array(v), lambda a: f"CASE WHEN {a} IS NULL THEN true ELSE {both(self.arrays(place, v, a))} END"))
        if may("object") and any(k in schema for k in OBJECTS) and by_path(schema):
            parts.append(self.paths(place, v if isinstance(v, Part) else Part(v), known == "object"))
        elif may("object") and any(k in schema for k in OBJECTS):
            parts.append(let(as_map(v), lambda m: f"CASE WHEN {m} IS NULL THEN true ELSE {both(self.objects(place, v, m))} END"))
        return parts

    def numeric(self, keyword: str, d: str, limit: float) -> str:
        if keyword in _SIGNS:
            return f"({d} {_SIGNS[keyword]} {number(limit)})"
        if not math.isfinite(limit) or limit <= 0:
            raise SchemaError(f"multipleOf {limit}")
        rest = f"abs({d}) % {number(limit)}"
        return f"({rest} <= 1e-8D OR abs({rest} - {number(limit)}) <= 1e-8D)"

    def textual(self, keyword: str, s: str, value: Any) -> str:
        match keyword:
            case "minLength":
                return f"(char_length({s}) >= {int(value)})"
            case "maxLength":
                return f"(char_length({s}) <= {int(value)})"
            case "pattern":
                return f"({s} RLIKE {quote(to_java(value))})"
        if value in self.custom:
            return f"coalesce(({self.custom[value].format(s)}), false)"
        return f"({s} RLIKE {quote(formats.java(value))})" if value in formats.FORMATS else "true"

    def arrays(self, place: Place, v: str, a: str) -> list[str]:
        schema, parts = place.schema, []
        if "minItems" in schema:
            parts.append(f"(size({a}) >= {int(schema['minItems'])})")
        if "maxItems" in schema:
            parts.append(f"(size({a}) <= {int(schema['maxItems'])})")
        if schema.get("uniqueItems"):
            x = fresh()
            parts.append(f"(size(array_distinct(transform({a}, {x} -> {canonical(x)}))) = size({a}))")
        prefix = schema.get("prefixItems", [])
        for i, s in enumerate(prefix):
            check = let(f"get({a}, {i})", lambda x, s=s: self.sub(place, s, x))
            parts.append(f"(size({a}) <= {i} OR {check})")
        if isinstance(schema.get("items"), (dict, bool)):
            x = fresh()
            check = self.sub(place, schema["items"], x)
            if check == "false":
                parts.append(f"(size({a}) <= {len(prefix)})")
            elif check != "true":
                rows = f"slice({a}, {len(prefix) + 1}, size({a}))" if prefix else a
                parts.append(f"forall({rows}, {x} -> {check})")
        if "contains" in schema:
            x = fresh()
            check = self.sub(place, schema["contains"], x)
            least, most = schema.get("minContains", 1), schema.get("maxContains")
            if least == 1 and most is None:
                parts.append(f"exists({a}, {x} -> {check})")
            else:
                bound = lambda n: both(([f"{n} >= {int(least)}"] if least else []) + ([f"{n} <= {int(most)}"] if most is not None else []))
                parts.append(let(f"size(filter({a}, {x} -> {check}))", bound))
        if "unevaluatedItems" in schema:
            from veridoc.plans.evaluated import evaluated_items

            i = fresh("i")
            check = let(f"get({a}, {i})", lambda x: self.sub(place, schema["unevaluatedItems"], x))
            if schema["unevaluatedItems"] is not True:
                done = evaluated_items(self, place, v, a, beside=True)
                left = f"array_except(CASE WHEN size({a}) = 0 THEN CAST(array() AS ARRAY<INT>) ELSE sequence(0, size({a}) - 1) END, {done})"
                parts.append(f"(size({left}) = 0)" if schema["unevaluatedItems"] is False else f"forall({left}, {i} -> {check})")
        return parts

    def paths(self, place: Place, v: Part, known: bool) -> str:
        """The checks of an object whose keys are all named, by their paths; others have none of them."""
        schema, parts = place.schema, []
        there = lambda k: f"({v.at(k)} IS NOT NULL)"
        needed = both([there(k) for k in dict.fromkeys(schema.get("required", []))])
        for k, others in schema.get("dependentRequired", {}).items():
            if others:
                parts.append(either([negate(there(k)), both([there(n) for n in others])]))
        for k, s in schema.get("properties", {}).items():
            check = self.sub(place, s, v.at(k))
            if check != "true" and self.merge:
                parts.append(Merged.below(v.at(k), check))
            elif check != "true":
                parts.append(check if k in schema.get("required", []) else f"({v.at(k)} IS NULL OR {check})")
        for k, s in schema.get("dependentSchemas", {}).items():
            parts.append(either([negate(there(k)), self.sub(place, s, v)]))
        if self.merge:
            return Merged([needed if known else either([needed, negate(is_type(v, "object"))]), *parts])
        if known or needed == "true":
            return both([needed, *parts])
        return f"CASE WHEN {needed} THEN {both(parts)} ELSE {negate(is_type(v, 'object'))} END"

    def objects(self, place: Place, v: str, m: str) -> list[str]:
        schema, parts = place.schema, []
        parts += [has(m, k) for k in dict.fromkeys(schema.get("required", []))]
        if "minProperties" in schema:
            parts.append(f"(size({m}) >= {int(schema['minProperties'])})")
        if "maxProperties" in schema:
            parts.append(f"(size({m}) <= {int(schema['maxProperties'])})")
        for k, needed in schema.get("dependentRequired", {}).items():
            if needed:
                parts.append(either([negate(has(m, k)), both([has(m, n) for n in needed])]))
        for k, s in schema.get("properties", {}).items():
            check = let(member(v, m, k), lambda x, s=s: f"CASE WHEN {x} IS NULL THEN true ELSE {c} END" if (c := self.sub(place, s, x)) != "true" else "true")
            if not check.endswith("-> true), 0)"):
                parts.append(check)
        extra = schema.get("additionalProperties", True)
        e, loops = fresh("e"), []
        for p, s in schema.get("patternProperties", {}).items():
            check = let(f"{e}.value", lambda x, s=s: self.sub(place, s, x))
            loops.append(either([f"(NOT {e}.key RLIKE {quote(to_java(p))})", check]))
        if extra is False:
            declared = schema.get("properties", {})
            if not schema.get("patternProperties") and declared and set(declared) == set(schema.get("required", [])):
                parts.append(f"(size({m}) = {len(declared)})")
            else:
                loops.append(negate(undeclared(f"{e}.key", schema)))
        elif extra is not True:
            loops.append(either([negate(undeclared(f"{e}.key", schema)), let(f"{e}.value", lambda x: self.sub(place, extra, x))]))
        if "propertyNames" in schema:
            loops.append(let(f"CAST({e}.key AS VARIANT)", lambda x: self.sub(place, schema["propertyNames"], x)))
        if both(loops) != "true":
            parts.append(f"forall(map_entries({m}), {e} -> {both(loops)})")
        for k, s in schema.get("dependentSchemas", {}).items():
            parts.append(either([negate(has(m, k)), self.sub(place, s, v)]))
        if "unevaluatedProperties" in schema and schema["unevaluatedProperties"] is not True:
            from veridoc.plans.evaluated import evaluated_keys

            left = f"array_except(map_keys({m}), {evaluated_keys(self, place, v, m, beside=True)})"
            k = fresh("k")
            check = let(f"element_at({m}, {k})", lambda x: self.sub(place, schema["unevaluatedProperties"], x))
            parts.append(f"(size({left}) = 0)" if schema["unevaluatedProperties"] is False else f"forall({left}, {k} -> {check})")
        return parts
