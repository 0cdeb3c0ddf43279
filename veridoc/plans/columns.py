"""Schemas over typed columns of any depth: SQL on structs, arrays and scalars as they are, without documents.

Which keys exist and what kind of value each holds is known from the type, so most of a schema is decided while it is
compiled; what is left are comparisons in generated code, and lambdas over real arrays only. Since types are finite,
schemas that lead back to themselves compile too. A SQL null is a missing key, or JSON's null if ``nulls``; in an array
it is JSON's null. Values of other types (maps, variants), and keywords that depend on what other keywords have
evaluated, go through a variant of that value alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import types as T

from veridoc.functions.regex import to_python
from veridoc.functions.text import both, either, fresh, let, negate, number, quote
from veridoc.plans.boolean import NUMERIC, TEXTUAL, BooleanCompiler
from veridoc.schema.interpret import Interpreter
from veridoc.schema.resolve import Place, RecursiveSchema, Resources

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
_SPELLED = (T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


class Untyped(Exception):
    """This value has to be judged as a variant."""


def field(x: str, name: str) -> str:
    return f"{x}.`{name.replace('`', '``')}`"


class ColumnCompiler:
    """Compiles the verdict of a schema on a typed value."""

    def __init__(self, resources: Resources, custom: dict[str, str] | None = None, nulls: bool = False):
        self.resources, self.custom, self.nulls = resources, custom or {}, nulls
        self.variants = BooleanCompiler(resources, custom)

    def compile(self, place: Place, x: str, kind: T.DataType) -> str:
        """SQL that is true if the value named x (not null) of that type fits."""
        if isinstance(place.schema, bool):
            return str(place.schema).lower()
        try:
            if "unevaluatedItems" in place.schema and isinstance(kind, T.ArrayType):
                raise Untyped
            return both([*self._any_kind(place, x, kind), *self._own_kind(place, x, kind)])
        except Untyped:
            if isinstance(kind, T.VariantType):
                return let(x, lambda v: self.variants.compile(place, v))
            if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
                return let(f"to_variant_object({x})" if self.nulls else f"parse_json(to_json({x}))", lambda v: self.variants.compile(place, v))
            raise

    def null_fits(self, place: Place) -> bool:
        """The verdict on JSON's null."""
        return not Interpreter(self.resources, place, {}).errors(None)

    def _inside(self, place: Place, schema: Any) -> Place:
        """A subschema of a part of the value: its references start anew, as types are finite."""
        return replace(place.sub(schema, self.resources), open_refs=())

    def _any_kind(self, place: Place, x: str, kind: T.DataType) -> list[str]:
        schema, parts = place.schema, []
        sub = lambda s: self.compile(place.sub(s, self.resources), x, kind)
        for key in ("$ref", "$dynamicRef"):
            if key in schema:
                parts.append(self.compile(self.resources.follow(place, key == "$dynamicRef"), x, kind))
        parts += [self._among(x, kind, [schema["const"]] if key == "const" else schema["enum"]) for key in ("enum", "const") if key in schema]
        parts += [sub(s) for s in schema.get("allOf", [])]
        if "anyOf" in schema:
            parts.append(either([sub(s) for s in schema["anyOf"]]))
        if "oneOf" in schema:
            parts.append("(" + " + ".join(f"int({sub(s)})" for s in schema["oneOf"]) + " = 1)" if schema["oneOf"] else "false")
        if "not" in schema:
            parts.append(negate(sub(schema["not"])))
        if "if" in schema and ("then" in schema or "else" in schema):
            test, then, other = sub(schema["if"]), sub(schema.get("then", True)), sub(schema.get("else", True))
            parts.append(then if test == "true" else other if test == "false" else f"CASE WHEN {test} THEN {then} ELSE {other} END")
        return parts

    def _own_kind(self, place: Place, x: str, kind: T.DataType) -> list[str]:
        names = place.schema.get("type")
        names = None if names is None else {names} if isinstance(names, str) else set(names)
        if isinstance(kind, (*_INTEGRAL, T.DecimalType)):
            return self._numbers(place, x, names, isinstance(kind, _INTEGRAL))
        if isinstance(kind, _FLOATING):
            # Infinite values and NaN are texts in a document, and of no type in a variant.
            whole = both(self._numbers(place, self._exact(x, kind), names, False))
            text = str(names is None).lower() if self.nulls else both(self._texts(place, f"CAST({x} AS STRING)", names))
            if whole == text:
                return [whole]
            return [f"CASE WHEN isnan({x}) OR abs({x}) = double('infinity') THEN {text} ELSE {whole} END"]
        if isinstance(kind, T.BooleanType):
            return ["false"] if names is not None and "boolean" not in names else []
        if isinstance(kind, T.StringType):
            return self._texts(place, x, names)
        if isinstance(kind, _SPELLED):
            if any(k in place.schema for k in TEXTUAL):
                raise Untyped
            return ["false"] if names is not None and "string" not in names else []
        if isinstance(kind, T.ArrayType):
            return ["false"] if names is not None and "array" not in names else self._arrays(place, x, kind)
        if isinstance(kind, T.StructType):
            return ["false"] if names is not None and "object" not in names else self._objects(place, x, kind)
        raise Untyped

    def _exact(self, x: str, kind: T.DataType) -> str:
        """A float or double as a double: of a float in a document, the number that it is spelled as."""
        return f"CAST(CAST({x} AS STRING) AS DOUBLE)" if isinstance(kind, T.FloatType) and not self.nulls else f"CAST({x} AS DOUBLE)"

    def _numbers(self, place: Place, x: str, names: set | None, integral: bool) -> list[str]:
        parts = []
        if names is not None and "number" not in names:
            if "integer" not in names:
                return ["false"]
            if not integral:
                parts.append(f"({x} % 1 = 0)")
        as_double = x if x.startswith("CAST(") else f"CAST({x} AS DOUBLE)"
        return parts + [self.variants.numeric(k, as_double, place.schema[k]) for k in NUMERIC if k in place.schema]

    def _texts(self, place: Place, x: str, names: set | None) -> list[str]:
        if names is not None and "string" not in names:
            return ["false"]
        return [self.variants.textual(k, x, place.schema[k]) for k in TEXTUAL if k in place.schema]

    def _among(self, x: str, kind: T.DataType, values: list) -> str:
        """Whether the value is one of the fixed ones; only those of its kind can be."""
        own = [v for v in values if v is not None]
        if isinstance(kind, T.BooleanType):
            return either([x if v else f"(NOT {x})" for v in dict.fromkeys(v for v in own if isinstance(v, bool))])
        numbers = [number(v) for v in own if isinstance(v, (int, float)) and not isinstance(v, bool)]
        texts = [quote(v) for v in own if isinstance(v, str)]
        within = lambda y, among: f"({y} IN ({', '.join(among)}))" if among else "false"
        if isinstance(kind, (*_INTEGRAL, T.DecimalType)):
            return within(f"CAST({x} AS DOUBLE)", numbers)
        if isinstance(kind, _FLOATING):
            return either([f"coalesce({within(self._exact(x, kind), numbers)}, false)", within(f"CAST({x} AS STRING)", [t for t in texts if not self.nulls and t in ("'NaN'", "'Infinity'", "'-Infinity'")])])
        if isinstance(kind, T.StringType):
            return within(x, texts)
        raise Untyped

    def _element(self, place: Place, x: str, kind: T.DataType) -> str:
        """The verdict on an array's element, which is JSON's null where it is SQL's."""
        check, null = self.compile(place, x, kind), str(self.null_fits(place)).lower()
        return check if check == null else f"CASE WHEN {x} IS NULL THEN {null} ELSE {check} END"

    def _arrays(self, place: Place, x: str, kind: T.ArrayType) -> list[str]:
        schema, parts, of = place.schema, [], kind.elementType
        if "minItems" in schema:
            parts.append(f"(size({x}) >= {int(schema['minItems'])})")
        if "maxItems" in schema:
            parts.append(f"(size({x}) <= {int(schema['maxItems'])})")
        if schema.get("uniqueItems"):
            if not isinstance(of, (*_INTEGRAL, *_FLOATING, T.DecimalType, T.StringType, T.BooleanType)):
                raise Untyped
            e = fresh()
            values = f"transform({x}, {e} -> {e} + 0.0D)" if isinstance(of, _FLOATING) else x  # zero has one sign
            parts.append(f"(size(array_distinct({values})) = size({x}))")
        prefix = schema.get("prefixItems", [])
        for i, s in enumerate(prefix):
            check = self._element(self._inside(place, s), f"get({x}, {i})", of)
            if check != "true":
                parts.append(f"(size({x}) <= {i} OR {check})")
        if isinstance(schema.get("items"), (dict, bool)):
            e = fresh()
            check = self._element(self._inside(place, schema["items"]), e, of)
            if check == "false":
                parts.append(f"(size({x}) <= {len(prefix)})")
            elif check != "true":
                parts.append(f"forall({f'slice({x}, {len(prefix) + 1}, size({x}))' if prefix else x}, {e} -> {check})")
        if "contains" in schema:
            e = fresh()
            check = self._element(self._inside(place, schema["contains"]), e, of)
            least, most = schema.get("minContains", 1), schema.get("maxContains")
            if least == 1 and most is None:
                parts.append(f"exists({x}, {e} -> {check})")
            else:
                n = f"size(filter({x}, {e} -> {check}))"
                parts += [f"({n} >= {int(least)})"] * bool(least) + [f"({n} <= {int(most)})"] * (most is not None)
        return parts

    def _objects(self, place: Place, x: str, kind: T.StructType) -> list[str]:
        schema, parts = place.schema, []
        kinds = {f.name: f.dataType for f in kind.fields}
        if len(kinds) != len(kind.fields):
            raise Untyped  # names that occur twice
        has = {k: "true" if self.nulls else f"({field(x, k)} IS NOT NULL)" for k in kinds}
        parts += [has.get(k, "false") for k in dict.fromkeys(schema.get("required", []))]
        n = " + ".join(f"int({h})" for h in has.values()) or "0"
        if "minProperties" in schema:
            parts.append(f"({n} >= {int(schema['minProperties'])})")
        if "maxProperties" in schema:
            parts.append(f"({n} <= {int(schema['maxProperties'])})")
        absent = lambda k: negate(has.get(k, "false"))
        for k, needed in schema.get("dependentRequired", {}).items():
            parts.append(either([absent(k), both([has.get(m, "false") for m in needed])]))
        for k, s in schema.get("dependentSchemas", {}).items():
            parts.append(either([absent(k), self.compile(place.sub(s, self.resources), x, kind)]))
        declared, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        for k, of in kinds.items():
            subs = [declared[k]] if k in declared else []
            subs += [s for p, s in patterns.items() if to_python(p).search(k)]
            if not subs and "additionalProperties" in schema:
                subs.append(schema["additionalProperties"])
            if "propertyNames" in schema:
                if self.custom:
                    raise Untyped
                if Interpreter(self.resources, place.sub(schema["propertyNames"], self.resources), {}).errors(k):
                    subs.append(False)
            places = [self._inside(place, s) for s in subs]
            check = both([self.compile(p, field(x, k), of) for p in places])
            null = str(all(self.null_fits(p) for p in places)).lower() if self.nulls else "true"
            if check == null:
                parts.append(check)
            elif null == "true":
                parts.append(f"({field(x, k)} IS NULL OR {check})")
            else:
                parts.append(f"({field(x, k)} IS NOT NULL AND {check})")
        if "unevaluatedProperties" in schema:
            beside = replace(place, schema={k: s for k, s in schema.items() if k != "unevaluatedProperties"})
            left = self._inside(place, schema["unevaluatedProperties"])
            for k, of in kinds.items():
                fits = self.compile(left, field(x, k), of)
                if self.nulls:
                    fits = f"CASE WHEN {field(x, k)} IS NULL THEN {str(self.null_fits(left)).lower()} ELSE {fits} END"
                parts.append(either([absent(k), self._evaluated(beside, x, kind, k), fits]))
        return parts

    def _evaluated(self, place: Place, x: str, kind: T.StructType, key: str) -> str:
        """SQL that is true if a schema that the object fits has evaluated the key."""
        schema = place.schema
        if not isinstance(schema, dict):
            return "false"
        if key in schema.get("properties", {}) or "additionalProperties" in schema or "unevaluatedProperties" in schema or any(to_python(p).search(key) for p in schema.get("patternProperties", {})):
            return "true"
        sub = lambda s: place.sub(s, self.resources)
        go = lambda s: self._evaluated(sub(s), x, kind, key)
        fits = lambda s: self.compile(sub(s), x, kind)
        parts = [self._evaluated(self.resources.follow(place, r == "$dynamicRef"), x, kind, key) for r in ("$ref", "$dynamicRef") if r in schema]
        parts += [go(s) for s in schema.get("allOf", [])]
        parts += [both([seen, fits(s)]) for name in ("anyOf", "oneOf") for s in schema.get(name, []) if (seen := go(s)) != "false"]
        names = [f.name for f in kind.fields]
        parts += [both([seen, "true" if self.nulls else f"({field(x, k)} IS NOT NULL)"]) for k, s in schema.get("dependentSchemas", {}).items() if k in names and (seen := go(s)) != "false"]
        if "if" in schema:
            test, first, then, other = fits(schema["if"]), go(schema["if"]), go(schema.get("then", True)), go(schema.get("else", True))
            parts += [both([test, either([first, then])]), both([negate(test), other])]
        return either(parts)


def typed_sql(resources: Resources, root: Place, custom: dict[str, str], kind: T.DataType, nulls: bool) -> Callable[[str], str] | None:
    """From a name of a value of that type to SQL of its verdict; None where the type has no such SQL."""
    compiler = ColumnCompiler(resources, custom, nulls)

    def sql(x: str) -> str:
        resources.followed = 0
        return compiler.compile(root, x, kind)

    try:
        sql("x")
    except (Untyped, RecursiveSchema):
        return None
    return sql


__all__ = ["ColumnCompiler", "typed_sql"]
